"""Embeddings, retrieval and vector points."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from docframe.functions.scalars import page_header, point_id, row_text, to_payload
from docframe.operators.jobs import dense_index
from docframe.operators.vector_index import SHARE, VectorIndex
from docframe.session import shared_path, ship, stage

EMBED_BATCH, TOP_K = 100, 10
#: Rows and components of a block of vectors at most.
BLOCK_ROWS, BLOCK_VALUES = 1024, 1 << 16
#: Blocks of queries that go out at a time: 16 MB.
ROUND_BLOCKS = 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector), cut into blocks of one dimension, each by ascending id; vectors of length 0 are left out."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).append_column("dims", pc.list_value_length(batch.column("vector")))
        t = t.take(pc.sort_indices(t, sort_keys=[("dims", "ascending"), ("id", "ascending")], null_placement="at_start")).combine_chunks()
        dims = t["dims"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(dims)) + 1, len(dims))
        at = 0
        while at < len(dims):
            size = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, int(dims[at]))))
            end = min(at + size, int(ends[np.searchsorted(ends, at, "right")]))
            part = t.slice(at, end - at).combine_chunks()
            data = _matrix(part["vector"], int(dims[at]))
            norms = np.sqrt((data * data).sum(axis=1))
            kept = ~(norms <= 0)
            if kept.any():
                ids = part["id"].filter(pa.array(kept)).combine_chunks()
                ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
                yield pa.RecordBatch.from_arrays([pa.array([dims[at]], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([norms[kept].tobytes()], pa.binary()), pa.array([data[kept].tobytes()], pa.binary())], names=["dims", "ids", "norms", "data"])
            at = end


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]).astype(np.float64).reshape(-1, dims)


class _Block:
    """A block as arrays."""

    def __init__(self, ids: pa.Array, dims: int, norms: bytes, data: bytes):
        self.ids, self.norms, self.data = ids, np.frombuffer(norms), np.frombuffer(data).reshape(-1, dims)


def _pairs(q: _Block, c: _Block, k: int) -> pa.Table:
    """The k best candidates for each query of a pair of blocks, by rounded cosine; no cosine (null) where the dimensions differ."""
    same = c.data.shape[1] == q.data.shape[1]
    if same:
        with np.errstate(all="ignore"):
            cosines = (q.data @ c.data.T) / np.outer(q.norms, c.norms)
            cosines = np.copysign(np.floor(np.abs(cosines) * 1e6 + 0.5) / 1e6, cosines) + 0.0
        key = np.where(np.isnan(cosines), np.inf, cosines)
    else:
        key = np.full((len(q.ids), len(c.ids)), -np.inf)
    least = np.partition(key, len(c.ids) - k, axis=1)[:, len(c.ids) - k] if len(c.ids) > k else np.full(len(q.ids), -np.inf)
    row, at = np.nonzero(key >= least[:, None])
    found = pa.table({"row": row, "key": key[row, at], "id": c.ids.take(pa.array(at)), "similarity": pa.array(cosines[row, at]) if same else pa.nulls(len(row), pa.float64())})
    return _top(found, k)


def _top(found: pa.Table, k: int) -> pa.Table:
    """The k best of every row, by key and id."""
    found = found.take(pc.sort_indices(found, sort_keys=[("row", "ascending"), ("key", "descending"), ("id", "ascending")], null_placement="at_start"))
    row = found["row"].to_numpy()
    return found.filter(pa.array(np.arange(len(row)) - np.searchsorted(row, row) < k))


def _meet(sent, k: int):
    """Every task: the k best of its candidates for each query of the round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                block = _Block(batch.column("ids")[n].values, *(batch.column(c)[n].as_py() for c in ("dims", "norms", "data")))
                for at, queries in enumerate(sent.value):
                    found = _pairs(queries, block, k)
                    best[at] = _top(pa.concat_tables([best[at], found]), k) if at in best else found
        for at, t in best.items():
            yield from pa.table({"query_id": sent.value[at].ids.take(t["row"].combine_chunks()), "chunk_id": t["id"], "similarity": t["similarity"]}).combine_chunks().to_batches()

    return run


def _packed(df: DataFrame, name: str) -> DataFrame:
    """Blocks of rows, staged."""
    whole = F.coalesce(F.forall("embedding", lambda x: x.isNotNull()), F.lit(False))
    rows = df.filter(whole).select(F.col(name).alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return stage(rows.mapInArrow(_blocks, f"dims int, ids array<{rows.schema['id'].dataType.simpleString()}>, norms binary, data binary"))


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """TK1: query_id, rank, chunk_id, similarity: the k nearest chunks of each query by cosine.

    chunks: chunk_id, embedding; queries: query_id, embedding, of any number.  Chunks stay in place,
    packed; queries go to them in rounds of ``round_blocks`` blocks of at most BLOCK_VALUES numbers, one
    round after another, and a task keeps its k best of every query before the shuffle.
    """
    spark = chunks.sparkSession
    ship(spark)
    c, q = _packed(chunks, "chunk_id"), _packed(queries, "query_id")
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, similarity double"
    rounds, results = max(1, -(-q.count() // round_blocks)), []
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    for r in range(rounds):
        blocks = [_Block(pa.array(x["ids"], kind), x["dims"], x["norms"], x["data"]) for x in q.filter(F.pmod(F.xxhash64("data", "ids"), F.lit(rounds)) == r).collect()]
        if blocks:
            hits = c.mapInArrow(_meet(spark.sparkContext.broadcast(blocks), k), kinds)
            found = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            results.append(found if rounds == 1 else stage(found, "retrieved"))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], f"{kinds}, rank int")


def retrieve_approx(chunks: DataFrame, queries: DataFrame | list[float], k: int = TOP_K, share: float = SHARE) -> DataFrame:
    """TK2 without a kept index: one is built in the shared folder and asked at once, see VectorIndex.

    Where queries is one vector, its chunk_id and similarity only.
    """
    spark = chunks.sparkSession
    if not isinstance(queries, DataFrame):
        one = spark.createDataFrame([(0, [float(x) for x in queries])], "query_id int, embedding array<double>")
        return retrieve_approx(chunks, one, k, share).select("chunk_id", "similarity")
    return VectorIndex.create(chunks, shared_path(spark, "vector-index")).search(queries, k, share)


def retrieval_context(ranked: DataFrame) -> DataFrame:
    """TK3: query_id, context: the chunks (rank, page_number, chunk_text) under page headers, in rank order."""
    block = F.concat(page_header(F.coalesce("page_number", F.lit(0))), F.lit("\n"), "chunk_text")
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda s: s["b"]), "\n\n").alias("context"))


def hash_embed(texts: DataFrame, column: str = "text", dimension: int = 256) -> DataFrame:
    """UD4, default: hashed words weighted by inverse document frequency, of unit length."""
    words = texts.withColumn("_words", F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"\W+"), lambda w: w != ""))
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimension).transform(words)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf).transform(tf)
    return Normalizer(inputCol="_idf", outputCol="_v").transform(idf).withColumn("embedding", vector_to_array("_v", "float32")).drop("_words", "_tf", "_idf", "_v")


def embed_with(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], column: str = "text", batch: int = EMBED_BATCH) -> DataFrame:
    """UD4, a user's embedder, called with at most ``batch`` texts."""

    @pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out = []
            for at in range(0, len(s), batch):
                out += embed(s.iloc[at : at + batch].fillna("").tolist())
            yield pd.Series(out, dtype=object)

    return texts.withColumn("embedding", run(column))


def points(df: DataFrame, table: str, collection: str, declared: list[str], order: list[str], embedding: str | None = None) -> DataFrame:
    """SNK3's rows, SC19-SC21: collection, point_id, row_index, text, payload and, where given, the vector.

    Rows are numbered by order; its first column groups them (a chunk), see dense_index.
    """
    cols = {c: F.col(c) for c in declared}
    indexed = dense_index(df, order[0], order)
    keep = [F.col(embedding).alias("vector")] if embedding else []
    return indexed.select(F.lit(collection).alias("collection"), point_id(table, F.col("row_index"), cols).alias("point_id"), "row_index", row_text(table, cols).alias("text"), to_payload(cols).alias("payload"), *keep)


def missing_vectors(texts: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """ST5: texts that have no vector."""
    return texts.join(vectors.select(key).distinct(), key, "left_anti")

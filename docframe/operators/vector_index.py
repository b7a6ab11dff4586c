"""TK2: a kept index for approximate retrieval: inverted lists of coded residuals.

A folder holds ``cells`` (centroids, from a k-means fit on a bounded sample; their number grows with the
table), and ``lists``: one row per part of a list, at most PART vectors of one cell, with their ids, their
residuals in 4-bit codes and, in a column of its own, the vectors themselves.  Parts are ranged by cell, a
long list fills many, and rows that are added later are more parts.

A search goes in rounds of queries of bounded size.  Tasks score the coded parts of the cells that are
nearest to a query and keep its best; only the vectors of these few are read and scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docframe.session import ship, stage

#: Vectors that the cells are fitted on, at most about, and of a cell at least about where the sample allows.
SAMPLE, SAMPLE_PER_CELL = 131_072, 16
PART, ROUND_BYTES = 1024, 16_000_000
#: Defaults of a search: the share of cells that a query meets, and exact scores a wanted chunk.
SHARE, REFINE = 0.6, 5
#: Cells up to which a scan is told which ones it needs.
LISTED = 64
_LEVELS, _REACH = 16, 2.5


def _unit(df: DataFrame, name: str) -> DataFrame:
    """id, vector (of length one) of rows with a whole vector; vectors of length 0 are left out."""
    whole = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), F.lit(False))
    rows = df.filter(whole).select(F.col(name).alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
    return rows.filter("norm > 0").select("id", F.transform("vector", lambda x: x / F.col("norm")).alias("vector"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _nearest_cell(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                x = _matrix(part.column("vector"), centroids.shape[1])
                yield part.add_column(0, "cell", pa.array((x @ centroids.T).argmax(1).astype(np.int32)))

    return run


def encode(residuals: np.ndarray) -> tuple[bytes, float]:
    """4 bits a component, two a byte, of values within REACH deviations; and the deviation."""
    scale = float(residuals.std()) or 1.0
    code = np.clip(np.floor((residuals / scale + _REACH) / (2 * _REACH) * _LEVELS), 0, _LEVELS - 1).astype(np.uint8).ravel()
    code = np.append(code, np.uint8(0)) if len(code) % 2 else code
    return (code[::2] << 4 | code[1::2]).tobytes(), scale


def decode(codes: bytes, scale: float, shape: tuple[int, int]) -> np.ndarray:
    packed = np.frombuffer(codes, np.uint8)
    flat = np.stack([packed >> 4, packed & 15], 1).ravel()[: shape[0] * shape[1]]
    return ((flat.reshape(shape) + 0.5) / _LEVELS * 2 - 1) * (_REACH * scale)


def _pack(centroids: np.ndarray, generation: int):
    """Rows (cell, id, vector) by cell: parts with a number that no other task or generation gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, nth, held = (generation << 48) + (TaskContext.get().partitionId() << 24), 0, None

        def part(rows: pa.Table) -> pa.RecordBatch:
            cell = rows["cell"][0].as_py()
            x = _matrix(pa.concat_arrays(rows["vector"].chunks), centroids.shape[1])
            codes, scale = encode(x - centroids[cell])
            ids = pa.concat_arrays(rows["id"].chunks)
            return pa.RecordBatch.from_arrays(
                [pa.array([cell], pa.int32()), pa.array([base + nth]), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([codes], pa.binary()), pa.array([scale]), pa.array([x.astype("<f4").tobytes()], pa.binary())],
                names=["cell", "part", "ids", "codes", "scale", "data"],
            )

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cells = held["cell"].to_numpy()
            ends, at, n = np.append(np.flatnonzero(np.diff(cells)) + 1, len(cells)), 0, len(cells)
            while at < n:
                stop = int(ends[np.searchsorted(ends, at, "right")])
                if stop == n and n - at <= PART:
                    break  # the cell may go on in the next batch
                end = min(at + PART, stop)
                yield part(held.slice(at, end - at))
                at, nth = end, nth + 1
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield part(held)

    return run


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder that driver and executors share; open it again by its path."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(chunks: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """Fit cells on a sample of about ``sample`` of chunks (chunk_id, embedding) and write all of them; all vectors have one length.

        There are about sqrt(n) cells, unless given or unless the sample has too few vectors for that many.
        """
        spark = chunks.sparkSession
        rows = stage(_unit(chunks, "chunk_id"), "index-vectors")
        n, low, high = rows.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if low != high:
            raise ValueError(f"an index holds vectors of one length, not of {low} to {high}")
        wanted = max(1, min(cells or round(n**0.5), max(1, min(n, sample) // SAMPLE_PER_CELL)))
        some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(sample / n * (1 << 20)) + 1))
        if n:
            some = stage(some.select(array_to_vector("vector").alias("features")), "index-sample")
            fit = KMeans(k=wanted, initMode="random", maxIter=8, seed=seed).fit(some) if wanted > 1 else None
            found = np.stack(fit.clusterCenters()) if fit else some.select("features").limit(1).first()[0].toArray()[None]
            centroids = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        else:
            centroids = np.zeros((0, 0))
        cell_rows = [(k, [float(x) for x in c]) for k, c in enumerate(centroids)]
        spark.createDataFrame(cell_rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
        index = VectorIndex(spark, path)
        index._write(rows, centroids, 0)
        return index

    def add(self, chunks: DataFrame) -> None:
        """More chunks, as parts of their own; the cells stay.  An id that is there already is then there twice."""
        rows, centroids = _unit(chunks, "chunk_id"), self.centroids()
        if not rows.filter(F.size("vector") != centroids.shape[1]).isEmpty():
            raise ValueError(f"an index of vectors of length {centroids.shape[1]} takes no others")
        last = self.lists().agg(F.max(F.shiftright("part", 48))).first()[0]
        self._write(rows, centroids, 0 if last is None else last + 1)

    def _write(self, rows: DataFrame, centroids: np.ndarray, generation: int) -> None:
        ship(self.spark)
        kind = rows.schema["id"].dataType.simpleString()
        placed = rows.mapInArrow(_nearest_cell(centroids), f"cell int, id {kind}, vector array<double>") if len(centroids) else rows.selectExpr("0 AS cell", "id", "vector")
        # the hash cuts a cell that is longer than a range
        ranged = placed.repartitionByRange("cell", F.xxhash64("id", "vector")).sortWithinPartitions("cell")
        packed = ranged.mapInArrow(_pack(centroids, generation), f"cell int, part long, ids array<{kind}>, codes binary, scale double, data binary")
        packed.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/lists")

    def centroids(self) -> np.ndarray:
        """The centroids: as many as the sample allows at most."""
        rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        return np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int = 10, share: float = SHARE, refine: int = REFINE, round_bytes: int = ROUND_BYTES) -> DataFrame:
        """query_id, rank, chunk_id, similarity: about the k nearest chunks of each of queries (query_id, embedding), by exact cosines.

        A query meets the codes of the ``share`` of cells that are nearest to it and the vectors of the
        ``refine * k`` best of these.  The share that a recall takes depends on how far vectors cluster.
        Queries without a whole vector, of length 0 or of another number of dimensions find nothing.
        """
        centroids = self.centroids()
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {self.lists().schema['ids'].dataType.elementType.simpleString()}, similarity double"
        dims = centroids.shape[1]
        asked = stage(_unit(queries, "query_id").filter(F.size("vector") == dims), "index-queries")
        n = asked.count() if len(centroids) else 0
        rounds = -(-n * (8 * dims + 40 * refine * k) // round_bytes)
        cells = self.spark.sparkContext.broadcast(centroids)
        results = []
        for r in range(rounds):
            rows = asked.filter(F.pmod(F.xxhash64("vector"), F.lit(rounds)) == r).collect()  # about round_bytes
            if rows:
                found = self._round([x.id for x in rows], np.array([x.vector for x in rows]), cells, k, share, refine, kinds, to_arrow_type(queries.schema["query_id"].dataType))
                results.append(found if rounds == 1 else stage(found, "index-round"))
        if not results:
            return self.spark.createDataFrame([], f"{kinds}, rank int").select("query_id", "rank", "chunk_id", "similarity")
        return reduce(DataFrame.unionByName, results)

    def _round(self, ids: list, matrix: np.ndarray, cells, k: int, share: float, refine: int, kinds: str, kind: pa.DataType) -> DataFrame:
        near = matrix @ cells.value.T
        met = max(1, round(share * near.shape[1]))
        cut = np.partition(near, near.shape[1] - met, axis=1)[:, near.shape[1] - met]
        lists = self.lists()
        wanted = np.flatnonzero((near >= cut[:, None]).any(0)).tolist()
        lists = lists.filter(F.col("cell").isin(wanted)) if len(wanted) <= LISTED else lists
        sent = self.spark.sparkContext.broadcast((matrix, cut))
        coded = lists.select("cell", "part", F.size("ids").alias("n"), "codes", "scale").mapInArrow(_score_codes(sent, cells, refine * k), "query int, part long, place int, score float")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "part", "place")
        first = coded.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= refine * k).select("query", "part", "place")
        chosen: dict[int, list] = {}
        for query, part, place in first.collect():  # refine * k a query of the round
            chosen.setdefault(part, []).append((query, place))
        kept = {part: np.array(rows, np.int64) for part, rows in chosen.items()}
        context = self.spark.sparkContext
        exact = lists.select("part", "ids", "data").mapInArrow(_score_vectors(sent, context.broadcast(kept), context.broadcast(pa.array(ids, kind))), kinds)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
        return exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "similarity")


def _score_codes(sent, cells, wanted: int):
    """Every task: the best coded vectors of its parts for each query that meets their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, cut = sent.value
        centroids = cells.value
        score = np.full((len(matrix), wanted), -np.inf, np.float32)
        part, place = np.full((len(matrix), wanted), -1, np.int64), np.full((len(matrix), wanted), -1, np.int32)
        for batch in batches:
            for row in batch.to_pylist():
                near = matrix @ centroids[row["cell"]]
                rows = np.flatnonzero(near >= cut)
                if not len(rows):
                    continue
                x = decode(row["codes"], row["scale"], (row["n"], matrix.shape[1]))
                new = (near[rows, None] + matrix[rows] @ x.T).astype(np.float32)
                better = np.flatnonzero((new > score[rows, :].min(1)[:, None]).any(1))
                if len(better):
                    rows, new = rows[better], new[better]
                    n = new.shape[1]
                    s = np.concatenate([score[rows], new], 1)
                    p = np.concatenate([part[rows], np.full((len(rows), n), row["part"])], 1)
                    i = np.concatenate([place[rows], np.tile(np.arange(n, dtype=np.int32), (len(rows), 1))], 1)
                    top = np.argpartition(-s, wanted - 1, axis=1)[:, :wanted]
                    score[rows], part[rows], place[rows] = (np.take_along_axis(v, top, 1) for v in (s, p, i))
        q, at = np.nonzero(part >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(part[q, at]), pa.array(place[q, at]), pa.array(score[q, at])], names=["query", "part", "place", "score"])

    return run


def _score_vectors(sent, chosen, names):
    """The cosines of the chosen vectors, kept as floats, rounded to six digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, ids = sent.value[0], names.value
        for batch in batches:
            for n, part in enumerate(batch.column("part").to_pylist()):
                rows = chosen.value.get(part)
                if rows is None:
                    continue
                data = np.frombuffer(batch.column("data")[n].as_buffer(), "<f4").astype(np.float64).reshape(-1, matrix.shape[1])
                query, place = rows.T
                cosine = np.einsum("ij,ij->i", matrix[query], data[place]) / np.linalg.norm(data[place], axis=1)
                cosine = np.copysign(np.floor(np.abs(cosine) * 1e6 + 0.5) / 1e6, cosine) + 0.0
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), batch.column("ids")[n].values.take(pa.array(place)), pa.array(cosine)], names=["query_id", "chunk_id", "similarity"])

    return run

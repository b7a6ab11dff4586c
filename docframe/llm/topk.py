"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions of the vectors are cut into ``lists`` slices: a candidate has one local score a slice,
and its score is their sum.  Candidates stay in place, packed in blocks; queries go to them in rounds
of at most ROUND, a broadcast whose size is bounded by that number.

1. gather: every task takes the k best candidates of each of its local score lists, for every query,
   and their whole scores; the k-th best of all these is a safe cutoff;
2. broadcast: queries go out again with their cutoffs.  A candidate whose whole score reaches the
   cutoff has a local score of cutoff / lists at least in one list: those entries are collected;
3. resolve: the other local scores of these entries alone are computed and added, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.common import stage
from docframe.session import ship

SCALE = 256.0
#: Candidates of a block, queries that meet a block at a time, and queries of a round.
CANDIDATES, QUERIES, ROUND = 4096, 256, 1 << 15
_BLOCK = "ids binary, dims long, data binary"
_HITS_SQL = "query_id long, vec_id long, score long"


def quantised(vectors: list) -> np.ndarray:
    """floor(256 x) of each component; shorter vectors are filled up with zeros.

    Numbers of 2^62 and over are kept as Python integers, so nothing is clipped.
    """
    dims = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), dims), np.float64)
    for row, v in zip(out, vectors):
        row[: len(v)] = np.floor(np.asarray(v, np.float64) * SCALE)
    return out.astype(np.int64) if not len(vectors) or np.abs(out).max(initial=0) < 2.0**62 else np.array([[int(x) for x in row] for row in out], object)


def _to_bytes(q: np.ndarray) -> bytes:
    return q.astype("<i8").tobytes() if q.dtype != object else b"big" + repr(q.tolist()).encode()


def _to_matrix(n: int, dims: int, data: bytes) -> np.ndarray:
    if data[:3] == b"big" and len(data) != 8 * n * dims:
        return np.array([[int(x) for x in row.split(",")] for row in data[5:-2].decode().split("], [")], object)
    return np.frombuffer(data, "<i8").reshape(n, dims)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(at, CANDIDATES)
            q = quantised(part.column(1).to_pylist())
            yield pa.RecordBatch.from_pylist([{"ids": part.column(0).to_numpy().astype("<i8").tobytes(), "dims": q.shape[1], "data": _to_bytes(q)}])


@dataclass
class Queries:
    """A round of queries, in order of their ids; cuts is None before there are cutoffs."""

    ids: np.ndarray
    matrix: np.ndarray
    cuts: list[int | None] | None = None


def slices(dims: int, lists: int) -> list[slice]:
    return [slice(dims * k // lists, dims * (k + 1) // lists) for k in range(lists)]


def _alike(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the same dimensions and a type in which every sum of products is exact."""
    dims = max(queries.shape[1], candidates.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (queries, candidates))
    most = max(1, dims) * int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0))
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    return q.astype(kind), c.astype(kind)


def gather(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, k: int, lists: int) -> np.ndarray:
    """Query and candidate of the k best entries of each local score list (own entries are none)."""
    q, c = _alike(queries, candidates)
    free, found = np.where(own, -np.inf, 0.0), []
    for s in slices(q.shape[1], lists):
        local = (q[:, s] @ c[:, s].T).astype(np.float64) + free
        top = np.argpartition(-local, k - 1, axis=1)[:, :k] if local.shape[1] > k else np.tile(np.arange(local.shape[1]), (len(local), 1))
        found.append((np.arange(len(local))[:, None] * len(c) + top).ravel())
    at = np.unique(np.concatenate(found))
    pairs = np.stack([at // max(1, len(c)), at % max(1, len(c))])
    return pairs[:, ~own[pairs[0], pairs[1]]]


def collect(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, cuts: list[int | None], lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and list of the entries that reach cutoff / lists: in the first list that they reach it."""
    q, c = _alike(queries, candidates)
    cut = np.array([-np.inf if x is None else x for x in cuts], object if q.dtype == object else np.float64)[:, None]
    # whole cutoffs of 2^53 and over lose their last bits as floating point numbers: leave room for that
    cut = cut - np.abs(cut) * 2.0**-50 if q.dtype != object and len(cut) and np.abs(cut[np.isfinite(cut)]).max(initial=0) >= 2.0**53 else cut
    open_, found = ~own, []
    for k, s in enumerate(slices(q.shape[1], lists)):
        reach = open_ & ((q[:, s] @ c[:, s].T) * lists >= cut).astype(bool)
        open_ &= ~reach
        a, b = np.nonzero(reach)
        found.append((a, b, np.full(len(a), k)))
    return tuple(np.concatenate(x) for x in zip(*found))


def resolve(queries: np.ndarray, candidates: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The whole scores of these entries, summed over all lists."""
    q, c = _alike(queries, candidates)
    if q.dtype == object:
        return np.array([int(sum(x * y for x, y in zip(q[i], c[j]))) for i, j in zip(a, b)], object)
    out = np.zeros(len(a), q.dtype)
    for at in range(0, len(a), 1 << 14):
        out[at : at + (1 << 14)] = np.einsum("ij,ij->i", q[a[at : at + (1 << 14)]], c[b[at : at + (1 << 14)]])
    return out.astype(np.int64)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of every query, ties to the smaller id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    new = np.flatnonzero(np.diff(query, prepend=-1))
    nth = np.arange(len(query)) - np.repeat(new, np.diff(new, append=len(query)))
    return query[nth < k], ids[nth < k], scores[nth < k]


def _meet(sent, k: int, lists: int):
    """Every task: the k best entries of its candidates for each query of the round, by gather or by collect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = sent.value
        best: dict[int, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                c = _to_matrix(len(ids), row["dims"], row["data"])
                for at in range(0, len(asked.ids), QUERIES):
                    q = asked.matrix[at : at + QUERIES]
                    own = asked.ids[at : at + QUERIES, None] == ids[None, :]
                    a, b = gather(q, c, own, k, lists) if asked.cuts is None else collect(q, c, own, asked.cuts[at : at + QUERIES], lists)[:2]
                    if len(a):
                        now = (a, ids[b], resolve(q, c, a, b))
                        old = best.get(at)
                        if old is not None:
                            now = tuple(np.concatenate(x) for x in zip(old, now))
                        best[at] = _best(*now, k)
        for at, (query, ids, scores) in best.items():
            if scores.dtype == object and any(not -(2**63) <= s < 2**63 for s in scores):
                raise OverflowError("a score is no 64-bit integer")
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[at + query]), pa.array(ids), pa.array(scores.tolist(), pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", round_size: int = ROUND) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of vectors for each of queries, ties to the smaller id.

    A component x counts as floor(256 x); the score is the integer inner product, an error if one of a
    result is no 64-bit integer.  Rows whose id is null, or whose vector is null or holds null or
    non-finite components, take no part; shorter vectors are padded with zeros.  A query never finds
    rows of its own id; of rows that repeat a query's id, the least vector asks.  Repeated candidate
    rows count each.  Empty tables give no rows; other columns are ignored.

    Rounds of ``round_size`` queries run one after another, each over all candidates in place.
    """

    def valid(df: DataFrame) -> DataFrame:
        v = df[vector_col]
        fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
        return df.select(df[id_col].cast("long").alias("v_id"), v.cast("array<double>").alias("vector")).filter(fine & F.col("v_id").isNotNull())

    spark = vectors.sparkSession
    ship(spark)
    asked = stage(valid(queries).groupBy("v_id").agg(F.min("vector").alias("vector")), "topk-queries")
    rounds = max(1, -(-asked.count() // (round_size // 2 or 1)))
    candidates = stage(valid(vectors).mapInArrow(_pack, _BLOCK), "topk-candidates")
    results = []
    for r in range(rounds):
        rows = asked.filter(F.pmod(F.xxhash64("v_id"), F.lit(rounds)) == r).orderBy("v_id").collect()  # about round_size / 2 queries
        ids, matrix = np.array([x.v_id for x in rows], np.int64), quantised([x.vector for x in rows])
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(Queries(ids, matrix))
        cutoffs = _ranked(candidates.mapInArrow(_meet(sent, k, lists), _HITS_SQL)).filter(F.col("rank") == k).select("query_id", "score")
        cut = dict(map(tuple, cutoffs.collect()))  # one number a query of the round
        sent = spark.sparkContext.broadcast(Queries(ids, matrix, [cut.get(i) for i in ids.tolist()]))
        found = _ranked(candidates.mapInArrow(_meet(sent, k, lists), _HITS_SQL)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        results.append(found if rounds == 1 else stage(found, "topk-round"))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, results)

"""Hard negatives from candidate blocks along a Hilbert curve, chosen by interval arithmetic on zone maps.

1. Candidates are ordered by label and by their place on a Hilbert curve through the coarse values of all
   dimensions, cut into blocks and written as Parquet: one row a block, with its packed ids and vectors
   and, in columns of their own, the least and the greatest value of every dimension (its zone map).
2. Every block gives the anchors in it the best scores of their own label within the block: the least of
   them bounds what their positives score.  Anchors then go out in rounds of bounded size.  A task holds
   an anchor against the zone maps of its blocks: the products of an anchor's component and a zone's two
   ends bound the score of every vector there, and only blocks that can still hold a positive are read.
3. The positives of a round fix its windows.  The same bounds choose the blocks of other labels that meet
   a window and can still hold one of its best; the best of all tasks are the hard negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.common import new_path, stage
from docframe.session import ship

SCALE = 256.0
#: Vectors of a block, and bytes of an anchor round's vectors (which bound what is broadcast).
BLOCK, ROUND_BYTES = 256, 32_000_000
#: Bits of a coarse value on the curve.
BITS = 2
_HITS = "anchor_id long, nth int, vec_id long, score long"
_BLOCK_SQL = "label long, dims long, ids binary, data binary, low binary, high binary, first_id long"


# --- the curve --------------------------------------------------------------------------------------


def hilbert_keys(coarse: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of small integers (below 2 ** bits) on a Hilbert curve through all its dimensions, as bytes that sort alike.

    The rotations of the curve are undone from the highest bit down, then the axes' bits are read as one
    Gray code; a row at a time is one column of every array step.
    """
    x = coarse.astype(np.int64).T.copy()
    dims, n = x.shape
    if not dims:
        return [b""] * n
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for d in range(dims):
            set_ = (x[d] & bit) > 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn, bit = np.zeros(n, np.int64), top
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # bit, dimension, row
    return [row.tobytes() for row in np.packbits(planes.transpose(2, 0, 1).reshape(n, -1).astype(np.uint8), axis=1)]


def quantised(vectors: list) -> np.ndarray:
    """floor(256 x) of every component; vectors of one length."""
    return np.floor(np.asarray(vectors, np.float64).reshape(len(vectors), -1) * SCALE)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: as floating point numbers where no sum can pass 2^53, else as Python integers."""
    most = max(1, a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    out = whole(a) @ whole(b).T
    if any(not -(2**63) <= s < 2**63 for s in out.ravel()):
        raise OverflowError("a score is no 64-bit integer")
    return out.astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each anchor can have with a vector of each zone.

    A product lies between those with the zone's two ends; the sign of the anchor's component tells
    which end gives which.  Sums of 2^53 and over are rounded, so they get some room on both sides.
    """
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    room = np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T
    room = np.where(room < 2.0**53, 0, room * 2.0**-45)
    return least - room, most + room


# --- blocks -----------------------------------------------------------------------------------------


def _place(centre: float, spread: float):
    """Columns vec_id, label, vector: with the length of each vector and its place on the curve of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            keys, by_dims = [b""] * len(vectors), {}
            for k, v in enumerate(vectors):
                by_dims.setdefault(len(v), []).append(k)
            for rows in by_dims.values():
                at = (quantised([vectors[k] for k in rows]) - centre) / spread
                coarse = np.clip(np.floor((at + 2) / 4 * (1 << BITS)), 0, (1 << BITS) - 1)
                for k, key in zip(rows, hilbert_keys(coarse, BITS)):
                    keys[k] = key
            yield batch.append_column("dims", pa.array([len(v) for v in vectors], pa.int64())).append_column("place", pa.array(keys, pa.binary()))

    return run


def _block(label: int, dims: int, ids: list[int], vectors: list) -> dict:
    q = quantised(vectors)
    return {"label": label, "dims": dims, "ids": np.array(ids, "<i8").tobytes(), "data": q.astype("<f8").tobytes(), "low": q.min(0).astype("<f8").tobytes(), "high": q.max(0).astype("<f8").tobytes(), "first_id": min(ids)}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK neighbours of one label and length."""
    name, ids, vectors = None, [], []
    for batch in batches:
        out = []
        for label, dims, vec_id, vector in zip(*(batch.column(c).to_pylist() for c in ("label", "dims", "vec_id", "vector"))):
            if name != (label, dims) or len(ids) == BLOCK:
                if ids:
                    out.append(_block(*name, ids, vectors))
                name, ids, vectors = (label, dims), [], []
            ids.append(vec_id)
            vectors.append(vector)
        if out:
            yield pa.RecordBatch.from_pylist(out)
    if ids:
        yield pa.RecordBatch.from_pylist([_block(*name, ids, vectors)])


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """vec_id, label, vector of the rows that take part."""
    v = vectors[vector_col]
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < float("inf"))), F.lit(False))
    out = vectors.select(vectors[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"), v.cast("array<double>").alias("vector"))
    return out.filter(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull())


def write_blocks(rows: DataFrame, path: str) -> None:
    """rows (see valid_vectors) as Parquet blocks along the curve; equal places are spread by id, so a common vector fills many blocks."""
    plain, squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, first, second = rows.agg(F.sum(F.size("vector")), F.sum(plain), F.sum(squares)).first()
    centre = SCALE * first / n if n else 0.0
    spread = float(np.sqrt(max(0.0, SCALE**2 * second / n - centre**2))) if n else 0.0
    spread = spread if 0 < spread < np.inf else 1.0
    placed = rows.mapInArrow(_place(centre if np.isfinite(centre) else 0.0, spread), "vec_id long, label long, vector array<double>, dims long, place binary")
    ordered = placed.repartitionByRange("label", "dims", "place", "vec_id").sortWithinPartitions("label", "dims", "place", "vec_id")
    ordered.mapInArrow(_pack, _BLOCK_SQL).write.option("compression", "zstd").parquet(path)


# --- search -----------------------------------------------------------------------------------------

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Block:
    label: int
    ids: np.ndarray
    data: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first_id: int

    @staticmethod
    def of(row: dict) -> Block:
        n, dims = len(row["ids"]) // 8, row["dims"]
        floats = lambda c, *shape: np.frombuffer(row[c], "<f8").reshape(shape) if row[c] else np.zeros(shape)
        return Block(row["label"], np.frombuffer(row["ids"], "<i8"), floats("data", n, dims), floats("low", dims), floats("high", dims), row["first_id"])


@dataclass
class Windows:
    """Searches of a round: each asks for the best ``k`` entries with a score from ``least`` to ``most``.

    ``at`` is a search's row of the anchors' arrays; ``same``: candidates of the anchor's label, else
    those of all others.
    """

    anchor_ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    at: np.ndarray
    nth: np.ndarray
    least: np.ndarray
    most: np.ndarray
    k: int
    same: bool


class Best:
    """The k best entries of every search so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), _LEAST), np.full((n, k), _MOST)

    def add(self, search: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Entries: a search, a score and an id each."""
        again = np.unique(search)
        old = self.scores[again] != _LEAST
        search = np.concatenate([search, np.repeat(again, old.sum(1))])
        scores, ids = np.concatenate([scores, self.scores[again][old]]), np.concatenate([ids, self.ids[again][old]])
        order = np.lexsort((ids, ~scores, search))  # ~s falls as s grows, and never overflows
        search, scores, ids = search[order], scores[order], ids[order]
        new = np.flatnonzero(np.diff(search, prepend=-1))
        nth = np.arange(len(search)) - np.repeat(new, np.diff(new, append=len(search)))
        top = nth < self.k
        self.scores[search[top], nth[top]], self.ids[search[top], nth[top]] = scores[top], ids[top]

    def can_enter(self, most: np.ndarray, first_id: int) -> np.ndarray:
        """Searches that an entry of at most this score and at least this id could still change."""
        last = self.scores[:, -1].astype(np.float64)
        return (self.scores[:, -1] == _LEAST) | (most > last) | ((most >= last - np.abs(last) * 2.0**-50) & (first_id < self.ids[:, -1]))


def search_block(block: Block, asked: Windows, best: Best) -> int:
    """The block's entries into best; the number of searches that had to read it.

    A shorter vector counts as filled up with zeros.
    """
    may = (asked.labels[asked.at] == block.label) == asked.same
    if not may.any():
        return 0
    dims = min(asked.matrix.shape[1], len(block.low))
    least, most = (b[asked.at, 0] for b in bounds(asked.matrix[:, :dims], block.low[None, :dims], block.high[None, :dims]))
    rows = np.flatnonzero(may & (most >= asked.least) & (least <= asked.most) & best.can_enter(most, block.first_id))
    if len(rows):
        anchors, back = np.unique(asked.at[rows], return_inverse=True)
        scores = exact_products(asked.matrix[anchors, :dims], block.data[:, :dims])[back]
        fits = (scores >= np.maximum(asked.least[rows], best.scores[rows, -1])[:, None]) & (scores <= asked.most[rows, None]) & (asked.anchor_ids[asked.at[rows], None] != block.ids)
        a, b = np.nonzero(fits)
        if len(a):
            best.add(rows[a], scores[a, b], block.ids[b])
    return len(rows)


def _search(sent):
    """Every task: the best entries of its blocks for each search of the round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Windows = sent.value
        best = Best(len(asked.at), asked.k)
        for batch in batches:
            for row in batch.to_pylist():
                search_block(Block.of(row), asked, best)
        a, b = np.nonzero(best.scores != _LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(asked.anchor_ids[asked.at[a]]), pa.array(asked.nth[a].astype(np.int32)), pa.array(best.ids[a, b]), pa.array(best.scores[a, b])], names=["anchor_id", "nth", "vec_id", "score"])

    return run


def _home(k: int, every: int):
    """The anchors of every block and the k-th best score that they have within it, null if there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                at = np.flatnonzero(block.ids % every == 0)
                if len(at):
                    others = np.sort(np.where(block.ids[at, None] == block.ids, _LEAST, exact_products(block.data[at], block.data)), 1)
                    cut = others[:, -k] if others.shape[1] >= k else np.full(len(at), _LEAST)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.ids[at]), pa.array(np.full(len(at), block.label, np.int64)), pa.array([x.tobytes() for x in block.data[at]], pa.binary()), pa.array(cut, mask=cut == _LEAST)],
                        names=["anchor_id", "label", "data", "cut"],
                    )

    return run


def _best_of(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _windows(asked: list, wanted: list[tuple[int, int, int, int]], k: int, same: bool) -> Windows:
    """asked: rows of anchors; wanted: anchor, number, least and most score of each search."""
    matrix = np.zeros((len(asked), max((len(x.data) // 8 for x in asked), default=0)))
    for row, x in zip(matrix, asked):
        row[: len(x.data) // 8] = np.frombuffer(x.data, "<f8") if x.data else 0
    place = {x.anchor_id: i for i, x in enumerate(asked)}
    at, nth, least, most = np.array([(place[w[0]], *w[1:]) for w in wanted], np.int64).reshape(-1, 4).T
    return Windows(np.array([x.anchor_id for x in asked], np.int64), np.array([x.label for x in asked], np.int64), matrix, at, nth, least, most, k, same)


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A component x counts as floor(256 x), and a row's score is its integer inner product with the anchor
    (an error if one that is computed is no 64-bit integer); ties go to the smaller id.  Anchors are the
    rows whose id is divisible by ``every``; their positives are the best other rows of their label, at
    most ``positives``; the negatives of a positive are the best rows of other labels whose score is from
    ``low`` to ``high`` hundredths of the positive's.  Rows with a null id or label, or whose vector is
    null or holds null or non-finite components, take no part; shorter vectors count as filled up with
    zeros.  An anchor never finds rows of its own id; of rows that repeat an anchor's id one asks;
    repeated candidates count each.  Empty tables give no rows; other columns are ignored.

    Anchors go in rounds of about ``round_bytes``, one after another, each to all blocks.
    """
    spark = vectors.sparkSession
    ship(spark)
    path = new_path(spark, "candidate-blocks")
    write_blocks(valid_vectors(vectors, id_col, vector_col, vectors["label"] if label is None else label), path)
    return search_blocks(spark.read.schema(_BLOCK_SQL).parquet(path), every, positives, negatives, low, high, round_bytes)


def search_blocks(blocks: DataFrame, every: int, positives: int, negatives: int, low: int, high: int, round_bytes: int) -> DataFrame:
    """The hard negatives of the anchors among the vectors of blocks that write_blocks has written."""
    context, row = blocks.sparkSession.sparkContext, F.struct("data", "label", "cut")
    home = blocks.mapInArrow(_home(positives, every), "anchor_id long, label long, data binary, cut long")
    anchors = stage(home.groupBy("anchor_id").agg(F.min(row).alias("r")).select("anchor_id", "r.*"), "anchors")
    # beside its vector an anchor brings a few numbers for each of its searches
    size = anchors.agg(F.sum(F.length("data") + F.lit(100 * (positives + 1)))).first()[0] or 0
    rounds = max(1, -(-size // round_bytes))
    results = []
    for r in range(rounds):
        asked = anchors.filter(F.pmod(F.xxhash64("anchor_id"), F.lit(rounds)) == r).collect()  # about round_bytes
        if not asked:
            continue
        # the block at home bounds what a positive scores
        first = _windows(asked, [(x.anchor_id, 0, _LEAST + 1 if x.cut is None else x.cut, _MOST) for x in asked], positives, True)
        best = _best_of(blocks.mapInArrow(_search(context.broadcast(first)), _HITS), positives)
        found = stage(best.select("anchor_id", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        open_ = [x for x in found.collect() if low * x.positive_score <= high * x.positive_score]  # a few numbers an anchor of the round
        if open_:
            second = _windows(asked, [(x.anchor_id, x.nth, -(-low * x.positive_score // 100), high * x.positive_score // 100) for x in open_], negatives, False)
            best = _best_of(blocks.mapInArrow(_search(context.broadcast(second)), _HITS), negatives)
            joined = best.join(found, ["anchor_id", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            results.append(joined if rounds == 1 else stage(joined, "negatives"))
    if not results:
        return blocks.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, results)

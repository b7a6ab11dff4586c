"""Near-duplicate join: MinHash bands propose, full n-gram sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import stage
from docframe.llm.components import components
from docframe.llm.shingles import Words, mix, seeds
from docframe.session import ship

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Hash functions at most, and bytes hashed at a time.
HASHES, CHUNK_BYTES = 128, 1 << 18
#: Documents and words of a block at most (about); two blocks of a bucket meet in one task.
BLOCK_DOCS, BLOCK_WORDS = 256, 1 << 18
#: Tasks that the members of one bucket are spread over while they are counted and joined.
SALTS = 16
#: Columns of an incidence matrix that are multiplied at a time; groups up to FEW are compared set by set.
COLUMNS, FEW = 4096, 6


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) that still find a pair at the threshold with this chance."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def _digest(words: list[bytes]) -> bytes:
    """Of the words: texts of the same words have the same n-grams."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a batch's texts of about CHUNK_BYTES, with the row each begins at."""
    held, size, begin = [], 0, 0
    for k, text in enumerate(batch.column(column).cast(pa.binary())):
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield begin, held
            held, size, begin = [], 0, k + 1
    if held:
        yield begin, held


def signatures(words: Words, n: int, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each text (texts x bands)."""
    shingles, per = words.shingles(n)
    out = np.zeros((len(per), bands), np.uint64)
    full = np.flatnonzero(per)
    if len(full):
        begins = (np.cumsum(per) - per)[full]
        salt, odd = seeds(bands * rows, 5), seeds(bands * rows, 6) | np.uint64(1)
        for b in range(bands):
            h = np.full(len(full), b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                h = mix(h * np.uint64(31) + np.minimum.reduceat((shingles ^ salt[k]) * odd[k], begins))
            out[full, b] = h
    return out


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _chunks(batch, 1):
                words = Words(texts)
                flat = pa.array(signatures(words, n, bands, rows).view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array([_digest(t.split()) for t in texts], pa.binary()), pa.array(words.ends - words.begins), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), flat)],
                    names=["d_id", "digest", "n", "bands"],
                )

    return run


def ngram_sets(lists: list[list[bytes]], n: int) -> list[np.ndarray]:
    """The set of n-grams of each list of words, as numbers: equal n-grams have equal numbers, and only they.

    Words are numbered, then n-grams by pairing numbers, so nothing is hashed.  A list of fewer than n
    words has one n-gram of all of them, filled up with a number that is no word's.
    """
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64) for words in lists]
    coded = [np.concatenate([c, np.zeros(max(0, n - len(c)), np.int64)]) if len(c) else c for c in coded]
    counts = np.array([len(c) for c in coded], np.int64)
    every = np.concatenate(coded) if coded else np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(every))
    at = np.flatnonzero(left >= n)
    gram = every[at]
    for k in range(1, n):
        # pairs of numbers below 2^31 each, so a pair is one number below 2^62
        gram = np.unique(gram * (len(numbers) + 1) + every[at + k], return_inverse=True)[1]
    per = np.maximum(counts - n + 1, 0) * (counts > 0)
    return [np.unique(g) for g in np.split(gram, np.cumsum(per)[:-1])] if len(lists) else []


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from products of their incidence columns."""
    m = len(sets)
    out = np.zeros((m, m), np.float64)
    if m <= FEW:
        as_sets = [set(s.tolist()) for s in sets]
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(as_sets[i] & as_sets[j])
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((m, COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def _least_labels(linked: np.ndarray) -> np.ndarray:
    """The least index that each can reach."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        now = np.where(reach, label[None, :], len(linked)).min(axis=1)
        if (now == label).all():
            return label
        label = now


def first_shared(buckets: list[list[int]], here: int) -> np.ndarray:
    """Which pairs share this bucket as the least of the buckets that they share."""
    every = sorted({b for mine in buckets for b in mine if b < here})
    place = {b: k for k, b in enumerate(every)}
    member = np.zeros((len(buckets), len(every)), np.float32)
    for row, mine in zip(member, buckets):
        row[[place[b] for b in mine if b < here]] = 1
    return member @ member.T == 0


def verified(bucket: int, docs: list[tuple], n: int, threshold: float) -> list[tuple[int, int, int]]:
    """rep, links, root of the documents of two blocks of a bucket: (rep, copies, block, buckets, words) each.

    Pairs count in the least bucket that they share, and pairs of one block where that block meets
    itself, so every pair is judged once.
    """
    reps, copies, block, buckets, words = zip(*docs)
    wanted = first_shared(buckets, bucket)
    if len(set(block)) > 1:
        wanted &= np.array(block)[:, None] != np.array(block)[None, :]
    np.fill_diagonal(wanted, False)
    asked = np.flatnonzero(wanted.any(axis=1))
    if not len(asked):
        return []
    wanted, reps, copies = wanted[np.ix_(asked, asked)], [reps[k] for k in asked], [copies[k] for k in asked]
    sets = ngram_sets([words[k] for k in asked], n)
    sizes, common = np.array([len(s) for s in sets], np.float64), overlaps(sets)
    linked = wanted & (common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9)
    links = (linked * np.array(copies)[None, :]).sum(axis=1).astype(np.int64).tolist()
    return [(r, c, reps[k]) for r, c, k in zip(reps, links, _least_labels(linked).tolist()) if c]


def _verify(n: int, threshold: float):
    """Rows in order of bucket, x, y, rep -> rep, links, root; the documents of one x, y are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, out = None, {}, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["rep", "links", "root"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]] + [batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            for bucket, x, y, rep, digest, copies, block, buckets, text in zip(*columns):
                if (bucket, x, y) != now:
                    if len(docs) > 1:
                        out += verified(now[0], list(docs.values()), n, threshold)
                    now, docs = (bucket, x, y), {}
                words = (text or b"").split()
                if (rep, digest) not in docs and _digest(words) == digest:
                    docs[rep, digest] = (rep, copies, block, buckets, words)
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        if len(docs) > 1:
            out += verified(now[0], list(docs.values()), n, threshold)
        if out:
            yield batch_of(out)

    return run


def _buckets(members: DataFrame) -> DataFrame:
    """h, salt, blocks of the buckets that hold two texts or more; of buckets with the same members, one.

    members: h, rep, digest, n.  A bucket is counted and joined in SALTS parts, so a common band hash is no
    hot key.  Two hashes, the count and the words of all members name a set of them.
    """
    one = F.struct("rep", "digest")
    parts = members.groupBy("h", "salt").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64(one)).alias("a"), F.bit_xor(F.xxhash64(one, F.lit(1))).alias("b"))
    whole = parts.groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.collect_list("salt").alias("salts")).filter("c > 1")
    kept = whole.groupBy("c", "n", "a", "b").agg(F.min_by(F.struct("h", "salts"), "h").alias("one"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_DOCS), F.ceil(F.col("n") / BLOCK_WORDS)).alias("blocks")
    return kept.select(F.col("one.h").alias("h"), F.explode("one.salts").alias("salt"), blocks)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: id, class_id, n_links, copy_of.

    Two documents link if the Jaccard similarity of their sets of n-word shingles is at least the
    threshold.  n_links counts the documents that one links to, copies included; class_id is the
    least id of its connected component; copy_of the least id of the documents of its very words.

    Texts of the same words are first merged to one, by a 128-bit digest of these, so copies cost
    nothing.  Texts that share a band
    hash share a bucket.  Buckets are cut into blocks of bounded size, and every pair of blocks is
    verified on the full n-gram sets within a task, which returns counts and a spanning forest of the
    links; components are those of verified links only.  A text without words links to nothing.  Rows
    of one id with different words count as linked by that id; rows with a null id take part under
    the id null: they get class_id null and no links, unless a copy of theirs has an id.  An empty
    table gives no rows; other columns of docs, whatever their names, are ignored.  A text is held
    whole, as a list of its words, by the tasks that sign and compare it.
    """
    ship(docs.sparkSession)
    bands, rows = bands_for(threshold, recall)
    slim = docs.select(docs[id_col].cast("long").alias("d_id"), docs[text_col].alias("d_text"))
    signed = stage(slim.mapInArrow(_sign(n, bands, rows), "d_id long, digest binary, n long, bands array<long>"), "ngram-signs")
    classes = stage(signed.filter("n > 0").groupBy("digest").agg(F.min("d_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "ngram-classes")
    named = classes.filter("rep IS NOT NULL")
    members = named.select("rep", "digest", "n", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt"), F.explode("bands").alias("h"))
    held = members.join(_buckets(members), ["h", "salt"]).select("rep", "digest", F.struct("h", "blocks").alias("bucket"))
    placed = stage(held.groupBy("rep", "digest").agg(F.array_sort(F.collect_list("bucket")).alias("buckets")).join(named.select("rep", "digest", "copies"), ["rep", "digest"]), "ngram-placed")
    # the texts are shuffled at every size: a plan that turns to it as the table grows can't be foreseen
    texts = slim.join(placed.hint("shuffle_hash"), F.col("d_id") == F.col("rep")).withColumn("at", F.explode("buckets"))
    block = F.pmod(F.xxhash64("rep"), F.col("at.blocks"))
    met = texts.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("at.blocks") - 1)))
    met = met.select(F.col("at.h").alias("h"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rep", "digest", "copies", "block", F.col("buckets.h").alias("buckets"), "d_text")
    sorted_met = met.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "rep")
    checked = stage(sorted_met.mapInArrow(_verify(n, threshold), "rep long, links long, root long"), "ngram-links")
    roots = components(checked.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("u").alias("rep"), F.col("v").alias("root"))
    links = checked.groupBy("rep").agg(F.sum("links").alias("links")).join(roots, "rep", "left")
    found = classes.select("digest", "rep", "copies").join(links, "rep", "left")
    out = signed.select("d_id", "digest").join(found, "digest", "left")
    return out.select(
        F.col("d_id").alias(id_col),
        F.coalesce("root", "rep", "d_id").alias("class_id"),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("rep", "d_id").alias("copy_of"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is the least of its class (and rows without an id), with all columns.

    Ids name documents here; see near_duplicates.
    """
    gone = near_duplicates(docs, id_col, text_col, **how).filter(F.col("class_id") < F.col(id_col)).select(F.col(id_col).alias("gone_id")).distinct()
    cols = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    kept = docs.select(*cols, docs[id_col].cast("long").alias("d_id")).join(stage(gone, "ngram-gone"), F.col("d_id") == F.col("gone_id"), "left_anti")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])

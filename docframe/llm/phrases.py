"""Substring dedup: recurring passages are confirmed, compiled to sharded automata and located everywhere.

A window is k consecutive words.  Its anchor is the run of ``anchor`` words in it whose hash is least;
equal windows have equal anchors, and neighbouring windows mostly share one.  The windows around one
anchor, from the first word of the first to the last word of the last, are a piece.

1. Anchors are counted.  Documents are dealt into chunks; a chunk is told which of its anchors stand
   nowhere else, and gives the distinct pieces of its other anchors, as words.
2. The pieces of an anchor meet.  A window recurs if they hold its words twice or more.  So the maximal
   runs of recurring windows of every piece are confirmed on words, over all documents: these are the
   passages.  Hashes only choose what is compared.  Anchors that are very common are taken apart: each
   of their windows is counted by its own words, in a shuffle with partial sums.
3. Passages go to the chunks that asked about their piece.  A chunk compiles its shard of them into an
   Aho-Corasick automaton over words and streams all its documents through it; what lies under an
   occurrence goes.  Nothing but the automaton tells where passages stand.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import stage
from docframe.llm.shingles import Words
from docframe.session import ship

WINDOW, ANCHOR = 35, 12
#: Characters of a chunk and of the chunks of a task, about; a single longer text is a chunk's excess.
CHUNK_CHARS, TASK_CHARS = 1_000_000, 48_000_000
#: Bytes hashed at a time.
BATCH_BYTES = 1 << 18
#: How often an anchor stands at most for its pieces to meet in one task.  It grows with the corpus
#: where more than about HOT_ANCHORS would stand as often, so a list of those stays small.
COMMON, HOT_ANCHORS = 100_000, 1_000_000
_KEPT = bytes([1, 0]).ljust(256, b"\0")


def anchors_of_windows(words: Words, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, the hash of its anchor and the word that begins it.

    Of equal hashes the last is the anchor, as in every equal window.
    """
    at, starts = words.starts(anchor), words.starts(k)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    # sliding minima by doubling: spans of 1, 2, 4 ... anchors, then two spans that cover the window's
    best, arg, span, wanted = words.runs(anchor)[at], np.arange(len(at)), 1, k - anchor + 1
    while span < wanted:
        step = min(span, wanted - span)
        less = best[step:] <= best[:-step]
        best, arg = np.where(less, best[step:], best[:-step]), np.where(less, arg[step:], arg[:-step])
        span += step
    place = np.zeros(len(words.hashes), np.int64)
    place[at] = np.arange(len(at))
    first = place[starts]
    return starts, best[first], at[arg[first]]


def _batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _bytes(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _anchors(words: Words, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every anchor once: its hash, its text's number, and the first and last window that it stands in."""
    starts, hashes, at = anchors_of_windows(words, k, anchor)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(new[1:], len(at)) - 1 if len(new) else new
    return hashes[new].view(np.int64), np.searchsorted(words.ends, at[new], side="right"), starts[new], starts[last]


def _give_anchors(k: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, texts, done = np.array(batch.column(0), np.int64), _bytes(batch.column(1)), 0
            for some in _batches(texts):
                hashes, text, _, _ = _anchors(Words(some), k, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(chunks[done : done + len(some)][text])], names=["h", "chunk"])
                done += len(some)

    return run


def _give_pieces(k: int, anchor: int, common: Broadcast):
    """A chunk's distinct pieces, and how often it holds each, of the anchors that are neither alone nor common."""

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        skipped, found = np.sort(np.concatenate([side["h"].to_numpy(), common.value])), Counter()
        for some in _batches(_bytes(docs["d_text"])):
            words = Words(some)
            hashes, _, first, last = _anchors(words, k, anchor)
            shared = np.flatnonzero(~_among(hashes, skipped))
            for h, a, b in zip(hashes[shared].tolist(), first[shared].tolist(), last[shared].tolist()):
                found[h, words.words(a, b + k)] += 1
        chunk = np.full(len(found), docs["chunk"][0].as_py() if docs.num_rows else 0, np.int64)
        return pa.table({"chunk": chunk, "h": pa.array([h for h, _ in found], pa.int64()), "piece": pa.array([p for _, p in found], pa.binary()), "n": pa.array(found.values(), pa.int64())})

    return run


def _give_spans(k: int, anchor: int, common: Broadcast):
    """chunk, span, n: the windows of common anchors, as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, texts, done = batch.column(0).to_pylist(), _bytes(batch.column(1)), 0
            for some in _batches(texts):
                words, found = Words(some), Counter()
                hashes, text, first, last = _anchors(words, k, anchor)
                for at in np.flatnonzero(_among(hashes, common.value)).tolist():
                    for s in range(int(first[at]), int(last[at]) + 1):
                        found[chunks[done + int(text[at])], words.words(s, s + k)] += 1
                done += len(some)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary()), pa.array(found.values(), pa.int64())], names=["chunk", "span", "n"])

    return run


def _among(hashes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which hashes are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(hashes), bool)
    return ordered[np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)] == hashes


def recurring_runs(pieces: list[tuple[bytes, int]], k: int) -> list[list[int]]:
    """Of each distinct piece of one anchor, with how often it stands: begin and end of its passages, by word.

    A passage is a maximal run of words under windows that follow each other and recur.
    """
    windows, seen = [], Counter()
    for piece, n in pieces:
        words = piece.split(b" ")
        mine = [b" ".join(words[s : s + k]) for s in range(len(words) - k + 1)] if len(pieces) > 1 else [b""] * (len(words) - k + 1)
        windows.append(mine)
        for w in set(mine):
            seen[w] += n
    out = []
    for mine in windows:
        runs: list[int] = []
        for s, w in enumerate(mine):
            if seen[w] > 1:
                if s and seen[mine[s - 1]] > 1:
                    runs[-1] = s + k
                else:
                    runs += [s, s + k]
        out.append(runs)
    return out


def _confirm(k: int):
    """Rows h, piece, chunk, n in order of h -> chunk, piece, runs of those with passages; one anchor's rows are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close():
            if len(held) == 1 and held[0][2] == 1:
                return
            times = Counter()
            for piece, _, n in held:
                times[piece] += n
            runs = dict(zip(times, recurring_runs(list(times.items()), k)))
            out.extend((chunk, piece, runs[piece]) for piece, chunk, _ in held if runs[piece])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.list_(pa.int32())))], names=["chunk", "piece", "runs"])

        for batch in batches:
            for h, piece, chunk, n in zip(*(c.to_pylist() for c in batch.columns)):
                if h != now:
                    close()
                    now, held = h, []
                held.append((piece, chunk, n))
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        close()
        if out:
            yield batch_of(out)

    return run


def automaton(passages: list[list[bytes]]) -> tuple[ahocorasick.Automaton | None, dict[bytes, int]]:
    """An automaton over the numbers of words, and these numbers (0 is any other word)."""
    numbers: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for words in passages:
        machine.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in words]), len(words))
    if not passages:
        return None, numbers
    machine.make_automaton()
    return machine, numbers


def covered(words: list[bytes], machine: ahocorasick.Automaton | None, numbers: dict[bytes, int]) -> bytearray:
    """1 for each word under an occurrence of a passage, else 0."""
    mask = bytearray(len(words))
    if machine is not None and words:
        number = numbers.get
        for end, length in machine.iter(tuple([number(w, 0) for w in words])):
            mask[end + 1 - length : end + 1] = b"\1" * length
    return mask


def _remove(spans: bool):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        passages = []
        for piece, runs in zip(side["piece"].to_pylist(), side["runs"].to_pylist()):
            words = piece.split(b" ")
            passages += [words[a:b] for a, b in zip(runs[::2], runs[1::2])]
        machine, numbers = automaton(passages)
        rows = []
        for doc, text in zip(docs["d_id"].to_pylist(), _bytes(docs["d_text"])):
            words = text.split()
            mask = covered(words, machine, numbers)
            removed = mask.count(1)
            kept = b" ".join(compress(words, mask.translate(_KEPT)) if removed else words)
            edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + mask + b"\0", np.int8))).tolist() if removed and spans else []
            rows.append((doc, len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if spans else None, edges))
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["d_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, anchor: int = ANCHOR, chunk_chars: int = CHUNK_CHARS, common: int = COMMON, texts: bool = True) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, kept_text, removed_spans.

    A word goes if a window over it has words that also start a window anywhere else, the same text
    included; windows are judged on the input.  Words are runs of anything but white space, kept ones
    are joined by one space.  removed_spans lists begin and end (exclusive) of each removed run of
    words, by word number; texts=False leaves the last two columns null and empty.  A null or empty
    text has no words.  Rows that repeat an id are documents of their own; an empty table gives none;
    other columns of docs, whatever their names, are ignored.  A text is held whole by one task, as a
    list of its words.
    """
    spark = docs.sparkSession
    ship(spark)
    chars = docs.agg(F.sum(F.length(docs[text_col]))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))
    chunks = max(2 * parts, -(-chars // chunk_chars))
    slim = docs.select(F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(chunks)).alias("chunk"), docs[id_col].cast("long").alias("d_id"), docs[text_col].alias("d_text"))
    slim_texts = slim.select("chunk", "d_text")
    anchors = slim_texts.mapInArrow(_give_anchors(window, anchor), "h long, chunk long")
    most = max(common, chars // (2 * HOT_ANCHORS))
    told = stage(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("chunk")).filter((F.col("n") == 1) | (F.col("n") > most)), "phrase-anchors")
    hot = np.array(sorted(r.h for r in told.filter(F.col("n") > most).select("h").collect()), np.int64)  # HOT_ANCHORS at most, about
    sent = spark.sparkContext.broadcast(hot)
    dealt = slim.repartition(parts, "chunk").groupBy("chunk")
    alone = told.filter("n = 1").select("chunk", "h").groupBy("chunk")
    pieces = dealt.cogroup(alone).applyInArrow(_give_pieces(window, anchor, sent), "chunk long, h long, piece binary, n long")
    passages = pieces.select("h", "piece", "chunk", "n").repartition("h").sortWithinPartitions("h").mapInArrow(_confirm(window), "chunk long, piece binary, runs array<int>")
    if len(hot):
        spans = stage(slim_texts.mapInArrow(_give_spans(window, anchor, sent), "chunk long, span binary, n long").groupBy("chunk", "span").agg(F.sum("n").alias("n")), "phrase-spans")
        again = spans.groupBy("span").agg(F.sum("n").alias("n")).filter("n > 1").select("span")
        passages = passages.unionByName(spans.join(again, "span").select("chunk", F.col("span").alias("piece"), F.array(F.lit(0), F.lit(window)).alias("runs")))
    schema = "d_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed_spans array<long>"
    out = dealt.cogroup(passages.groupBy("chunk")).applyInArrow(_remove(texts), schema)
    return out.withColumnRenamed("d_id", id_col)

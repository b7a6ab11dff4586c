"""Quality rules by lines: what many different documents of a host share is no text of its own.

1. Every text is read once: counts for the plain rules, a digest of the text, and of each different line
   a digest of its normalised form (lower case, single spaces) with the words that it holds.
2. Equal texts of a host count as one document.  Documents are counted per host and line, with partial
   sums; a line above both limits is boilerplate there.
3. Texts lose their boilerplate lines.  A text that keeps too few words, or too small a part, is depleted.

Digests are 128 bits and hold the host, so one key names a line or a text of a host.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import join_spread, stage
from docframe.session import ship

SYMBOLS = b"#*$%&|<>"
SPAN = 5
#: The plain rules: words at least, and words in repeated spans in a hundred at most.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A line is boilerplate where more documents of a host hold it than MAX_DOCS and than MAX_SHARE of them.
MAX_DOCS, MAX_SHARE = 20, 0.001
#: A document is depleted below MIN_WORDS words or this part of its words.
MIN_LEFT = 0.5
#: Rows that are read at a time, so that a batch of long texts stays small.
ROWS = 64

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes], span: int = SPAN) -> int:
    """Words that stand in a span of ``span`` words found twice or more; spans may overlap."""
    spans = list(zip(*(words[k:] for k in range(span))))
    times = Counter(spans)
    if len(times) == len(spans):
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    again = np.array([k for k, s in enumerate(spans) if times[s] > 1])
    np.add.at(covered, again, 1)
    np.add.at(covered, again + span, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


def line_key(host: bytes, line: bytes) -> bytes:
    """Digest of a line's normalised form within its host; of no word, the empty line's."""
    return xxhash.xxh3_128_digest(host + b"\n" + b" ".join(line.decode().lower().encode().split()))


def read_text(host: bytes, text: bytes) -> tuple[list[int], dict[bytes, int]]:
    """The counts of _COUNTS (but for word_chars' multi-byte letters, which the caller takes off) and the words of each different line."""
    words, seen, lines, dups = text.split(), set(), {}, 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            dups += line in seen
            seen.add(line)
            key = line_key(host, line)
            lines[key] = lines.get(key, 0) + n
    letters = sum(map(len, words))
    return [len(words), letters, len(text) - len(text.translate(None, SYMBOLS)), dups, repeat_words(words)], lines


def _hosts(column: pa.Array) -> list[bytes]:
    return [b"-" if h is None else b"=" + h.encode() for h in column.to_pylist()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns host, text and others: the others, the host's key, the text's key, its counts and its lines."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            text = batch.column("d_text").fill_null("")
            more = pc.subtract(pc.binary_length(text), pc.utf8_length(text)).to_pylist()
            raw, hosts = text.cast(pa.binary()).to_pylist(), _hosts(batch.column("d_host"))
            found = [read_text(h, t) for h, t in zip(hosts, raw)]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, len(_COUNTS))
            counts[:, 1] -= np.array(more, np.int64)
            lines = pa.array([[{"line": k, "words": n} for k, n in f[1].items()] for f in found], pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64())])))
            keys = pa.array([xxhash.xxh3_128_digest(h + b"\n" + t) for h, t in zip(hosts, raw)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("d_id"), pa.array(hosts, pa.binary()), keys, *(pa.array(c) for c in counts.T), lines], names=["d_id", "host", "key", *_COUNTS, "lines"])


def _boilerplate(texts: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """key, line, words of the boilerplate lines of different texts."""
    lines = texts.select("host", "key", F.inline("lines"))
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("all_docs"))
    above = counted.filter(F.col("docs") > max_docs).join(hosts, "host").filter(F.col("docs") > F.col("all_docs") * F.lit(max_share)).select("line", F.lit(True).alias("above"))
    return join_spread(lines.select("key", "line", "words"), above, "line").filter("above").select("key", "line", "words")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int, max_share: float) -> tuple[DataFrame, DataFrame]:
    """The rows that were read, and key, line, words of the boilerplate of their texts."""
    ship(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("d_id"), docs[host_col].cast("string").alias("d_host"), docs[text_col].cast("string").alias("d_text"))
    kind = slim.schema["d_id"].dataType.simpleString()
    read = stage(slim.mapInArrow(_read, f"d_id {kind}, host binary, key binary, {', '.join(f'{c} long' for c in _COUNTS)}, lines array<struct<line: binary, words: bigint>>"), "line-rules")
    texts = read.select("host", "key", "lines").dropDuplicates(["key"])
    return read.drop("lines", "host"), stage(_boilerplate(texts, max_docs, max_share), "boilerplate")


def _judged(rows: DataFrame, lost: DataFrame, min_left: float) -> DataFrame:
    """rows with what their texts have lost, base_failed and kept."""
    n, left = F.col("n_words"), F.col("n_words") - F.col("n_removed")
    judged = join_spread(rows, lost, "key").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    judged = judged.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))
    return judged.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= n * F.lit(min_left)))


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed (words of boilerplate lines), kept.

    Null texts are empty and fail the plain rules, as do texts of fewer than ten words.  A null host is a
    host of its own.  Equal texts of one host are one document and share one fate, so copies alone never
    make a line common; rows that repeat an id are judged each.  A text is read whole, by one task.  An
    empty table gives no rows; other columns are ignored.
    """
    rows, found = _verdicts(docs, id_col, text_col, host_col, max_docs, max_share)
    lost = found.groupBy("key").agg(F.sum("words").alias("n_removed"))
    return _judged(rows, lost, min_left).select(F.col("d_id").alias(id_col), *_COUNTS, "base_failed", "n_removed", "kept")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose keys are listed."""
    for batch in batches:
        texts = []
        for text, host, gone in zip(batch.column("d_text").to_pylist(), _hosts(batch.column("d_host")), batch.column("gone").to_pylist()):
            drop = set(gone or ())
            texts.append("\n".join(x for x in text.split("\n") if line_key(host, x.encode()) not in drop) if drop else text)
        at = batch.schema.names.index("d_text")
        kept = batch.set_column(at, "d_text", pa.array(texts, pa.string()))
        yield kept.select([n for n in kept.schema.names if n != "gone"])


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of docs that pass, with all their columns, their texts without boilerplate lines; see line_rules."""
    cols = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    text, host = docs.columns.index(text_col), docs.columns.index(host_col)
    # the row itself is the id: what the rules say goes back with it
    whole = docs.select(F.struct(*cols).alias("row"), docs[text_col].alias("t"), docs[host_col].alias("h"))
    rows, found = _verdicts(whole, "row", "t", "h", max_docs, max_share)
    lost = found.groupBy("key").agg(F.sum("words").alias("n_removed"), F.collect_list("line").alias("gone"))
    flat = _judged(rows, lost, min_left).filter("kept").select(F.col(f"d_id.c{text}").cast("string").alias("d_text"), F.col(f"d_id.c{host}").cast("string").alias("d_host"), "d_id", "gone")
    clean = flat.mapInArrow(_without, f"d_text string, d_host string, d_id {flat.schema['d_id'].dataType.simpleString()}")
    return clean.select(*[(F.col("d_text") if k == text else F.col(f"d_id.c{k}")).alias(c) for k, c in enumerate(docs.columns)])

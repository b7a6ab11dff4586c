"""Token-id files: shards of Simple-8b blocks, in ascending order of the document ids.

A set of token files is a Parquet folder; each file is a run of one shard's blocks, so Spark's
committer writes it and any reader can split it.  A block holds whole documents of at least
``block_ids`` ids together (the last one of a shard fewer):

    shard, block   long    place of the block; shards and blocks ascend with the document ids
    first          long    ids of the shard before this block
    n_ids          long    ids in the block
    doc_ids        binary  8-byte signed ids of its documents, little-endian; with doc_null flags
    doc_null       binary  one byte a document, 1 if its id is null
    doc_lens       binary  8-byte ids per document, end id included
    words, raw     binary  packed and raw 64-bit words of Simple-8b, little-endian
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe.llm import simple8b
from docframe.llm.bpe import encoder, slices, vocabulary_path
from docframe.llm.common import stage
from docframe.session import ship

BLOCK_IDS = 1 << 16
BLOCKS = "shard long, block long, first long, n_ids long, doc_ids binary, doc_null binary, doc_lens binary, words binary, raw binary"


def _block(shard: int, block: int, first: int, docs: list, ids: list[bytes]) -> pa.RecordBatch:
    values = np.frombuffer(b"".join(ids), "<u4").astype(np.uint64)
    words, raw = simple8b.encode(values)
    known = np.array([d is None for d in docs], np.uint8)
    row = {
        "shard": shard, "block": block, "first": first, "n_ids": len(values),
        "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "doc_null": known.tobytes(),
        "doc_lens": np.array([len(i) // 4 for i in ids], "<i8").tobytes(),
        "words": words.astype("<u8").tobytes(), "raw": raw.astype("<u8").tobytes(),
    }
    return pa.RecordBatch.from_pylist([row])


def _writer(path: str | None, end_id: int, block_ids: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_path()).encode
        end = np.array([end_id], "<u4").tobytes()
        shard, block, first, held = TaskContext.get().partitionId(), 0, 0, 0
        docs, ids = [], []
        for batch in batches:
            for part in slices(batch, 1):
                for doc, found in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    docs.append(doc)
                    ids.append(found + end)
                    held += len(ids[-1]) // 4
                    if held >= block_ids:
                        yield _block(shard, block, first, docs, ids)
                        block, first, held, docs, ids = block + 1, first + held, 0, [], []
        if docs:
            yield _block(shard, block, first, docs, ids)

    return blocks


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every text (null: empty), each followed by end_id, in ascending order of id_col.

    Null ids come first; rows that repeat an id go to one task and come by a hash of their text, then
    by it.  An empty table gives files without rows; other columns of docs, whatever their names, are
    ignored.  A text is held whole, with the ids of its block, by the task that encodes it.
    vocabulary: a tokenizers file, else the public byte BPE.
    """
    ship(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("d_id"), docs[text_col].alias("d_text"))
    order = [F.col("d_id").asc_nulls_first(), F.xxhash64("d_text"), F.col("d_text")]
    ranged = slim.repartitionByRange(order[0]).sortWithinPartitions(*order)
    ranged.select("d_id", "d_text").mapInArrow(_writer(vocabulary, end_id, block_ids), BLOCKS).write.option("compression", "zstd").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lens = np.frombuffer(row["doc_lens"], "<i8")
            ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["raw"], "<u8")).astype("<u4").tobytes()
            ends = np.cumsum(lens)
            starts = row["start"] + row["first"] + ends - lens
            docs = np.frombuffer(row["doc_ids"], "<i8").tolist()
            null = np.frombuffer(row["doc_null"], np.uint8).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if z else d for d, z in zip(docs, null)], pa.int64()), pa.array(starts, pa.int64()), pa.array(lens, pa.int64()),
                    pa.array([ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist())], pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "token-shards")
    return blocks.join(starts, "shard").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")

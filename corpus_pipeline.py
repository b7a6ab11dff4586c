"""From raw documents to packed training windows: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.common import bound_batches, stage
from docframe.llm.exact_dedup import drop_exact_copies
from docframe.llm.mixing import mix
from docframe.llm.ngram_join import drop_near_duplicates
from docframe.llm.packing import pack
from docframe.llm.quality import drop_low_quality

#: Pieces of text that a worker remembers while it packs: half as many as by default, as its executor still holds the memory of the stages before.
PACK_PIECES = 600_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored like others, repeated rows alike; equal scores share one fate; a
    long text is scored whole; columns of any name are kept; an empty table gives no rows.
    """
    bound_batches(spark)
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the smallest id.

    Null counts as empty text; a null id stays only where all ids of a text are null; of rows that
    repeat id and text one stays; long texts are compared whole; columns of any name are kept; an
    empty table gives no rows.
    """
    return drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest id.

    Texts without words and rows without an id stay; rows that repeat an id stay or go together; long
    texts are compared whole; columns of any name are kept; an empty table gives no rows.
    """
    bound_batches(spark)
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own; null and empty texts count no words; rows that repeat id,
    source and size share one fate, equal keys go by id and size; columns of any name are kept; an
    empty table gives no rows.
    """
    return mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty; rows that repeat an id, or have none, are documents of their own; long
    texts span windows; other columns are ignored; an empty table gives no rows.
    """
    bound_batches(spark)
    return pack(docs, cache_pieces=PACK_PIECES).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

#: A trained network and a tokenizer have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

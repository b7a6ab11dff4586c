"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe import session
from docframe.session import shared_path

#: White space and words of the operators' contracts, for Java's and DuckDB's regex alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch that a Python task is sent, about.  Spark's own bound is 64 MB; a task holds two batches, and Spark buffers of twice the size beside them.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Tasks that the rows of one key are spread over where a key may be common.
SALTS = 16


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; see docframe.session.shared_path."""
    return shared_path(spark, name)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: it survives lost executors."""
    return session.stage(df, name)


def bound_batches(spark: SparkSession) -> None:
    """From now on Python tasks of this session get batches of about BATCH_BYTES, or of one longer row; a bound that the user has set stays."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right, which has one row a key or none.

    The rows of one key are spread over SALTS tasks by the partition that they come from, which a task
    that runs again finds alike.  The column ``salt`` is the function's own.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return left.withColumn("salt", F.spark_partition_id() % SALTS).join(right.withColumn("salt", salts), [key, "salt"], "left").drop("salt")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)

"""Exact duplicates, found by skew-safe combining of full texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.common import SPACE, stage


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _combined(docs: DataFrame, digest, salts: int) -> DataFrame:
    """One row for each digest and full text: the smallest id and the number of rows.

    Three combining steps, each on the digest and the whole text: the partial aggregate deduplicates
    within a task, the first shuffle merges the tasks of one salt, the second the at most ``salts``
    winners of a digest.  So no task ever gets more than ``salts`` rows or tasks of one group.
    """
    local = docs.select("d_id", "d_text", digest(F.col("d_text")).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    salted = local.groupBy("digest", "salt", "d_text").agg(F.min("d_id").alias("d_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "d_text").agg(F.min("d_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("d_id"), normalised(docs[text_col]).alias("d_text"))


def _groups(slim: DataFrame, digest, salts: int) -> tuple[DataFrame, list[str]]:
    """Groups with the columns that name one: the digest, or digest and text if two texts share a digest."""
    groups = stage(_combined(slim, digest, salts).select("digest", "keep_id", "group_size"), "exact-groups")
    if groups.groupBy("digest").count().filter("count > 1").isEmpty():
        return groups, ["digest"]
    return _combined(slim, digest, salts), ["digest", "d_text"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, salts: int = 16) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as
    empty.  Of equal texts the smallest id stays (null only if all ids are null); of rows that repeat
    that id and text, one is kept.  Texts are compared in full: a shared digest never merges two
    texts.  An empty table gives an empty result; other columns are ignored.
    """
    slim = _slim(docs, id_col, text_col)
    groups, names = _groups(slim, digest, salts)
    rows = slim.select("d_id", digest(F.col("d_text")).alias("digest"), *([] if names == ["digest"] else ["d_text"]), sha256(F.col("d_text")).alias("text_sha256"))
    found = rows.join(groups, names).withColumn("first", F.col("d_id").eqNullSafe(F.col("keep_id")))
    twins = Window.partitionBy("first", "text_sha256", "d_id", F.when(~F.col("first"), F.lit(0))).orderBy(F.lit(0))
    nth = F.row_number().over(twins)
    return found.select(F.col("d_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("first") & (nth == 1)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, salts: int = 16) -> DataFrame:
    """The rows of docs that stay, with all their columns; see exact_groups."""
    slim = _slim(docs, id_col, text_col)
    groups, names = _groups(slim, digest, salts)
    cols = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    text = normalised(docs[text_col])
    # a key without nulls: rows that repeat id and text become one within tasks first, and whole rows are shuffled once for that and the join
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    keyed = docs.select(*cols, key(docs[id_col]).alias("d_key"), digest(text).alias("digest"), *([] if names == ["digest"] else [text.alias("d_text")]))
    winners = groups.select(*names, key(F.col("keep_id")).alias("d_key"))
    kept = keyed.dropDuplicates([*names, "d_key"]).join(winners, [*names, "d_key"])
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])

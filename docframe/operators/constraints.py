"""What a relational target would enforce at load, as reports of violating rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.scalars import coerce


def unique_violations(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """CON1 for one column: rows after the first of a value, by load order; nulls never collide."""
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first, column).filter(F.struct(*order) != F.col("_first")).drop("_first")


def _dealt(df: DataFrame, column: str) -> DataFrame:
    """df with _deal: 0, or any of many numbers where the column is null, so that a join spreads these rows."""
    return df.withColumn("_deal", F.when(F.col(column).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int") + 1).otherwise(0))


def unique_survivors(df: DataFrame, columns: Sequence[str], order: Sequence[str], materialise=None) -> DataFrame:
    """CON1 for several columns: rows that load when each is unique by itself.

    Row-atomic in load order: a skipped row uses up no value.  Rounds of: rows that are first for all
    their values survive, rows that share a value with a survivor fall.  Each round settles the first
    row that is left, so rounds end by themselves.  ``materialise`` cuts the lineage between rounds (a function DataFrame -> DataFrame); without it, DataFrame.checkpoint.
    """
    cut = materialise or (lambda d: d.checkpoint())
    place = F.struct(*order)
    live, kept = cut(df), None
    while True:
        marked, good = live, F.lit(True)
        for c in columns:
            # partial minima of values; nulls, which never collide, are dealt out
            first = live.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(place).alias(f"_first_{c}")).withColumn("_deal", F.lit(0))
            marked = _dealt(marked, c).join(first, [c, "_deal"], "left").drop("_deal")
            good = good & (F.col(c).isNull() | (F.col(f"_first_{c}") == place))
        now = cut(marked.withColumn("_good", good).select(*df.columns, "_good"))
        won = now.filter("_good").drop("_good")
        kept = won if kept is None else kept.unionByName(won)
        rest = now.filter("NOT _good").drop("_good")
        for c in columns:
            rest = _dealt(rest, c).join(won.filter(F.col(c).isNotNull()).select(c).distinct().withColumn("_deal", F.lit(0)), [c, "_deal"], "left_anti").drop("_deal")
        live = cut(rest.select(*df.columns))
        if live.isEmpty():
            return kept.select(*df.columns)


def fk_violations(child: DataFrame, fk: str, surviving: DataFrame, pk: str) -> DataFrame:
    """CON2: rows whose key isn't null and has no surviving parent."""
    keys = surviving.select(F.col(pk).alias("_pk")).distinct()
    return child.filter(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def fk_survivors(child: DataFrame, fk: str, surviving: DataFrame, pk: str) -> DataFrame:
    keys = surviving.select(F.col(pk).alias("_pk")).distinct()
    return child.join(keys, F.col(fk) == F.col("_pk"), "left").filter(F.col(fk).isNull() | F.col("_pk").isNotNull()).drop("_pk")


def type_violations(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """CON3: rows with a value that its column's type can't take, and the first such column."""
    types = dict(df.dtypes)
    bad = F.coalesce(*[F.when(F.col(c).isNotNull() & coerce(F.col(c), k, types[c]).isNull(), F.lit(c)) for c, k in kinds.items()])
    return df.withColumn("bad_column", bad).filter("bad_column IS NOT NULL")


def load_report(offered: DataFrame, skipped: DataFrame) -> DataFrame:
    """CON4: table_name, offered, skipped, inserted; offered: table_name, skipped: table_name, reason."""
    a = offered.groupBy("table_name").agg(F.count(F.lit(1)).alias("offered"))
    b = skipped.groupBy("table_name").agg(F.count(F.lit(1)).alias("skipped"))
    out = a.join(b, "table_name", "left").withColumn("skipped", F.coalesce("skipped", F.lit(0)))
    return out.withColumn("inserted", F.col("offered") - F.col("skipped"))

"""Tables as a property graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.scalars import edge_key, edge_type, lookup_key, row_key, to_payload


@dataclass(frozen=True)
class Link:
    """A foreign key of a table: column -> references_table.references_column, by ordinal in the model."""

    column: str
    references_table: str
    references_column: str
    ordinal: int
    kind: str = "string"


@dataclass(frozen=True)
class NodeTable:
    df: DataFrame
    pk: dict[str, str]  # column -> logical type
    order: tuple[str, ...]
    links: tuple[Link, ...] = field(default=())
    declared: tuple[str, ...] = ()  # columns of texts and payloads; all of df's where empty


def nodes(tables: dict[str, NodeTable], scope: str) -> DataFrame:
    """ST3: __job_scope, __table, __row_key, props of all tables."""
    out = None
    for name, t in tables.items():
        indexed = with_keys(name, t)
        part = indexed.select(F.lit(scope).alias("__job_scope"), F.lit(name).alias("__table"), "__row_key", to_payload({c: F.col(c) for c in t.df.columns}).alias("props"))
        out = part if out is None else out.unionByName(part)
    return out


def merged_nodes(tables: dict[str, NodeTable], scope: str) -> DataFrame:
    """One node per key of a table, as it is stored: of rows that share one, the last in load order."""
    out = None
    for name, t in tables.items():
        props = to_payload({c: F.col(c) for c in t.df.columns})
        part = with_keys(name, t).groupBy("__row_key").agg(F.max_by(props, F.struct(*t.order)).alias("props"))
        part = part.select(F.lit(scope).alias("__job_scope"), F.lit(name).alias("__table"), "__row_key", "props")
        out = part if out is None else out.unionByName(part)
    return out


def with_keys(name: str, t: NodeTable) -> DataFrame:
    """A table with __row_key; a row without a whole key is told apart by its place in load order."""
    place = F.concat_ws(",", *[F.col(c).cast("string") for c in t.order])
    return t.df.withColumn("__row_key", row_key(name, {c: (F.col(c), k) for c, k in t.pk.items()}, place, {c: F.col(c) for c in t.df.columns}))


def graph_edges(tables: dict[str, NodeTable], scope: str) -> DataFrame:
    """JN5: an edge per child row whose key, case folded, is a parent's; of parents that share a key the last."""
    out = None
    for name, t in tables.items():
        for link in t.links:
            parent = tables[link.references_table]
            ends = with_keys(link.references_table, parent).filter(F.col(link.references_column).isNotNull())
            ends = ends.groupBy(lookup_key(F.col(link.references_column), link.kind).alias("_k")).agg(F.max_by("__row_key", F.struct(*parent.order)).alias("dst"))
            begins = with_keys(name, t).filter(F.col(link.column).isNotNull()).select(lookup_key(F.col(link.column), link.kind).alias("_k"), F.col("__row_key").alias("src"))
            part = begins.join(ends, "_k").select(
                F.lit(scope).alias("__job_scope"), "src", "dst",
                edge_type(F.lit(name), F.lit(link.references_table)).alias("type"), edge_key(F.col("src"), F.col("dst"), F.lit(link.ordinal)).alias("edge_key"),
            )
            out = part if out is None else out.unionByName(part)
    return out


def graph_counts(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """AG18: rows merged as nodes, distinct nodes, edges."""
    n = node_rows.agg(F.count(F.lit(1)).alias("node_rows"), F.count_distinct("__table", "__row_key").alias("nodes"))
    return n.crossJoin(edge_rows.agg(F.count(F.lit(1)).alias("edges")))  # one row each



"""Sinks: relational tables, graph, vector points, notes, audit."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions.scalars import coerce
from docframe.operators.constraints import fk_survivors, unique_survivors
from docframe.operators.graph import NodeTable, graph_edges, merged_nodes
from docframe.operators.jobs import latest_per_job
from docframe.operators.vectors import points
from docframe.session import stage
from docframe.sources.published import Published, count_rows


#: Columns of what the graph and the vector sink store, beside the scope.
GRAPH = {"nodes": "__row_key string, props string, __table string", "edges": "src string, dst string, edge_key string, type string"}
POINTS = "point_id string, row_index long, text string, payload string, vector array<float>"
#: Folders that the jobs of a dump are dealt over; part of its layout, as read_buckets looks there.
JOB_FOLDERS = 256


class Sink(Protocol):
    """UD6: where finished tables go.  Provisioning a scope again replaces what it held."""

    def provision(self, tables: dict[str, NodeTable], scope: str) -> dict[str, int]: ...

    def delete_output(self, scope: str) -> None: ...


def sink_for(target: str, **sinks: Callable[[], Sink]) -> Sink:
    """UD6: the sink that a job names (sql, graph, vector, or any other that is given)."""
    try:
        return sinks[target.lower()]()
    except KeyError:
        raise ValueError(f"no sink for {target!r}; there are {', '.join(sorted(sinks))}") from None


def _frame(t: NodeTable | DataFrame) -> DataFrame:
    return t.df if isinstance(t, NodeTable) else t


class SqlSink:
    """SNK1, SNK6: a database per scope, parents before children, rows that break a constraint left out.

    keys: unique columns by table; links: (table, column, parent, parent column); kinds: logical types
    by table and column, rows whose values don't fit are left out; order: load order of the columns
    that place a row.  Survivors are staged, so a parent's are found once.

    All tables of a scope are published at once, in ``path`` (the warehouse's own folder, if not given);
    then the database's tables are made to point there, one by one.  ``read`` sees the former load or
    the new one; ``register`` mends a database whose tables were left at the former.
    """

    def __init__(self, spark: SparkSession, keys: dict[str, Sequence[str]], links: Sequence[tuple[str, str, str, str]] = (), order: Sequence[str] = ("chunk_index", "row_no"), materialise=None, kinds: dict[str, dict[str, str]] | None = None, path: str | None = None):
        self.spark, self.keys, self.links, self.order, self.materialise, self.kinds = spark, keys, links, order, materialise or stage, kinds or {}
        self.published = Published(spark, path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/published")

    def load_order(self, names: Iterable[str]) -> list[str]:
        """Parents before children, else as given; tables of a cycle come last, as given."""
        left, done = list(names), []
        while left:
            free = [n for n in left if not any(t == n and p != n and p in left for t, _, p, _ in self.links)] or left
            done += free
            left = [n for n in left if n not in free]
        return done

    def survivors(self, tables: dict[str, NodeTable | DataFrame]) -> dict[str, DataFrame]:
        done: dict[str, DataFrame] = {}
        for name in self.load_order(tables):
            df = _frame(tables[name])
            if self.kinds.get(name):
                types = dict(df.dtypes)
                for column, kind in self.kinds[name].items():
                    df = df.filter(F.col(column).isNull() | coerce(F.col(column), kind, types[column]).isNotNull())
                df = df.withColumns({c: coerce(F.col(c), k, types[c]) for c, k in self.kinds[name].items()})
            for table, column, parent, pk in self.links:
                if table == name and parent in done:
                    df = fk_survivors(df, column, done[parent], pk)
            done[name] = unique_survivors(df, self.keys[name], self.order, self.materialise) if self.keys.get(name) else self.materialise(df)
        return done

    def provision(self, tables: dict[str, NodeTable | DataFrame], scope: str) -> dict[str, int]:
        loaded = self.survivors(tables)
        self.published.replace(scope, {name: (df, []) for name, df in loaded.items()})
        self.register(scope)
        return {name: self.spark.table(f"`{scope}`.`{name}`").count() for name in loaded}

    def read(self, scope: str, name: str) -> DataFrame:
        """A table of the scope's last load."""
        return self.spark.read.parquet(self._place(scope, name))

    def register(self, scope: str) -> None:
        """The database of the scope has the tables of its last load."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{scope}`")
        wanted = self.published.current(scope)
        for name in {t.name for t in self.spark.catalog.listTables(f"`{scope}`")} | set(wanted):
            self.spark.sql(f"DROP TABLE IF EXISTS `{scope}`.`{name}`")
            if name in wanted:
                self.spark.sql(f"CREATE TABLE `{scope}`.`{name}` USING parquet LOCATION '{self._place(scope, name)}'")

    def _place(self, scope: str, name: str) -> str:
        return self.published.folder(scope, name)

    def delete_output(self, scope: str) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS `{scope}` CASCADE")
        self.published.drop(scope)


class GraphSink:
    """SNK2: nodes and edges by scope and table; running again replaces, never doubles.

    Of rows that share a key the last in load order is the node.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.published = Published(spark, path, "__job_scope")

    def provision(self, tables: dict[str, NodeTable], scope: str) -> dict[str, int]:
        nodes, edges = merged_nodes(tables, scope), graph_edges(tables, scope)
        made = {"nodes": (nodes, ["__table"])} | ({} if edges is None else {"edges": (edges.dropDuplicates(["__job_scope", "edge_key"]), ["type"])})
        self.published.replace(scope, made)
        return dict.fromkeys(tables, 0) | count_rows(self.read("nodes", [scope]), "__table")

    def read(self, name: str, scopes: Sequence[str] | None = None) -> DataFrame:
        """The published nodes or edges, of all scopes or of some."""
        return self.published.read(name, GRAPH[name], scopes)

    def delete_output(self, scope: str) -> None:
        self.published.drop(scope)


class VectorSink:
    """SNK3: points of a collection, replaced as a whole; every text needs its vector.

    embed gives a DataFrame of points (text) its column ``vector``.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.embed = spark, path, embed
        self.published = Published(spark, path, "collection")

    def provision(self, tables: dict[str, NodeTable], scope: str) -> dict[str, int]:
        counts, every = {}, None
        for name, t in tables.items():
            made = points(t.df, name, scope, list(t.declared or t.df.columns), list(t.order))
            made = stage(self.embed(made) if self.embed else made.withColumn("vector", F.lit(None).cast("array<float>")))
            counts[name], every = made.count(), made if every is None else every.unionByName(made)
        if every is not None:
            self.provision_points(every, scope)
        return counts

    def provision_points(self, rows: DataFrame, scope: str) -> None:
        if not rows.filter("vector IS NULL").isEmpty():
            raise ValueError("points without a vector")
        self.published.replace(scope, {"points": (rows.withColumn("vector", F.col("vector").cast("array<float>")), [])})

    def read(self, scopes: Sequence[str] | None = None) -> DataFrame:
        """The published points, of all collections or of some."""
        return self.published.read("points", POINTS, scopes)

    def delete_output(self, scope: str) -> None:
        self.published.drop(scope)


def _job_folder(job_id: Column) -> Column:
    return F.pmod(F.hash(job_id.cast("string")), F.lit(JOB_FOLDERS))


def write_buckets(extracted: DataFrame, path: str) -> None:
    """SNK4: rows as JSON, those of a job in one folder and side by side.

    A folder holds many jobs, so that the number of files depends on the size of the rows, not on the
    number of jobs; a large folder, be it of one job, is written by several tasks.
    """
    dealt = extracted.withColumn("__job_folder", _job_folder(F.col("job_id"))).hint("rebalance", "__job_folder")
    dealt.sortWithinPartitions("__job_folder", "job_id").write.partitionBy("__job_folder").mode("overwrite").json(path, compression="gzip")


def read_buckets(spark: SparkSession, path: str, schema: str, jobs: Sequence[str] | None = None) -> DataFrame:
    """Rows of a dump, of all jobs or of some, whose folders alone are read; schema: their columns, job_id among them."""
    rows = spark.read.schema(f"{schema}, __job_folder int").json(path)
    if jobs is not None:
        rows = rows.filter(F.col("__job_folder").isin(*[_job_folder(F.lit(j)) for j in jobs]) & F.col("job_id").isin(*jobs))
    return rows.drop("__job_folder")


def run_notes(notes: DataFrame, counts: DataFrame) -> DataFrame:
    """SNK5: run: job_id, JSON of notes and table counts (notes: job_id, note; counts: job_id, table_name, n_rows)."""
    n = notes.groupBy("job_id").agg(F.array_sort(F.collect_list("note")).alias("notes"))
    c = counts.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "n_rows")))).alias("table_counts"))
    both = c.join(n, "job_id", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
    return both.select("job_id", F.to_json(F.struct("notes", "table_counts")).alias("run"))


def write_run_notes(notes: DataFrame, counts: DataFrame, path: str) -> None:
    run_notes(notes, counts).write.mode("overwrite").json(path)


def provision_summary(counts: DataFrame, target: str) -> DataFrame:
    """SNK7: one row: what was loaded where (counts: table_name, n_rows)."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_name", "n_rows"))), lambda s: F.concat(s["table_name"], F.lit("="), s["n_rows"].cast("string"))), ", ")
    return counts.agg(F.format_string(f"{target}: %d rows in %d tables: %s", F.sum("n_rows"), F.count(F.lit(1)), lines).alias("summary"))


def audit_jobs(updates: DataFrame, path: str) -> None:
    """SNK8: append updates; read_audit gives the state."""
    updates.write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return latest_per_job(spark.read.parquet(path))

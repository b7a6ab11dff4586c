"""Jobs: listing, previews, gates, audit and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.session import stage

# Job statuses, which of them allow what, and the phase that each shows as.
DELETABLE = ("MODEL_PROPOSED", "AWAITING_REVIEW", "AWAITING_QUERY", "COMPLETED", "FAILED")
IDLE = ("COMPLETED", "FAILED", "MODEL_PROPOSED", "AWAITING_REVIEW", "AWAITING_QUERY")
TERMINAL = ("COMPLETED", "FAILED")
ACTIONS = (
    ("approve", "MODEL_PROPOSED"), ("approve", "AWAITING_REVIEW"), ("reject", "MODEL_PROPOSED"), ("reject", "AWAITING_REVIEW"), ("query", "AWAITING_QUERY"),
    *(("delete", s) for s in DELETABLE),
)
PHASES = {
    "UPLOADED": 0, "OCR_PROCESSING": 1, "INDEXING": 1, "AWAITING_QUERY": 3, "PROFILING": 2, "MODEL_PROPOSED": 3, "AWAITING_REVIEW": 3, "MODEL_LOCKED": 3,
    "EXTRACTING": 4, "MERGING": 4, "RECONCILING": 5, "TRANSLATING": 5, "PROVISIONING": 6, "COMPLETED": 7, "FAILED": -1,
}


def dense_index(df: DataFrame, group: str, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Position of each row, from 0, in the order of ``order``, whose first column is ``group``.

    Groups are counted and ranged by their order; counts are summed up within each range, and the
    ranges' totals, one row each, in one small window.  Rows are numbered within their group only, so
    no task sees all rows or all groups.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranged = stage(counts.repartitionByRange(group).withColumn("_range", F.spark_partition_id()), "index-groups")
    totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_t"))
    offsets = totals.select("_range", (F.sum("_t").over(Window.orderBy("_range")) - F.col("_t")).alias("_offset"))
    mine = F.sum("_n").over(Window.partitionBy("_range").orderBy(group)) - F.col("_n")
    before = ranged.join(offsets, "_range").select(F.col(group).alias("_g"), (F.col("_offset") + mine).alias("_before"))
    out = df.join(before, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return out.withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).drop("_before")


def deletable(status: Column) -> Column:
    """FLT9."""
    return status.isin(*DELETABLE)


def idle(status: Column) -> Column:
    return status.isin(*IDLE)


def terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def check_inputs(jobs: DataFrame) -> DataFrame:
    """FLT10: id, violation: field rules that a job's inputs break."""
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    rules = [
        F.when(~size("filename").between(1, 512), F.lit("filename")),
        F.when(~size("file_key").between(1, 1024), F.lit("file_key")),
        F.when(F.coalesce(F.col("file_size") <= 0, F.lit(True)), F.lit("file_size")),
        F.when(F.col("query").isNotNull() & ~size("query").between(1, 2000), F.lit("query")),
    ]
    return jobs.select("id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def status_gate(requests: DataFrame) -> DataFrame:
    """FLT11: requests (id, status, action) with ``allowed``; the table of actions is a fixed list."""
    allowed = F.lit(False)
    for action in sorted({a for a, _ in ACTIONS}):
        allowed = allowed | ((F.col("action") == action) & F.col("status").isin(*[s for a, s in ACTIONS if a == action]))
    return requests.withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def preview(rows: DataFrame, table: str, order: Sequence[str], limit: int = 20) -> DataFrame:
    """TK5: the first rows of each table and its total."""
    nth = F.row_number().over(Window.partitionBy(table).orderBy(*order))
    first = rows.withColumn("position", nth).filter(F.col("position") <= limit)
    return first.join(rows.groupBy(table).agg(F.count(F.lit(1)).alias("total")), table)


def declared_columns(previews: DataFrame, model_columns: DataFrame) -> DataFrame:
    """JN10: table_name, columns: declared ones in order, else the first row's (row map<string,string>)."""
    names = model_columns.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_no", "column_name"))), lambda s: s["column_name"]).alias("declared"))
    first = previews.groupBy("table_name").agg(F.min_by("row", "position").alias("row"))
    return first.join(names, "table_name", "left").select("table_name", F.coalesce("declared", F.array_sort(F.map_keys("row"))).alias("columns"))


def list_jobs(jobs: DataFrame, user: Column | int | str, skip: int, limit: int) -> DataFrame:
    """TK6: a user's jobs, newest first, ids break ties."""
    return jobs.filter(F.col("user_id") == user).orderBy(F.desc("created_at"), "id").offset(skip).limit(limit)


def job_stats(jobs: DataFrame) -> DataFrame:
    """AG13, AG14: total, active, completed, failed."""
    done = F.col("status").isin(*TERMINAL)
    return jobs.agg(F.count(F.lit(1)).alias("total"), F.count_if(~done).alias("active"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"))


def table_counts(rows: DataFrame, model_tables: DataFrame) -> DataFrame:
    """AG12: rows of each table of the model, empty ones included."""
    n = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    return model_tables.select("table_name").distinct().join(n, "table_name", "left").select("table_name", F.coalesce("n", F.lit(0)).alias("n_rows"))


def latest_per_job(updates: DataFrame) -> DataFrame:
    """SNK8's view: the last value that isn't null of each audited field, and when it was updated."""
    fields = [c for c in updates.columns if c not in ("job_id", "updated_at")]
    return updates.groupBy("job_id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(c) for c in fields], F.max("updated_at").alias("updated_at"))


def failed_events(failures: DataFrame) -> DataFrame:
    """SM3: failures (job_id, error_type, error_text, ts) as job events."""
    message = F.format_string("Task failed: %s: %s", "error_type", "error_text")
    return failures.select("job_id", F.lit("FAILED").alias("status"), F.lit(0.0).alias("progress"), message.alias("error_message"), F.lit(None).cast("string").alias("connection_string"), "ts")


def progress_phase(status: Column) -> Column:
    """SM4: the phase that a status shows as; null for an unknown one."""
    return F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])[status]


def until_terminal(events: DataFrame, key: str = "job_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """SM2 for stored events: those up to a job's first terminal one, in the order of ``order``.

    Of events that tie, the terminal ones come last, and one of those passes.
    """
    place = _place(order)
    ends = events.filter(terminal(F.col("status"))).groupBy(key).agg(F.min(place).alias("_end"))
    return events.join(ends, key, "left").filter(F.col("_end").isNull() | (place <= F.col("_end"))).drop("_end")


def _place(order: Sequence[str]) -> Column:
    return F.struct(*order, terminal(F.col("status")).alias("_last"), F.col("status").alias("_status"))


def status_feed(events: DataFrame, since: Column, key: str = "job_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """SM2: what a job's reader gets who comes at ``since``: its state by then, then its later events up to a terminal one.

    The rows of the state have ``current`` true; a job that is at its end by then has that row only.
    """
    passed, early = until_terminal(events, key, order), F.col(order[0]) <= since
    state = passed.filter(early).groupBy(key).agg(F.max_by(F.struct(*events.columns), _place(order)).alias("e"))
    return state.select("e.*", F.lit(True).alias("current")).unionByName(passed.filter(~early).withColumn("current", F.lit(False)))


def latest_status(events: DataFrame, key: str = "job_id", carried: Sequence[str] = ("error_message", "connection_string")) -> DataFrame:
    """SM1: a job's last status and progress; carried fields keep their last value that isn't null.

    The same aggregation runs on stored and on streamed events.
    """
    now = [F.max_by(F.col(c), "ts").alias(c) for c in ("status", "progress")]
    kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in carried]
    return events.groupBy(key).agg(*now, *kept, F.max("ts").alias("ts"))

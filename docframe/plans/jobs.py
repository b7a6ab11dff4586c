"""Queries over jobs: every user of the events is a job, every event a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.operators import jobs as J
from docframe.plans.registry import query, table
from docframe.sources import sinks

# status of each event type
STATUS = {"click": "EXTRACTING", "view": "PROFILING", "signup": "MODEL_PROPOSED", "purchase": "COMPLETED", "error": "FAILED"}
_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
EVENTS = f"""ev AS (SELECT CAST(user_id AS VARCHAR) AS job_id, {_STATUS} AS status, value AS progress, CASE WHEN event_type = 'error' THEN props END AS error_message,
  CASE WHEN event_type = 'signup' THEN props END AS connection_string, ts, event_id FROM events)"""


def status() -> F.Column:
    return F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]


def job_events(spark: SparkSession, d: str) -> DataFrame:
    props = lambda kind: F.when(F.col("event_type") == kind, F.col("props"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), status().alias("status"), F.col("value").alias("progress"), props("error").alias("error_message"), props("signup").alias("connection_string"), "ts", "event_id")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a job of its user."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", status().alias("status"), F.col("ts").alias("created_at"))


@query("FLT9_status_sets", f"SELECT event_id AS id, CAST(s IN ('MODEL_PROPOSED', 'AWAITING_REVIEW', 'AWAITING_QUERY', 'COMPLETED', 'FAILED') AS INTEGER) AS deletable, CAST(s IN ('COMPLETED', 'FAILED') AS INTEGER) AS terminal FROM (SELECT event_id, {_STATUS} AS s FROM events)")
def flt9(spark, d):
    return jobs(spark, d).select("id", J.deletable(F.col("status")).cast("int").alias("deletable"), J.terminal(F.col("status")).cast("int").alias("terminal"))


@query("FLT10_check_inputs", """WITH j AS (SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN '' ELSE url END AS filename, repeat(url, page_id % 50) AS file_key, page_id - 3 AS file_size, CASE WHEN page_id % 3 = 0 THEN html END AS query FROM pages)
SELECT id, 'filename' AS violation FROM j WHERE length(filename) NOT BETWEEN 1 AND 512 UNION ALL SELECT id, 'file_key' FROM j WHERE length(file_key) NOT BETWEEN 1 AND 1024
UNION ALL SELECT id, 'file_size' FROM j WHERE file_size <= 0 UNION ALL SELECT id, 'query' FROM j WHERE query IS NOT NULL AND length(query) NOT BETWEEN 1 AND 2000""")
def flt10(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(k.alias("id"), F.when(k % 4 == 0, "").otherwise(F.col("url")).alias("filename"), F.expr("repeat(url, cast(page_id % 50 as int))").alias("file_key"), (k - 3).alias("file_size"), F.when(k % 3 == 0, F.col("html")).alias("query"))
    return J.check_inputs(rows)


@query("FLT11_status_gate", f"""WITH r AS (SELECT event_id AS id, {_STATUS} AS status, ['approve', 'reject', 'query', 'delete'][event_id % 4 + 1] AS action FROM events)
SELECT id, action, CAST(CASE WHEN action IN ('approve', 'reject') THEN status IN ('MODEL_PROPOSED', 'AWAITING_REVIEW') WHEN action = 'query' THEN status = 'AWAITING_QUERY'
  ELSE status IN ('MODEL_PROPOSED', 'AWAITING_REVIEW', 'AWAITING_QUERY', 'COMPLETED', 'FAILED') END AS INTEGER) AS allowed FROM r""")
def flt11(spark, d):
    action = F.element_at(F.array(*[F.lit(a) for a in ("approve", "reject", "query", "delete")]), (F.col("id") % 4 + 1).cast("int"))
    return J.status_gate(jobs(spark, d).withColumn("action", action)).select("id", "action", F.col("allowed").cast("int").alias("allowed"))


@query("TK5_preview", "WITH p AS (SELECT event_type AS table_name, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS position, count(*) OVER (PARTITION BY event_type) AS total FROM events) SELECT * FROM p WHERE position <= 20")
def tk5(spark, d):
    return J.preview(table(spark, d, "events").select(F.col("event_type").alias("table_name"), "event_id"), "table_name", ["event_id"])


@query("TK6_list_jobs", "SELECT event_id AS id, user_id FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 5")
def tk6(spark, d):
    return J.list_jobs(jobs(spark, d), 3, 5, 20).select("id", "user_id")


@query("AG13_job_stats", f"WITH {EVENTS} SELECT count(*) AS total, count(*) FILTER (status NOT IN ('COMPLETED', 'FAILED')) AS active, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed FROM ev")
def ag13(spark, d):
    return J.job_stats(jobs(spark, d))


@query("AG14_count_jobs", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def ag14(spark, d):
    return jobs(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("JN10_declared_columns", """WITH f AS (SELECT event_type AS table_name, count(*) AS n FROM events GROUP BY 1) SELECT table_name, CASE WHEN table_name IN ('click', 'view') THEN 'event_id,user_id' ELSE 'k,v' END AS columns FROM f""")
def jn10(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("table_name"), F.col("event_id").alias("position"), F.create_map(F.lit("v"), F.col("value").cast("string"), F.lit("k"), F.col("props")).alias("row"))
    known = rows.select("table_name").distinct().filter(F.col("table_name").isin("click", "view"))
    declared = known.select("table_name", F.posexplode(F.array(F.lit("event_id"), F.lit("user_id"))).alias("column_no", "column_name"))
    return J.declared_columns(rows, declared).withColumn("columns", F.array_join("columns", ","))


@query("SNK5_run_notes", """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT job_id, '{"notes":[' || coalesce((SELECT string_agg('"' || x.event_type || ' many"', ',' ORDER BY x.event_type) FROM n x WHERE x.job_id = n.job_id AND x.n > 12), '') || '],"table_counts":{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}}' AS run FROM n GROUP BY job_id""")
def snk5(spark, d):
    n = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("table_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return sinks.run_notes(n.filter("n_rows > 12").select("job_id", F.concat("table_name", F.lit(" many")).alias("note")), n)


@query("SNK7_summary", """WITH n AS (SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1) SELECT 'SQL: ' || CAST(sum(n) AS BIGINT) || ' rows in ' || count(*) || ' tables: ' || string_agg(t || '=' || n, ', ' ORDER BY t) AS summary FROM n""")
def snk7(spark, d):
    return sinks.provision_summary(table(spark, d, "events").groupBy(F.col("event_type").alias("table_name")).agg(F.count(F.lit(1)).alias("n_rows")), "SQL")


@query("SNK8_audit", f"""WITH {EVENTS} SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(error_message, (ts, event_id)) FILTER (error_message IS NOT NULL) AS error_message, max(event_id) AS n FROM ev GROUP BY job_id""")
def snk8(spark, d):
    e = job_events(spark, d).select("job_id", "status", "error_message", F.struct("ts", "event_id").alias("updated_at"))
    top = J.latest_per_job(e)
    return top.join(job_events(spark, d).groupBy("job_id").agg(F.max("event_id").alias("n")), "job_id").drop("updated_at")


@query("SM1_latest_status", f"""WITH {EVENTS} SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress, arg_max(error_message, (ts, event_id)) FILTER (error_message IS NOT NULL) AS error_message,
  arg_max(connection_string, (ts, event_id)) FILTER (connection_string IS NOT NULL) AS connection_string FROM ev GROUP BY job_id""")
def sm1(spark, d):
    """The stored twin of the streamed aggregate; tests run both."""
    return J.latest_status(job_events(spark, d).withColumn("ts", F.struct("ts", "event_id"))).drop("ts")


@query("SM2_until_terminal", f"WITH {EVENTS}, t AS (SELECT job_id, min((ts, event_id)) AS e FROM ev WHERE status IN ('COMPLETED', 'FAILED') GROUP BY 1) SELECT ev.job_id, event_id, status FROM ev LEFT JOIN t ON t.job_id = ev.job_id WHERE e IS NULL OR (ts, event_id) <= e")
def sm2(spark, d):
    return J.until_terminal(job_events(spark, d), order=("ts", "event_id")).select("job_id", "event_id", "status")


@query("SM2_feed", f"""WITH {EVENTS}, t AS (SELECT job_id, min((ts, event_id)) AS e FROM ev WHERE status IN ('COMPLETED', 'FAILED') GROUP BY 1),
p AS (SELECT ev.* FROM ev LEFT JOIN t ON t.job_id = ev.job_id WHERE e IS NULL OR (ts, event_id) <= e)
SELECT job_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(status, (ts, event_id)) AS status, 1 AS current FROM p WHERE ts <= TIMESTAMP '2024-01-01 12:00:00' GROUP BY job_id
UNION ALL SELECT job_id, event_id, status, 0 FROM p WHERE ts > TIMESTAMP '2024-01-01 12:00:00'""")
def sm2_feed(spark, d):
    """What readers get who come at noon of the first day."""
    feed = J.status_feed(job_events(spark, d), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), order=("ts", "event_id"))
    return feed.select("job_id", "event_id", "status", F.col("current").cast("int").alias("current"))


@query("SM3_failed_events", "SELECT CAST(user_id AS VARCHAR) AS job_id, 'FAILED' AS status, 0.0::DOUBLE AS progress, 'Task failed: ' || event_type || ': ' || props AS error_message FROM events WHERE event_type = 'error'")
def sm3(spark, d):
    lost = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("error_type"), F.col("props").alias("error_text"), "ts")
    return J.failed_events(lost).drop("connection_string", "ts")


@query("SM4_progress_phase", f"WITH {EVENTS} SELECT event_id, CASE status WHEN 'EXTRACTING' THEN 4 WHEN 'PROFILING' THEN 2 WHEN 'MODEL_PROPOSED' THEN 3 WHEN 'COMPLETED' THEN 7 ELSE -1 END AS phase FROM ev")
def sm4(spark, d):
    return job_events(spark, d).select("event_id", J.progress_phase(F.col("status")).alias("phase"))

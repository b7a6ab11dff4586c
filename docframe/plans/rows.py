"""Queries over rows: coercion, keys, merging, foreign keys, entities, constraints, graph and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe.functions import scalars as S
from docframe.operators import constraints, extract, graph, reconcile, vectors
from docframe.operators.jobs import dense_index
from docframe.operators.model import model_to_schema
from docframe.operators.reconcile import Declared
from docframe.operators.text import chunks_from_retrieval
from docframe.operators.vector_index import VectorIndex
from docframe.plans.documents import EMAIL
from docframe.plans.registry import query, table
from docframe.session import shared_path, stage
from docframe.sources import sinks
from docframe.sources.published import Published

LINEITEM = [Declared("l_orderkey", "integer", True), Declared("l_linenumber", "integer", True), Declared("l_partkey", "integer"), Declared("l_quantity", "float"), Declared("l_shipmode", "string")]


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Line items as extracted rows; some values are missing."""
    t = table(spark, d, "lineitem")
    return t.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("l_partkey"),
        F.when(F.col("l_suppkey") % 4 > 0, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_returnflag")).alias("l_shipmode"),
        F.col("l_partkey").alias("chunk_index"), F.struct("l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber").alias("row_no"),
    )


LINES = """li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 > 0 THEN l_partkey END AS l_partkey, CASE WHEN l_suppkey % 4 > 0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_partkey % 5 > 0 THEN l_returnflag END AS l_shipmode, (l_partkey, l_suppkey, l_extendedprice, l_orderkey, l_linenumber) AS ord FROM lineitem)"""


@query("AG6_merge_lineitem", f"""WITH {LINES} SELECT l_orderkey, l_linenumber, arg_min(l_partkey, ord) FILTER (l_partkey IS NOT NULL) AS l_partkey, arg_min(l_quantity, ord) FILTER (l_quantity IS NOT NULL) AS l_quantity,
  arg_min(l_shipmode, ord) FILTER (l_shipmode IS NOT NULL) AS l_shipmode FROM li GROUP BY ALL""")
def ag6(spark, d):
    return reconcile.merge_by_natural_key(lineitem(spark, d), LINEITEM).drop("chunk_index", "row_no")


@query("AG7_merge_notes", f"""WITH {LINES}, w AS (SELECT *, row_number() OVER k - 1 AS n, count(l_partkey) OVER b AS a1, count(l_quantity) OVER b AS a2, count(l_shipmode) OVER b AS a3 FROM li
  WINDOW k AS (PARTITION BY l_orderkey, l_linenumber ORDER BY ord), b AS (PARTITION BY l_orderkey, l_linenumber ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT l_orderkey || '|' || l_linenumber AS k, concat_ws(', ', CASE WHEN l_partkey IS NOT NULL AND a1 = 0 THEN 'l_partkey' END, CASE WHEN l_quantity IS NOT NULL AND a2 = 0 THEN 'l_quantity' END, CASE WHEN l_shipmode IS NOT NULL AND a3 = 0 THEN 'l_shipmode' END) AS f FROM w WHERE n > 0)
SELECT CASE WHEN f <> '' THEN 'lineitem: a later row of key ' || k || ' gave ' || f ELSE 'lineitem: a later row of key ' || k || ' gave nothing new' END AS note, count(*) AS n FROM f GROUP BY ALL""")
def ag7(spark, d):
    return reconcile.merge_notes(lineitem(spark, d), "lineitem", LINEITEM).groupBy("note").agg(F.count(F.lit(1)).alias("n"))


@query("AG8_fingerprint_dedupe", """SELECT arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name, arg_min(p_size, p_partkey) AS p_size FROM part GROUP BY lower(p_name) || '|' || lower(p_brand) || '|' || lower(p_type)""")
def ag8(spark, d):
    cols = [Declared("p_name"), Declared("p_brand"), Declared("p_type"), Declared("p_size", "integer")]
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.lit(0).alias("chunk_index"), F.col("p_partkey").alias("row_no"))
    return reconcile.dedupe_by_fingerprint(p, cols).select("p_partkey", "p_name", "p_size")


@query("WN2_first_seen", "SELECT l_orderkey, arg_min(l_linenumber, (l_shipdate, l_linenumber, l_partkey)) AS l_linenumber, arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def wn2(spark, d):
    return reconcile.first_seen(table(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("WN3_last_parent", "SELECT lower(p_name) AS name_key, arg_max(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, p_partkey) AS canonical FROM part GROUP BY 1")
def wn3(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), F.lit(0).alias("chunk_index"), F.col("p_partkey").alias("row_no"))
    return reconcile.last_parent(p, "p_name").select(F.col("_norm").alias("name_key"), F.col("_canonical").alias("canonical"))


@query("WN5_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_index FROM orders")
def wn5(spark, d):
    return dense_index(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_custkey", "o_orderkey"]).select("o_orderkey", "row_index")


# suppliers name their nation in other words: another case, two words swapped, a suffix, or nothing
NAMED = """ns AS (SELECT n_nationkey, replace(n_name, ' ', '_') || ' region ' || n_regionkey AS n_name FROM nation),
cs AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN ' ' || lower(n_name) || ' ' WHEN 1 THEN split_part(n_name, ' ', 2) || ', ' || split_part(n_name, ' ', 1) || '  ' || split_part(n_name, ' ', 3)
  WHEN 2 THEN n_name || ' x' WHEN 3 THEN NULL ELSE n_name END AS nation FROM supplier JOIN ns ON s_nationkey = n_nationkey)"""
TOKENS = r"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({0}), '[,.\s]+'), lambda t: t <> '')))"


def named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, d, "nation").select("n_nationkey", F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" region "), F.col("n_regionkey").cast("string")).alias("n_name"))
    name, word = F.col("n_name"), lambda k: F.split_part("n_name", F.lit(" "), F.lit(k))
    kind = F.col("s_suppkey") % 5
    said = F.when(kind == 0, F.concat(F.lit(" "), F.lower(name), F.lit(" "))).when(kind == 1, F.concat(word(2), F.lit(", "), word(1), F.lit("  "), word(3))).when(kind == 2, F.concat(name, F.lit(" x"))).when(kind == 4, name)
    child = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", said.alias("nation"))
    return child, nation.withColumn("chunk_index", F.lit(0)).withColumn("row_no", F.col("n_nationkey"))


FK = rf"""WITH {NAMED}, j AS (SELECT s_suppkey, nation, (SELECT max(n_name) FROM ns WHERE lower(n_name) = lower(trim(nation))) AS exact,
  (SELECT max(n_name) FROM ns WHERE {TOKENS.format('n_name')} = {TOKENS.format('nation')}) AS tokens FROM cs)"""


@query("JN1_fk_exact", f"{FK} SELECT s_suppkey, exact AS nation FROM j WHERE exact IS NOT NULL")
def jn1(spark, d):
    child, parents = named(spark, d)
    return reconcile.repair_fk(child, "nation", parents, "nation.n_name", "supplier.nation").filter("fk_note IS NULL AND nation IS NOT NULL").select("s_suppkey", "nation")


@query("JN2_fk_tokenset", f"""{FK} SELECT s_suppkey, coalesce(exact, tokens, nation) AS nation, CASE WHEN nation IS NULL OR exact IS NOT NULL THEN NULL
  WHEN tokens IS NOT NULL THEN 'supplier.nation: ''' || nation || ''' was read as ''' || tokens || ''', which has the same words'
  ELSE 'supplier.nation: ''' || nation || ''' is no value of nation.n_name' END AS fk_note FROM j""")
def jn2(spark, d):
    child, parents = named(spark, d)
    return reconcile.repair_fk(child, "nation", parents, "nation.n_name", "supplier.nation").select("s_suppkey", "nation", "fk_note")


@query("JN3_fk_misses", f"{FK} SELECT s_suppkey, nation FROM j WHERE nation IS NOT NULL AND exact IS NULL AND tokens IS NULL")
def jn3(spark, d):
    child, parents = named(spark, d)
    return reconcile.fk_misses(child, "nation", parents, "n_name").select("s_suppkey", "nation")


@query("JN4_fk_typed", "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 5 = 0 THEN 'customer.nation: ' || c_nationkey || ' is no value of nation.n_nationkey' END AS fk_note FROM customer")
def jn4(spark, d):
    parents = table(spark, d, "nation").filter("n_nationkey % 5 <> 0").select("n_nationkey", F.lit(0).alias("chunk_index"), F.col("n_nationkey").alias("row_no"))
    child = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return reconcile.repair_fk(child, "c_nationkey", parents, "nation.n_nationkey", "customer.nation", "integer").select("c_custkey", "c_nationkey", "fk_note")


PARTS = r"""pa AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || '.' END AS p_name,
  CASE WHEN p_partkey % 3 > 0 THEN p_type END AS p_type, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS p_size, CAST(p_partkey // 50 AS INTEGER) AS chunk_index FROM part),
e AS (SELECT *, CASE WHEN p_name IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[,.\s]+'), lambda t: t <> ''))), ' ') END AS e FROM pa),
absorbed AS (SELECT * EXCLUDE e, last_value(e IGNORE NULLS) OVER (PARTITION BY chunk_index ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS entity_id FROM e)"""
PART = [Declared("p_name", "string", True), Declared("p_type"), Declared("p_size", "integer")]


def parts(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    p = table(spark, d, "part").select(
        key, F.when(key % 7 == 0, None).when(key % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("."))).alias("p_name"), F.when(key % 3 > 0, F.col("p_type")).alias("p_type"),
        F.when(key % 4 > 0, F.col("p_size")).alias("p_size"), F.floor(key / 50).cast("int").alias("chunk_index"), key.alias("row_no"),
    )
    return reconcile.absorb_partial_rows(p.withColumn("entity_id", reconcile.entity_id(PART)), ["chunk_index"])


# the suppliers' nations again, in a job for each region; every seventh supplier is in the next job, and the last job has no nations
JOBS = rf"""WITH {NAMED}, nj AS (SELECT ns.n_name, n_regionkey AS job_id FROM ns JOIN nation USING (n_nationkey)),
cj AS (SELECT cs.s_suppkey, trim(cs.nation) AS nation, n_regionkey + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS job_id FROM cs JOIN supplier USING (s_suppkey) JOIN nation ON s_nationkey = n_nationkey),
j AS (SELECT cj.*, (SELECT max(n_name) FROM nj WHERE nj.job_id = cj.job_id AND lower(n_name) = lower(nation)) AS exact, (SELECT max(n_name) FROM nj WHERE nj.job_id = cj.job_id AND {TOKENS.format('n_name')} = {TOKENS.format('nation')}) AS tokens,
  EXISTS (SELECT 1 FROM nj WHERE nj.job_id = cj.job_id) AS has FROM cj)"""


@query("REC_many_jobs", f"""{JOBS} SELECT job_id, s_suppkey, coalesce(exact, tokens, nation) AS nation, CASE WHEN nation IS NULL OR exact IS NOT NULL OR NOT has THEN NULL
  WHEN tokens IS NOT NULL THEN 'supplier.nation: ' || chr(39) || nation || chr(39) || ' was read as ' || chr(39) || tokens || chr(39) || ', which has the same words' ELSE 'supplier.nation: ' || chr(39) || nation || chr(39) || ' is no value of nation.n_name' END AS reconciliation_notes, job_id || ',' || s_suppkey % 3 AS pages FROM j""")
def rec_many_jobs(spark, d):
    """Reconciliation as a whole, over all jobs at once."""
    child, nation = named(spark, d)
    region = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("job_id"))
    home = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(region, "n_nationkey")
    rows = child.join(home, "s_suppkey").withColumn("job_id", F.col("job_id") + (F.col("s_suppkey") % 7 == 0).cast("int"))
    rows = rows.select("job_id", "s_suppkey", "nation", (F.col("s_suppkey") % 3).cast("int").alias("chunk_index"), F.col("s_suppkey").alias("row_no"))
    nations = nation.join(region, "n_nationkey").select("job_id", "n_name", "chunk_index", "row_no")
    pages = rows.select("job_id", F.lit("supplier").alias("table_name"), "chunk_index").distinct().withColumn("pages", F.array(F.col("job_id").cast("int"), F.col("chunk_index")))
    declared = {"supplier": [Declared("s_suppkey", "integer", True), Declared("nation")], "nation": [Declared("n_name", "string", True)]}
    done = reconcile.reconcile({"supplier": rows, "nation": nations, "orphans": nations}, declared, [reconcile.ForeignKey("supplier", "nation", "nation", "n_name")], pages)
    return done["supplier"].select("job_id", "s_suppkey", "nation", "reconciliation_notes", F.array_join(F.col("source_page_numbers").cast("array<string>"), ",").alias("pages"))


@query("WN6_absorb", f"WITH {PARTS} SELECT p_partkey, entity_id FROM absorbed")
def wn6(spark, d):
    return parts(spark, d).select("p_partkey", "entity_id")


@query("UD5_entities", f"WITH {PARTS} SELECT e AS entity_id, count(*) AS n FROM e GROUP BY 1")
def ud5(spark, d):
    return parts(spark, d).select("p_name").withColumn("entity_id", reconcile.entity_id(PART)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("AG9_entity_merge", f"""WITH {PARTS} SELECT entity_id, arg_max(p_name, (length(p_name), -p_partkey)) FILTER (p_name IS NOT NULL) AS p_name, arg_max(p_type, (length(p_type), -p_partkey)) FILTER (p_type IS NOT NULL) AS p_type,
  arg_max(p_size, (length(CAST(p_size AS VARCHAR)), -p_partkey)) FILTER (p_size IS NOT NULL) AS p_size FROM absorbed WHERE entity_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT entity_id, p_name, p_type, p_size FROM absorbed WHERE entity_id IS NULL""")
def ag9(spark, d):
    return reconcile.entity_merge(parts(spark, d).drop("p_partkey")).select("entity_id", "p_name", "p_type", "p_size")


@query("AG10_entity_notes", f"WITH {PARTS} SELECT 'part: ' || count(entity_id) || ' rows tell of ' || count(DISTINCT entity_id) || ' entities' AS note FROM absorbed")
def ag10(spark, d):
    return reconcile.entity_notes(parts(spark, d), "part")


@query("ST4_unaccounted", f"WITH {PARTS} SELECT p_partkey FROM absorbed WHERE entity_id IS NULL")
def st4(spark, d):
    p = parts(spark, d)
    return reconcile.unaccounted_rows(p, p.filter("entity_id IS NOT NULL"), "p_partkey").select("p_partkey")


@query("AG19_join_notes", "SELECT o_orderkey, nullif(concat_ws('; ', CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'F' THEN 'final' END), '') AS reconciliation_notes FROM orders")
def ag19(spark, d):
    notes = F.array(F.when(F.col("o_totalprice") > 200000, "large"), F.when(F.col("o_orderstatus") == "F", "final"))
    return table(spark, d, "orders").select("o_orderkey", reconcile.join_notes(notes).alias("reconciliation_notes"))


@query("FLT4_orphan_buckets", "SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS table_name, 'dropped ' || count(*) || ' rows of unknown table ' || event_type AS note FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY user_id, event_type")
def flt4(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("table_name"))
    known = e.filter(F.col("table_name").isin("click", "view")).distinct()
    jobs = e.select("job_id").distinct().select("job_id", F.explode(F.array(F.lit("click"), F.lit("view"))).alias("table_name"))
    return extract.drop_orphan_buckets(e, known.unionByName(jobs).distinct())[1]


@query("FLT5_bad_entries", """WITH p AS (SELECT user_id, event_id, event_type, event_id % 4 AS k FROM events)
SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS table_name, CAST(event_id AS BIGINT) AS chunk_index, CAST(event_id AS VARCHAR) AS v FROM p WHERE k IN (0, 3)""")
def flt5(spark, d):
    e = table(spark, d, "events")
    good = F.format_string('{"table_name": "%s", "rows": [{"v": "%d"}%s]}', "event_type", "event_id", F.when(F.col("event_id") % 4 == 3, ', "not a row"').otherwise(""))
    payload = F.when(F.col("event_id") % 4 == 1, "[1, 2]").when(F.col("event_id") % 4 == 2, '{"rows": [{"v": "1"}]}').otherwise(good)
    raw = e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("chunk_index"), payload.alias("payload"))
    return extract.filter_bad_entries(raw).select("job_id", "table_name", "chunk_index", F.col("row")["v"].alias("v"))


@query("FLT6_project_declared", "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_since, CAST(NULL AS VARCHAR) AS reconciliation_notes FROM customer")
def flt6(spark, d):
    cols = [Declared("c_custkey", "integer"), Declared("c_name"), Declared("c_since")]
    return reconcile.project_declared(table(spark, d, "customer"), cols).drop("source_page_numbers", "extraction_confidence")


@query("FLT7_strip_internal", "SELECT s_suppkey, s_name FROM supplier")
def flt7(spark, d):
    return reconcile.strip_internal(table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("__nation")))


@query("ST1_union_results", "SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def st1(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return extract.union_chunk_results(a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")))


MESSY = """CASE p_partkey % 10 WHEN 0 THEN ' $' || p_size || ',000 ' WHEN 1 THEN 'N/A' WHEN 2 THEN '(' || p_size || ')' WHEN 3 THEN p_size || '%' WHEN 4 THEN '−' || p_size
  WHEN 5 THEN p_size || '.75' WHEN 6 THEN p_size || 'e2' WHEN 7 THEN 'none' WHEN 8 THEN 'size ' || p_size ELSE CAST(p_size AS VARCHAR) END"""


def messy() -> F.Column:
    k, s = F.col("p_partkey") % 10, F.col("p_size").cast("string")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    return (
        F.when(k == 0, c(" $", s, ",000 ")).when(k == 1, "N/A").when(k == 2, c("(", s, ")")).when(k == 3, c(s, "%")).when(k == 4, c("−", s))
        .when(k == 5, c(s, ".75")).when(k == 6, c(s, "e2")).when(k == 7, "none").when(k == 8, c("size ", s)).otherwise(s)
    )


NUM = r"CASE WHEN regexp_matches(b, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST(b AS DOUBLE) END"
BARE = rf"WITH m AS (SELECT p_partkey, {MESSY} AS v FROM part), b AS (SELECT p_partkey, v, CASE WHEN lower(trim(v)) NOT IN ('', 'null', 'none', 'n/a', 'na', 'undefined') THEN regexp_replace(replace(v, '−', '-'), '[$€£¥,\s]', '', 'g') END AS b FROM m)"


@query("SC1_null_tokens", f"WITH m AS (SELECT p_partkey, {MESSY} AS v FROM part) SELECT p_partkey, CASE WHEN lower(trim(v)) NOT IN ('', 'null', 'none', 'n/a', 'na', 'undefined') THEN v END AS v FROM m")
def sc1(spark, d):
    return table(spark, d, "part").select("p_partkey", S.null_tokens(messy()).alias("v"))


@query("SC2_strings", f"WITH m AS (SELECT p_partkey, {MESSY} AS v FROM part) SELECT p_partkey, CASE WHEN lower(trim(v)) NOT IN ('', 'null', 'none', 'n/a', 'na', 'undefined') THEN trim(v) END AS v FROM m")
def sc2(spark, d):
    return table(spark, d, "part").select("p_partkey", S.to_string(messy()).alias("v"))


# e acute and u umlaut, in one sign and in two
BOTH_FORMS = ("caf\u00e9 M\u00fcller ", "cafe\u0301 Mu\u0308ller ")


@query("SC2_composed", f"""WITH p AS (SELECT p_partkey, '{BOTH_FORMS[0]}' || p_partkey // 2 AS name FROM part WHERE p_partkey % 3 > 0)
SELECT lower(name) AS k, name AS v, count(*) AS n FROM p GROUP BY ALL""")
def sc2_composed(spark, d):
    """Both spellings of a name are one value and one natural key."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, BOTH_FORMS[0]).otherwise(BOTH_FORMS[1]), F.floor(F.col("p_partkey") / 2).cast("string"))
    p = reconcile.normalize_row(table(spark, d, "part").filter("p_partkey % 3 > 0").select("p_partkey", name.alias("v")), [Declared("v", pk=True)])
    return p.groupBy(S.natural_key([(F.col("v"), "string")])["k0"].alias("k"), "v").agg(F.count(F.lit(1)).alias("n"))


@query("SC3_ints", f"{BARE} SELECT p_partkey, CAST(trunc({NUM}) AS BIGINT) AS v FROM b")
def sc3(spark, d):
    return table(spark, d, "part").select("p_partkey", S.to_int(messy()).alias("v"))


@query("SC4_floats", f"{BARE} SELECT p_partkey, {NUM} AS v FROM b")
def sc4(spark, d):
    return table(spark, d, "part").select("p_partkey", S.to_float(messy()).alias("v"))


@query("SC5_bools", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, count(*) AS n, CASE lower(l_returnflag) WHEN 'n' THEN 'false' WHEN 'y' THEN 'true' END AS v, CASE l_linenumber WHEN 1 THEN 'true' END AS w FROM lineitem GROUP BY ALL")
def sc5(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    n = table(spark, d, "lineitem").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*keys, "n", S.to_bool(F.col("l_returnflag")).cast("string").alias("v"), S.to_bool(F.col("l_linenumber").cast("string")).cast("string").alias("w"))


@query("SC6_dates", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS v FROM orders""")
def sc6(spark, d):
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate")
    said = F.when(k == 0, F.concat(F.lit("ordered "), F.date_format(t, "yyyy-MM-dd"), F.lit(" and paid"))).when(k == 1, F.date_format(t, "MM/dd/yyyy")).when(k == 2, F.date_format(t, "MMM d, yyyy")).otherwise("some day")
    return table(spark, d, "orders").select("o_orderkey", S.to_date(said).cast("string").alias("v"))


@query("SC7_normalize", f"{BARE} SELECT p_partkey, CAST(trunc({NUM}) AS BIGINT) AS size, CASE WHEN lower(trim(v)) NOT IN ('', 'null', 'none', 'n/a', 'na', 'undefined') THEN trim(v) END AS raw FROM b")
def sc7(spark, d):
    p = table(spark, d, "part").select("p_partkey", messy().alias("size"), messy().alias("raw"))
    return reconcile.normalize_row(p, [Declared("size", "integer"), Declared("raw")])


@query("SC7_typed", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_extendedprice) AS BIGINT) AS f2i, CAST(l_linenumber <> 1 AS INTEGER) AS n2b, CAST(l_quantity <> 1 AS INTEGER) AS f2b, CAST(l_linenumber = 1 AS BIGINT) AS b2i,
  CAST(l_linenumber = 1 AS DOUBLE) AS b2f, CASE WHEN l_linenumber = 1 THEN 'True' ELSE 'False' END AS b2s, CAST(l_linenumber AS VARCHAR) AS n2s, CAST(NULL AS VARCHAR) AS n2d, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d2d FROM lineitem""")
def sc7_typed(spark, d):
    """Values that have a type already."""
    one, n = F.col("l_linenumber") == 1, F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", n, "l_partkey", F.col("l_extendedprice").alias("f2i"), (n - 1).alias("n2b"), (F.col("l_quantity") - 1).alias("f2b"), one.alias("b2i"), one.alias("b2f"), one.alias("b2s"), n.alias("n2s"), n.alias("n2d"), F.col("l_shipdate").alias("d2d"),
    )
    kinds = {"f2i": "integer", "n2b": "boolean", "f2b": "boolean", "b2i": "integer", "b2f": "float", "b2s": "string", "n2s": "string", "n2d": "date", "d2d": "date"}
    out = reconcile.normalize_row(rows, [Declared(c, k) for c, k in kinds.items()])
    return out.withColumns({c: F.col(c).cast("int") for c in ("n2b", "f2b")} | {c: F.col(c).cast("string") for c in ("n2d", "d2d")})


# what a date is written as, by o_orderkey: a format of Spark's and one of DuckDB's
DATE_FORMS = (
    ("MMMM d, yyyy", "%B %-d, %Y"), ("d MMMM yyyy", "%-d %B %Y"), ("MMM d yyyy", "%b %-d %Y"), ("MM-dd-yyyy", "%m-%d-%Y"), ("M.d.yyyy", "%-m.%-d.%Y"), ("M/d/yy", "%-m/%-d/%y"), ("yyyy.MM.dd", "%Y.%m.%d"), ("'the 'd' of 'MMMM, yyyy", "the %-d of %B, %Y"),
    ("yyyyMMdd", "%Y%m%d"), ("d-MMM-yyyy", "%-d-%b-%Y"), ("ddMMMyyyy", "%d%b%Y"), ("'on 'EEEE', 'MMMM d, yyyy' at 'HH:mm", "on %A, %B %-d, %Y at %H:%M"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"), ("yyyy MMM d", "%Y %b %-d"),
)


@query("SC6_date_forms", f"""WITH t AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % {len(DATE_FORMS)} {" ".join(f"WHEN {k} THEN strftime(o_orderdate, '{f}')" for k, (_, f) in enumerate(DATE_FORMS))} END AS said FROM orders)
SELECT o_orderkey, said, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS v FROM t""")
def sc6_forms(spark, d):
    """Dates as people write them; the years of two digits are near ours."""
    said = F.coalesce(*[F.when(F.col("o_orderkey") % len(DATE_FORMS) == k, F.date_format("o_orderdate", f)) for k, (f, _) in enumerate(DATE_FORMS)])
    return table(spark, d, "orders").select("o_orderkey", said.alias("said"), S.to_date(said).cast("string").alias("v"))


# forms of a date with a part missing: Spark's, DuckDB's, and what it says given a reference date
REFERENCE = "1996-02-29"
PARTIAL_FORMS = (
    ("MMMM d", "%B %-d", "make_date(1996, month(o_orderdate), day(o_orderdate))"), ("MMM yyyy", "%b %Y", "make_date(year(o_orderdate), month(o_orderdate), least(29, day(last_day(o_orderdate))))"), ("yyyy-MM", "%Y-%m", "make_date(year(o_orderdate), month(o_orderdate), least(29, day(last_day(o_orderdate))))"),
    ("M/d", "%-m/%-d", "make_date(1996, month(o_orderdate), day(o_orderdate))"), ("'due 'd MMM', 2 pcs'", "due %-d %b, 2 pcs", "make_date(1996, month(o_orderdate), day(o_orderdate))"), ("MMMM", "%B", "NULL"), ("d", "%-d", "NULL"),
)


@query("SC6_partial_dates", f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % {len(PARTIAL_FORMS)} {" ".join(f"WHEN {k} THEN strftime(o_orderdate, '{f}')" for k, (_, f, _) in enumerate(PARTIAL_FORMS))} END AS said,
  CASE o_orderkey % {len(PARTIAL_FORMS)} {" ".join(f"WHEN {k} THEN {v}" for k, (_, _, v) in enumerate(PARTIAL_FORMS))} END AS v FROM orders) SELECT o_orderkey, said, CAST(v AS VARCHAR) AS v FROM t""")
def sc6_partial(spark, d):
    """Dates without a day or a year, which a reference date completes."""
    said = F.coalesce(*[F.when(F.col("o_orderkey") % len(PARTIAL_FORMS) == k, F.date_format("o_orderdate", f)) for k, (f, _, _) in enumerate(PARTIAL_FORMS)])
    return table(spark, d, "orders").select("o_orderkey", said.alias("said"), S.to_date(said, F.lit(REFERENCE).cast("date")).cast("string").alias("v"))


@query("SC8_natural_key", "SELECT lower(trim(p_name)) || '#' || p_size AS k, count(*) AS n FROM part GROUP BY 1")
def sc8(spark, d):
    p = table(spark, d, "part").withColumn("k", S.natural_key([(F.concat(F.lit(" "), F.upper("p_name")), "string"), (F.col("p_size"), "integer")]))
    return p.groupBy(F.concat_ws("#", "k.k0", F.col("k.k1").cast("string")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SC9_fingerprint", "SELECT c_custkey, lower(c_name) || '|' || lower(c_mktsegment) AS v FROM customer")
def sc9(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.fingerprint([F.col("c_name"), F.lit(" "), F.col("c_mktsegment")]).alias("v"))


@query("SC10_token_set", f"SELECT p_partkey, array_to_string({TOKENS.format('p_name || chr(32) || p_type')}, ' ') AS v FROM part")
def sc10(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(S.token_set(F.concat("p_name", F.lit(" "), "p_type")), " ").alias("v"))


@query("SC11_snake", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_brand || '--' || p_type || '!'), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS v FROM part")
def sc11(spark, d):
    return table(spark, d, "part").select("p_partkey", S.snake_case(F.concat("p_brand", F.lit("--"), "p_type", F.lit("!"))).alias("v"))


_HALF = "list_transform(range({0}, len(embedding) + 1, 2), lambda i: embedding[i])"


@query("SC13_bbox", f"SELECT vec_id, CAST(trunc(100 * list_min({_HALF.format(1)})) AS INTEGER) AS x1, CAST(trunc(100 * list_min({_HALF.format(2)})) AS INTEGER) AS y1, CAST(trunc(100 * list_max({_HALF.format(1)})) AS INTEGER) AS x2, CAST(trunc(100 * list_max({_HALF.format(2)})) AS INTEGER) AS y2 FROM embeddings")
def sc13(spark, d):
    """A vector as a polygon: every two components are a point."""
    scaled = lambda k: F.get("embedding", k) * F.lit(100).cast("float")
    box = S.poly_to_bbox(F.transform(F.sequence(F.lit(0), F.size("embedding") - 2, F.lit(2)), lambda k: F.array(scaled(k), scaled(k + 1))))
    return table(spark, d, "embeddings").select("vec_id", *[box[c].alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("SC18_identifiers", "SELECT doc_id, CAST(coalesce(len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*$'))), 0) AS INTEGER) AS n FROM documents")
def sc18(spark, d):
    """How many words of a text could name a column as they stand."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.size(F.filter(F.split("text", " "), S.is_identifier)), F.lit(0)).alias("n"))


@query("SC22_names", "SELECT page_id, 'job_' || replace(split_part(url, '/', 3), '-', '_') AS namespace, regexp_extract(url, '^(.*/)', 1) AS prefix, '--- Page ' || page_id || ' ---' AS header FROM pages")
def sc22(spark, d):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return table(spark, d, "pages").select("page_id", S.namespace(host).alias("namespace"), S.artifact_prefix(F.col("url")).alias("prefix"), S.page_header(F.col("page_id")).alias("header"))


@query("CON1_unique", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n > 1")
def con1(spark, d):
    return constraints.unique_violations(table(spark, d, "part"), "p_name", ["p_partkey"]).select("p_partkey")


@query("CON1_unique_columns", """WITH RECURSIVE o AS (SELECT p_partkey, p_name, p_size, row_number() OVER (ORDER BY p_partkey) AS i FROM part),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS sizes, false AS ok
  UNION ALL SELECT o.i, CASE WHEN list_contains(names, p_name) OR list_contains(sizes, p_size) THEN names ELSE list_append(names, p_name) END,
    CASE WHEN list_contains(names, p_name) OR list_contains(sizes, p_size) THEN sizes ELSE list_append(sizes, p_size) END, NOT (list_contains(names, p_name) OR list_contains(sizes, p_size)) FROM f JOIN o ON o.i = f.i + 1)
SELECT p_partkey, p_name, p_size FROM f JOIN o USING (i) WHERE ok""")
def con1_columns(spark, d):
    """Parts that load when name and size must each be unique, in order of their keys."""
    return constraints.unique_survivors(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), ["p_name", "p_size"], ["p_partkey"], stage)


@query("CON2_fk_cascade", """WITH n AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0), c AS (SELECT c_custkey FROM customer SEMI JOIN n ON c_nationkey = n_nationkey)
SELECT o_orderkey, o_custkey FROM orders ANTI JOIN c ON o_custkey = c_custkey""")
def con2(spark, d):
    nation = table(spark, d, "nation").filter("n_nationkey % 5 <> 0")
    customer = constraints.fk_survivors(table(spark, d, "customer"), "c_nationkey", nation, "n_nationkey")
    return constraints.fk_violations(table(spark, d, "orders"), "o_custkey", customer, "c_custkey").select("o_orderkey", "o_custkey")


@query("CON3_types", f"{BARE} SELECT p_partkey, 'size' AS bad_column FROM b WHERE {NUM} IS NULL")
def con3(spark, d):
    p = table(spark, d, "part").select("p_partkey", messy().alias("size"))
    return constraints.type_violations(p, {"size": "integer"}).select("p_partkey", "bad_column")


@query("CON4_load_report", """WITH b AS (SELECT 'part' AS table_name, count(*) AS offered, count(*) - count(DISTINCT p_name) AS skipped FROM part
  UNION ALL SELECT 'customer', count(*), count(*) FILTER (c_nationkey % 5 = 0) FROM customer) SELECT *, offered - skipped AS inserted FROM b""")
def con4(spark, d):
    part, customer = table(spark, d, "part"), table(spark, d, "customer")
    lost_part = constraints.unique_violations(part, "p_name", ["p_partkey"]).select(F.lit("part").alias("table_name"), F.lit("unique").alias("reason"))
    lost_customer = constraints.fk_violations(customer, "c_nationkey", table(spark, d, "nation").filter("n_nationkey % 5 <> 0"), "n_nationkey").select(F.lit("customer").alias("table_name"), F.lit("fk").alias("reason"))
    offered = part.select(F.lit("part").alias("table_name")).unionByName(customer.select(F.lit("customer").alias("table_name")))
    return constraints.load_report(offered, lost_part.unionByName(lost_customer))


def node_tables(spark: SparkSession, d: str) -> dict[str, graph.NodeTable]:
    link = graph.Link
    return {
        "region": graph.NodeTable(table(spark, d, "region").select("r_regionkey", "r_name"), {"r_name": "string"}, ("r_regionkey",)),
        "nation": graph.NodeTable(
            table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.upper("r_name").alias("region")),
            {"n_nationkey": "integer"}, ("n_nationkey",), (link("region", "region", "r_name", 0),),
        ),
        "customer": graph.NodeTable(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), {"c_custkey": "integer"}, ("c_custkey",), (link("c_nationkey", "nation", "n_nationkey", 1, "integer"),)),
        "orders": graph.NodeTable(table(spark, d, "orders").select("o_orderkey", "o_custkey"), {"o_orderkey": "integer"}, ("o_orderkey",), (link("o_custkey", "customer", "c_custkey", 2, "integer"),)),
    }


NODES = """nodes AS (SELECT 'region' AS t, 'pk:region:r_name=' || lower(r_name) AS k FROM region UNION ALL SELECT 'nation', 'pk:nation:n_nationkey=' || n_nationkey FROM nation
  UNION ALL SELECT 'customer', 'pk:customer:c_custkey=' || c_custkey FROM customer UNION ALL SELECT 'orders', 'pk:orders:o_orderkey=' || o_orderkey FROM orders)"""
EDGES = """edges AS (SELECT 'pk:nation:n_nationkey=' || n_nationkey AS src, 'pk:region:r_name=' || lower(r_name) AS dst, 'NATION_TO_REGION' AS type, 0 AS o FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'pk:customer:c_custkey=' || c_custkey, 'pk:nation:n_nationkey=' || n_nationkey, 'CUSTOMER_TO_NATION', 1 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'pk:orders:o_orderkey=' || o_orderkey, 'pk:customer:c_custkey=' || c_custkey, 'ORDERS_TO_CUSTOMER', 2 FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("ST3_nodes", f"WITH {NODES} SELECT 'job_1' AS job_scope, t AS table_name, k AS row_key FROM nodes")
def st3(spark, d):
    return graph.nodes(node_tables(spark, d), "job_1").select(F.col("__job_scope").alias("job_scope"), F.col("__table").alias("table_name"), F.col("__row_key").alias("row_key"))


@query("JN5_edges", f"WITH {EDGES} SELECT 'job_1' AS job_scope, src, dst, type, src || '|' || dst || '|' || o AS edge_key FROM edges")
def jn5(spark, d):
    return graph.graph_edges(node_tables(spark, d), "job_1").withColumnRenamed("__job_scope", "job_scope")


@query("AG18_graph_counts", f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM nodes) AS node_rows, (SELECT count(DISTINCT (t, k)) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def ag18(spark, d):
    t = node_tables(spark, d)
    return graph.graph_counts(graph.nodes(t, "job_1"), graph.graph_edges(t, "job_1"))


def uuid5_sql(name: str) -> str:
    """A version 5 UUID in SQL, by its definition."""
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || (['8', '9', 'a', 'b'])[CAST('0x' || substr({h}, 17, 1) AS INTEGER) % 4 + 1] || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query("SC15_row_keys", f"SELECT s_suppkey, 'row:' || {uuid5_sql("'supplier␟' || s_suppkey || '␟s_acctbal=' || s_acctbal || '␟s_name=' || s_name || '␟s_suppkey=' || s_suppkey")} AS row_key FROM supplier")
def sc15(spark, d):
    """Keys of rows without a natural key: UUIDs of their content and place."""
    t = graph.NodeTable(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), {}, ("s_suppkey",))
    return graph.with_keys("supplier", t).select("s_suppkey", F.col("__row_key").alias("row_key"))


@query("SNK3_points", f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS row_index FROM customer)
SELECT 'job_1' AS collection, row_index, {uuid5_sql("'customer␟' || row_index || '␟c_mktsegment=' || c_mktsegment || '␟c_name=' || c_name")} AS point_id,
  'table: customer' || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment AS text, '{{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}}' AS payload FROM p""")
def snk3(spark, d):
    return vectors.points(table(spark, d, "customer"), "customer", "job_1", ["c_name", "c_mktsegment"], ["c_nationkey", "c_custkey"])


@query("SC20_point_ids", f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS row_index FROM supplier)
SELECT 'job_1' AS collection, row_index, {uuid5_sql("'supplier␟' || row_index || '␟s_name=' || s_name || '␟s_suppkey=' || s_suppkey")} AS point_id,
  'table: supplier' || chr(10) || 's_suppkey: ' || s_suppkey || chr(10) || 's_name: ' || s_name AS text, '{{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}}' AS payload FROM p""")
def sc20(spark, d):
    return vectors.points(table(spark, d, "supplier"), "supplier", "job_1", ["s_suppkey", "s_name"], ["s_nationkey", "s_suppkey"])


COS = "(list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) / (sqrt(list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(a.embedding, lambda x: x::DOUBLE))) * sqrt(list_inner_product(list_transform(b.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)))))"


@query("TK1_topk", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def tk1(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.retrieve(e.withColumnRenamed("vec_id", "chunk_id"), e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))


@query("TK2_approx")
def tk2(spark, d):
    """TK1's queries by a kept index that is written once and opened again (tests measure the recall over all of them)."""
    e, path = table(spark, d, "embeddings"), shared_path(spark, "vector-index")
    VectorIndex.create(e.withColumnRenamed("vec_id", "chunk_id"), path)
    return VectorIndex(spark, path).search(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))


@query("CH3_retrieved_chunks", """WITH r AS (SELECT conv_id, turn, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, md5(text)) AS INTEGER) AS n FROM conversations)
SELECT conv_id AS query_id, n - 1 AS chunk_index, text, CASE WHEN turn % 4 = 0 THEN '' ELSE CAST(turn AS VARCHAR) END AS pages FROM r WHERE n <= 3""")
def ch3(spark, d):
    top = retrieved_turns(spark, d).withColumn("page_number", F.when(F.col("page_number") % 4 > 0, F.col("page_number")))
    return chunks_from_retrieval(top).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("E2E_targeted", rf"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM s),
m AS (SELECT query_id, rank - 1 AS chunk_index, unnest(regexp_extract_all(text, '{EMAIL}')) AS value, generate_subscripts(regexp_extract_all(text, '{EMAIL}'), 1) AS n FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 10)
SELECT query_id, arg_min(value, (chunk_index, n)) AS email, count(*) AS n_mentions FROM m GROUP BY query_id, lower(value)""")
def e2e_targeted(spark, d):
    """Targeted mode: the chunks nearest to each query (here whole documents, a vector each), contacts from these alone."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.lit(None).cast("int").alias("page_number"))
    found = chunks_from_retrieval(tk1(spark, d).join(texts, "chunk_id"))
    rows = extract.extract_regex(found, "contact", {"email": EMAIL}, "query_id").withColumn("email", F.col("row")["email"]).drop("row", "table_name")
    merged = reconcile.merge_by_natural_key(rows, [Declared("email", "string", True)], scope=("query_id",), counted="n_mentions")
    return merged.select("query_id", "email", "n_mentions")


def retrieved_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of a conversation, as retrieved chunks."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.md5(F.col("text").cast("binary")))
    top = table(spark, d, "conversations").withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    return top.select(F.col("conv_id").alias("query_id"), "rank", F.col("turn").alias("page_number"), F.col("text").alias("chunk_text"))


@query("TK3_context", """WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, md5(text)) AS n FROM conversations)
SELECT conv_id AS query_id, md5(string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY n)) AS context FROM r WHERE n <= 3 GROUP BY 1""")
def tk3(spark, d):
    return vectors.retrieval_context(retrieved_turns(spark, d)).withColumn("context", F.md5(F.col("context").cast("binary")))


@query("UD4_hash_embed")
def ud4(spark, d):
    """Whole vectors (tests hold them against plain loops)."""
    return vectors.hash_embed(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "embedding")


@query("ST5_missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def st5(spark, d):
    return vectors.missing_vectors(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("SNK2_graph", f"WITH {NODES} SELECT t AS table_name, count(*) AS n FROM nodes GROUP BY 1")
def snk2(spark, d):
    """The graph as the sink stores it, written twice."""
    t, path = node_tables(spark, d), shared_path(spark)
    sink = sinks.GraphSink(spark, path)
    for _ in range(2):
        sink.provision(t, "job_1")
    return sink.read("nodes").groupBy(F.col("__table").alias("table_name")).agg(F.count(F.lit(1)).alias("n"))


@query("SNK6_drop_output", f"WITH {NODES} SELECT 'job_1' AS job_scope, count(*) AS n FROM nodes")
def snk6(spark, d):
    t, path = node_tables(spark, d), shared_path(spark)
    sink = sinks.GraphSink(spark, path)
    for scope in ("job_1", "job_2"):
        sink.provision(t, scope)
    sink.delete_output("job_2")
    return sink.read("nodes").groupBy(F.col("__job_scope").alias("job_scope")).agg(F.count(F.lit(1)).alias("n"))


@query("SNK4_buckets", "SELECT CAST(l_suppkey AS VARCHAR) AS job_id, count(*) AS n FROM lineitem GROUP BY 1")
def snk4(spark, d):
    path = shared_path(spark)
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("job_id"), F.lit("lineitem").alias("table_name"), F.col("l_orderkey").alias("chunk_index"), F.col("l_linenumber").alias("row_no"))
    sinks.write_buckets(rows, path)
    return sinks.read_buckets(spark, path, "table_name string, job_id string").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


@query("SNK1_load_sql", """WITH p AS (SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) WHERE k = 1)
SELECT 'part' AS table_name, count(*) AS n FROM p UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM p)""")
def snk1(spark, d):
    """What the relational sink loads: parts of a unique name, then line items whose part was loaded."""
    part = table(spark, d, "part").select("p_partkey", "p_name", F.lit(0).alias("chunk_index"), F.col("p_partkey").alias("row_no"))
    item = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.lit(0).alias("chunk_index"), F.col("l_orderkey").alias("row_no"))
    sink = sinks.SqlSink(spark, {"part": ["p_name"]}, [("lineitem", "l_partkey", "part", "p_partkey")], materialise=stage)
    scope = "job_" + uuid.uuid4().hex
    try:
        loaded = sink.provision({"lineitem": item, "part": part}, scope)
    finally:
        sink.delete_output(scope)
    return spark.createDataFrame(list(loaded.items()), "table_name string, n long")  # a row a table


@query("UD5_fuzzy_entities", r"""WITH RECURSIVE t AS (SELECT DISTINCT p_name, '  ' || lower(trim(p_name)) || ' ' AS body FROM part WHERE p_name IS NOT NULL),
g AS (SELECT p_name, list_distinct(list_transform(range(1, length(body) - 1), lambda i: substring(body, i, 3))) AS grams FROM t), e AS (SELECT p_name, len(grams) AS n, unnest(grams) AS gram FROM g),
l AS (SELECT x.p_name AS a, y.p_name AS b FROM e x JOIN e y USING (gram) WHERE x.p_name <> y.p_name GROUP BY ALL HAVING count(*) >= 0.7::DOUBLE * (any_value(x.n) + any_value(y.n) - count(*)) - 0.000000001),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT p_name, least(p_name, min(b)) AS entity_id FROM t LEFT JOIN reach ON a = p_name GROUP BY p_name""")
def ud5_fuzzy(spark, d):
    """Part names by likeness, held against all pairs."""
    return reconcile.fuzzy_entities(table(spark, d, "part"), "p_name")


@query("MD7_schema", f"""WITH m AS (SELECT p_partkey, {MESSY} AS size, p_name, p_brand FROM part) SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 10 IN (5, 6, 9) THEN size END AS DOUBLE) AS size, p_brand AS brand FROM m""")
def md7(spark, d):
    """Rows as JSON, read back by the schema of their locked table; the brand links to another table and isn't declared."""
    part = table(spark, d, "part").withColumn("size", messy())
    number = F.when((F.col("p_partkey") % 10).isin(5, 6, 9), F.col("size")).try_cast("double")
    raw = part.select(F.to_json(F.struct("p_partkey", number.alias("size"), F.col("p_brand").alias("brand"))).alias("raw"))
    return raw.select(F.from_json("raw", model_to_schema([("p_partkey", "integer"), ("size", "float")], ["brand"])).alias("r")).select("r.*")


@query("UD6_custom_sink", "SELECT 'supplier' AS table_name, count(*) AS n FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation")
def ud6(spark, d):
    """A sink of a user's own, chosen by its name: it publishes every table as JSON rows."""

    class JsonSink:
        def __init__(self, path):
            self.published = Published(spark, path, "scope")

        def provision(self, tables, scope):
            self.published.replace(scope, {name: (t.select(F.to_json(F.struct("*")).alias("row")), []) for name, t in tables.items()})
            return {name: self.published.read(name, "row string", [scope]).count() for name in tables}

        def delete_output(self, scope):
            self.published.drop(scope)

    sink = sinks.sink_for("json", json=lambda: JsonSink(shared_path(spark, "json-sink")))
    loaded = sink.provision({t: table(spark, d, t) for t in ("supplier", "nation")}, "job_1")
    return spark.createDataFrame(list(loaded.items()), "table_name string, n long")  # a row a table

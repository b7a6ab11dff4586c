"""Queries over data models: one model per conversation, a table per turn; and models proposed from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe import schemas
from docframe.operators import model as M
from docframe.plans.registry import query, table
from docframe.sources import readers

KINDS = ("string", "integer", "float", "boolean", "date")


def models(spark: SparkSession, d: str) -> DataFrame:
    """A turn is a table named by its first word, its words are the columns, the first the key; each turn links to the one before."""
    words = F.split("text", " ")
    kind = lambda w: F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.length(w) % 5 + 1)
    columns = F.transform(words, lambda w, n: F.struct(w.alias("name"), kind(w).alias("type"), F.lit(None).cast("string").alias("description"), (n == 0).alias("is_primary_key")))
    turns = table(spark, d, "conversations").select(F.col("conv_id"), "turn", words[0].alias("first"), F.get(words, F.lit(1)).alias("second"), F.struct(words[0].alias("table_name"), F.col("role").alias("description"), columns.alias("columns")).alias("t"))
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "first", "second", "t"))).alias("ts"))
    links = F.transform(
        F.filter(F.transform("ts", lambda x, n: F.struct(x.alias("x"), F.get(F.col("ts"), n - 1).alias("p"), n.alias("n"))), lambda y: y["n"] > 0),
        lambda y: F.struct(
            y["x"]["first"].alias("source_table"), y["x"]["second"].alias("source_column"), y["p"]["first"].alias("references_table"),
            F.when(y["n"] % 3 == 0, y["p"]["second"]).otherwise(y["p"]["first"]).alias("references_column"), F.lit("natural_key").alias("link_basis"),
            F.array(y["x"]["second"]).alias("composite_key_columns"), F.lit(True).alias("nullable"), F.lit(True).alias("enabled"),
        ),
    )
    made = F.struct(F.lit("table_graph").alias("extraction_type"), F.transform("ts", lambda x: x["t"]).alias("tables"), links.alias("relationships"))
    return per.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("job_id"), made.cast(schemas.MODEL).alias("model"))


def snake(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


RAW = """
tu AS (SELECT 'conv-' || conv_id AS job_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS table_no, role, string_split(text, ' ') AS w FROM conversations),
tables_ AS (SELECT job_id, table_no, w[1] AS table_name, w[2] AS second, role FROM tu),
c0 AS (SELECT job_id, table_no, w[1] AS table_name, unnest(w) AS column_name, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS column_no FROM tu),
columns_ AS (SELECT *, ['string','integer','float','boolean','date'][length(column_name) % 5 + 1] AS type, column_no = 0 AS is_primary_key FROM c0),
rels AS (SELECT a.job_id, a.table_no - 1 AS rel_no, a.table_name AS source_table, a.second AS source_column, b.table_name AS references_table,
  CASE WHEN a.table_no % 3 = 0 THEN b.second ELSE b.table_name END AS references_column FROM tables_ a JOIN tables_ b ON a.job_id = b.job_id AND a.table_no = b.table_no + 1)"""
NORMAL = f"""{RAW},
nt AS (SELECT job_id, table_no, {snake('table_name')} AS table_name FROM tables_),
nc AS (SELECT job_id, table_no, {snake('table_name')} AS table_name, column_no, {snake('column_name')} AS column_name, type, is_primary_key FROM columns_),
nr AS (SELECT job_id, rel_no, {snake('source_table')} AS source_table, {snake('source_column')} AS source_column, {snake('references_table')} AS references_table, {snake('references_column')} AS references_column FROM rels)"""
_RESERVED = ", ".join(f"'{w}'" for w in M.RESERVED)
_BAD = "CASE WHEN coalesce({0}, '') = '' THEN 'empty' WHEN regexp_matches({0}, '^[0-9]') THEN 'starts with a digit' WHEN {0} IN (" + _RESERVED + ") THEN 'reserved word'{1} END"
DOWNGRADED = f"""{NORMAL},
pk AS (SELECT job_id, table_name, column_name, max(is_primary_key) AS pk FROM nc GROUP BY ALL),
dr AS (SELECT nr.*, CASE
  WHEN NOT EXISTS (SELECT 1 FROM nt t WHERE t.job_id = nr.job_id AND t.table_name = source_table) THEN 'relationship downgraded: source_table ''' || source_table || ''' not in model'
  WHEN NOT EXISTS (SELECT 1 FROM nt t WHERE t.job_id = nr.job_id AND t.table_name = references_table) THEN 'relationship downgraded: references_table ''' || references_table || ''' not in model'
  WHEN s.pk IS NULL THEN 'relationship downgraded: column ' || source_table || '.' || source_column || ' not declared'
  WHEN r.pk IS NULL THEN 'relationship downgraded: column ' || references_table || '.' || references_column || ' not declared'
  WHEN NOT r.pk THEN 'relationship downgraded: ' || references_table || '.' || references_column || ' is no key by itself' END AS note
  FROM nr LEFT JOIN pk s ON s.job_id = nr.job_id AND s.table_name = source_table AND s.column_name = source_column
  LEFT JOIN pk r ON r.job_id = nr.job_id AND r.table_name = references_table AND r.column_name = references_column)"""


@query("MD1_columns", f"WITH {RAW} SELECT job_id, table_no, table_name, column_no, column_name, type, CAST(is_primary_key AS INTEGER) AS is_primary_key FROM columns_")
def md1(spark, d):
    return M.model_columns(models(spark, d)).withColumn("is_primary_key", F.col("is_primary_key").cast("int"))


@query("MD1_relationships", f"WITH {RAW} SELECT * FROM rels")
def md1_relationships(spark, d):
    return M.model_relationships(models(spark, d)).select("job_id", "rel_no", "source_table", "source_column", "references_table", "references_column")


@query("MD2_normalized", f"WITH {NORMAL} SELECT job_id, table_no, table_name, column_no, column_name FROM nc")
def md2(spark, d):
    return M.model_columns(M.normalize_identifiers(models(spark, d))).select("job_id", "table_no", "table_name", "column_no", "column_name")


@query("MD3_identifier_errors", f"""WITH {NORMAL}, e AS (
  SELECT job_id, 'table' AS kind, table_name, NULL AS column_name, {_BAD.format('table_name', '')} AS problem FROM nt
  UNION ALL SELECT job_id, 'column', table_name, column_name, {_BAD.format('column_name', " WHEN column_name IN ('id', 'source_page_numbers', 'extraction_confidence', 'reconciliation_notes') THEN 'reserved for provenance'")} FROM nc
  UNION ALL SELECT job_id, 'table', table_name, NULL, 'duplicate' FROM nt GROUP BY job_id, table_name HAVING count(*) > 1
  UNION ALL SELECT job_id, 'column', table_name, column_name, 'duplicate' FROM nc GROUP BY job_id, table_no, table_name, column_name HAVING count(*) > 1
) SELECT * FROM e WHERE problem IS NOT NULL""")
def md3(spark, d):
    return M.identifier_errors(M.normalize_identifiers(models(spark, d)))


@query("MD4_downgrade", f"WITH {DOWNGRADED} SELECT job_id, rel_no, source_table, source_column, references_table, references_column, CAST(note IS NULL AS INTEGER) AS enabled, note FROM dr")
def md4(spark, d):
    return M.downgrade_relationships(M.normalize_identifiers(models(spark, d))).withColumn("enabled", F.col("enabled").cast("int"))


@query("MD5_ddl", f"""WITH {DOWNGRADED}, s AS (
  SELECT job_id, 0 AS part, table_no AS a, 0 AS b, 'CREATE TABLE "job_' || replace(job_id, '-', '_') || '"."' || table_name || '" (' || chr(10) || '    "id" BIGSERIAL PRIMARY KEY,' || chr(10) || '    ' ||
    string_agg('"' || column_name || '" ' || CASE type WHEN 'integer' THEN 'BIGINT' WHEN 'float' THEN 'NUMERIC' WHEN 'boolean' THEN 'BOOLEAN' WHEN 'date' THEN 'DATE' ELSE 'TEXT' END, ',' || chr(10) || '    ' ORDER BY column_no)
    || ',' || chr(10) || '    "source_page_numbers" JSONB,' || chr(10) || '    "extraction_confidence" NUMERIC,' || chr(10) || '    "reconciliation_notes" TEXT' || chr(10) || ')' AS line
  FROM nc GROUP BY job_id, table_no, table_name
  UNION ALL SELECT job_id, 1, table_no, column_no, 'ALTER TABLE "job_' || replace(job_id, '-', '_') || '"."' || table_name || '" ADD CONSTRAINT "uq_' || table_name || '_' || column_name || '" UNIQUE ("' || column_name || '")' FROM nc WHERE is_primary_key
  UNION ALL SELECT job_id, 2, rel_no, 0, 'ALTER TABLE "job_' || replace(job_id, '-', '_') || '"."' || source_table || '" ADD CONSTRAINT "fk_' || source_table || '_' || source_column || '_' || rel_no || '" FOREIGN KEY ("' || source_column
    || '") REFERENCES "job_' || replace(job_id, '-', '_') || '"."' || references_table || '" ("' || references_column || '")' FROM dr WHERE note IS NULL
) SELECT job_id, md5(string_agg(line, ';' || chr(10) ORDER BY part, a, b)) AS ddl FROM s GROUP BY job_id""")
def md5_ddl(spark, d):
    m = M.normalize_identifiers(models(spark, d))
    return M.render_ddl(m, M.downgrade_relationships(m)).withColumn("ddl", F.md5(F.col("ddl").cast("binary")))


@query("MD6_load_order", f"""WITH RECURSIVE {DOWNGRADED}, t AS (SELECT job_id, table_name, min(table_no) AS table_no FROM nt GROUP BY ALL), n AS (SELECT job_id, count(*) AS n FROM t GROUP BY job_id),
ed AS (SELECT DISTINCT job_id, source_table AS child, references_table AS parent FROM dr WHERE note IS NULL AND source_table <> references_table),
de AS (SELECT job_id, table_name, 0 AS depth FROM t UNION SELECT ed.job_id, ed.child, depth + 1 FROM de JOIN ed ON ed.job_id = de.job_id AND ed.parent = de.table_name JOIN n ON n.job_id = de.job_id WHERE depth < n),
m AS (SELECT job_id, table_name, max(depth) AS depth FROM de GROUP BY ALL),
o AS (SELECT t.*, CASE WHEN max(depth) OVER (PARTITION BY t.job_id) < n THEN depth END AS depth FROM t JOIN m USING (job_id, table_name) JOIN n USING (job_id))
SELECT job_id, table_name, table_no, depth, CAST(row_number() OVER (PARTITION BY job_id ORDER BY depth NULLS FIRST, table_no) AS INTEGER) AS load_no FROM o""")
def md6(spark, d):
    m = M.normalize_identifiers(models(spark, d))
    return M.load_order(m, M.downgrade_relationships(m))


@query("MD10_remove_table", f"""WITH {RAW}, f AS (SELECT job_id, table_name AS gone FROM tables_ WHERE table_no = 0)
SELECT f.job_id, (SELECT count(*) FROM tables_ t WHERE t.job_id = f.job_id AND table_name <> gone) AS n_tables, (SELECT count(*) FROM rels r WHERE r.job_id = f.job_id AND source_table <> gone AND references_table <> gone) AS n_relationships FROM f""")
def md10(spark, d):
    m = M.remove_table(models(spark, d), F.col("model.tables")[0]["table_name"])
    return m.select("job_id", F.size("model.tables").cast("long").alias("n_tables"), F.size("model.relationships").cast("long").alias("n_relationships"))


@query("MD11_local_errors", f"""WITH {RAW}
SELECT job_id, 'duplicate table' AS problem, lower(trim(table_name)) AS name FROM tables_ WHERE trim(table_name) <> '' GROUP BY job_id, lower(trim(table_name)) HAVING count(*) > 1
UNION ALL SELECT job_id, 'duplicate column', table_name || '.' || lower(trim(column_name)) FROM columns_ WHERE trim(column_name) <> '' GROUP BY job_id, table_no, table_name, lower(trim(column_name)) HAVING count(*) > 1
UNION ALL SELECT job_id, 'column without a name', table_name FROM columns_ WHERE trim(column_name) = ''
UNION ALL SELECT job_id, 'table without a name', '' FROM tables_ WHERE trim(table_name) = ''""")
def md11(spark, d):
    return M.local_errors(models(spark, d))


@query("SRC5_parse_models", f"WITH {RAW} SELECT job_id, CASE WHEN right(job_id, 1) = '3' THEN NULL ELSE count(*) END AS n_tables, CASE WHEN right(job_id, 1) = '3' THEN 'not json' END AS corrupt FROM tables_ GROUP BY job_id")
def src5(spark, d):
    text = models(spark, d).select("job_id", F.when(F.col("job_id").endswith("3"), "not json").otherwise(F.to_json("model")).alias("model"))
    return readers.parse_models(text).select("job_id", F.when(F.col("corrupt").isNull(), F.size("parsed.tables")).cast("long").alias("n_tables"), "corrupt")


@query("JN7_link_targets", f"WITH {DOWNGRADED} SELECT job_id, source_table AS table_name, source_column, references_table, references_column FROM dr WHERE note IS NULL")
def jn7(spark, d):
    from docframe.operators.extract import link_targets

    return link_targets(M.downgrade_relationships(M.normalize_identifiers(models(spark, d))))


# all columns of these tables
SOURCES = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "benchmark": ("item_id", "text"), "labels": ("doc_id", "quality", "toxic"), "conversations": ("conv_id", "turn", "role", "text"),
}
#: Its key has two columns.
PAIRED = "conversations"


def sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in SOURCES}


_NUM = r"CASE WHEN regexp_matches(v, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST(v AS DOUBLE) END"
_UNIQUE = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS column_no, count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AND count(*) > 0 AS u FROM {t}" for t, cols in SOURCES.items() for k, c in enumerate(cols))
_PAIRS = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, count({a}) = count(*) AND count({b}) = count(*) AND count(DISTINCT ({a}, {b})) = count(*) AS u FROM {PAIRED}" for i, a in enumerate(SOURCES[PAIRED]) for j, b in enumerate(SOURCES[PAIRED]) if i < j
)
_FACTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS column_no, '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cols in SOURCES.items() for k, c in enumerate(cols))


@query("MD8_propose_model", rf"""WITH v AS ({_FACTS}), u AS ({_UNIQUE}), k AS (SELECT table_name, min(column_no) AS key FROM u WHERE u GROUP BY 1), p AS (SELECT min((i, j)) AS key FROM ({_PAIRS}) WHERE u),
f AS (SELECT table_name, column_no, column_name, count(v) AS n, count(DISTINCT v) AS dv, count({_NUM}) AS nums, count(*) FILTER (({_NUM}) <> trunc({_NUM})) AS frac,
  count(*) FILTER (lower(v) IN ('true','t','yes','y','1','false','f','no','n','0')) AS bools, count(*) FILTER (regexp_matches(v, '\d{{4}}-\d{{1,2}}-\d{{1,2}}')) AS dates FROM v GROUP BY ALL)
SELECT table_name, column_name, CASE WHEN bools = n AND dv <= 2 AND NOT (nums = n AND frac = 0) THEN 'boolean' WHEN nums = n AND frac = 0 THEN 'integer' WHEN nums = n THEN 'float' WHEN dates = n THEN 'date' ELSE 'string' END AS type,
  CAST(CASE WHEN k.key IS NOT NULL THEN column_no = k.key ELSE f.table_name = '{PAIRED}' AND coalesce(column_no = p.key[1] OR column_no = p.key[2], false) END AS INTEGER) AS is_primary_key FROM f LEFT JOIN k USING (table_name), p""")
def md8(spark, d):
    return M.propose_columns(sources(spark, d)).select("table_name", "column_name", "type", F.col("is_primary_key").cast("int").alias("is_primary_key"))


_TYPED = rf"""v AS ({_FACTS}), u AS ({_UNIQUE}), k AS (SELECT table_name, min(column_no) AS key FROM u WHERE u GROUP BY 1), p AS (SELECT min((i, j)) AS key FROM ({_PAIRS}) WHERE u),
f AS (SELECT table_name, column_no, column_name, count(v) AS n, count(DISTINCT v) AS dv, count({_NUM}) AS nums, count(*) FILTER (({_NUM}) <> trunc({_NUM})) AS frac,
  count(*) FILTER (lower(v) IN ('true','t','yes','y','1','false','f','no','n','0')) AS bools, count(*) FILTER (regexp_matches(v, '\d{{4}}-\d{{1,2}}-\d{{1,2}}')) AS dates FROM v GROUP BY ALL),
ty AS (SELECT table_name, column_no, column_name, CASE WHEN bools = n AND dv <= 2 AND NOT (nums = n AND frac = 0) THEN 'boolean' WHEN nums = n AND frac = 0 THEN 'integer' WHEN nums = n THEN 'float' WHEN dates = n THEN 'date' ELSE 'string' END AS type,
  CASE WHEN k.key IS NOT NULL THEN column_no = k.key ELSE f.table_name = '{PAIRED}' AND coalesce(column_no = p.key[1] OR column_no = p.key[2], false) END AS pk FROM f LEFT JOIN k USING (table_name), p)"""
_BOTH = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{a}' AS a, '{b}' AS b, CAST({a} AS VARCHAR) AS va, CAST({b} AS VARCHAR) AS vb FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for t, cols in SOURCES.items() for a in cols for b in cols if a != b)
_TAIL = "regexp_replace(lower({}), '^[^_]*_', '')"


def _names_agree(column: str, parent: str, key: str) -> str:
    return f"({_TAIL.format(column)} = {_TAIL.format(key)} OR contains(lower({column}), regexp_replace(lower({parent}), 's+$', '')))"


_LINKED = f"""{_TYPED}, nk AS (SELECT table_name, count(*) AS n_columns FROM ty WHERE pk GROUP BY 1),
d AS (SELECT DISTINCT table_name, column_name, type, pk, v FROM v JOIN ty USING (table_name, column_name) WHERE v IS NOT NULL), n AS (SELECT table_name, column_name, count(*) AS n FROM d GROUP BY ALL),
one AS (SELECT a.table_name AS st, a.column_name AS sc, b.table_name AS rt, b.column_name AS rc, any_value(a.pk) AS a_key, count(*) AS m FROM d a JOIN d b ON a.type = b.type AND a.v = b.v AND b.pk AND (a.table_name, a.column_name) <> (b.table_name, b.column_name) JOIN nk ON nk.table_name = b.table_name AND n_columns = 1 GROUP BY ALL),
single AS (SELECT st, sc, rt, rc, m AS n_values, y.n AS n_keys, a_key, {_names_agree("sc", "rt", "rc")} AS alike FROM one JOIN n x ON x.table_name = st AND x.column_name = sc AND x.n = m JOIN n y ON y.table_name = rt AND y.column_name = rc)"""


@query("MD8_inclusions", f"""WITH {_LINKED}, two AS ({_BOTH}), kinds AS (SELECT two.*, x.type AS ta, y.type AS tb FROM two JOIN ty x ON x.table_name = t AND x.column_name = a JOIN ty y ON y.table_name = t AND y.column_name = b),
key2 AS (SELECT t.table_name AS rt, min(t.column_name) FILTER (t.column_no = p.key[1]) AS ra, min(t.column_name) FILTER (t.column_no = p.key[2]) AS rb FROM ty t JOIN nk USING (table_name), p WHERE pk AND n_columns = 2 GROUP BY 1),
n2 AS (SELECT t, a, b, count(*) AS n FROM two GROUP BY ALL),
pairs AS (SELECT x.t, x.a, x.b, rt, ra, rb, count(*) AS m FROM kinds x JOIN kinds y ON x.va = y.va AND x.vb = y.vb AND x.ta = y.ta AND x.tb = y.tb JOIN key2 ON y.t = rt AND y.a = ra AND y.b = rb WHERE (x.t, x.a, x.b) <> (rt, ra, rb) GROUP BY ALL)
SELECT st AS source_table, sc AS source_columns, rt AS references_table, rc AS references_columns, n_values, n_keys, CAST(alike AS INTEGER) AS alike FROM single
UNION ALL SELECT pairs.t, pairs.a || ', ' || pairs.b, rt, ra || ', ' || rb, m, k.n, CAST({_names_agree("pairs.a", "rt", "ra")} AND {_names_agree("pairs.b", "rt", "rb")} AS INTEGER)
FROM pairs JOIN n2 c ON c.t = pairs.t AND c.a = pairs.a AND c.b = pairs.b AND c.n = m JOIN n2 k ON k.t = rt AND k.a = ra AND k.b = rb""")
def md8_inclusions(spark, d):
    """All columns, and pairs of columns, whose values are all values of a key."""
    t = sources(spark, d)
    names = [F.array_join(c, ", ").alias(c) for c in ("source_columns", "references_columns")]
    return M.propose_links(t, M.propose_columns(t)).select("source_table", names[0], "references_table", names[1], "n_values", "n_keys", F.col("alike").cast("int").alias("alike"))


@query("MD8_propose_links", f"""WITH {_LINKED} SELECT st AS source_table, sc AS source_column, rt AS references_table, rc AS references_column FROM single WHERE alike OR (NOT a_key AND n_values / n_keys >= 0.5)
QUALIFY row_number() OVER (PARTITION BY st, sc ORDER BY alike DESC, n_values / n_keys DESC, rt) = 1""")
def md8_links(spark, d):
    t = sources(spark, d)
    return M.propose_relationships(t, M.propose_columns(t))


@query("UD2_custom_proposer", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {k} AS column_no, (SELECT count(*) FROM {t}) AS n_rows" for t, cols in SOURCES.items() for k, c in enumerate(cols)))
def ud2(spark, d):
    """A user's proposer: a table for each source, all columns texts, its description the number of rows."""

    def propose(tables):
        one = None
        for no, (name, df) in enumerate(tables.items()):
            columns = F.array(*[F.struct(F.lit(c).alias("name"), F.lit("string").alias("type"), F.lit(None).cast("string").alias("description"), F.lit(False).alias("is_primary_key")) for c in df.columns])
            row = df.agg(F.count(F.lit(1)).cast("string").alias("description")).select(F.lit(no).alias("no"), F.struct(F.lit(name).alias("table_name"), "description", columns.alias("columns")).alias("t"))
            one = row if one is None else one.unionByName(row)
        kept = one.agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "t"))), lambda x: x["t"]).alias("tables"))  # a row a table
        return kept.select(F.lit("j").alias("job_id"), F.struct(F.lit("table_graph"), "tables", F.array().cast("array<struct<a:string,b:string,c:string,d:string,e:string,f:array<string>,g:boolean,h:boolean>>")).cast(schemas.MODEL).alias("model"))

    model = M.propose_model(sources(spark, d), "j", propose)
    rows = M.model_tables(model).join(M.model_columns(model), ["job_id", "table_name"])
    return rows.select("table_name", "column_name", "column_no", F.col("description").cast("long").alias("n_rows"))

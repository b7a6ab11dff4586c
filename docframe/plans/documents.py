"""Queries from documents and web pages: regions, pages, profiles, chunks, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe.functions.scalars import cap_context, coerce, page_markers
from docframe.operators import extract, reconcile, text
from docframe.operators.jobs import table_counts
from docframe.plans.registry import query, table
from docframe.sources import readers

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"

REGIONS = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
regions AS (
  SELECT doc_id, CAST(line // 10 + 1 AS INTEGER) AS page_number, CAST(line % 10 AS INTEGER) AS region_no, 'text' AS region_type,
         regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text
  FROM l WHERE regexp_replace(raw, '^\s+|\s+$', '', 'g') <> ''
)"""
PAGES = REGIONS + r""",
pages_ AS (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY region_no) AS page_text FROM regions GROUP BY ALL)"""
TEXTS = PAGES + r""",
texts AS (
  SELECT doc_id, string_agg('--- Page ' || page_number || ' ---' || chr(10) || page_text, chr(10) || chr(10) ORDER BY page_number) AS full_text,
         count(*) AS page_count
  FROM pages_ GROUP BY doc_id
)"""
_TAGS = " UNION ALL ".join(
    f"SELECT page_id AS doc_id, '{kind}' AS region_type, {k} AS tag, unnest(regexp_extract_all(html, '(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>', 1)) AS raw,"
    f" generate_subscripts(regexp_extract_all(html, '(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>', 1), 1) AS n FROM pages"
    for k, (tag, kind) in enumerate(readers.TAGS)
)
HTML = rf"""
h AS (SELECT doc_id, region_type, tag, n, regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM ({_TAGS})),
html_regions AS (
  SELECT doc_id, 1 AS page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tag, n) - 1 AS INTEGER) AS region_no, region_type, text
  FROM h WHERE text <> ''
)"""
CHUNKS = TEXTS + r""",
paras AS (
  SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS i, len(p) AS n FROM (
    SELECT doc_id, regexp_split_to_array(regexp_replace(full_text, '(--- Page \d+)', chr(1) || '\1', 'g'), '\n\n+|\x01') AS p
    FROM texts WHERE length(full_text) > 3000)
), trimmed AS (
  SELECT doc_id, i, n, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS p FROM paras
), fold AS (
  WITH RECURSIVE f AS (
    SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS cur, CAST(0 AS BIGINT) AS start_char, CAST(0 AS BIGINT) AS pos,
           CAST(NULL AS VARCHAR) AS out_text, CAST(NULL AS BIGINT) AS out_start, CAST(NULL AS BIGINT) AS out_end
    FROM (SELECT DISTINCT doc_id FROM trimmed)
    UNION ALL
    SELECT f.doc_id, t.i,
           CASE WHEN t.p = '' THEN cur WHEN cur = '' THEN t.p
                WHEN length(cur) + length(t.p) + 2 > 3000 THEN (CASE WHEN length(cur) > 500 THEN right(cur, 500) ELSE cur END) || chr(10) || chr(10) || t.p
                ELSE cur || chr(10) || chr(10) || t.p END,
           CASE WHEN t.p = '' THEN start_char WHEN cur = '' THEN pos
                WHEN length(cur) + length(t.p) + 2 > 3000 THEN greatest(0, pos - 500) ELSE start_char END,
           pos + length(t.p) + 2,
           CASE WHEN t.p <> '' AND cur <> '' AND length(cur) + length(t.p) + 2 > 3000 THEN cur END,
           CASE WHEN t.p <> '' AND cur <> '' AND length(cur) + length(t.p) + 2 > 3000 THEN start_char END,
           CASE WHEN t.p <> '' AND cur <> '' AND length(cur) + length(t.p) + 2 > 3000 THEN pos END
    FROM f JOIN trimmed t ON t.doc_id = f.doc_id AND t.i = f.i + 1
  ) SELECT * FROM f
), folded AS (
  SELECT doc_id, i, out_text AS raw, out_start AS start_char, out_end AS end_char FROM fold WHERE out_text IS NOT NULL
  UNION ALL
  SELECT f.doc_id, f.i + 1, cur, start_char, pos FROM fold f JOIN (SELECT doc_id, max(n) AS n FROM trimmed GROUP BY doc_id) e ON e.doc_id = f.doc_id AND e.n = f.i
  WHERE regexp_replace(cur, '^\s+|\s+$', '', 'g') <> ''
), chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index,
         regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char
  FROM folded
  UNION ALL
  SELECT doc_id, 0, full_text, 0, CAST(length(full_text) AS INTEGER) FROM texts WHERE length(full_text) <= 3000
)"""
PAGE_LIST = r"list_reduce(list_prepend('', list_transform(regexp_extract_all({0}, '--- Page (\d+) ---', 1), lambda x: x)), lambda a, b: CASE WHEN contains(',' || a || ',', ',' || b || ',') THEN a WHEN a = '' THEN b ELSE a || ',' || b END)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.regions_from_text(table(spark, sf_dir, "documents"))


def html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.regions_from_html(table(spark, sf_dir, "pages"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.full_text(text.page_text(regions(spark, sf_dir)))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_paragraphs(texts(spark, sf_dir))


def digest(df: DataFrame, column: str) -> DataFrame:
    """A long text as its md5."""
    return df.withColumn(column, F.md5(F.col(column).cast("binary")))


@query("SRC3_regions", f"WITH {REGIONS} SELECT * FROM regions")
def src3(spark, d):
    return regions(spark, d).select("doc_id", "page_number", "region_no", "region_type", "text")


@query("SRC4_html_regions", f"WITH {HTML} SELECT * FROM html_regions")
def src4(spark, d):
    return html_regions(spark, d).select("doc_id", "page_number", "region_no", "region_type", "text")


@query("SRC1_uploads", """SELECT path, length, extension, extension IN ('pdf','png','jpg','jpeg','tiff','bmp','webp') AND length <= 104857600 AS accepted FROM (
  SELECT source || '/' || doc_id || '.' || CASE doc_id % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'png' ELSE 'txt' END AS path, n_chars * 10000 AS length,
         CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' ELSE 'txt' END AS extension FROM documents)""")
def src1(spark, d):
    ext = F.when(F.col("doc_id") % 3 == 0, "PDF").when(F.col("doc_id") % 3 == 1, "png").otherwise("txt")
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), (F.col("n_chars") * 10000).alias("length"))
    return readers.check_uploads(files)


@query("SRC2_layout_regions", f"WITH {REGIONS} SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY region_no) - 1 AS INTEGER) AS region_no, region_type, text FROM regions")
def src2(spark, d):
    r = regions(spark, d)
    region = F.struct(F.col("region_type"), F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("text"), F.col("confidence"))
    pages = r.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("region_no", region.alias("r")))), lambda s: s["r"]).alias("regions"))
    layouts = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page_number", "regions")).alias("pages"))
    return readers.explode_layout(layouts, "doc_id").select("doc_id", "page_number", "region_no", "region_type", "text")


@query("FLT1_route", f"""WITH {PAGES}, t AS (SELECT *, CAST(page_number % 2 AS INTEGER) AS images FROM pages_)
SELECT doc_id, page_number, CASE WHEN length(regexp_replace(page_text, '[^a-zA-Z0-9]', '', 'g')) / CAST(length(page_text) AS DOUBLE) < 0.4
  OR (images >= 1 AND length(page_text) < 100) THEN 'ocr' ELSE 'native' END AS route FROM t""")
def flt1(spark, d):
    return text.page_text(regions(spark, d)).select("doc_id", "page_number", text.route_page(F.col("page_text"), F.col("page_number") % 2).alias("route"))


@query("AG16_route_counts", f"""WITH {PAGES}, r AS (SELECT doc_id, CASE WHEN length(regexp_replace(page_text, '[^a-zA-Z0-9]', '', 'g')) / CAST(length(page_text) AS DOUBLE) < 0.4
  OR (page_number % 2 >= 1 AND length(page_text) < 100) THEN 'ocr' ELSE 'native' END AS route FROM pages_)
SELECT doc_id, count(*) FILTER (route = 'native') AS native_pages, count(*) FILTER (route = 'ocr') AS ocr_pages FROM r GROUP BY doc_id""")
def ag16(spark, d):
    return text.route_counts(flt1(spark, d))


@query("FLT2_nonblank_turns", r"SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def flt2(spark, d):
    return text.drop_blank_regions(table(spark, d, "conversations")).select("conv_id", "turn", "text")


@query("FLT3_region_types", "SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 3 = 0 THEN '' ELSE role END, ''), 'unknown') AS region_type FROM conversations")
def flt3(spark, d):
    role = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.coalesce_region_type(role).alias("region_type"))


@query("FLT8_cap_context", f"WITH {TEXTS} SELECT doc_id, md5(substr(full_text, 1, 16000)) AS context FROM texts")
def flt8(spark, d):
    return texts(spark, d).select("doc_id", F.md5(cap_context(F.col("full_text")).cast("binary")).alias("context"))


@query("WN1_reading_order", f"WITH {HTML} SELECT doc_id, region_no, region_type, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY length(text) % 7, region_no) AS INTEGER) AS position FROM html_regions")
def wn1(spark, d):
    moved = html_regions(spark, d).withColumn("y1", F.length("text") % 7).withColumn("x1", F.lit(0))
    return text.reading_order(moved).select("doc_id", "region_no", "region_type", "position")


@query("AG1_histogram", f"WITH {HTML} SELECT doc_id, region_type, count(*) AS n FROM html_regions GROUP BY ALL")
def ag1(spark, d):
    return text.region_histogram(html_regions(spark, d))


@query("AG2_diversity", f"WITH {HTML} SELECT doc_id, page_number, count(DISTINCT region_type) AS n_types FROM html_regions GROUP BY ALL")
def ag2(spark, d):
    return text.page_diversity(html_regions(spark, d))


@query("AG3_page_text", f"WITH {PAGES} SELECT doc_id, page_number, md5(page_text) AS page_text FROM pages_")
def ag3(spark, d):
    return digest(text.page_text(regions(spark, d)), "page_text")


@query("AG4_full_text", f"WITH {TEXTS} SELECT doc_id, md5(full_text) AS full_text, page_count FROM texts")
def ag4(spark, d):
    return digest(texts(spark, d), "full_text")


SAMPLED = """
p AS (SELECT doc_id, page_number, count(DISTINCT region_type) AS n_types FROM regions GROUP BY ALL),
q AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS i FROM p),
r AS (SELECT *, i <= 3 OR i > n - 2 AS edge, i > 3 AND i < n - 1 AS inside FROM q),
s AS (SELECT *, edge OR (inside AND row_number() OVER (PARTITION BY doc_id, inside ORDER BY n_types DESC, i) <= 3) AS picked FROM r),
t AS (SELECT *, 15 - count(*) FILTER (picked) OVER (PARTITION BY doc_id) AS free FROM s),
u AS (SELECT *, NOT picked AND i % greatest(1, n // (free + 1)) = 0 AS filler FROM t),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, filler ORDER BY i) AS nth FROM u),
sampled AS (SELECT doc_id, page_number FROM v WHERE n <= 15 OR picked OR (filler AND nth <= free))"""


@query("TK4_sample_pages", f"WITH {REGIONS}, {SAMPLED} SELECT * FROM sampled")
def tk4(spark, d):
    return text.sample_pages(text.page_diversity(regions(spark, d)))


@query("AG5_context", f"""WITH {REGIONS}, {SAMPLED}, b AS (
  SELECT doc_id, page_number, '--- Page ' || page_number || ' (types: text) ---' || chr(10) || string_agg(text, chr(10) ORDER BY region_no) AS block
  FROM regions SEMI JOIN sampled USING (doc_id, page_number) GROUP BY doc_id, page_number)
SELECT doc_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY page_number)) AS context FROM b GROUP BY doc_id""")
def ag5(spark, d):
    r = regions(spark, d)
    return digest(text.profile_context(r, text.sample_pages(text.page_diversity(r))), "context")


@query("MD9_profile", f"""WITH {REGIONS}, {SAMPLED} SELECT doc_id, count(DISTINCT page_number) AS total_pages, (SELECT string_agg(page_number, ',' ORDER BY page_number) FROM sampled x WHERE x.doc_id = regions.doc_id) AS sampled_pages,
  count(*) AS n_text FROM regions GROUP BY doc_id""")
def md9(spark, d):
    p = text.build_profile(regions(spark, d))
    return p.select("doc_id", "total_pages", F.array_join(F.col("sampled_pages").cast("array<string>"), ",").alias("sampled_pages"), F.col("region_summary")["text"].alias("n_text"))


@query("CH1_paragraph_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_index, md5(text) AS text, start_char, end_char FROM chunks")
def ch1(spark, d):
    return digest(chunks(spark, d), "text").drop("pages")


LINES = TEXTS + r""",
lines AS (SELECT doc_id, unnest(string_split(full_text, chr(10))) AS raw, generate_subscripts(string_split(full_text, chr(10)), 1) AS k FROM texts),
kept AS (
  SELECT doc_id, k, t, t LIKE '--- Page %' AND t LIKE '%---' AS marker, TRY_CAST(nullif(regexp_extract(t, '^--- Page ([0-9]+)-* ?', 1), '') AS INTEGER) AS page
  FROM (SELECT doc_id, k, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM lines) WHERE t <> ''
), body AS (
  SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, page FROM (
    SELECT doc_id, k, t, marker, coalesce(last_value(CASE WHEN marker THEN page END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS page FROM kept)
  WHERE NOT marker
), ends AS (SELECT doc_id, max(i) AS n FROM body GROUP BY doc_id), fold2 AS (
  WITH RECURSIVE f AS (
    SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS cur, CAST(NULL AS VARCHAR) AS out_text, CAST(NULL AS INTEGER) AS out_page, 1 AS page FROM ends
    UNION ALL
    SELECT f.doc_id, b.i,
           CASE WHEN cur = '' THEN b.t WHEN length(cur) + length(b.t) + 1 > 2000 THEN (CASE WHEN length(cur) > 200 THEN right(cur, 200) ELSE cur END) || chr(10) || b.t ELSE cur || chr(10) || b.t END,
           CASE WHEN cur <> '' AND length(cur) + length(b.t) + 1 > 2000 THEN cur END, CASE WHEN cur <> '' AND length(cur) + length(b.t) + 1 > 2000 THEN b.page END, b.page
    FROM f JOIN body b ON b.doc_id = f.doc_id AND b.i = f.i + 1
  ) SELECT * FROM f
), line_chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, regexp_replace(t, '^\s+|\s+$', '', 'g') AS chunk_text, page AS page_number FROM (
    SELECT doc_id, i, out_text AS t, out_page AS page FROM fold2 WHERE out_text IS NOT NULL
    UNION ALL SELECT f.doc_id, f.i + 1, cur, page FROM fold2 f JOIN ends e ON e.doc_id = f.doc_id AND e.n = f.i)
)"""


@query("CH2_line_chunks", f"WITH {LINES} SELECT doc_id, chunk_index, md5(chunk_text) AS chunk_text, page_number FROM line_chunks")
def ch2(spark, d):
    return digest(text.chunk_lines(texts(spark, d)), "chunk_text")


@query("AG17_chunk_stats", f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(text)) // count(*) AS BIGINT) AS avg_chars FROM chunks GROUP BY doc_id")
def ag17(spark, d):
    return text.chunk_stats(chunks(spark, d))


@query("SC12_markers", f"WITH {CHUNKS} SELECT doc_id, chunk_index, {PAGE_LIST.format('text')} AS pages FROM chunks")
def sc12(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_index", F.array_join(page_markers(F.col("text")).cast("array<string>"), ",").alias("pages"))


@query("AG15_token_usage", f"""WITH {CHUNKS} SELECT doc_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS prompt_tokens, CAST(sum(ceil(length(md5(text)) / 4.0)) AS BIGINT) AS completion_tokens,
  CAST(sum(ceil(length(text) / 4.0)) + sum(ceil(length(md5(text)) / 4.0)) AS BIGINT) AS total_tokens FROM chunks GROUP BY doc_id""")
def ag15(spark, d):
    return extract.token_usage(chunks(spark, d).withColumn("answer", F.md5(F.col("text").cast("binary"))), "text", "answer", "doc_id")


def _matches(pattern: str, column: str) -> str:
    return rf"""WITH {CHUNKS}, m AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(text, '{pattern}')) AS v, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS n FROM chunks)
SELECT doc_id, chunk_index, CAST(n - 1 AS INTEGER) AS row_no, v AS {column} FROM m"""


@query("UD3_contacts", _matches(EMAIL, "email"))
def ud3_contacts(spark, d):
    rows = extract.extract_regex(chunks(spark, d), "contact", {"email": EMAIL}, "doc_id")
    return rows.select("doc_id", "chunk_index", "row_no", F.col("row")["email"].alias("email"))


@query("UD3_hosts", _matches(IPV4, "ip"))
def ud3_hosts(spark, d):
    rows = extract.extract_regex(chunks(spark, d), "host", {"ip": IPV4}, "doc_id")
    return rows.select("doc_id", "chunk_index", "row_no", F.col("row")["ip"].alias("ip"))


@query("UD3_delimited", rf"""WITH {CHUNKS}, dl AS (SELECT doc_id, chunk_index, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS n FROM (
  SELECT doc_id, chunk_index, list_filter(string_split(text, chr(10)), lambda t: contains(t, '|')) AS x FROM chunks))
SELECT doc_id, chunk_index, CAST(n AS INTEGER) AS row_no, nullif(trim(string_split(line, '|')[1]), '') AS a, nullif(trim(string_split(line, '|')[2]), '') AS b FROM dl""")
def ud3_delimited(spark, d):
    rows = extract.extract_delimited(chunks(spark, d), "cells", ["a", "b"], "doc_id")
    return rows.select("doc_id", "chunk_index", "row_no", F.col("row")["a"].alias("a"), F.col("row")["b"].alias("b"))


CONTACTS = rf"""{CHUNKS},
mentions AS (
  SELECT doc_id, 'contact' AS table_name, chunk_index, unnest(regexp_extract_all(text, '{EMAIL}')) AS value, generate_subscripts(regexp_extract_all(text, '{EMAIL}'), 1) - 1 AS row_no FROM chunks
  UNION ALL
  SELECT doc_id, 'host', chunk_index, unnest(regexp_extract_all(text, '{IPV4}')), generate_subscripts(regexp_extract_all(text, '{IPV4}'), 1) - 1 FROM chunks
)"""


@query("E2E_contacts", rf"""WITH {CONTACTS}, m AS (SELECT *, {PAGE_LIST.format('c.text')} AS pages FROM mentions JOIN (SELECT doc_id AS d, chunk_index AS ci, text FROM chunks) c ON d = doc_id AND ci = chunk_index)
SELECT doc_id, table_name, arg_min(value, (chunk_index, row_no)) AS value, arg_min(pages, (chunk_index, row_no)) AS source_page_numbers, count(*) AS n_mentions
FROM m GROUP BY doc_id, table_name, lower(value)""")
def e2e_contacts(spark, d):
    """Contacts and hosts by document: extracted from overlapping chunks, merged by key, with their pages."""
    found = extract.extract_tables(chunks(spark, d), {"contact": {"value": EMAIL}, "host": {"value": IPV4}}, "doc_id", "pages")
    found = found.withColumn("value", F.col("row")["value"]).drop("row")
    merged = reconcile.merge_by_natural_key(found, [reconcile.Declared("value", "string", True)], scope=("doc_id", "table_name"), counted="n_mentions")
    return merged.select("doc_id", "table_name", "value", F.array_join(F.col("pages").cast("array<string>"), ",").alias("source_page_numbers"), "n_mentions")


@query("AG12_table_counts", rf"WITH {CONTACTS} SELECT t AS table_name, (SELECT count(*) FROM mentions m WHERE m.table_name = t) AS n_rows FROM (VALUES ('contact'), ('host'), ('secret')) x(t)")
def ag12(spark, d):
    found = extract.extract_tables(chunks(spark, d), {"contact": {"v": EMAIL}, "host": {"v": IPV4}}, "doc_id")
    return table_counts(found, spark.createDataFrame([("contact",), ("host",), ("secret",)], "table_name string"))


@query("JN6_route_chunks", rf"""WITH {CHUNKS}, c AS (SELECT doc_id, chunk_index, list_transform(regexp_extract_all(text, '--- Page (\d+) ---', 1), lambda x: CAST(x AS INTEGER)) AS pages FROM chunks)
SELECT doc_id, chunk_index, t AS table_name FROM c, (VALUES ('contact'), ('host'), ('cells')) x(t)
WHERE t = 'contact' OR (t = 'host' AND len(list_filter(pages, lambda p: p <= 2)) > 0) OR (t = 'cells' AND (doc_id % 2 = 1 OR len(list_filter(pages, lambda p: p >= 3 AND p <= 4)) > 0))""")
def jn6(spark, d):
    c = chunks(spark, d)
    docs = table(spark, d, "documents").select("doc_id")
    tables = docs.select("doc_id", F.explode(F.array(F.lit("contact"), F.lit("host"), F.lit("cells"))).alias("table_name"))
    sections = docs.select("doc_id", F.lit("host").alias("table_name"), F.lit(1).alias("first_page"), F.lit(2).alias("last_page"))
    sections = sections.unionByName(docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("cells").alias("table_name"), F.lit(3).alias("first_page"), F.lit(4).alias("last_page")))
    return extract.route_chunks(c.select("doc_id", "chunk_index", "pages"), tables, sections).select("doc_id", "chunk_index", "table_name")


@query("JN8_attach_pages", rf"""WITH {CONTACTS} SELECT doc_id, table_name, m.chunk_index, m.row_no, CASE WHEN c.text IS NULL THEN NULL ELSE {PAGE_LIST.format('c.text')} END AS source_page_numbers
FROM mentions m LEFT JOIN (SELECT doc_id AS dd, chunk_index AS ci, text FROM chunks WHERE chunk_index % 5 <> 1) c ON dd = doc_id AND ci = m.chunk_index""")
def jn8(spark, d):
    c = chunks(spark, d)
    rows = extract.extract_tables(c, {"contact": {"v": EMAIL}, "host": {"v": IPV4}}, "doc_id")
    known = c.filter("chunk_index % 5 <> 1").select("doc_id", F.explode(F.array(F.lit("contact"), F.lit("host"))).alias("table_name"), "chunk_index", "pages")
    out = reconcile.attach_pages(rows, known, ["doc_id", "table_name", "chunk_index"])
    return out.select("doc_id", "table_name", "chunk_index", "row_no", F.array_join(F.col("source_page_numbers").cast("array<string>"), ",").alias("source_page_numbers"))


@query("ST6_unique_pages", f"WITH {TEXTS} SELECT doc_id, {PAGE_LIST.format('full_text || full_text')} AS pages FROM texts")
def st6(spark, d):
    return texts(spark, d).select("doc_id", F.array_join(page_markers(F.concat("full_text", "full_text")).cast("array<string>"), ",").alias("pages"))


@query("UD1_custom_reader", "SELECT 'doc-' || doc_id || '.log' AS path, CAST(i AS INTEGER) AS page_number, CAST(0 AS INTEGER) AS region_no, md5(line) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE line <> ''")
def ud1(spark, d):
    """A user's reader of files: here a page a line."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    files = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".log")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    lines = lambda path, content: [{"page_number": k, "region_type": "text", "text": line} for k, line in enumerate(bytes(content).decode().split("\n"), 1) if line]
    found = readers.read_with(files, lines)
    # the reader numbers the regions of a file; a page has one
    return found.select("path", "page_number", F.lit(0).alias("region_no"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("SRC4_page_order")
def src4_order(spark, d):
    """Elements in page order, nested and unclosed ones too (tests hold them against a plain parser)."""
    return readers.regions_from_markup(table(spark, d, "pages")).select("doc_id", "page_number", "region_no", "region_type", "text")


@query("UD3_layout", """SELECT n_nationkey AS page, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS row_no, s_suppkey AS supplier_no, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 100 AS DOUBLE) END AS balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def ud3_layout(spark, d):
    """Suppliers as a table on each nation's page, boxes out of order and out of line, a head in two boxes; read back as typed rows."""
    s = table(spark, d, "supplier").withColumn("line", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    box = lambda no, x, width, text, dy=0: F.struct(F.lit(no).alias("no"), F.lit(x).alias("x1"), F.lit(width).alias("width"), F.lit(dy).alias("dy"), text.alias("text"))
    cells = F.array(box(0, 300, 60, F.when(F.col("s_suppkey") % 3 > 0, (F.col("s_suppkey") % 100).cast("string")), 3), box(1, 10, 40, F.col("s_suppkey").cast("string")), box(2, 100, 80, F.col("s_name"), 2))
    body = s.select(F.col("s_nationkey").alias("page"), "line", F.explode(cells).alias("c"))
    heads = s.select(F.col("s_nationkey").alias("page")).distinct().select("page", F.lit(0).alias("line"), F.explode(F.array(box(0, 305, 70, F.lit("Balance")), box(1, 5, 30, F.lit("Supplier")), box(3, 40, 20, F.lit("No.")), box(2, 110, 50, F.lit("Name")))).alias("c"))
    y = F.col("line") * 20 + F.col("c.dy")
    regions = body.unionByName(heads).select("page", (F.col("line") * 4 + F.col("c.no")).alias("region_no"), F.col("c.x1").alias("x1"), y.alias("y1"), (F.col("c.x1") + F.col("c.width")).alias("x2"), (y + 12).alias("y2"), "c.text")
    rows = extract.extract_layout(regions, "supplier", "page")
    value = lambda c, kind: coerce(F.col("row")[c], kind).alias(c)
    return rows.select("page", "row_no", value("supplier_no", "integer"), value("name", "string"), value("balance", "float"))

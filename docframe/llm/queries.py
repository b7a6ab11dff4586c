"""The registered queries of this subpackage and, where SQL can express one, its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from docframe.llm import language, quality
from docframe.llm.common import new_path, stage
from docframe.llm.exact_dedup import exact_groups
from docframe.llm.hard_negatives import hard_negatives
from docframe.llm.licenses import DENIAL, MARK, TEMPLATES, scan_licenses
from docframe.llm.line_rules import MAX_DOCS, MAX_SHARE, MIN_LEFT, line_rules
from docframe.llm.mixing import mix_plan
from docframe.llm.ngram_join import near_duplicates
from docframe.llm.packing import pack
from docframe.llm.phrases import remove_repeats
from docframe.llm.prefix_trie import prefix_nodes, turn_sequences, with_shared_heads
from docframe.llm.token_files import read_token_files, write_token_files
from docframe.llm.topk import exact_top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op2_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_table(spark, sf_dir, "documents"))


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of files: source / thousands / hundreds / name, every 25th a licence file."""
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 25 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), (F.col("doc_id") / 1000).cast("long").cast("string"), (F.col("doc_id") / 100).cast("long").cast("string"), name)
    return scan_licenses(docs.select("doc_id", "text", path.alias("path"))).drop("text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = stage(turn_sequences(_table(spark, sf_dir, "conversations")), "turn-sequences")
    return prefix_nodes(with_shared_heads(sequences))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, label=label)


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY body)
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS grp, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         length(coalesce(text, '')) AS n,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '!#$%&*|<>{}', '')) AS marks
  FROM documents
), k AS (
  SELECT doc_id, source, grp, size,
         -ln((CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
         / (CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * marks / n) END) AS key
  FROM d
), s AS (
  SELECT grp, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY grp
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
         source_size * 2.0::DOUBLE AS most, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(most) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT grp, source_size,
         least(most, coalesce((SELECT max(level) FROM l WHERE level * weight <= most) * weight, most)) AS target
  FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
)
SELECT doc_id, size, source_size, target,
       size * (epochs + CASE WHEN sum(size) OVER (PARTITION BY grp ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE
                                  < target - epochs * source_size THEN 1 ELSE 0 END) AS taken
FROM k JOIN e USING (grp)
"""

OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n, w FROM d
), s AS (
  SELECT r, i, word, CASE WHEN i + 34 <= n THEN md5(array_to_string(w[i:i + 34], ' ')) END AS span FROM p
), c AS (
  SELECT r, i, word, coalesce(span IS NOT NULL AND count(*) OVER (PARTITION BY span) > 1, false) AS again FROM s
), g AS (
  SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c
), k AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, array_to_string(list(word ORDER BY i) FILTER (NOT gone), ' ') AS kept FROM g GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

OP5_SQL = rf"""
WITH t AS (
  SELECT * FROM (VALUES {", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))}) x(template, license, notice)
), tw AS (
  SELECT template, license, word, count(*) AS tf FROM (SELECT template, license, unnest(regexp_split_to_array(lower(notice), '[^a-z0-9]+')) AS word FROM t) WHERE word <> '' GROUP BY ALL
), f AS (
  SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR), CASE WHEN doc_id % 25 = 0 THEN 'LICENSE' ELSE 'doc-' || doc_id || '.txt' END) AS path FROM documents
), df AS (
  SELECT word, count(*) AS df FROM (SELECT DISTINCT path, doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM f) WHERE word <> '' GROUP BY 1
), n AS (
  SELECT count(text) AS n FROM f
), u AS (
  SELECT DISTINCT path, unit FROM (
    SELECT path, unnest(string_split(text, chr(10))) AS unit FROM f UNION ALL SELECT path, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) FROM f UNION ALL SELECT path, text FROM f WHERE doc_id % 25 = 0
    UNION ALL SELECT path, array_to_string(p[list_position(m, true):len(m) + 1 - list_position(list_reverse(m), true)], chr(10) || chr(10)) FROM (SELECT path, p, list_transform(p, lambda x: regexp_matches(x, '{MARK}')) AS m FROM (SELECT path, regexp_split_to_array(text, '\n[ \t]*\n') AS p FROM f)) WHERE list_contains(m, true)
  ) WHERE regexp_matches(unit, '{MARK}') AND NOT regexp_matches(unit, '{DENIAL}')
), c AS (
  SELECT unit, word, count(*) AS tf FROM (SELECT unit, unnest(regexp_split_to_array(lower(unit), '[^a-z0-9]+')) AS word FROM (SELECT DISTINCT unit FROM u)) WHERE word <> '' GROUP BY ALL
), idf AS (
  SELECT v.word, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1.0::DOUBLE AS idf FROM (SELECT word FROM tw UNION SELECT word FROM c) v LEFT JOIN df USING (word), n
), known AS (
  SELECT word, template, license, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS w FROM tw JOIN idf USING (word)
), wt AS (
  SELECT unit, word, tf * idf AS w FROM c JOIN idf USING (word)
), sc AS (
  SELECT unit, license, round(sum(wt.w * known.w) / any_value(norm), 6) AS score, any_value(size) AS size FROM wt JOIN known USING (word) JOIN (SELECT unit, sqrt(sum(w * w)) AS norm FROM wt GROUP BY unit) USING (unit) JOIN (SELECT unit, sum(tf) AS size FROM c GROUP BY unit) USING (unit) GROUP BY unit, template, license
), own AS (
  SELECT path, arg_min(license, (-score * size, -score, license)) AS license, arg_min(score, (-score * size, -score, license)) AS score FROM u JOIN sc USING (unit) WHERE score >= 0.7 GROUP BY path
), spread AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS above, arg_min(license, (-score, license)) AS license, max(score) AS score FROM own WHERE path LIKE '%/LICENSE' GROUP BY 1
), up AS (
  SELECT doc_id, arg_max(s.license, length(above)) AS license, arg_max(s.score, length(above)) AS score FROM f JOIN spread s ON starts_with(f.path, above || '/') GROUP BY doc_id
)
SELECT f.doc_id, f.path, coalesce(own.license, up.license) AS license, coalesce(own.score, up.score) AS license_score,
       CASE WHEN own.license IS NOT NULL THEN 'own' WHEN up.license IS NOT NULL THEN 'inherited' END AS license_from
FROM f LEFT JOIN own ON own.path = f.path LEFT JOIN up ON up.doc_id = f.doc_id
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), c AS (
  SELECT array_to_string(w, ' ') AS body, min(doc_id) AS rep, count(*) AS copies, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY 1
), g AS (
  SELECT DISTINCT rep, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT rep, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM c)
), n AS (
  SELECT rep, count(*) AS n FROM g GROUP BY rep
), common AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY 1, 2
), l AS (
  SELECT a, b FROM common JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 0.000000001
), reach AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b
), root AS (
  SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a
), links AS (
  SELECT a, sum(copies) AS n FROM l JOIN c ON c.rep = b GROUP BY a
)
SELECT d.doc_id, coalesce(root, c.rep, d.doc_id) AS class_id, CAST(coalesce(coalesce(links.n, 0) + copies - 1, 0) AS BIGINT) AS n_links, coalesce(c.rep, d.doc_id) AS copy_of
FROM d LEFT JOIN c ON array_to_string(d.w, ' ') = c.body AND len(d.w) > 0 LEFT JOIN root ON root.a = c.rep LEFT JOIN links ON links.a = c.rep
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

OP11_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
         lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [1, 2, 3, 4, 5, 6, 7, 8]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND i < h UNION ALL SELECT conv_id, i, role, text FROM c JOIN t USING (conv_id) WHERE i >= h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER w) AS key, length(text) AS size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), l AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS above, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) AS below FROM p
), n AS (
  SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(above) AS above, count(*) AS n_convs, count(DISTINCT below) AS n_children, any_value(size) AS size,
         string_agg(conv_id, ',' ORDER BY conv_id) FILTER (below IS NULL) AS ends
  FROM l GROUP BY key
), s AS (
  SELECT a AS key, sum(n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT DISTINCT x.key AS a, y.key AS b FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.depth <= y.depth) JOIN n ON n.key = b GROUP BY a
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s USING (key) LEFT JOIN n m ON m.key = n.above
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""

OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS body FROM documents
), x AS (
  SELECT r, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM d
), l AS (
  SELECT r, line, i, len(regexp_extract_all(line, '[^ 	-
]+')) AS words,
         trim(regexp_replace(lower(line), '[ 	-
]+', ' ', 'g')) AS norm
  FROM x WHERE regexp_matches(line, '[^ 	-
]')
), dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r
), texts AS (
  SELECT host, body, min(r) AS r FROM d GROUP BY ALL
), hosts AS (
  SELECT host, count(*) AS all_docs FROM texts GROUP BY host
), above AS (
  SELECT host, norm FROM texts JOIN l USING (r) JOIN hosts USING (host) GROUP BY host, norm HAVING count(DISTINCT r) > {MAX_DOCS} AND count(DISTINCT r) > any_value(all_docs) * {MAX_SHARE!r}::DOUBLE
), lost AS (
  SELECT r, CAST(sum(words) AS BIGINT) AS n_removed FROM l JOIN d USING (r) JOIN above USING (host, norm) GROUP BY r
), w AS (
  SELECT r, regexp_extract_all(body, '[^ 	-
]+') AS w FROM d
), s AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, span) > 1 AS again
  FROM (SELECT r, unnest(range(1, greatest(len(w) - 3, 1))) AS i, array_to_string(w[i:i + 4], ' ') AS span FROM w)
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM s, range(5) t(k) WHERE again GROUP BY r
), f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_removed
  FROM d JOIN w USING (r) LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
)
SELECT *, NOT base_failed AND n_words - n_removed >= 10 AND n_words - n_removed >= n_words * {MIN_LEFT!r}::DOUBLE AS kept FROM b
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pack_windows": op2_pack_windows,
    "op3_mix_sources": op3_mix_sources,
    "op4_repeated_phrases": op4_repeated_phrases,
    "op5_license_scan": op5_license_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_exact_topk": op8_exact_topk,
    "op9_token_files": op9_token_files,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_line_rules": op13_line_rules,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_mix_sources": OP3_SQL,
    "op4_repeated_phrases": OP4_SQL,
    "op5_license_scan": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_ngram_join": OP7_SQL,
    "op8_exact_topk": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_line_rules": OP13_SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

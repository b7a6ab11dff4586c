"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.common import join_spread, stage
from docframe.llm.license_notices import TEMPLATES

#: A line or paragraph without one of these, of which every template holds one, is no notice; nor is one that denies it.
MARK = r"(?i)licen[sc]e|permission|redistribut|copyright|spdx|creative commons|\bcc0|\bcc[ -]by\b|public domain|provided .as is"
DENIAL = r"(?i)\bnot (licen[sc]ed|released) under\b"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)(\.[^/]*)?$"
#: Least cosine of a notice.
COSINE = 0.7


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def _templates(docs: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("notice")) for k, (name, text) in enumerate(TEMPLATES)])
    return docs.sparkSession.range(1, numPartitions=1).select(F.inline(rows)).select("template", "license", F.explode(_words(F.col("notice"))).alias("word")).groupBy("template", "license", "word").agg(F.count(F.lit(1)).alias("tf"))


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _directory(path: Column) -> Column:
    """Without the last name and its slash; a file at the top is in the directory ''."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_notices(files: DataFrame, cosine: float = COSINE) -> DataFrame:
    """path, license, score of the rows with a notice of their own.

    files: path, text.  Units are the lines and the paragraphs of every whole text, all from its first
    paragraph with a MARK to its last, and the whole text of a licence file, as far as they hold a MARK
    and no DENIAL.  Of the units that reach the cosine the one that covers most decides: most words,
    each counted by the unit's score.  idf is ln((1 + texts) / (1 + texts with the word)) + 1, counted
    over all texts for every word of a unit or a template.
    """
    paragraphs = F.split("text", r"\n[ \t]*\n")
    marked = F.transform(paragraphs, lambda p: p.rlike(MARK))
    first, after = F.array_position(marked, True).cast("int"), F.array_position(F.reverse(marked), True).cast("int")
    none = F.array().cast("array<string>")
    span = F.when(first > 0, F.array(F.array_join(F.slice(paragraphs, first, F.size(marked) - after - first + 2), "\n\n"))).otherwise(none)
    pieces = F.concat(F.split("text", r"\n"), paragraphs, span, F.when(_name(F.col("path")).rlike(LICENCE_FILE), F.array("text")).otherwise(none))
    notice = lambda u: u.rlike(MARK) & ~u.rlike(DENIAL)
    found = files.filter(F.col("text").rlike(MARK)).select("path", F.explode(F.array_distinct(F.filter(pieces, notice))).alias("body"))
    # a unit goes by its digest: its text isn't carried along with each of its words
    found = stage(found.withColumn("unit", F.unhex(F.sha2(F.col("body").cast("binary"), 256))), "license-units")
    # all words of a unit stay in one place, so that sums by unit are whole before any shuffle
    words = found.select("unit", "body").dropDuplicates(["unit"]).select("unit", F.explode(_words(F.col("body"))).alias("word"))
    counts = stage(words.groupBy("unit", "word").agg(F.count(F.lit(1)).alias("tf")), "license-counts")
    n = files.agg(F.count("text").alias("texts"))
    df = files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("word", (F.log((1.0 + F.col("texts")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))  # one row of texts
    idf = stage(idf, "license-idf")
    none = n.select((F.log(1.0 + F.col("texts")) + 1.0).alias("none"))  # of a word that no text holds
    known = _templates(files).join(idf, "word", "left").crossJoin(F.broadcast(none)).withColumn("idf", F.coalesce("idf", "none")).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    known = stage(known.select("word", "template", "license", "idf", (F.col("w") / norm).alias("tw")), "license-words")
    per_word = F.broadcast(known.groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("template", "license", "tw")).alias("in")))  # as many rows as the templates have words
    shared = counts.join(per_word, "word").withColumn("w", F.col("tf") * F.col("idf"))
    dots = shared.select("unit", "w", F.explode("in").alias("t")).groupBy("unit", "t.template", "t.license").agg(F.sum(F.col("w") * F.col("t.tw")).alias("dot"))
    part = shared.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("part"))
    # the words that it shares with templates are part of a unit's norm, so they bound its cosine from above
    likely = stage(dots.join(part, "unit").filter(F.col("dot") >= (cosine - 1e-6) * F.col("part")).drop("part"), "license-likely")
    norms = counts.join(likely.select("unit").distinct(), "unit", "left_semi").join(idf, "word")
    norms = norms.groupBy("unit").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2)))).alias("norm"), F.sum("tf").alias("size"))
    scored = likely.join(norms, "unit").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= cosine)
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("score") * F.col("size")).alias("cover"), (-F.col("score")).alias("minus"), "license")).alias("best"))
    return join_spread(found.select("path", "unit"), best, "unit").filter("best IS NOT NULL").groupBy("path").agg(F.min("best").alias("best")).select("path", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def scan_licenses(files: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of files, with its columns and: license, license_score, license_from.

    license_from is 'own', 'inherited' (from a licence file in the nearest directory above that has
    one; of several there the best score, then the least name) or null, where no licence is known.
    A null path or text has none of its own and a null path inherits none; rows that repeat a path
    share the best notice of all; ties go to the licence that comes first by name.  Columns of files
    that have one of the three names are replaced, all others kept, whatever their names.  An empty
    table gives no rows; texts of any length are read whole, by built-in functions.
    """
    slim = files.select(F.col("path"), F.col("text"))
    own = stage(scan_notices(slim, cosine), "license-own")
    spread = own.filter(_name(F.col("path")).rlike(LICENCE_FILE)).groupBy(_directory(F.col("path")).alias("above"))
    spread = spread.agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("spread"))
    folders = files.select(_directory(F.col("path")).alias("folder")).filter("folder IS NOT NULL").distinct()
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    steps = F.sequence(F.lit(0), F.size(parts))
    ancestors = folders.select("folder", F.explode(steps).alias("depth"), parts.alias("parts")).withColumn("above", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    nearest = ancestors.join(spread, "above").groupBy("folder").agg(F.max_by("spread", "depth").alias("near"))
    names = [c for c in files.columns if c not in ("license", "license_score", "license_from")]
    cols = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    out = files.select(*cols, F.col("path").alias("_path"), _directory(F.col("path")).alias("_folder"))
    out = join_spread(out, own.select(F.col("path").alias("_path"), F.struct((-F.col("score")).alias("minus"), "license").alias("_own")), "_path")
    out = join_spread(out, nearest.select(F.col("folder").alias("_folder"), F.col("near").alias("_near")), "_folder")
    got = F.coalesce("_own", "_near")
    origin = F.when(F.col("_own").isNotNull(), "own").when(F.col("_near").isNotNull(), "inherited")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], got["license"].alias("license"), (-got["minus"]).alias("license_score"), origin.alias("license_from"))

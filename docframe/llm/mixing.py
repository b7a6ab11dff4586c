"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.common import join_spread, stage, word_count

#: Parts that a span of keys is cut into at a time, and rows of a span that one task puts in order.
CELLS, SPAN_ROWS = 1024, 4096
#: Characters that markup and junk are made of; their share lowers a document's weight.
MARKS = "!#$%&*|<>{}"


def quality_weight(text: Column) -> Column:
    """Between 1/21 and 1: the fewer markup characters, the likelier a document is drawn."""
    n = F.length(F.coalesce(text, F.lit("")))
    marks = n - F.length(F.translate(F.coalesce(text, F.lit("")), MARKS, ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 / (1.0 + 20.0 * marks / n))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """Exponential key -ln(u) / weight; u comes from the id, so reruns agree.  Small keys are drawn first."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """source, grp, source_size -> with target: the share of all sizes by weight, no target above cap times its size.

    The excess of capped sources goes to the others by weight.  Sorted by cap to weight, the capped
    ones come first, so one pass of running sums finds the level that the others get per weight.
    """
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    nth = (F.row_number().over(by_name) - 1) % len(weights) + 1
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), nth)).withColumn("most", F.col("source_size") * float(cap))
    w = w.withColumn("total", F.sum("source_size").over(every) * float(share)).withColumn("all_weight", F.sum("weight").over(every))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(every)
    w = w.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most"))))
    return w.select("grp", "source", "source_size", "target")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight, seed: int) -> list[Column]:
    """The columns that decide a row's fate, in the order of drawing."""
    text, source = docs[text_col], docs[source_col]
    return [
        F.coalesce(F.concat(F.lit("="), source), F.lit("-")).alias("grp"),
        word_count(text).alias("size"),
        sampling_key(docs[id_col], weight(text), seed).alias("key"),
    ]


def _inside(sized: DataFrame, span: DataFrame) -> DataFrame:
    """The rows of sized, and the span of their source, whose keys lie in it."""
    return join_spread(sized, span, "grp").filter(F.col("key").between(F.col("lo"), F.col("hi")))


def _narrowed(sized: DataFrame, span: DataFrame) -> DataFrame:
    """The span of each source cut into CELLS of equal width: the cell in which the budget ends.

    A source has CELLS rows at most here, so its running sums are one small window.
    """
    width = (F.col("hi") - F.col("lo")) / CELLS
    cell = F.when(width > 0, F.least(F.lit(CELLS - 1), F.floor((F.col("key") - F.col("lo")) / width))).otherwise(0).cast("long")
    cells = _inside(sized, span).groupBy("grp", "rest", "before", cell.alias("cell")).agg(F.sum("size").alias("words"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("grp").orderBy("cell"))
    crossing = cells.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words")).filter((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
    return stage(crossing.select("grp", "rest", "before", "lo", "hi", "n"), "mix-spans")


def _draw(sized: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """Per source: target, whole epochs, and where the fractional epoch ends.

    All rows with keys below lo are drawn, and those up to ``last`` in the order of key, id and size.
    Spans of keys are narrowed until SPAN_ROWS rows or one key are left in each.
    """
    sources = sized.groupBy("grp").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"))
    sources = stage(sources, "mix-sources")
    targets = source_targets(sources.select("grp", "source", "source_size"), share, cap, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = stage(targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    span = targets.filter("rest > 0").select("grp", "rest").join(sources, "grp").select("grp", "rest", F.lit(0).cast("long").alias("before"), "lo", "hi", "n")
    while not span.filter((F.col("n") > SPAN_ROWS) & (F.col("hi") > F.col("lo"))).isEmpty():
        span = _narrowed(sized, span)
    ties = _inside(sized, span).groupBy("grp", "rest", "before", "lo", "key", "d_id", "size").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("grp").orderBy("key", "d_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0)) + F.col("size") / 2
    ends = ties.withColumn("in", middle < F.col("rest")).groupBy("grp").agg(F.first("lo").alias("lo"), F.max(F.when(F.col("in"), F.struct("key", "d_id", "size"))).alias("last"))
    return stage(targets.drop("source").join(ends, "grp", "left"), "mix-cutoffs")


def _times() -> Column:
    """How often the mix takes a row."""
    drawn = F.coalesce(F.col("key") < F.col("lo"), F.lit(False)) | F.coalesce(F.struct("key", "d_id", "size") <= F.col("last"), F.lit(False))
    return F.col("epochs") + drawn.cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), weight=quality_weight, seed: int = 7) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken.

    A source's target is its share of the mix by weight.  Every document is taken floor(target /
    source size) times; for the rest, documents are drawn by keys -ln(u) / quality weight, smallest
    first, whole, as long as at least half of one fits the budget.  So a source misses its target by
    half a document at most.  A null text has size 0; null is a source of its own, the last one; rows
    that repeat id, source and size share one fate; sources of size 0 have target 0; a document without
    words is drawn like others, with what is drawn before the budget ends.  An empty table gives no
    rows; other columns, whatever their names, are ignored.  A text is only read by built-in functions,
    whatever its length.  Sources are ranked in one task, a row each.
    """
    sized = stage(docs.select(docs[id_col].alias("d_id"), docs[source_col].alias("source"), *_keyed(docs, id_col, text_col, source_col, weight, seed)), "mix-sizes")
    cutoffs = _draw(sized, share, cap, weights)
    out = join_spread(sized, cutoffs, "grp")
    return out.select(F.col("d_id").alias(id_col), "size", "source_size", "target", (_times() * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), weight=quality_weight, seed: int = 7) -> DataFrame:
    """The mixed documents: each row of docs as often as mix_plan takes it, in docs' columns.

    Odd rows are treated as in mix_plan; columns of any name are kept.
    """
    decide = _keyed(docs, id_col, text_col, source_col, weight, seed)
    sized = stage(docs.select(docs[id_col].alias("d_id"), docs[source_col].alias("source"), *decide), "mix-sizes")
    cutoffs = _draw(sized, share, cap, weights)
    cols = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    taken = docs.select(*cols, docs[id_col].alias("d_id"), *decide)
    copies = join_spread(taken, cutoffs, "grp").withColumn("copy", F.explode(F.sequence(F.lit(0), _times()))).filter(F.col("copy") > 0)
    return copies.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])

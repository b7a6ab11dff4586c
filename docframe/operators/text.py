"""From regions to pages, documents, profiles and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.scalars import page_header, page_markers, strip

# Fixed values of page routing, sampling and chunking.
ALNUM_SHARE, IMAGE_CHARS = 0.4, 100
SAMPLE_PAGES, FIRST_PAGES, LAST_PAGES, DIVERSE_PAGES = 15, 3, 2, 3
CHUNK_CHARS, CHUNK_OVERLAP = 3000, 500
#: Characters of a block that texts are cut into first.
CUT = 4096
LINE_CHARS, LINE_OVERLAP = 2000, 200


def route_page(text: Column, images: Column) -> Column:
    """FLT1: 'ocr' where the native text layer is missing or poor, else 'native'."""
    bare = strip(F.coalesce(text, F.lit("")))
    share = F.length(F.regexp_replace(bare, "[^a-zA-Z0-9]", "")) / F.length(bare)
    poor = (bare == "") | (share < ALNUM_SHARE) | ((images >= 1) & (F.length(bare) < IMAGE_CHARS))
    return F.when(poor, "ocr").otherwise("native")


def drop_blank_regions(regions: DataFrame) -> DataFrame:
    """FLT2."""
    return regions.withColumn("text", strip(F.col("text"))).filter("text <> ''")


def coalesce_region_type(kind: Column) -> Column:
    """FLT3."""
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown"))


def reading_order(regions: DataFrame) -> DataFrame:
    """WN1: position of each region on its page, top to bottom and left to right."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("y1", "x1", "region_no")
    return regions.withColumn("position", F.row_number().over(order))


def _joined(order: str, text: str, sep: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(items, lambda s: s["t"]), sep)


def page_text(regions: DataFrame) -> DataFrame:
    """AG3: doc_id, page_number, page_text: the page's texts that aren't blank, by region, a line each.

    Regions are dealt by document, which full_text needs as well, so both take one shuffle.
    """
    return drop_blank_regions(regions).repartition("doc_id").groupBy("doc_id", "page_number").agg(_joined("region_no", "text", "\n").alias("page_text"))


def full_text(pages: DataFrame) -> DataFrame:
    """AG4: doc_id, full_text, page_count: pages under their markers, a blank line between them."""
    headed = pages.withColumn("block", F.concat(page_header(F.col("page_number")), F.lit("\n"), F.col("page_text")))
    return headed.groupBy("doc_id").agg(_joined("page_number", "block", "\n\n").alias("full_text"), F.count(F.lit(1)).alias("page_count"))


def region_histogram(regions: DataFrame) -> DataFrame:
    """AG1: regions of each type per document."""
    return regions.groupBy("doc_id", coalesce_region_type(F.col("region_type")).alias("region_type")).agg(F.count(F.lit(1)).alias("n"))


def page_diversity(regions: DataFrame) -> DataFrame:
    """AG2: distinct region types per page."""
    return regions.groupBy("doc_id", "page_number").agg(F.count_distinct(coalesce_region_type(F.col("region_type"))).alias("n_types"))


def sample_pages(diversity: DataFrame) -> DataFrame:
    """TK4, WN4, ST2: doc_id, page_number of the pages that stand for a document.

    All pages of up to 15.  Else the first 3, the last 2, the most diverse ones (lower page first)
    until 3 of them lie strictly between, and pages at an even stride until there are 15.  Ranks per
    document are windows over page rows, so nothing grows but with the pages.
    """
    per_doc = Window.partitionBy("doc_id")
    pages = diversity.withColumn("n", F.count(F.lit(1)).over(per_doc))
    small = pages.filter(F.col("n") <= SAMPLE_PAGES).select("doc_id", "page_number")
    place = F.row_number().over(per_doc.orderBy("page_number"))
    large = pages.filter(F.col("n") > SAMPLE_PAGES).withColumn("i", place)
    inner = (F.col("i") > FIRST_PAGES) & (F.col("i") < F.col("n") - LAST_PAGES + 1)
    large = large.withColumn("edge", (F.col("i") <= FIRST_PAGES) | (F.col("i") > F.col("n") - LAST_PAGES)).withColumn("inner", inner)
    rank = Window.partitionBy("doc_id", "inner").orderBy(F.desc("n_types"), "i")
    large = large.withColumn("picked", F.col("edge") | (F.col("inner") & (F.row_number().over(rank) <= DIVERSE_PAGES)))
    large = large.withColumn("free", SAMPLE_PAGES - F.sum(F.col("picked").cast("int")).over(per_doc))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / (F.col("free") + 1)))
    filler = ~F.col("picked") & (F.col("i") % stride == 0)
    large = large.withColumn("filler", filler)
    nth = F.row_number().over(Window.partitionBy("doc_id", "filler").orderBy("i"))
    large = large.withColumn("nth", nth).filter(F.col("picked") | (F.col("filler") & (F.col("nth") <= F.col("free"))))
    return small.unionByName(large.select("doc_id", "page_number"))


def profile_context(regions: DataFrame, picked: DataFrame) -> DataFrame:
    """AG5, JN9: doc_id, context: the picked pages with their region types and texts."""
    kept = regions.join(picked.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_semi")
    kept = kept.withColumn("kind", coalesce_region_type(F.col("region_type"))).withColumn("text", strip(F.col("text")))
    pages = kept.groupBy("doc_id", "page_number").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(F.col("region_no").alias("o"), F.col("text").alias("t"))))), lambda s: s["t"]), "\n").alias("body"),
    )
    head = F.format_string("--- Page %d (types: %s) ---\n%s", "page_number", F.when(F.col("kinds") == "", "none").otherwise(F.col("kinds")), "body")
    return pages.withColumn("block", head).groupBy("doc_id").agg(_joined("page_number", "block", "\n\n").alias("context"))


def _kept_lines(parts: Column) -> Column:
    """The stripped parts that aren't blank."""
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def _cut(body: Column, spans: Column) -> Column:
    """The spans (s, e and other fields) of a text, each with its own text as ``raw``.

    The text is cut once into blocks, and a span is put together from the few that it touches; so the
    work grows with the text, though characters are found from a block's start only.  The outer array
    of one element holds the blocks, which no span cuts anew.
    """
    blocks = F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))

    def raw(blocks: Column, c: Column) -> Column:
        first, last = F.floor(c["s"] / CUT).cast("int"), F.floor((c["e"] - 1) / CUT).cast("int")
        return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), c["s"] - first * CUT + 1, c["e"] - c["s"])

    both = F.array(F.struct(blocks.alias("blocks"), spans.alias("spans")))
    return F.flatten(F.transform(both, lambda x: F.transform(x["spans"], lambda c: F.struct(raw(x["blocks"], c).alias("raw"), c.alias("span")))))


def chunk_paragraphs(texts: DataFrame, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """CH1: doc_id, chunk_index, text, start_char, end_char, pages of doc_id, full_text.

    A text of at most ``size`` characters is one chunk as it stands.  Else it is split at blank lines
    and before page markers; stripped paragraphs are packed until the next would exceed the size, and
    a new chunk begins with the last ``overlap`` characters of the one before.  Offsets count two
    characters per gap, so they are near, not exact.  A paragraph is never cut.

    Every chunk is a span of the joined paragraphs, so the fold runs over their lengths and texts are
    cut once, at the end.  A document is one task's, in time and memory in proportion to its text.
    """
    text = F.col("full_text")
    paras = F.split(text, r"\n{2,}|(?=--- Page \d+)")
    paras = F.when(text.rlike(r"^--- Page \d+"), F.concat(F.array(F.lit("")), paras)).otherwise(paras)  # a cut before the first character leaves an empty part
    one = F.length(text) <= size
    split = texts.select("doc_id", "full_text", one.alias("one"), F.when(~one, F.transform(paras, strip)).alias("p"))
    split = split.withColumn("joined", F.array_join(F.filter("p", lambda p: p != ""), "\n\n")).withColumn("lengths", F.transform("p", F.length)).drop("p")
    zero = F.expr("named_struct('out', cast(array() as array<struct<s:int,e:int,start_char:int,end_char:int>>), 's', 0, 'e', 0, 'start', 0, 'pos', 0)")

    def flushed(acc):
        return F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"), acc["start"].alias("start_char"), acc["pos"].alias("end_char"))))

    def step(acc, n):
        held = acc["e"] - acc["s"]
        over = (held > 0) & (held + n + 2 > size)
        s = F.when(over & (held > overlap), acc["e"] - overlap).otherwise(acc["s"])
        start = F.when(over, F.greatest(F.lit(0), acc["pos"] - overlap)).when(held == 0, acc["pos"]).otherwise(acc["start"])
        end = F.when(held == 0, n).otherwise(acc["e"] + 2 + n)
        put = F.struct(F.when(over, flushed(acc)).otherwise(acc["out"]).alias("out"), s.alias("s"), end.alias("e"), start.alias("start"), (acc["pos"] + n + 2).alias("pos"))
        return F.when(n > 0, put).otherwise(acc.withField("pos", acc["pos"] + 2))

    folded = F.aggregate("lengths", zero, step, lambda acc: F.when(acc["e"] > acc["s"], flushed(acc)).otherwise(acc["out"]))
    length = F.length("full_text")
    whole = F.array(F.struct(text.alias("raw"), F.struct(F.lit(0).alias("s"), length.alias("e"), F.lit(0).alias("start_char"), length.alias("end_char")).alias("span")))
    cut = split.select("doc_id", "one", F.when(F.col("one"), whole).otherwise(_cut(F.col("joined"), folded)).alias("chunks"))
    chunks = cut.select("doc_id", "one", F.posexplode("chunks").alias("chunk_index", "c"))
    shown = F.when(F.col("one"), F.col("c.raw")).otherwise(strip(F.col("c.raw")))
    return chunks.select("doc_id", "chunk_index", shown.alias("text"), "c.span.start_char", "c.span.end_char", page_markers(F.col("c.raw")).alias("pages"))


def chunk_lines(texts: DataFrame, size: int = LINE_CHARS, overlap: int = LINE_OVERLAP) -> DataFrame:
    """CH2, WN7: doc_id, chunk_index, chunk_text, page_number of doc_id, full_text.

    Stripped lines are packed greedily with an overlap; marker lines only set the running page, 1 at
    first.  A chunk has the page that runs when it is closed.  As in chunk_paragraphs the fold runs
    over lengths, here with the markers' pages.
    """
    is_marker = lambda p: p.startswith("--- Page ") & p.endswith("---")
    page_of = lambda p: F.regexp_extract(p, r"^--- Page ([0-9]+)-* ?", 1).try_cast("int")
    lines = texts.select("doc_id", _kept_lines(F.split("full_text", "\n")).alias("p"))
    lines = lines.withColumn("joined", F.array_join(F.filter("p", lambda p: ~is_marker(p)), "\n"))
    lines = lines.withColumn("marks", F.transform("p", lambda p: F.struct(F.when(is_marker(p), 0).otherwise(F.length(p)).alias("n"), page_of(p).alias("page")))).drop("p")
    zero = F.expr("named_struct('out', cast(array() as array<struct<s:int,e:int,page:int>>), 's', 0, 'e', 0, 'page', 1)")

    def flushed(acc):
        return F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"), acc["page"].alias("page"))))

    def step(acc, mark):
        held, n = acc["e"] - acc["s"], mark["n"]
        over = (held > 0) & (held + n + 1 > size)
        s = F.when(over & (held > overlap), acc["e"] - overlap).otherwise(acc["s"])
        end = F.when(held == 0, n).otherwise(acc["e"] + 1 + n)
        put = F.struct(F.when(over, flushed(acc)).otherwise(acc["out"]).alias("out"), s.alias("s"), end.alias("e"), acc["page"].alias("page"))
        return F.when(n > 0, put).otherwise(acc.withField("page", F.coalesce(mark["page"], acc["page"])))

    folded = F.aggregate("marks", zero, step, lambda acc: F.when(acc["e"] > acc["s"], flushed(acc)).otherwise(acc["out"]))
    chunks = lines.select("doc_id", F.posexplode(_cut(F.col("joined"), folded)).alias("chunk_index", "c"))
    return chunks.select("doc_id", "chunk_index", strip(F.col("c.raw")).alias("chunk_text"), F.col("c.span.page").alias("page_number"))


def chunks_from_retrieval(ranked: DataFrame) -> DataFrame:
    """CH3: retrieved chunks (query_id, rank from 1, chunk_text, page_number) as base chunks."""
    pages = F.when(F.col("page_number").isNull(), F.array().cast("array<int>")).otherwise(F.array(F.col("page_number").cast("int")))
    return ranked.select("query_id", (F.col("rank") - 1).alias("chunk_index"), F.col("chunk_text").alias("text"), pages.alias("pages"))


def chunk_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """AG17: chunks per document and their mean length, whole characters."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.floor(F.sum(F.length(text)) / F.count(F.lit(1))).alias("avg_chars"))


def route_counts(pages: DataFrame) -> DataFrame:
    """AG16: native and ocr pages per document."""
    return pages.groupBy("doc_id").agg(F.count_if(F.col("route") == "native").alias("native_pages"), F.count_if(F.col("route") == "ocr").alias("ocr_pages"))


def build_profile(regions: DataFrame, recommended: Column | None = None) -> DataFrame:
    """MD9: doc_id, total_pages, sampled_pages, region_summary, rationale."""
    diversity = page_diversity(regions)
    sampled = sample_pages(diversity).groupBy("doc_id").agg(F.array_sort(F.collect_list("page_number")).alias("sampled_pages"))
    total = diversity.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"))
    summary = region_histogram(regions).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region_type", "n")))).alias("region_summary"))
    out = total.join(sampled, "doc_id").join(summary, "doc_id")
    why = F.format_string("%d of %d pages sampled, %d region types", F.size("sampled_pages"), "total_pages", F.size(F.map_keys("region_summary")))
    return out.withColumn("rationale", why)

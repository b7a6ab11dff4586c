"""Sources: uploads, stored layouts, text and marked-up pages, model metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe import schemas
from docframe.functions.scalars import strip

# What an upload may be, and its size limit.
UPLOAD_TYPES = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp", "webp")
UPLOAD_BYTES = 100 * 1024 * 1024
LINES_PER_PAGE = 10
#: Regions of a user's reader that go on together.
REGIONS_AT_A_TIME = 4096
#: Region type by tag.
TAGS = (("title", "title"), ("h1", "title"), ("p", "text"), ("li", "header"), ("nav", "header"), ("table", "table"), ("figure", "figure"), ("footer", "footer"))


def check_uploads(files: DataFrame) -> DataFrame:
    """path, length -> with extension and accepted."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", "length", extension.alias("extension"), (extension.isin(*UPLOAD_TYPES) & (F.col("length") <= UPLOAD_BYTES)).alias("accepted"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: the files under a path; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return check_uploads(files.select("path", "length"))


def explode_layout(layouts: DataFrame, *keys: str) -> DataFrame:
    """Regions of parsed layouts (page_count, pages)."""
    pages = layouts.select(*keys, F.explode("pages").alias("p")).select(*keys, "p.page_number", F.posexplode("p.regions").alias("region_no", "r"))
    box = [F.get("r.bbox", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return pages.select(*keys, "page_number", "region_no", "r.region_type", *box, "r.text", "r.confidence")


def read_regions_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: stored layout files to regions; file names the document."""
    layouts = spark.read.schema(schemas.LAYOUT).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_name"))
    return explode_layout(layouts, "file")


def _region(kind: Column, text: Column, order: Column) -> list[Column]:
    return [kind.alias("region_type"), F.lit(0).alias("x1"), order.cast("int").alias("y1"), F.length(text).alias("x2"), (order + 1).cast("int").alias("y2"), text.alias("text"), F.lit(1.0).alias("confidence")]


def regions_from_text(documents: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """SRC3: one text region per non-blank line, stripped, so many lines to a page."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    text = strip(F.col("raw"))
    lines = lines.select("doc_id", "line", text.alias("text")).filter("text <> ''")
    page = (F.floor(F.col("line") / lines_per_page) + 1).cast("int")
    return lines.select("doc_id", page.alias("page_number"), (F.col("line") % lines_per_page).alias("region_no"), *_region(F.lit("text"), F.col("text"), F.col("line") % lines_per_page))


def regions_from_html(pages: DataFrame) -> DataFrame:
    """SRC4: a region per marked-up element, typed by its tag, in order of the tags' list and then of the page."""
    found = []
    for k, (tag, kind) in enumerate(TAGS):
        bodies = F.regexp_extract_all("html", F.lit(rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1))
        found.append(F.transform(bodies, lambda b, n: F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("tag"), n.alias("n"), strip(F.regexp_replace(b, "<[^>]*>", " ")).alias("text"))))
    regions = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.filter(F.concat(*found), lambda r: r["text"] != "")).alias("region_no", "r"))
    return regions.select("doc_id", F.lit(1).alias("page_number"), "region_no", *_region(F.col("r.kind"), F.col("r.text"), F.col("region_no")))


#: Elements whose inner elements are no regions of their own; those that open no region but begin a new line; and lists, in which an item ends the one before.
WHOLE = ("nav", "table", "figure", "footer")
LISTS = ("ul", "ol")
BLOCKS = (*LISTS, "div", "article", "section", "main", "header", "aside", "blockquote", "form", "body", "dl", "pre", "hr", "h2", "h3", "h4", "h5", "h6")
_TOKEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|[^<]+"


def regions_from_markup(pages: DataFrame) -> DataFrame:
    """SRC4 in page order: a region per marked-up element with text, by one pass over a page's tags with a stack.

    A text belongs to the innermost open element of TAGS, or to the outermost of WHOLE around it; so
    each text is in one region.  Elements are in order of their opening.  An item ends the item before
    it in its list and a block ends an open paragraph, closed or not; an end tag closes what is open
    within its element, one without an element is passed over, as are comments, scripts and styles.
    White space is one space.  A page is one task's; entities stay as they are written.
    """
    region = {tag: kind for tag, kind in TAGS}
    known = [*region, *BLOCKS]
    tokens = F.regexp_extract_all("html", F.lit(_TOKEN), F.lit(0))
    tag = lambda t: F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    marks = F.transform(tokens, lambda t: F.struct((~t.startswith("<")).alias("text"), t.startswith("</").alias("end"), tag(t).alias("tag"), t.alias("raw")))
    marks = F.filter(marks, lambda m: F.when(m["text"], m["raw"].rlike(r"\S")).otherwise(m["tag"].isin(*known)))
    kinds = F.create_map(*[F.lit(x) for pair in region.items() for x in pair])
    zero = F.expr("named_struct('stack', cast(array() as array<struct<tag:string,id:int,kind:string,whole:boolean>>), 'next', 0, 'out', cast(array() as array<struct<id:int,kind:string,text:string>>))")
    nobody = F.struct(F.lit("").alias("tag"), F.lit(-1).alias("id"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("whole"))

    def last(stack: Column) -> Column:
        return F.coalesce(F.try_element_at(stack, F.lit(-1)), nobody)

    def cut(stack: Column, wanted) -> Column:
        """The stack below its last entry that is wanted."""
        at = F.size(stack) - F.array_position(F.transform(F.reverse(stack), wanted), True).cast("int")
        return F.when(F.exists(stack, wanted), F.slice(stack, F.lit(1), at)).otherwise(stack)

    def step(acc: Column, m: Column) -> Column:
        stack, top = acc["stack"], last(acc["stack"])
        is_tag = lambda *names: lambda e: e["tag"].isin(*names)
        # an item is open in this list if no list opens behind it
        item = F.exists(stack, is_tag("li")) & (F.try_element_at(F.filter(stack, is_tag("li", *LISTS)), F.lit(-1))["tag"] == "li")
        below = F.when((m["tag"] == "li") & item, cut(stack, is_tag("li"))).when(top["tag"] == "p", cut(stack, is_tag("p"))).otherwise(stack)
        under = last(below)
        opens = kinds[m["tag"]].isNotNull() & ~under["whole"]
        entry = F.struct(m["tag"].alias("tag"), F.when(opens, acc["next"]).otherwise(under["id"]).alias("id"), F.when(opens, kinds[m["tag"]]).otherwise(under["kind"]).alias("kind"), (under["whole"] | m["tag"].isin(*WHOLE)).alias("whole"))
        told = F.when(m["text"] & (top["id"] >= 0), F.concat(acc["out"], F.array(F.struct(top["id"].alias("id"), top["kind"].alias("kind"), m["raw"].alias("text"))))).otherwise(acc["out"])
        moved = F.when(m["text"], stack).when(m["end"], cut(stack, lambda e: e["tag"] == m["tag"])).otherwise(F.concat(below, F.array(entry)))
        return F.struct(moved.alias("stack"), (acc["next"] + F.when(~m["text"] & ~m["end"] & opens, 1).otherwise(0)).alias("next"), told.alias("out"))

    pieces = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.aggregate(marks, zero, step, lambda acc: acc["out"])).alias("n", "r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("r.text").alias("t")))), lambda x: x["t"]), " ")
    found = pieces.groupBy("doc_id", F.col("r.id").alias("id")).agg(F.first("r.kind").alias("kind"), strip(F.regexp_replace(joined, r"(?U)\s+", " ")).alias("text")).filter("text <> ''")
    regions = found.withColumn("region_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")) - 1)
    return regions.select("doc_id", F.lit(1).alias("page_number"), "region_no", *_region(F.col("kind"), F.col("text"), F.col("region_no")))


def read_with(files: DataFrame, reader: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """UD1: regions by a user's reader (path, content) -> [{page_number, region_type, bbox, text, confidence}].

    files: path, content (format binaryFile); the reader runs in the tasks, a file at a time, and its
    regions go on some thousands at a time.
    """
    names = ["path", "page_number", "region_no", "region_type", "bbox", "text", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows += [(path, int(r["page_number"]), n, r.get("region_type"), list(r.get("bbox") or (0, 0, 0, 0)), r.get("text"), r.get("confidence")) for n, r in enumerate(reader(path, content))]
                if len(rows) >= REGIONS_AT_A_TIME:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    found = files.select("path", "content").mapInPandas(run, "path string, page_number int, region_no int, region_type string, bbox array<int>, text string, confidence double")
    box = [F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return found.select("path", "page_number", "region_no", "region_type", *box, "text", "confidence")


def parse_models(rows: DataFrame, column: str = "model") -> DataFrame:
    """SRC5: JSON text to a model; text that is none goes to ``corrupt``."""
    parsed = F.from_json(F.col(column).cast("string"), schemas.MODEL, {"mode": "PERMISSIVE"})
    return rows.withColumn("parsed", parsed).withColumn("corrupt", F.when(F.col("parsed").isNull() | (F.col("parsed.tables").isNull()), F.col(column).cast("string")))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return parse_models(spark.read.parquet(path))


def write_models(models: DataFrame, path: str) -> None:
    models.withColumn("model", F.to_json("model")).write.mode("overwrite").parquet(path)

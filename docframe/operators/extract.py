"""Routing chunks to tables and extracting rows from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.scalars import snake_case, strip

CHARS_PER_TOKEN = 4


def route_chunks(chunks: DataFrame, tables: DataFrame, sections: DataFrame) -> DataFrame:
    """JN6: chunks x the tables of their document's model, restricted by section pages.

    chunks: doc_id, chunk_index, pages; tables: doc_id, table_name; sections: doc_id, table_name,
    first_page, last_page (a table assigned to a page range).  A table that no section names takes all
    chunks; one that sections name takes chunks with a page in one of its ranges.
    """
    ranges = sections.groupBy("doc_id", "table_name").agg(F.collect_set(F.struct("first_page", "last_page")).alias("ranges"))
    pairs = chunks.join(tables.join(ranges, ["doc_id", "table_name"], "left"), "doc_id")
    hit = F.exists("pages", lambda p: F.exists("ranges", lambda r: (p >= r["first_page"]) & (p <= r["last_page"])))
    return pairs.filter(F.col("ranges").isNull() | hit).drop("ranges")


def link_targets(relationships: DataFrame) -> DataFrame:
    """JN7: enabled relationships by their source table."""
    return relationships.filter("enabled").select("job_id", F.col("source_table").alias("table_name"), "source_column", "references_table", "references_column")


def extract_regex(chunks: DataFrame, table: str, rules: dict[str, str], *keys: str) -> DataFrame:
    """UD3, regex rules: a row for the n-th match of every column's pattern in a chunk.

    Columns are aligned by position; a row has null where a pattern matched less often.
    """
    return extract_tables(chunks, {table: rules}, *keys)


def extract_tables(chunks: DataFrame, tables: dict[str, dict[str, str]], *keys: str) -> DataFrame:
    """extract_regex for several tables in one pass over the chunks."""
    found = []
    for table, rules in tables.items():
        zipped = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(rules.values())])
        row = lambda z, rules=rules: F.create_map(*[x for k, c in enumerate(rules) for x in (F.lit(c), z[f"m{k}"])])
        found.append(F.transform(zipped, _placed(table, row)))
    return chunks.select(*keys, "chunk_index", F.explode(F.concat(*found)).alias("m")).select(*keys, "m.table_name", "chunk_index", "m.row_no", "m.row")


def _placed(table: str, row: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda z, n: F.struct(F.lit(table).alias("table_name"), n.alias("row_no"), row(z).alias("row"))


def extract_labelled(chunks: DataFrame, table: str, columns: list[str], *keys: str) -> DataFrame:
    """UD3, 'label: value' lines: at most one row per chunk with the first value of each label."""
    value = lambda c: F.nullif(F.regexp_extract("text", rf"(?im)^[ \t]*{re.escape(c)}[ \t]*:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))
    row = F.create_map(*[x for c in columns for x in (F.lit(c), value(c))])
    rows = chunks.select(*keys, F.lit(table).alias("table_name"), "chunk_index", F.lit(0).alias("row_no"), row.alias("row"))
    return rows.filter(F.exists(F.map_values("row"), lambda v: v.isNotNull()))


def extract_delimited(chunks: DataFrame, table: str, columns: list[str], *keys: str, delimiter: str = r"\|") -> DataFrame:
    """UD3, delimited lines: one row per line that has the delimiter, cells stripped, by position."""
    lines = chunks.select(*keys, "chunk_index", F.posexplode(F.filter(F.split("text", "\n"), lambda t: t.rlike(delimiter))).alias("row_no", "line"))
    cells = F.transform(F.split("line", delimiter), lambda c: F.trim(c))
    row = F.create_map(*[x for k, c in enumerate(columns) for x in (F.lit(c), F.nullif(F.get(cells, F.lit(k)), F.lit("")))])
    return lines.select(*keys, F.lit(table).alias("table_name"), "chunk_index", "row_no", row.alias("row"))


def _bands(boxes: DataFrame, keys: Sequence[str], low: str, high: str, name: str) -> DataFrame:
    """boxes with the number, from 0, of the band that each lies in: a band ends where a gap is, behind the furthest end so far."""
    order = Window.partitionBy(*keys).orderBy(low, high, "region_no")
    furthest = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col(low) >= furthest, F.lit(False)).cast("int")
    return boxes.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_opens")


def layout_cells(regions: DataFrame, *keys: str) -> DataFrame:
    """UD3 on layouts: keys, line_no, column_no, text: the cells of the table that the boxes of a page make.

    regions: keys (a page, or a table of one), region_no, x1, y1, x2, y2, text.  Lines and columns are
    found from the gaps between boxes alone, so no box may span two columns; boxes of one cell are joined
    in reading order.  Regions without a box or without text are left out.  A page is one task's.
    """
    whole = F.lit(True)
    for c in ("x1", "y1", "x2", "y2"):
        whole = whole & F.col(c).isNotNull()
    boxes = regions.filter(whole & (strip(F.coalesce("text", F.lit(""))) != "")).select(*keys, "region_no", "x1", "y1", "x2", "y2", strip(F.col("text")).alias("text"))
    placed = _bands(_bands(boxes, keys, "y1", "y2", "line_no"), keys, "x1", "x2", "column_no")
    words = F.array_sort(F.collect_list(F.struct("y1", "x1", "region_no", "text")))
    return placed.groupBy(*keys, "line_no", "column_no").agg(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"))


def extract_layout(regions: DataFrame, table: str, *keys: str) -> DataFrame:
    """UD3 on layouts: keys, table_name, row_no, row: the lines of layout_cells below the first, by the names in the first.

    Names are in snake case; a column without one, or whose name stood before, gets its number.
    """
    cells = layout_cells(regions, *keys)
    named = cells.filter("line_no = 0").withColumn("name", F.nullif(snake_case(F.col("text")), F.lit("")))
    nth = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("column_no"))
    names = named.withColumn("name", F.when(F.col("name").isNull() | (nth > 1), F.concat_ws("_", F.coalesce("name", F.lit("column")), F.col("column_no").cast("string"))).otherwise(F.col("name"))).select(*keys, "column_no", "name")
    below = cells.filter("line_no > 0").join(names, [*keys, "column_no"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("column_"), F.col("column_no").cast("string"))))
    row = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "text"))))
    return below.groupBy(*keys, "line_no").agg(row.alias("row")).select(*keys, F.lit(table).alias("table_name"), (F.col("line_no") - 1).alias("row_no"), "row")


def extract_with(pairs: DataFrame, extractor: Callable[[str, str], list[dict]]) -> DataFrame:
    """UD3, a user's function (text, table) -> rows, over routed chunks, in Arrow batches.

    pairs: job_id, table_name, chunk_index, text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (p.job_id, p.table_name, p.chunk_index, n, {k: None if v is None else str(v) for k, v in row.items()})
                for p in batch.itertuples()
                for n, row in enumerate(extractor(p.text, p.table_name))
            ]
            yield pd.DataFrame(rows, columns=["job_id", "table_name", "chunk_index", "row_no", "row"])

    return pairs.mapInPandas(run, "job_id string, table_name string, chunk_index int, row_no int, row map<string,string>")


def union_chunk_results(*results: DataFrame) -> DataFrame:
    """ST1: all results in one table, missing columns null."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def filter_bad_entries(results: DataFrame) -> DataFrame:
    """FLT5, AG11: raw results (job_id, chunk_index, payload JSON) to rows; what is no object with a table and rows goes."""
    entry = F.from_json("payload", "table_name string, rows array<string>", {"mode": "PERMISSIVE"})
    rows = results.select("job_id", "chunk_index", entry.alias("e")).filter("e.table_name IS NOT NULL AND e.rows IS NOT NULL")
    rows = rows.select("job_id", F.col("e.table_name").alias("table_name"), "chunk_index", F.posexplode("e.rows").alias("row_no", "raw"))
    return rows.withColumn("row", F.from_json("raw", "map<string,string>")).filter("row IS NOT NULL AND raw LIKE '{%'").drop("raw")


def drop_orphan_buckets(rows: DataFrame, model_tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT4: rows of the model's tables, and a note per job and table that isn't in the model."""
    keys = ["job_id", "table_name"]
    split = rows.join(model_tables.select(*keys, F.lit(True).alias("_known")).distinct(), keys, "left")
    kept = split.filter("_known").drop("_known")
    lost = split.filter("_known IS NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return kept, lost.select(*keys, F.format_string("dropped %d rows of unknown table %s", "n", "table_name").alias("note"))


def token_usage(texts: DataFrame, prompt: str, completion: str, *keys: str) -> DataFrame:
    """AG15: estimated tokens, a token for each four characters begun."""
    tokens = lambda c: F.ceil(F.length(F.coalesce(F.col(c), F.lit(""))) / CHARS_PER_TOKEN)
    sums = texts.groupBy(*keys).agg(F.sum(tokens(prompt)).alias("prompt_tokens"), F.sum(tokens(completion)).alias("completion_tokens"))
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def row_index(rows: DataFrame, *keys: str, order: tuple[str, ...] = ("chunk_index", "row_no")) -> DataFrame:
    """WN5: position of a row in its table, from 0."""
    return rows.withColumn("row_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)

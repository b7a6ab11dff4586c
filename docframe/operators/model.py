"""Data models as data: one row per job with a nested model, and operators over many of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe import schemas
from docframe.functions.scalars import namespace, snake_case, to_bool, to_date, to_float, to_int
from docframe.operators.keys import links_to_keys, smallest_key
from docframe.session import stage

# Words that may not name a table or column, and columns that every table gets.
RESERVED = (
    "all", "analyse", "analyze", "and", "any", "array", "as", "asc", "asymmetric", "both", "case", "cast", "check", "collate", "column",
    "constraint", "create", "current_catalog", "current_date", "current_role", "current_time", "current_timestamp", "current_user", "default",
    "deferrable", "desc", "distinct", "do", "else", "end", "except", "false", "fetch", "for", "foreign", "from", "grant", "group", "having", "in",
    "initially", "intersect", "into", "lateral", "leading", "limit", "localtime", "localtimestamp", "not", "null", "offset", "on", "only", "or",
    "order", "placing", "primary", "references", "returning", "select", "session_user", "some", "symmetric", "table", "then", "to", "trailing",
    "true", "union", "unique", "user", "using", "variadic", "when", "where", "window", "with",
)
PROVENANCE_NAMES = ("id", "source_page_numbers", "extraction_confidence", "reconciliation_notes")
TYPES = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}
SQL_TYPES = {"string": "TEXT", "integer": "BIGINT", "float": "NUMERIC", "boolean": "BOOLEAN", "date": "DATE"}
SPARK_TYPES = {"string": "STRING", "integer": "BIGINT", "float": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
PROVENANCE_SQL = (("source_page_numbers", "JSONB"), ("extraction_confidence", "NUMERIC"), ("reconciliation_notes", "TEXT"))
PROVENANCE_SPARK = (("source_page_numbers", "ARRAY<INT>"), ("extraction_confidence", "DOUBLE"), ("reconciliation_notes", "STRING"))


def model_tables(models: DataFrame) -> DataFrame:
    """MD1: job_id, table_no, table_name, description."""
    return models.select("job_id", F.posexplode_outer("model.tables").alias("table_no", "t")).filter("t IS NOT NULL").select("job_id", "table_no", "t.table_name", "t.description")


def model_columns(models: DataFrame) -> DataFrame:
    """MD1: job_id, table_no, table_name, column_no, column_name, type, is_primary_key."""
    t = models.select("job_id", F.posexplode("model.tables").alias("table_no", "t"))
    c = t.select("job_id", "table_no", "t.table_name", F.posexplode("t.columns").alias("column_no", "c"))
    return c.select("job_id", "table_no", "table_name", "column_no", F.col("c.name").alias("column_name"), F.col("c.type").alias("type"), F.coalesce("c.is_primary_key", F.lit(False)).alias("is_primary_key"))


def model_relationships(models: DataFrame) -> DataFrame:
    """MD1: job_id, rel_no and the relationship's fields."""
    return models.select("job_id", F.posexplode("model.relationships").alias("rel_no", "r")).select("job_id", "rel_no", "r.*")


def normalize_identifiers(models: DataFrame) -> DataFrame:
    """MD2: every name of the model in snake case."""

    def table(t: Column) -> Column:
        columns = F.transform(t["columns"], lambda c: c.withField("name", snake_case(c["name"])))
        return t.withField("table_name", snake_case(t["table_name"])).withField("columns", columns)

    def relationship(r: Column) -> Column:
        for name in ("source_table", "source_column", "references_table", "references_column"):
            r = r.withField(name, snake_case(r[name]))
        return r.withField("composite_key_columns", F.transform(r["composite_key_columns"], lambda c: snake_case(c)))

    model = F.col("model").withField("tables", F.transform("model.tables", table)).withField("relationships", F.transform("model.relationships", relationship))
    return models.withColumn("model", model)


def _bad_name(name: Column, provenance: bool) -> Column:
    out = F.when(F.coalesce(name, F.lit("")) == "", "empty").when(name.rlike("^[0-9]"), "starts with a digit").when(name.isin(*RESERVED), "reserved word")
    return out.when(name.isin(*PROVENANCE_NAMES), "reserved for provenance") if provenance else out


def identifier_errors(models: DataFrame) -> DataFrame:
    """MD3: job_id, kind (table, column), table_name, column_name, problem, for names in snake case."""
    names, cols = model_tables(models), model_columns(models)
    none = F.lit(None).cast("string").alias("column_name")
    found = [
        names.withColumn("problem", _bad_name(F.col("table_name"), False)).select("job_id", F.lit("table").alias("kind"), "table_name", none, "problem"),
        cols.withColumn("problem", _bad_name(F.col("column_name"), True)).select("job_id", F.lit("column").alias("kind"), "table_name", "column_name", "problem"),
        names.groupBy("job_id", "table_name").count().filter("count > 1").select("job_id", F.lit("table").alias("kind"), "table_name", none, F.lit("duplicate").alias("problem")),
        cols.groupBy("job_id", "table_no", "table_name", "column_name").count().filter("count > 1").select("job_id", F.lit("column").alias("kind"), "table_name", "column_name", F.lit("duplicate").alias("problem")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter("problem IS NOT NULL")


def downgrade_relationships(models: DataFrame) -> DataFrame:
    """MD4: relationships with enabled and note; the first failing check disables one, which is kept.

    The first two words of the notes are fixed values: users search their logs for these.
    """
    rel, cols = model_relationships(models), model_columns(models)
    pk = cols.groupBy("job_id", "table_name", "column_name").agg(F.max("is_primary_key").alias("pk"))
    tables = model_tables(models).select("job_id", "table_name").distinct()
    out = rel
    for side, table, column in (("s", "source_table", "source_column"), ("r", "references_table", "references_column")):
        known = tables.select("job_id", F.col("table_name").alias(table), F.lit(True).alias(f"{side}_table"))
        named = pk.select("job_id", F.col("table_name").alias(table), F.col("column_name").alias(column), F.col("pk").alias(f"{side}_pk"))
        out = out.join(known, ["job_id", table], "left").join(named, ["job_id", table, column], "left")
    note = (
        F.when(F.col("s_table").isNull(), F.format_string("relationship downgraded: source_table '%s' not in model", "source_table"))
        .when(F.col("r_table").isNull(), F.format_string("relationship downgraded: references_table '%s' not in model", "references_table"))
        .when(F.col("s_pk").isNull(), F.format_string("relationship downgraded: column %s.%s not declared", "source_table", "source_column"))
        .when(F.col("r_pk").isNull(), F.format_string("relationship downgraded: column %s.%s not declared", "references_table", "references_column"))
        .when(~F.col("r_pk"), F.format_string("relationship downgraded: %s.%s is no key by itself", "references_table", "references_column"))
    )
    out = out.withColumn("note", note).withColumn("enabled", F.coalesce("enabled", F.lit(True)) & F.col("note").isNull())
    return out.select("job_id", "rel_no", "source_table", "source_column", "references_table", "references_column", "enabled", "note")


def render_ddl(models: DataFrame, relationships: DataFrame, dialect: str = "postgres") -> DataFrame:
    """MD5: job_id, ddl: tables, then a UNIQUE per key column, then a FOREIGN KEY per enabled relationship.

    dialect 'spark' writes the tables only, with Spark's types: Spark enforces no constraints.
    """
    cols, full = model_columns(models), dialect == "postgres"
    quote = '"' if full else "`"
    kinds = SQL_TYPES if full else SPARK_TYPES
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("type")], F.lit(kinds["string"]))

    def named(*names: str) -> Column:
        return F.concat(F.lit(quote), *[F.col(n) if n in ("column_name", "table_name", "source_table", "source_column", "references_table", "references_column", "rel_no") else F.lit(n) for n in names], F.lit(quote))

    def place(table: str) -> Column:
        return F.concat(F.lit(quote), namespace(F.col("job_id")), F.lit(quote + "."), named(table))

    def line(part: int, a: str, b: Column, *text: Column | str) -> list[Column]:
        return ["job_id", F.lit(part).alias("part"), F.col(a).alias("a"), b.alias("b"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("line")]

    provenance = [f"{quote}{n}{quote} {k}" for n, k in (PROVENANCE_SQL if full else PROVENANCE_SPARK)]
    first = ['"id" BIGSERIAL PRIMARY KEY'] if full else []
    declared = F.transform(F.array_sort(F.collect_list(F.struct("column_no", F.concat(named("column_name"), F.lit(" "), kind).alias("t")))), lambda s: s["t"])
    body = F.array_join(F.concat(F.array(*[F.lit(x) for x in first]).cast("array<string>"), declared, F.array(*[F.lit(x) for x in provenance])), ",\n    ")
    tables = cols.groupBy("job_id", "table_no", "table_name").agg(body.alias("body"))
    parts = tables.select(*line(0, "table_no", F.lit(0), "CREATE TABLE ", place("table_name"), " (\n    ", F.col("body"), "\n)"))
    if full:
        unique = cols.filter("is_primary_key")
        parts = parts.unionByName(unique.select(*line(1, "table_no", F.col("column_no"), "ALTER TABLE ", place("table_name"), " ADD CONSTRAINT ", named("uq_", "table_name", "_", "column_name"), " UNIQUE (", named("column_name"), ")")))
        foreign = relationships.filter("enabled")
        ends = (" FOREIGN KEY (", named("source_column"), ") REFERENCES ", place("references_table"), " (", named("references_column"), ")")
        parts = parts.unionByName(foreign.select(*line(2, "rel_no", F.lit(0), "ALTER TABLE ", place("source_table"), " ADD CONSTRAINT ", named("fk_", "source_table", "_", "source_column", "_", "rel_no"), *ends)))
    ordered = F.array_sort(F.collect_list(F.struct("part", "a", "b", "line")))
    return parts.groupBy("job_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), ";\n").alias("ddl"))


def load_order(models: DataFrame, relationships: DataFrame) -> DataFrame:
    """MD6: job_id, table_name, table_no, depth, load_no: parents before children, then as declared.

    Self references don't count.  Depth grows by one join per level, in a job for as many levels as it
    has tables; one that is not done by then has a cycle and loads as declared (depth null).
    """
    tables = model_tables(models).select("job_id", "table_name", "table_no").groupBy("job_id", "table_name").agg(F.min("table_no").alias("table_no"))
    sizes = tables.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    edges = relationships.filter("enabled AND source_table <> references_table").select("job_id", F.col("source_table").alias("child"), F.col("references_table").alias("parent")).distinct()
    known = tables.select("job_id", F.col("table_name").alias("child"))
    edges = edges.join(known, ["job_id", "child"], "left_semi").join(known.withColumnRenamed("child", "parent"), ["job_id", "parent"], "left_semi").join(sizes, "job_id")
    edges = stage(edges, "model-edges")
    placed = tables.select("job_id", "table_name", F.lit(0).alias("depth"))
    level, frontier = 1, edges.select("job_id", F.col("child").alias("table_name")).distinct()
    while not frontier.isEmpty():
        placed = placed.unionByName(frontier.withColumn("depth", F.lit(level)))
        reached = frontier.withColumnRenamed("table_name", "parent")
        frontier = edges.filter(F.col("n") > level).join(reached, ["job_id", "parent"], "left_semi").select("job_id", F.col("child").alias("table_name")).distinct()
        frontier = stage(frontier, "model-level")
        level += 1
    depth = placed.groupBy("job_id", "table_name").agg(F.max("depth").alias("depth"))
    out = tables.join(depth, ["job_id", "table_name"]).join(sizes, "job_id")
    cyclic = F.max("depth").over(Window.partitionBy("job_id")) >= F.col("n")
    out = out.withColumn("depth", F.when(~cyclic, F.col("depth")))
    return out.select("job_id", "table_name", "table_no", "depth", F.row_number().over(Window.partitionBy("job_id").orderBy("depth", "table_no")).alias("load_no"))


def model_to_schema(columns: Sequence[tuple[str, str]], link_columns: Sequence[str] = ()) -> T.StructType:
    """MD7: a locked table as a schema; link columns that it doesn't declare come as text."""
    out = T.StructType()
    for name, kind in columns:
        out = out.add(name, TYPES[kind], True)
    for name in link_columns:
        if name not in {n for n, _ in columns}:
            out = out.add(name, T.StringType(), True)
    return out


def _column_facts(df: DataFrame, table: str, table_no: int) -> DataFrame:
    """One pass over a table: the type of each column, and whether it is whole (no nulls).  Nested columns count as texts."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for k, (name, dtype) in enumerate(df.dtypes):
        text = F.when(F.col(f"`{name}`").isNotNull(), "x") if dtype.startswith(("array", "map", "struct")) else F.col(f"`{name}`").cast("string")
        aggs += [F.count(text).alias(f"n{k}"), F.approx_count_distinct(text).alias(f"d{k}")]
        aggs += [F.count_if(f(text).isNotNull()).alias(f"{tag}{k}") for tag, f in (("i", to_int), ("f", to_float), ("b", to_bool), ("t", to_date))]
        aggs.append(F.count_if(F.coalesce(to_float(text) != to_int(text), F.lit(False))).alias(f"frac{k}"))
    facts = df.agg(*aggs)
    per = []
    for k, name in enumerate(df.columns):
        n = F.col(f"n{k}")
        whole = (F.col(f"i{k}") == n) & (F.col(f"frac{k}") == 0)
        kind = F.when(n == 0, "string").when((F.col(f"b{k}") == n) & (F.col(f"d{k}") <= 2) & ~whole, "boolean").when(whole, "integer").when(F.col(f"f{k}") == n, "float").when(F.col(f"t{k}") == n, "date").otherwise("string")
        per.append(F.struct(F.lit(k).alias("column_no"), F.lit(name).alias("column_name"), kind.alias("type"), ((n == F.col("rows")) & (n > 0)).alias("whole")))
    return facts.select(F.lit(table).alias("table_name"), F.lit(table_no).alias("table_no"), F.explode(F.array(*per)).alias("c")).select("table_name", "table_no", "c.*")


def propose_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """MD8, columns: type of each, and the smallest set of columns, without nulls, that is unique as the primary key."""
    found = []
    for no, (name, df) in enumerate(tables.items()):
        facts = _column_facts(df, name, no).collect()  # a row a column
        key = smallest_key(df, [r.column_name for r in facts if r.whole])
        found += [(r.table_name, no, r.column_no, r.column_name, r.type, r.column_name in key) for r in facts]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(found, "table_name string, table_no int, column_no int, column_name string, type string, is_primary_key boolean")


LINKS = "source_table string, source_columns array<string>, references_table string, references_columns array<string>, n_values long, n_keys long, alike boolean"


def _alike(column: str, parent: str, key: str) -> bool:
    """Whether a column's name speaks of a key: the same from the first underscore on, or with the table's name in it."""
    tail = lambda name: name.split("_", 1)[-1].lower()
    return tail(column) == tail(key) or parent.lower().rstrip("s") in column.lower()


def propose_links(tables: dict[str, DataFrame], columns: DataFrame) -> DataFrame:
    """MD8, links: all columns, or sets of them, whose every value is a value of a primary key of the same types.

    Names play no part in finding them, and a table's own key is no exception; ``alike`` tells whether
    the names agree, n_values and n_keys how many different values both sides have.
    """
    rows = columns.orderBy("table_no", "column_no").collect()  # a row a column
    keys: dict[str, tuple[str, ...]] = {}
    for r in rows:
        if r.is_primary_key:
            keys[r.table_name] = (*keys.get(r.table_name, ()), r.column_name)
    found = links_to_keys(tables, {(r.table_name, r.column_name): r.type for r in rows}, keys)
    out = [(t, list(c), p, list(k), n, m, all(_alike(x, p, y) for x, y in zip(c, k))) for t, c, p, k, n, m in found]
    return columns.sparkSession.createDataFrame(out, LINKS)


def propose_relationships(tables: dict[str, DataFrame], columns: DataFrame, cover: float = 0.5) -> DataFrame:
    """MD8: of the links of each column to keys of one column the likeliest: of like names, or those that reach a share of ``cover`` of the keys.

    Like names come first, then the larger share, then the first names; a key links to no other table
    whose names are unlike its own, as numbers from one on are in each other.
    """
    own = columns.filter("is_primary_key").select(F.col("table_name").alias("source_table"), F.array("column_name").alias("source_columns"), F.lit(True).alias("is_key"))
    share = F.col("n_values") / F.col("n_keys")
    single = propose_links(tables, columns).filter(F.size("source_columns") == 1).join(F.broadcast(own), ["source_table", "source_columns"], "left")  # a row a column
    likely = single.filter(F.col("alike") | (F.col("is_key").isNull() & (share >= cover)))
    order = Window.partitionBy("source_table", "source_columns").orderBy(F.desc("alike"), F.desc(share), "references_table")
    best = likely.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return best.select("source_table", F.col("source_columns")[0].alias("source_column"), "references_table", F.col("references_columns")[0].alias("references_column"))


def propose_model(tables: dict[str, DataFrame], job_id: str, proposer: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> DataFrame:
    """UD2: job_id, model: by a user's proposer, or from the data's types, unique columns and inclusions."""
    if proposer:
        return proposer(tables)
    columns = propose_columns(tables)
    links = propose_relationships(tables, columns)
    column = F.struct(F.col("column_name").alias("name"), "type", F.lit(None).cast("string").alias("description"), "is_primary_key")
    per = columns.groupBy("table_no", "table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_no", column.alias("c")))), lambda x: x["c"]).alias("columns"))
    nested = F.struct("table_name", F.lit(None).cast("string").alias("description"), "columns")
    model = per.agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", nested.alias("t")))), lambda x: x["t"]).alias("tables"))
    rel = F.struct("source_table", "source_column", "references_table", "references_column", F.lit("natural_key"), F.lit(None).cast("array<string>"), F.lit(True), F.lit(True))
    rels = links.agg(F.array_sort(F.collect_list(rel)).alias("relationships"))
    kind = F.when(F.size("tables") > 1, "table_graph").otherwise("single_table")
    return model.crossJoin(rels).select(F.lit(job_id).alias("job_id"), F.struct(kind, "tables", "relationships").cast(schemas.MODEL).alias("model"))  # one row each


def remove_table(models: DataFrame, name: Column) -> DataFrame:
    """MD10: models without a table and without the relationships at either end of it."""
    rels = F.filter("model.relationships", lambda r: (r["source_table"] != name) & (r["references_table"] != name))
    return models.withColumn("model", F.col("model").withField("tables", F.filter("model.tables", lambda t: t["table_name"] != name)).withField("relationships", rels))


def local_errors(models: DataFrame) -> DataFrame:
    """MD11: what an editor shows: nameless, duplicate or empty tables and columns, as typed."""
    names, cols = model_tables(models), model_columns(models)
    per_table = models.select("job_id", F.posexplode("model.tables").alias("table_no", "t")).select("job_id", "t.table_name", F.coalesce(F.size("t.columns"), F.lit(0)).alias("n"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    found = [
        names.filter(blank("table_name")).select("job_id", F.lit("table without a name").alias("problem"), F.lit("").alias("name")),
        names.filter(~blank("table_name")).groupBy("job_id", F.lower(F.trim("table_name")).alias("name")).count().filter("count > 1").select("job_id", F.lit("duplicate table").alias("problem"), "name"),
        per_table.filter("n <= 0").select("job_id", F.lit("table without columns").alias("problem"), F.col("table_name").alias("name")),
        cols.filter(blank("column_name")).select("job_id", F.lit("column without a name").alias("problem"), F.col("table_name").alias("name")),
        cols.filter(~blank("column_name")).groupBy("job_id", "table_no", "table_name", F.lower(F.trim("column_name")).alias("c")).count().filter("count > 1").select("job_id", F.lit("duplicate column").alias("problem"), F.concat("table_name", F.lit("."), "c").alias("name")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out

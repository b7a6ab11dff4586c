"""Reconciliation: coercion, entities, foreign keys, natural keys, provenance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe import schemas
from docframe.functions.scalars import coerce, fingerprint, key_part, natural_key, strip, token_set
from docframe.session import stage

ORDER = ("chunk_index", "row_no")
#: Tasks that a hot key is spread over, and names that share a gram in one task, about.
SALTS, DEALT = 8, 2000


@dataclass(frozen=True)
class Declared:
    """A declared column."""

    name: str
    type: str = "string"
    pk: bool = False


def _order(order: Sequence[str] = ORDER) -> Column:
    return F.struct(*order)


def normalize_row(df: DataFrame, columns: Sequence[Declared]) -> DataFrame:
    """SC7: declared columns coerced by their types, from whatever type they have; all others as they are."""
    kinds, types = {c.name: c.type for c in columns}, dict(df.dtypes)
    return df.select(*[coerce(F.col(n), kinds[n], types[n]).alias(n) if n in kinds else F.col(n) for n in df.columns])


def project_declared(df: DataFrame, columns: Sequence[Declared]) -> DataFrame:
    """FLT6: declared and provenance columns in order; missing ones null, nested ones JSON text."""
    wanted = {c.name: schemas.TYPES[c.type] for c in columns} | schemas.PROVENANCE
    types = dict(df.dtypes)

    def pick(name: str, kind: str) -> Column:
        if name not in types:
            return F.lit(None).cast(kind).alias(name)
        nested = types[name].startswith(("array", "map", "struct")) and not kind.startswith("array")
        return (F.to_json(name) if nested else F.col(name)).alias(name)

    return df.select(*[pick(n, k) for n, k in wanted.items()])


def strip_internal(df: DataFrame) -> DataFrame:
    """FLT7: without columns that begin with two underscores."""
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def _key(columns: Sequence[Declared]) -> Column:
    return natural_key([(F.col(c.name), c.type) for c in columns if c.pk])


def _alone(group: Column) -> Column:
    """Sets a row without a group apart from all others, so that one aggregate takes both kinds."""
    return F.when(group.isNull(), F.monotonically_increasing_id())


def merge_by_natural_key(df: DataFrame, columns: Sequence[Declared], order: Sequence[str] = ORDER, scope: Sequence[str] = (), counted: str | None = None) -> DataFrame:
    """AG6: one row per natural key: the first row's values, its nulls filled from later rows in order.

    Rows without a whole key are all kept.  Rows of different ``scope`` (job, document) never merge.
    Every column is a partial minimum by order, so a hot key costs one row per task in the shuffle.
    ``counted`` names a column for the number of rows merged.
    """
    values = [c for c in df.columns if c not in (*order, *scope)]
    keyed = df.withColumn("_key", _key(columns)).withColumn("_alone", _alone(F.col("_key")))
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), _order(order))).alias(c) for c in values]
    place, n = F.min(_order(order)).alias("_first"), [F.count(F.lit(1)).alias(counted)] if counted else []
    merged = keyed.groupBy(*scope, "_key", "_alone").agg(*first, place, *n)
    return merged.select(*scope, *values, *[F.col(f"_first.{o}").alias(o) for o in order], *([counted] if counted else []))


def merge_notes(df: DataFrame, table: str, columns: Sequence[Declared], order: Sequence[str] = ORDER, scope: Sequence[str] = ()) -> DataFrame:
    """AG7: a note for each row that merge_by_natural_key merges into an earlier one, or keeps for want of a key."""
    fields, place = [c.name for c in columns], _order(order)
    keyed = df.withColumn("_key", _key(columns))
    # a row fills a field if it is the first with a value: partial minima of the keys that stand twice,
    # joined by key and salt, so neither a hot key nor the rows without one meet in one task
    firsts = [F.min(F.when(F.col(f).isNotNull(), place)).alias(f"_at{k}") for k, f in enumerate(fields)]
    known = keyed.filter("_key IS NOT NULL").groupBy(*scope, "_key").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"), *firsts).filter("_n > 1")
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = keyed.withColumn("_salt", F.spark_partition_id() % SALTS).join(known, [*scope, "_key", "_salt"], "left").filter(F.col("_key").isNull() | (place > F.col("_first")))
    filled = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & (place == F.col(f"_at{k}")), F.lit(f)) for k, f in enumerate(fields)]))
    parts = [F.col(f"_key.k{n}").cast("string") for n in range(sum(c.pk for c in columns))]
    met = met.withColumn("_filled", filled).withColumn("_head", F.concat(F.lit(f"{table}: a later row of key "), F.concat_ws("|", *parts), F.lit(" gave ")))
    gave = F.concat("_head", F.when(F.size("_filled") > 0, F.array_join("_filled", ", ")).otherwise("nothing new"))
    alone = F.lit(f"{table}: kept as it is, for want of " + ", ".join(c.name for c in columns if c.pk))
    return met.select(*scope, *order, F.when(F.col("_key").isNull(), alone).otherwise(gave).alias("note"))


def dedupe_by_fingerprint(df: DataFrame, columns: Sequence[Declared], order: Sequence[str] = ORDER, scope: Sequence[str] = ()) -> DataFrame:
    """AG8: the first row of each fingerprint within a scope; for tables without a key."""
    strings = [F.col(c.name) for c in columns if c.type == "string"]
    mark = fingerprint(strings, [F.col(c.name) for c in columns])
    values = [c for c in df.columns if c not in order]
    first = df.withColumn("_mark", mark).groupBy(*scope, "_mark").agg(F.min_by(F.struct(*df.columns), _order(order)).alias("r"))
    return first.select(*[F.col(f"r.{c}").alias(c) for c in [*values, *order]])


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """WN2: the first row of each key in order of arrival, as a partial minimum."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), _order(order)).alias("r"))
    return first.select(*[F.col(f"r.{c}").alias(c) for c in df.columns])


def last_parent(parents: DataFrame, column: str, kind: str = "string", order: Sequence[str] = ORDER, scope: Sequence[str] = ()) -> DataFrame:
    """WN3: _norm, _canonical: of parents that share a key, the last one's spelling, in each scope."""
    kept = parents.filter(F.col(column).isNotNull())
    return kept.groupBy(*scope, key_part(F.col(column), kind).alias("_norm")).agg(F.max_by(F.col(column), _order(order)).alias("_canonical"))


def repair_fk(child: DataFrame, fk: str, parents: DataFrame, pk: str, label: str, kind: str = "string", order: Sequence[str] = ORDER, scope: Sequence[str] = ()) -> DataFrame:
    """JN1-JN4: child with fk rewritten to its parent's spelling, and fk_note.

    Texts match first without case and outer space (no note), then by their token set (noted); other
    types match by value.  A miss is noted and the row kept; null keys stay as they are, and so do
    all rows of a scope whose parent table is empty.  ``label`` and ``pk`` name the two columns in
    notes; pk may be 'table.column'.  Parents enter a join once per key, so the child's rows never
    multiply.
    """
    column = pk.split(".")[-1]
    exact = last_parent(parents, column, kind, order, scope)
    out = child.withColumn("_norm", key_part(F.col(fk), kind)).join(exact, [*scope, "_norm"], "left")
    if kind == "string":
        sets = parents.filter(F.col(column).isNotNull()).groupBy(*scope, token_set(F.col(column)).alias("_tokens")).agg(F.max_by(F.col(column), _order(order)).alias("_by_tokens"))
        out = out.withColumn("_tokens", F.when(F.col("_canonical").isNull(), token_set(F.col(fk)))).join(sets.filter(F.size("_tokens") > 0), [*scope, "_tokens"], "left")
        repaired, said = F.format_string(f"{label}: '%s' was read as '%s', which has the same words", F.col(fk), F.col("_by_tokens")), "'%s'"
    else:
        out = out.withColumn("_by_tokens", F.lit(None).cast(child.schema[fk].dataType))
        repaired, said = F.lit(None).cast("string"), "%s"
    some = parents.groupBy(*scope).agg((F.count(F.lit(1)) > 0).alias("_some"))
    out = out.join(some, list(scope), "left") if scope else out.crossJoin(F.broadcast(some))  # one row
    missed = F.format_string(f"{label}: {said} is no value of {pk}", F.col(fk).cast("string"))
    known = F.col(fk).isNull() | F.col("_canonical").isNotNull() | ~F.coalesce("_some", F.lit(False))
    note = F.when(known, F.lit(None)).when(F.col("_by_tokens").isNotNull(), repaired).otherwise(missed)
    return out.withColumn("fk_note", note).withColumn(fk, F.coalesce("_canonical", "_by_tokens", F.col(fk))).drop("_norm", "_canonical", "_tokens", "_by_tokens", "_some")


def fk_misses(child: DataFrame, fk: str, parents: DataFrame, pk: str, kind: str = "string", scope: Sequence[str] = ()) -> DataFrame:
    """JN3: the child's rows whose key isn't null and matches no parent exactly or by tokens; none in a scope without parents."""
    keys = parents.select(*scope, key_part(F.col(pk), kind).alias("_norm")).filter("_norm IS NOT NULL").distinct()
    some = parents.select(*scope).distinct() if scope else parents.select(F.lit(1).alias("_one")).limit(1)
    asked = child.filter(F.col(fk).isNotNull())
    asked = asked.join(some, list(scope), "left_semi") if scope else asked.withColumn("_one", F.lit(1)).join(some, "_one", "left_semi").drop("_one")
    lost = asked.withColumn("_norm", key_part(F.col(fk), kind)).join(keys, [*scope, "_norm"], "left_anti").drop("_norm")
    if kind != "string":
        return lost
    sets = parents.select(*scope, token_set(F.col(pk)).alias("_tokens")).filter("size(_tokens) > 0").distinct()
    return lost.withColumn("_tokens", token_set(F.col(fk))).join(sets, [*scope, "_tokens"], "left_anti").drop("_tokens")


def attach_pages(rows: DataFrame, chunk_pages: DataFrame, keys: Sequence[str] = ("table_name", "chunk_index")) -> DataFrame:
    """JN8: source_page_numbers from the row's chunk: null if the chunk is unknown, [] if it has no marker.

    keys name a chunk: over many jobs or documents they are part of it.
    """
    return rows.join(chunk_pages.select(*keys, F.col("pages").alias("source_page_numbers")), list(keys), "left")


def join_notes(notes: Column) -> Column:
    """AG19: notes of a row in one text; null without any."""
    return F.nullif(F.array_join(F.array_compact(notes), "; "), F.lit(""))


def finish_rows(rows: DataFrame) -> DataFrame:
    """Provenance columns that extraction left open."""
    for name, kind in schemas.PROVENANCE.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return strip_internal(rows)


def entity_id(columns: Sequence[Declared]) -> Column:
    """UD5: which entity a row speaks of: the token sets of its key parts; null if all parts are null."""
    parts = [F.array_join(token_set(F.col(c.name).cast("string")), " ") for c in columns if c.pk]
    some = F.lit(False)
    for c in columns:
        if c.pk:
            some = some | F.col(c.name).isNotNull()
    return F.when(some, F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def trigrams(text: Column) -> Column:
    """The different runs of three letters of a name, two spaces put before it and one behind."""
    padded = F.concat(F.lit("  "), F.lower(strip(text)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def alike_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b): all pairs of rows (id, grams: different texts) whose Jaccard likeness is at least the threshold.

    Grams have one order, the rarest first.  Two sets that are alike share a gram among the first
    n - ceil(threshold * n) + 1 of both; so only these prefixes meet, of sets whose sizes allow it, and
    where the places of the shared gram leave enough to share behind it.  A gram that many prefixes
    hold is dealt over tasks.  What is left is verified on whole sets.
    """
    need = lambda n: F.ceil(n * F.lit(threshold) - 1e-9)
    grams = sets.select("id", F.explode("grams").alias("gram"))
    seen = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = grams.withColumn("_salt", F.spark_partition_id() % SALTS).join(seen, ["gram", "_salt"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    sized = known.select("id", "g", F.size("g").alias("n"))
    prefix = stage(sized.select("id", "n", F.posexplode(F.slice("g", F.lit(1), (F.col("n") - need(F.col("n")) + 1).cast("int"))).alias("at", "x")).select("id", "n", "at", "x.gram", "x.df"), "alike-prefixes")
    parts = F.least(F.lit(64), F.ceil(F.col("df") / DEALT)).cast("int")
    left = prefix.select("gram", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    right = prefix.select("gram", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    shared = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    met = left.join(right, ["gram", "part"]).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= need(F.greatest("na", "nb"))))
    met = met.filter(F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= shared).select("a", "b").distinct()
    whole = sets.select("id", "grams")
    both = met.join(whole.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(whole.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= F.lit(threshold) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def fuzzy_entities(names: DataFrame, column: str, threshold: float = 0.7) -> DataFrame:
    """UD5, option: column, entity_id: names whose letter trigrams are alike (Jaccard of at least the threshold), and names alike to those.

    All such pairs are found, see alike_pairs; the least name of a component stands for it.  In each
    round a name takes the least label among its neighbours' and then the label that this label itself
    has, so rounds grow with the logarithm of a chain's length; they end when nothing changes.
    """
    kinds = stage(names.select(column).filter(F.col(column).isNotNull()).distinct(), "names")
    found = stage(alike_pairs(kinds.select(F.col(column).alias("id"), trigrams(F.col(column)).alias("grams")), threshold), "alike")
    pairs = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = stage(kinds.select(F.col(column).alias("a"), F.col(column).alias("label")))
    while True:
        least = pairs.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        # the labels are names too: those whose label fell are told by name, so each is hooked to the least that is known
        step = stage(label.join(least, "a", "left").select("a", "label", F.least("label", "least").alias("now")))
        if step.filter("now < label").isEmpty():
            return label.select(F.col("a").alias(column), F.col("label").alias("entity_id"))
        hooked = step.select(F.col("label").alias("a"), F.col("now").alias("h")).groupBy("a").agg(F.min("h").alias("h"))
        hung = step.join(hooked, "a", "left").select("a", F.least("now", "h").alias("now"))
        jump = hung.select(F.col("a").alias("now"), F.col("now").alias("then"))
        label = stage(hung.join(jump, "now", "left").select("a", F.least("now", "then").alias("label")))


def absorb_partial_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("row_no",)) -> DataFrame:
    """WN6: rows without an entity take that of the nearest row before them in their chunk.

    keys name a chunk: job, document and chunk_index.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("entity_id", F.last("entity_id", ignorenulls=True).over(w))


def entity_merge(df: DataFrame, order: Sequence[str] = ORDER, scope: Sequence[str] = ()) -> DataFrame:
    """AG9: one row per entity_id of a scope; of a column's values the longest, of equals the first; markers (__*)
    and place from the row with the most values.  Rows without an entity pass as they are."""
    skip = {"entity_id", *order, *scope}
    values = [c for c in df.columns if c not in skip and not c.startswith("__")]
    marks = [c for c in df.columns if c.startswith("__")] + list(order)
    rank = [(-F.col(o)).alias(o) for o in order]
    filled = sum((F.col(c).isNotNull().cast("int") for c in values), F.lit(0))
    best = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.length(F.col(c).cast("string")).alias("n"), *rank))).alias(c) for c in values]
    fullest = F.max_by(F.struct(*marks), F.struct(filled.alias("n"), *rank)).alias("_m")
    merged = df.withColumn("_alone", _alone(F.col("entity_id"))).groupBy(*scope, "entity_id", "_alone").agg(*best, fullest)
    return merged.select(*scope, "entity_id", *values, *[F.col(f"_m.{m}").alias(m) for m in marks])


def entity_notes(df: DataFrame, table: str, scope: Sequence[str] = ()) -> DataFrame:
    """AG10."""
    n = df.groupBy(*scope).agg(F.count("entity_id").alias("n"), F.count_distinct("entity_id").alias("m"))
    return n.select(*scope, F.format_string(f"{table}: %d rows tell of %d entities", "n", "m").alias("note"))


def unaccounted_rows(rows: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """ST4: rows that no entity took."""
    return rows.join(assigned.select(key).distinct(), key, "left_anti")




@dataclass(frozen=True)
class ForeignKey:
    """An enabled relationship: table.column refers to parent.parent_column."""

    table: str
    column: str
    parent: str
    parent_column: str


def reconcile(tables: dict[str, DataFrame], declared: dict[str, Sequence[Declared]], links: Sequence[ForeignKey] = (), chunk_pages: DataFrame | None = None, scope: Sequence[str] = ("job_id",), order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """Extracted rows of many jobs to finished tables, in the fixed order: values, entities, foreign keys, natural keys, provenance.

    tables: by name, with the scope's and order's columns (the first of order being chunk_index), the
    declared ones, and others as they are.  A name that isn't declared is left out.  Tables with a key
    have their rows of one entity merged, then of one key; those without are deduplicated by
    fingerprint.  chunk_pages: scope, table_name, chunk_index, pages.  A row's notes are joined in
    reconciliation_notes.  Tables at either end of a link are staged once their entities are merged and
    again when their links are mended, so every table given is read once.
    """
    kept = {name: normalize_row(df, declared[name]) for name, df in tables.items() if name in declared}
    for name, df in kept.items():
        if any(c.pk for c in declared[name]):
            known = df.withColumn("entity_id", entity_id(declared[name]))
            kept[name] = entity_merge(absorb_partial_rows(known, [*scope, order[0]], order[1:]), order, scope).drop("entity_id")
        kept[name] = kept[name].withColumn("_notes", F.array().cast("array<string>"))
    linked = [link for link in links if link.table in kept and link.parent in kept]
    for name in {n for link in linked for n in (link.table, link.parent)}:
        kept[name] = stage(kept[name], f"reconcile-{name}")
    for link in linked:
        kinds = {c.name: c.type for c in declared.get(link.parent, ())}
        if link.parent_column in kinds:
            label = f"{link.table}.{link.column}"
            mended = repair_fk(kept[link.table], link.column, kept[link.parent], f"{link.parent}.{link.parent_column}", label, kinds[link.parent_column], order, scope)
            kept[link.table] = stage(mended.withColumn("_notes", F.concat("_notes", F.array_compact(F.array("fk_note")))).drop("fk_note"), f"mended-{link.table}")
    for name, df in kept.items():
        key = any(c.pk for c in declared[name])
        df = merge_by_natural_key(df, declared[name], order, scope) if key else dedupe_by_fingerprint(df, declared[name], order, scope)
        if chunk_pages is not None:
            df = attach_pages(df, chunk_pages.filter(F.col("table_name") == name), [*scope, order[0]])
        kept[name] = finish_rows(df.withColumn("reconciliation_notes", join_notes(F.col("_notes"))).drop("_notes"))
    return kept

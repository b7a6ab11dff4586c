"""Scalar functions as native Column expressions: coercion, keys, identifiers, page markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as missing and as true or false, whatever the case.
NULL_TOKENS = ("", "null", "none", "n/a", "na", "undefined")
TRUE_TOKENS = ("true", "t", "yes", "y", "1")
FALSE_TOKENS = ("false", "f", "no", "n", "0")
CURRENCY = r"(?U)[$€£¥,\s]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TYPED = {"integer": "bigint", "float": "double", "boolean": "boolean"}
MARKER = r"--- Page (\d+) ---"
_MONTHS_SHORT = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# --- dates: what a date may look like, in lower case
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_NAME, _DAY, _GAP = rf"(?:{_MONTHS})(?![a-z])\.?", r"\d{1,2}(?:st|nd|rd|th)?(?!\d)", r"[\s,./-]*(?:of\s+)?"
_YEAR, _SHORT_YEAR = r"\d{4}(?!\d)", r"'?\d{2}(?!\d)"
#: Runs of parts that are a date, the fullest first; parts of digits alone need one separator.
_RUNS = (
    rf"{_DAY}{_GAP}{_NAME}{_GAP}(?:{_YEAR}|{_SHORT_YEAR})", rf"{_NAME}{_GAP}{_DAY}{_GAP}(?:{_YEAR}|{_SHORT_YEAR})", rf"{_YEAR}{_GAP}{_NAME}{_GAP}{_DAY}",
    *(rf"\d{{4}}{sep}\d{{1,2}}{sep}\d{{1,2}}" for sep in ("-", "/", r"\.")), *(rf"\d{{1,2}}{sep}\d{{1,2}}{sep}(?:\d{{4}}|\d{{2}})" for sep in ("-", "/", r"\.")), r"\d{8}",
    rf"{_DAY}{_GAP}{_NAME}", rf"{_NAME}{_GAP}(?:{_YEAR}|{_DAY})", rf"{_YEAR}{_GAP}{_NAME}", r"\d{4}[-/]\d{1,2}", r"\d{1,2}[-/]\d{4}", r"\d{1,2}/\d{1,2}",
)
_RUN = rf"(?<![\w.])(?<!\d[-/])(?:{'|'.join(_RUNS)})(?!\w|[-/.]\d)"
#: Times of day, which are no part of a date.
_TIME = r"(?:(?<=\d)t|\bat\s+|(?<![\w:]))\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[ap]\.?m\b\.?)?\s*(?:z\b|utc\b|gmt\b|[+-]\d{2}:?\d{2}(?!\d))?"


def strip(v: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def null_tokens(v: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """SC1: null for blank text and the words that stand for a missing value."""
    return F.when(F.lower(strip(v)).isin(*tokens), F.lit(None).cast("string")).otherwise(v)


def to_string(v: Column) -> Column:
    """SC2: stripped, in Unicode's composed form."""
    from docframe.functions.udfs import composed

    return composed(strip(null_tokens(v)))


def _number(v: Column) -> Column:
    """The text of a plain number: currency and spaces gone, the minus sign made ASCII; else null."""
    bare = F.regexp_replace(F.translate(null_tokens(v), "−", "-"), CURRENCY, "")
    return F.when(bare.rlike(NUMBER), bare)


def to_float(v: Column) -> Column:
    """SC4."""
    return _number(v).try_cast("double")


def to_int(v: Column) -> Column:
    """SC3: truncated toward zero; null outside 64 bits."""
    return to_float(v).try_cast("bigint")


def to_bool(v: Column) -> Column:
    """SC5."""
    word = F.lower(strip(null_tokens(v)))
    return F.when(word.isin(*TRUE_TOKENS), F.lit(True)).when(word.isin(*FALSE_TOKENS), F.lit(False))


def to_date(v: Column, reference: Column | None = None) -> Column:
    """SC6: the first whole date of a text, else its first with a part missing.

    A date is a run of numbers and month names; weekdays, times and other words are passed over.  Of
    numbers alone the month comes before the day where both fit, and a number of four digits or over 31
    that stands first is the year; with a month's name the other short number is the day.  Years of two
    digits are those within 50 years of ``reference`` (today, if not given).  A missing day or year is
    the reference's, a day past the month's end its last one.  A lone number or name is no date.
    """
    reference = F.current_date() if reference is None else reference
    text = F.regexp_replace(F.lower(null_tokens(v)), _TIME, " ")
    atoms = F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), lambda r: F.regexp_extract_all(r, F.lit(rf"\d+|{_MONTHS}"), F.lit(0)))
    digits = lambda x: x.rlike(r"^\d")
    runs = F.transform(atoms, lambda a: F.struct(F.get(F.filter(a, lambda x: ~digits(x)), F.lit(0)).alias("name"), F.filter(a, digits).alias("n")))
    # eight digits are a year, a month and a day
    runs = F.transform(runs, lambda r: F.struct(r["name"].alias("name"), F.when(F.length(r["n"][0]) == 8, F.array(F.substring(r["n"][0], 1, 4), F.substring(r["n"][0], 5, 2), F.substring(r["n"][0], 7, 2))).otherwise(r["n"]).alias("n")))
    dates = F.transform(F.transform(runs, _parts), lambda p: _dated(p, reference))
    first = lambda known: F.get(F.filter(dates, lambda d: d["date"].isNotNull() & (d["known"] >= known)), F.lit(0))["date"]
    return F.coalesce(first(3), first(2))


def _parts(run: Column) -> Column:
    """year (a text), month, day of a run's name and numbers; null where it has none."""
    n = [F.get(run["n"], F.lit(k)) for k in range(3)]
    whole = [x.cast("int") for x in n]
    count, named, year_first = F.size(run["n"]), run["name"].isNotNull(), (F.length(n[0]) == 4) | (whole[0] > 31)
    pick = lambda *cases: F.coalesce(*[F.when(c, x) for c, x in cases])
    month = F.array_position(F.lit(_MONTHS_SHORT), F.substring(run["name"], 1, 3)).cast("int")
    year = pick((year_first, n[0]), (named & (count == 2), n[1]), (~named & (count == 3), n[2]), (~named & (count == 2) & (F.length(n[1]) == 4), n[1]))
    # two numbers of a date without names, in their order
    low, high = F.when(year_first, whole[1]).otherwise(whole[0]), F.when(year_first, whole[2]).otherwise(F.when((count == 2) & (F.length(n[1]) == 4), None).otherwise(whole[1]))
    swapped = (low > 12) & (high <= 12)
    day = F.when(named, F.when(year_first, whole[1]).otherwise(whole[0])).otherwise(F.when(swapped, low).otherwise(high))
    return F.struct(year.alias("year"), F.when(named, month).otherwise(F.when(swapped, high).otherwise(low)).alias("month"), day.alias("day"))


def _dated(p: Column, reference: Column) -> Column:
    """date, known (parts): null where no such day is."""
    now, short = F.year(reference), F.length(p["year"]) < 3
    near = F.floor(now / 100).cast("int") * 100 + p["year"].cast("int")
    year = F.coalesce(F.when(short, near + F.when(near >= now + 50, -100).when(near < now - 50, 100).otherwise(0)), p["year"].cast("int"), now)
    first = F.try_to_timestamp(F.format_string("%04d-%02d-01", year, p["month"]), F.lit("yyyy-MM-dd")).cast("date")
    day = F.coalesce(p["day"], F.least(F.dayofmonth(reference), F.dayofmonth(F.last_day(first))))
    date = F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))
    return F.struct(date.alias("date"), (p["year"].isNotNull().cast("int") + p["month"].isNotNull().cast("int") + p["day"].isNotNull().cast("int")).alias("known"))


COERCE = {"string": to_string, "integer": to_int, "float": to_float, "boolean": to_bool, "date": to_date}


def coerce(v: Column, kind: str, source: str = "string") -> Column:
    """SC7: a value of Spark type ``source`` as a declared kind.

    Texts are read by the rules above.  A boolean counts as 1 or 0, a number is true unless it is 0,
    and either becomes a text as it is written; only texts and dates become dates.
    """
    if source == "string":
        return COERCE[kind](v)
    if kind == "string":
        return to_string(F.initcap(v.cast("string")) if source == "boolean" else F.to_json(v) if source.startswith(("array", "map", "struct")) else v.cast("string"))
    if kind == "date":
        return v.cast("date") if source.startswith(("date", "timestamp")) else F.lit(None).cast("date")
    if source == "boolean":
        return v if kind == "boolean" else v.cast(TYPED[kind])
    if source in ("tinyint", "smallint", "int", "bigint", "float", "double") or source.startswith("decimal"):
        return v != 0 if kind == "boolean" else v.try_cast(TYPED[kind])
    return F.lit(None).cast(TYPED[kind])


def key_part(v: Column, kind: str = "string") -> Column:
    """How a value counts in a natural key: text without case or outer space, else as it is."""
    return F.lower(strip(v)) if kind == "string" else v


def natural_key(cols: Sequence[tuple[Column, str]]) -> Column:
    """SC8: the key as a struct, null if any part is."""
    parts = [key_part(c, k) for c, k in cols]
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    return F.when(whole, F.struct(*[p.alias(f"k{n}") for n, p in enumerate(parts)]))


def fingerprint(strings: Sequence[Column], otherwise: Sequence[Column] = ()) -> Column:
    """SC9: the first three texts that aren't blank, 50 characters each; without any, a hash of all columns."""
    texts = F.filter(F.array(*[F.substring(F.lower(strip(c)), 1, 50) for c in strings]), lambda t: t.isNotNull() & (t != "")) if strings else F.array().cast("array<string>")
    joined = F.array_join(F.slice(texts, 1, 3), "|")
    if not otherwise:
        return joined
    return F.when(F.size(texts) > 0, joined).otherwise(F.concat(F.lit("#"), F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in otherwise]).cast("binary"))))


def token_set(v: Column) -> Column:
    """SC10: the distinct lower-case tokens between commas, points and spaces, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(strip(v)), r"(?U)[,.\s]+"), lambda t: t != "")))


def snake_case(v: Column) -> Column:
    """SC11."""
    bare = F.regexp_replace(F.lower(strip(v)), r"[^a-z0-9_]+", "_")
    return F.regexp_replace(F.regexp_replace(bare, "_+", "_"), "^_+|_+$", "")


def page_markers(text: Column) -> Column:
    """SC12 and ST6: the distinct page numbers of a text's markers, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda n: n.cast("int")))


def page_header(page: Column) -> Column:
    """SC24."""
    return F.format_string("--- Page %d ---", page)


def poly_to_bbox(poly: Column) -> Column:
    """SC13: the box around an array of points [x, y], whole numbers; zeros without points."""
    side = lambda f, k: F.coalesce(f(F.transform(poly, lambda p: p[k])).cast("int"), F.lit(0))
    return F.struct(side(F.array_min, 0).alias("x1"), side(F.array_min, 1).alias("y1"), side(F.array_max, 0).alias("x2"), side(F.array_max, 1).alias("y2"))


def lookup_key(v: Column, kind: str = "string") -> Column:
    """SC14: the graph's key of a value; case folded for text."""
    return F.lower(F.replace(strip(v), F.lit("ß"), F.lit("ss"))) if kind == "string" else v.cast("string")


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Version 5 UUID of a text in a namespace given in hex (by default the one for URLs)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("bigint")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def canonical(cols: dict[str, Column]) -> Column:
    """A row as text for identifiers: column=value by name, nulls left out."""
    return F.concat_ws("␟", *[F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in sorted(cols.items())])


def row_key(table: str, pk: dict[str, tuple[Column, str]], index: Column, row: dict[str, Column]) -> Column:
    """SC15: by the primary key if all its parts are there, else by the row's content and place."""
    other = F.concat(F.lit("row:"), uuid5(F.concat_ws("␟", F.lit(table), index.cast("string"), canonical(row))))
    if not pk:
        return other
    parts = [F.concat(F.lit(f"{n}="), lookup_key(c, k)) for n, (c, k) in pk.items()]
    whole = F.lit(True)
    for c, _ in pk.values():
        whole = whole & c.isNotNull()
    return F.when(whole, F.concat(F.lit(f"pk:{table}:"), F.concat_ws("|", *parts))).otherwise(other)


def point_id(table: str, index: Column, row: dict[str, Column]) -> Column:
    """SC20."""
    return uuid5(F.concat_ws("␟", F.lit(table), index.cast("string"), canonical(row)))


def edge_key(source: Column, target: Column, ordinal: Column) -> Column:
    """SC16."""
    return F.concat_ws("|", source, target, ordinal.cast("string"))


def edge_type(source: Column, target: Column) -> Column:
    """SC17."""
    name = F.regexp_replace(F.upper(F.concat(source, F.lit("_TO_"), target)), "[^A-Z0-9_]", "_")
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("REL_"), name)).otherwise(name)


def is_identifier(v: Column) -> Column:
    """SC18."""
    return F.coalesce(v.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def row_text(table: str, declared: dict[str, Column], extras: dict[str, Column] | None = None) -> Column:
    """SC19: the table and each value that isn't null on a line; declared order, then other columns by name."""
    lines = [*declared.items(), *sorted((extras or {}).items())]
    return F.concat_ws("\n", F.lit(f"table: {table}"), *[F.concat(F.lit(f"{n}: "), c.cast("string")) for n, c in lines])


def to_payload(cols: dict[str, Column]) -> Column:
    """SC21: the row as JSON, dates as ISO text."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]), {"dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"})


def namespace(job_id: Column) -> Column:
    """SC22."""
    return F.concat(F.lit("job_"), F.replace(job_id, F.lit("-"), F.lit("_")))


def artifact_prefix(key: Column) -> Column:
    """SC23: the folder of an object key, slash included."""
    return F.regexp_extract(key, r"^(.*/)", 1)


def cap_context(text: Column, most: int = 16_000) -> Column:
    """FLT8: what fits a model's context."""
    return F.substring(text, 1, most)

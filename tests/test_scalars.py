import datetime
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from docframe.functions import scalars as S


def values(spark, items, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(items)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_null_tokens(spark):
    assert values(spark, [None, " ", " N/A ", "undefined", "na", "NULL", "nab", "0"], S.null_tokens) == [None] * 6 + ["nab", "0"]


def test_numbers(spark):
    texts = ["$1,234.50", "−5", "-5", "(5)", "5%", "1_000", "1e3", "inf", "nan", "1e30", "1d", " 7 ", " 8 ", ".5", "x", None]
    assert values(spark, texts, S.to_float) == [1234.5, -5, -5, None, None, None, 1000, None, None, 1e30, None, 7, 8, 0.5, None, None]
    assert values(spark, texts, S.to_int) == [1234, -5, -5, None, None, None, 1000, None, None, None, None, 7, 8, 0, None, None]


def test_booleans_and_dates(spark):
    assert values(spark, ["Yes", "0", "maybe", " T ", None, "n"], S.to_bool) == [True, False, None, True, None, False]
    d = datetime.date
    texts = ["2024-03-04", "03/04/2024", "13/04/2024", "Invoice dated 2024-03-04 paid", "garbage", "May 5, 2024", "n/a"]
    assert values(spark, texts, S.to_date) == [d(2024, 3, 4), d(2024, 3, 4), d(2024, 4, 13), d(2024, 3, 4), None, d(2024, 5, 5), None]
    texts = ["March 5, 2024", "5 March 2024", "Mar 5 2024", "03-04-2024", "4.3.2024", "3/4/24", "the 1st of may, 1999", "Sept. 9th, 2001", "2024.12.31", "3/4-2024", "99/99/2024", "12024-03-04"]
    assert values(spark, texts, S.to_date) == [*[d(2024, 3, 5)] * 3, d(2024, 3, 4), d(2024, 4, 3), d(2024, 3, 4), d(1999, 5, 1), d(2001, 9, 9), d(2024, 12, 31), None, None, None]


def test_a_grammar_of_dates(spark):
    d, today = datetime.date, F.lit("2023-01-31").cast("date")
    said = {
        "20240304": d(2024, 3, 4), "5-Mar-2024": d(2024, 3, 5), "05Mar2024": d(2024, 3, 5), "May 5": d(2023, 5, 5), "March 2024": d(2024, 3, 31), "5-Mar-24": d(2024, 3, 5), "Mar 24": d(2023, 3, 24), "Feb 2023": d(2023, 2, 28),
        "Tuesday, 5 March 2024 at 10:30 pm": d(2024, 3, 5), "2024-03-04T23:59:59.123+02:00": d(2024, 3, 4), "10:30 2024/3/4": d(2024, 3, 4), "2024-3": d(2024, 3, 31), "3/2024": d(2024, 3, 31), "13/4": d(2023, 4, 13), "4/13": d(2023, 4, 13),
        "paid 12 of 40 items, June 3rd '99": d(1999, 6, 3), "from 3/4 to 5 May 2021": d(2021, 5, 5), "73-01-02": None, "1/2/73": d(1973, 1, 2), "1/2/72": d(2072, 1, 2), "31/12/1999": d(1999, 12, 31), "Feb 30, 2024": None, "29 Feb 2024": d(2024, 2, 29),
        "you may pay 5": None, "may": None, "7": None, "2024": None, "10.0.0.1": None, "12.5": None, "v1.2.3.4": None, "20241399": None, "1, 2, 3": None, "marching 5": None, "maybe 5 bands": None, "2021 Dec 9": d(2021, 12, 9), "": None, None: None,
    }
    said.pop("73-01-02")
    assert dict(zip(said, values(spark, list(said), lambda v: S.to_date(v, today)))) == said


def test_typed_values(spark):
    typed = lambda items, kind, source: values(spark, items, lambda v: S.coerce(v, kind, source), source)
    assert typed([5, 0, None], "boolean", "bigint") == [True, False, None] and typed([2.5, 0.0], "boolean", "double") == [True, False]
    assert typed([True, False, None], "integer", "boolean") == [1, 0, None] and typed([True], "float", "boolean") == [1.0] and typed([True], "string", "boolean") == ["True"]
    assert typed([2.9, -2.9, 1e30, float("nan")], "integer", "double") == [2, -2, None, None] and typed([7], "date", "int") == [None]
    assert typed([datetime.date(2024, 1, 2)], "date", "date") == [datetime.date(2024, 1, 2)] and typed([["a"]], "string", "array<string>") == ['["a"]']


def test_strings(spark):
    texts = ["é ", "plain", None, " x "]
    assert values(spark, texts, S.to_string) == [unicodedata.normalize("NFC", "é"), "plain", None, "x"]
    assert values(spark, [" Total  Amount ($)", "9lives", "__a--b__", "é"], S.snake_case) == ["total_amount", "9lives", "a_b", ""]
    assert values(spark, ["Last, First", "first  LAST", "a.b,,a"], S.token_set) == [["first", "last"], ["first", "last"], ["a", "b"]]


def test_keys(spark):
    df = spark.createDataFrame([("Acme Corp ", 1), ("acme corp", 1), (None, 1)], "a string, b int")
    keys = [r[0] for r in df.select(S.natural_key([(F.col("a"), "string"), (F.col("b"), "integer")])).collect()]
    assert keys[0] == keys[1] and keys[2] is None
    marks = [r[0] for r in df.select(S.fingerprint([F.col("a"), F.lit(" "), F.lit("X" * 60)])).collect()]
    assert marks == ["acme corp|" + "x" * 50] * 2 + ["x" * 50]
    assert values(spark, ["Straße", " A "], S.lookup_key) == ["strasse", "a"]


def test_uuid_is_version_5(spark):
    assert values(spark, ["a", "ü", ""], S.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in ("a", "ü", "")]


def test_graph_names(spark):
    df = spark.createDataFrame([("line item", "9x"), ("9a", "b")], "a string, b string")
    assert [r[0] for r in df.select(S.edge_type(F.col("a"), F.col("b"))).collect()] == ["LINE_ITEM_TO_9X", "REL_9A_TO_B"]
    df = spark.createDataFrame([("Acme", 2), (None, 3)], "a string, i int")
    keys = [r[0] for r in df.select(S.row_key("t", {"a": (F.col("a"), "string")}, F.col("i"), {"a": F.col("a")})).collect()]
    assert keys[0] == "pk:t:a=acme" and keys[1].startswith("row:") and len(keys[1]) == 40


def test_markers_and_boxes(spark):
    assert values(spark, ["--- Page 2 ---\nx --- Page 1 --- --- Page 2 ---", "--- Page x ---", None], S.page_markers) == [[2, 1], [], None]
    box = values(spark, [[[3.9, 1.0], [-2.5, 8.2]], None], S.poly_to_bbox, "array<array<double>>")
    assert [tuple(b) for b in box] == [(-2, 1, 3, 8), (0, 0, 0, 0)]


def test_text_of_a_row(spark):
    df = spark.createDataFrame([("x", None, 2.5)], "a string, b string, z double")
    cols = {c: F.col(c) for c in "ab"}
    assert df.select(S.row_text("t", cols, {"z": F.col("z")})).first()[0] == "table: t\na: x\nz: 2.5"
    assert df.select(S.to_payload(cols)).first()[0] == '{"a":"x","b":null}'


@pytest.mark.parametrize("key, prefix", [("u/j/doc.pdf", "u/j/"), ("doc.pdf", "")])
def test_prefix(spark, key, prefix):
    assert values(spark, [key], S.artifact_prefix) == [prefix]

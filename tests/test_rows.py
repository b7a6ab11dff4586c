import random

import pytest
from pyspark.sql import functions as F

from docframe.operators import constraints, reconcile
from docframe.operators.reconcile import Declared
from docframe.session import stage

COLS = [Declared("k", "string", True), Declared("a"), Declared("b", "integer")]
SCHEMA = "k string, a string, b long, chunk_index int, row_no int"


def merged(spark, rows, parts=1):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in reconcile.merge_by_natural_key(df, COLS).collect()), key=repr)


def test_merge(spark):
    rows = [("Acme ", "x", None, 0, 0), ("acme", "y", 1, 0, 1), ("ACME", None, 2, 1, 0), (None, "n", 1, 0, 2), (None, "n", 1, 0, 3)]
    assert merged(spark, rows) == sorted([("Acme ", "x", 1, 0, 0), (None, "n", 1, 0, 2), (None, "n", 1, 0, 3)], key=repr)
    assert merged(spark, rows, 7) == merged(spark, rows)
    assert merged(spark, merged(spark, rows)) == merged(spark, rows)


def test_merge_notes(spark):
    rows = [("a", None, 1, 0, 0), ("a", "x", 2, 0, 1), ("a", "y", 3, 0, 2), (None, "z", 1, 0, 3)]
    notes = [r.note for r in reconcile.merge_notes(spark.createDataFrame(rows, SCHEMA), "t", COLS).orderBy("row_no").collect()]
    assert notes == ["t: a later row of key a gave a", "t: a later row of key a gave nothing new", "t: kept as it is, for want of k"]


def test_fingerprint(spark):
    rows = [("a", "x", 1, 0, 0), ("A ", "X", 2, 0, 1), ("b", "x", 1, 0, 2), (None, None, 5, 0, 3), (None, None, 5, 1, 0), (None, None, 6, 1, 1)]
    out = reconcile.dedupe_by_fingerprint(spark.createDataFrame(rows, SCHEMA), COLS).collect()
    assert sorted((r.chunk_index, r.row_no) for r in out) == [(0, 0), (0, 2), (0, 3), (1, 1)]


def test_fk_repair(spark):
    parents = spark.createDataFrame([("Jane Roe", 0, 0), ("ACME", 0, 1), ("Acme", 0, 2), (None, 0, 3)], "name string, chunk_index int, row_no int")
    child = spark.createDataFrame([(1, " acme"), (2, "Roe, Jane"), (3, "nobody"), (4, None)], "i int, who string")
    out = {r.i: (r.who, r.fk_note) for r in reconcile.repair_fk(child, "who", parents, "name", "t.who").collect()}
    assert out == {1: ("Acme", None), 2: ("Jane Roe", "t.who: 'Roe, Jane' was read as 'Jane Roe', which has the same words"), 3: ("nobody", "t.who: 'nobody' is no value of name"), 4: (None, None)}
    assert [r.i for r in reconcile.fk_misses(child, "who", parents, "name").collect()] == [3]


def test_entities(spark):
    rows = [("Roe, Jane", None, 1, 0, 0), ("Jane Roe", "long", 1, 0, 1), (None, "longest one", None, 0, 2), ("Bob", "b", 2, 1, 1), (None, "z", None, 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("entity_id", reconcile.entity_id(COLS))
    out = {r.entity_id: r for r in reconcile.entity_merge(reconcile.absorb_partial_rows(df, ["chunk_index"])).collect()}
    assert set(out) == {"jane roe", "bob", None}
    assert (out["jane roe"].k, out["jane roe"].a, out["jane roe"].row_no) == ("Roe, Jane", "longest one", 1)
    assert out[None].a == "z"


def test_unique_columns_load_in_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(8)]), rng.choice([None, *range(8)])) for i in range(60)]
    seen, want = [set(), set()], []
    for i, *vals in rows:
        if all(v is None or v not in s for v, s in zip(vals, seen)):
            want.append(i)
            for v, s in zip(vals, seen):
                s.add(v)
    df = spark.createDataFrame(rows, "i int, a int, b int")
    assert sorted(r.i for r in constraints.unique_survivors(df, ["a", "b"], ["i"], stage).collect()) == want


def test_types_and_report(spark):
    df = spark.createDataFrame([(1, "5", "x"), (2, "y", "2024-01-01"), (3, None, None)], "i int, n string, d string")
    assert [(r.i, r.bad_column) for r in constraints.type_violations(df, {"n": "integer", "d": "date"}).orderBy("i").collect()] == [(1, "d"), (2, "n")]
    offered = df.select(F.lit("t").alias("table_name"))
    assert tuple(constraints.load_report(offered, offered.limit(1)).first()) == ("t", 3, 1, 2)


def test_declared_projection(spark):
    df = spark.createDataFrame([("a", ["x"], 1)], "k string, a array<string>, __i int")
    r = reconcile.project_declared(df, COLS).first()
    assert r.a == '["x"]' and r.b is None and "__i" not in r.asDict() and r.source_page_numbers is None
    assert "__i" not in reconcile.finish_rows(df).columns


def test_fuzzy_entities(spark):
    names = spark.createDataFrame([(n,) for n in ("Acme Corporation", "acme corporation ", "Acme Corporations", "Globex Industries", None)], "name string")
    got = {r.name: r.entity_id for r in reconcile.fuzzy_entities(names, "name").collect()}
    assert len(set(got.values())) == 2 and got["Acme Corporation"] == got["acme corporation "] == got["Acme Corporations"]
    chain = spark.createDataFrame([("".join(chr(97 + (k + j) % 26) for j in range(20)),) for k in range(60)], "name string")
    assert {r.entity_id for r in reconcile.fuzzy_entities(chain, "name", 0.6).collect()} == {chain.agg(F.min("name")).first()[0]}


def test_jobs_and_documents_stay_apart(spark):
    schema = "job_id int, k string, a string, b long, chunk_index int, row_no int"
    rows = [(1, "x", "p", None, 0, 0), (1, "X", None, 5, 0, 1), (2, "x", "q", 7, 0, 0), (2, None, "late", None, 0, 1), (1, None, None, None, 1, 0)]
    df = spark.createDataFrame(rows, schema)
    merged = reconcile.merge_by_natural_key(df, COLS, scope=["job_id"], counted="n")
    assert sorted((r.job_id, r.k, r.a, r.b, r.n) for r in merged.filter("k IS NOT NULL").collect()) == [(1, "x", "p", 5, 2), (2, "x", "q", 7, 1)]
    assert sorted((r.job_id, r.note) for r in reconcile.merge_notes(df, "t", COLS, scope=["job_id"]).filter("note LIKE '% gave b'").collect()) == [(1, "t: a later row of key x gave b")]
    known = reconcile.absorb_partial_rows(df.withColumn("entity_id", reconcile.entity_id(COLS)), ["job_id", "chunk_index"])
    assert sorted((r.job_id, r.chunk_index, r.row_no, r.entity_id) for r in known.collect()) == [(1, 0, 0, "x"), (1, 0, 1, "x"), (1, 1, 0, None), (2, 0, 0, "x"), (2, 0, 1, "x")]
    out = {(r.job_id, r.entity_id): r for r in reconcile.entity_merge(known, scope=["job_id"]).collect()}
    assert out[2, "x"].a == "late" and out[1, "x"].b == 5 and len(out) == 3
    pages = spark.createDataFrame([(1, "t", 0, [3]), (2, "t", 0, [4])], "job_id int, table_name string, chunk_index int, pages array<int>")
    assert sorted({(r.job_id, r.chunk_index, str(r.source_page_numbers)) for r in reconcile.attach_pages(df, pages, ["job_id", "chunk_index"]).collect()}) == [(1, 0, "[3]"), (1, 1, "None"), (2, 0, "[4]")]


def test_reconcile_in_order(spark):
    people = spark.createDataFrame([(1, "Jane Roe", "$5", 0, 0), (1, "Roe, Jane", None, 1, 0), (2, "Bob", "x", 0, 0)], "job_id int, name string, age string, chunk_index int, row_no int")
    bills = spark.createDataFrame([(1, "b1", "roe. jane", 0, 0), (1, "b2", "nobody", 0, 1), (2, "b1", "nobody", 0, 0), (3, "b1", "alone", 0, 0)], "job_id int, bill string, who string, chunk_index int, row_no int")
    declared = {"people": [Declared("name", "string", True), Declared("age", "integer")], "bills": [Declared("bill", "string", True), Declared("who")]}
    pages = spark.createDataFrame([(1, "bills", 0, [7])], "job_id int, table_name string, chunk_index int, pages array<int>")
    done = reconcile.reconcile({"people": people, "bills": bills, "unknown": bills}, declared, [reconcile.ForeignKey("bills", "who", "people", "name"), reconcile.ForeignKey("bills", "who", "nowhere", "x")], pages)
    assert set(done) == {"people", "bills"}
    assert sorted((r.job_id, r.name, r.age) for r in done["people"].collect()) == [(1, "Roe, Jane", 5), (2, "Bob", None)]
    got = {(r.job_id, r.bill): (r.who, r.reconciliation_notes, r.source_page_numbers) for r in done["bills"].collect()}
    assert got == {
        (1, "b1"): ("Roe, Jane", "bills.who: 'roe. jane' was read as 'Roe, Jane', which has the same words", [7]), (1, "b2"): ("nobody", "bills.who: 'nobody' is no value of people.name", [7]),
        (2, "b1"): ("nobody", "bills.who: 'nobody' is no value of people.name", None), (3, "b1"): ("alone", None, None),
    }


@pytest.mark.parametrize(("threshold", "seed"), [(0.5, 1), (0.7, 2), (0.9, 3), (1.0, 4)])
def test_alike_pairs_are_those_of_brute_force(spark, monkeypatch, threshold, seed):
    """Frequent grams, which many names share, are dealt over tasks."""
    monkeypatch.setattr(reconcile, "DEALT", 5)
    rng = random.Random(seed)
    names = sorted({"aaa " + "".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(120)} | {"", "a", "aa", "\u00e9\u00e9"})
    sets = spark.createDataFrame([(n,) for n in names], "id string").withColumn("grams", reconcile.trigrams(F.col("id")))
    grams = {r.id: set(r.grams) for r in sets.collect()}
    want = {(a, b) for a in names for b in names if a < b and len(grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b]) - 1e-9}
    got = [(r.a, r.b) for r in reconcile.alike_pairs(sets, threshold).collect()]
    assert set(got) == want and len(got) == len(want)


def test_linked_tables_are_read_once(spark, tmp_path):
    """A plan of reconcile() over stored tables scans each of them once in all its jobs."""
    child, parent = str(tmp_path / "child"), str(tmp_path / "parent")
    spark.createDataFrame([("j", f"b{k}", f"p{k % 5}", k, 0) for k in range(20)], "job_id string, no string, who string, chunk_index int, row_no int").write.parquet(child)
    spark.createDataFrame([("j", f"P{k}", k, 0) for k in range(5)], "job_id string, name string, chunk_index int, row_no int").write.parquet(parent)
    declared = {"child": [reconcile.Declared("no", pk=True), reconcile.Declared("who")], "parent": [reconcile.Declared("name", pk=True)]}
    scans, stage_ = [], reconcile.stage

    def noted(df, name="stage"):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString() + str(df.inputFiles()))
        return stage_(df, name)

    reconcile.stage, kept = noted, reconcile.stage
    try:
        out = reconcile.reconcile({"child": spark.read.parquet(child), "parent": spark.read.parquet(parent)}, declared, [reconcile.ForeignKey("child", "who", "parent", "name")])
    finally:
        reconcile.stage = kept
    scans += [str(df.inputFiles()) for df in out.values()]
    assert sum(str(child) in s for s in scans) == sum(str(parent) in s for s in scans) == 1
    assert sorted({r.who for r in out["child"].collect()}) == [f"P{k}" for k in range(5)]
    leaves = [df._jdf.queryExecution().optimizedPlan().collectLeaves().size() for df in out.values()]
    assert leaves == [1, 1]

"""Keys and links found in data, against brute force."""

import random
from itertools import combinations, permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docframe.operators import keys
from docframe.operators import model as M
from docframe.operators.keys import Evidence, inclusions, links_to_keys, smallest_key


def unique(rows, s):
    return len({tuple(r[k] for k in s) for r in rows}) == len(rows)


@settings(deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2)] * 5), min_size=1, max_size=12), st.integers(1, 5))
def test_candidates_are_what_all_evidence_allows(rows, size):
    """With all pairs as evidence the candidates of the smallest size are the keys."""
    evidence = Evidence(5)
    evidence.add(Evidence.differing(a, b) for a, b in combinations(rows, 2))
    keys_ = [s for s in combinations(range(5), size) if unique(rows, s)]
    smaller = any(unique(rows, s) for n in range(size) for s in combinations(range(5), n))
    if not smaller:
        assert evidence.candidates(size) == keys_


@pytest.mark.parametrize("seed", range(3))
def test_smallest_key(spark, seed):
    rng = random.Random(seed)
    rows = list({tuple(rng.choice("abc") if k % 2 else rng.randint(0, 3 + seed) for k in range(6)) for _ in range(150)})
    df = spark.createDataFrame(rows, "c0 int, c1 string, c2 int, c3 string, c4 int, c5 string").repartition(4)
    want = next(s for n in range(1, 7) for s in combinations(range(6), n) if unique(rows, s))
    assert smallest_key(df, df.columns) == tuple(f"c{k}" for k in want)
    assert smallest_key(df.unionByName(df.limit(1)), df.columns) == () == smallest_key(df.limit(0), df.columns)
    assert smallest_key(df.limit(1), df.columns) == ("c0",)


def test_a_key_of_four_among_sixty_columns_takes_few_passes(spark, monkeypatch):
    """And no sample shows it: the rows that refute smaller sets are rare."""
    n = 6000
    base = spark.range(n).select(
        *[(F.col("id") / d % m).cast("int").alias(f"k{j}") for j, (d, m) in enumerate([(1, 9), (9, 9), (81, 9), (729, 9)])],
        *[F.when(F.col("id") % 2999 == j, j).otherwise((F.col("id") * (j + 3) % 7).cast("int") % (2 + j % 3)).cast("int").alias(f"x{j}") for j in range(56)],
    )
    passes, failing = [], keys._failing
    monkeypatch.setattr(keys, "_failing", lambda rows, sets: passes.append(len(sets)) or failing(rows, sets))
    found = smallest_key(base, base.columns)
    assert len(found) <= 4 and base.select(*found).distinct().count() == n
    assert len(passes) <= 12, passes
    passes.clear()
    assert smallest_key(base.select("k0", "k1", "k2", "k3"), ["k3", "k2", "k1", "k0"]) == ("k3", "k2", "k1", "k0")


@pytest.fixture(scope="module")
def shop(spark):
    customer = spark.createDataFrame([(k, f"n{k % 3}", k // 2 if k > 1 else None) for k in range(1, 30)], "customer_id int, name string, parent_id int")
    sale = spark.createDataFrame([(k, str(1 + k % 29), "ab"[k % 2], k % 7) for k in range(40, 120)], "no int, buyer string, shop string, shelf int")
    place = spark.createDataFrame([(s, n, 1) for s in "abc" for n in range(7)], "shop string, shelf int, floor int")
    return {"customer": customer, "sale": sale, "place": place}


def test_links(shop):
    columns = M.propose_columns(shop)
    assert {(r.table_name, r.column_name) for r in columns.filter("is_primary_key").collect()} == {("customer", "customer_id"), ("sale", "no"), ("place", "shop"), ("place", "shelf")}
    got = {(r.source_table, tuple(r.source_columns), r.references_table, tuple(r.references_columns)) for r in M.propose_links(shop, columns).collect()}
    assert {("sale", ("buyer",), "customer", ("customer_id",)), ("customer", ("parent_id",), "customer", ("customer_id",)), ("sale", ("shop", "shelf"), "place", ("shop", "shelf"))} <= got
    assert not any(t == "place" and c == ("shelf", "shop") for t, c, _, _ in got)
    best = {(r.source_table, r.source_column): r.references_table for r in M.propose_relationships(shop, columns).collect()}
    assert best["sale", "buyer"] == best["customer", "parent_id"] == "customer" and ("sale", "no") not in best


@pytest.mark.parametrize("seed", range(3))
def test_links_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    tables, rows = {}, {}
    for t, width in (("p", 3), ("q", 4)):
        rows[t] = [tuple(rng.choice([None, *range(3 + 2 * (t == "p"))]) for _ in range(width)) for _ in range(30)]
        tables[t] = spark.createDataFrame(rows[t], ", ".join(f"{t}{k} int" for k in range(width)))
    kinds = {(t, c): "integer" for t, df in tables.items() for c in df.columns}
    key = ("p0", "p1", "p2")

    def values(t, cols):
        at = [int(c[1:]) for c in cols]
        return {v for r in rows[t] if None not in (v := tuple(r[k] for k in at))}

    want = sorted((t, c, "p", key, len(values(t, c)), len(values("p", key))) for t, df in tables.items() for c in permutations(df.columns, 3) if (t, c) != ("p", key) and values(t, c) and values(t, c) <= values("p", key))
    assert links_to_keys(tables, kinds, {"p": key}) == want


def test_inclusions_by_type(spark):
    tables = {"a": spark.createDataFrame([("1", "x"), ("+2", None), (None, "y")], "n string, s string"), "b": spark.createDataFrame([(1.0, 2), (2.0, 1), (3.0, 3)], "f double, i int")}
    attributes = [("a", ("n",), ("integer",)), ("b", ("i",), ("integer",)), ("b", ("f",), ("float",)), ("a", ("s",), ("string",)), ("a", ("n", "s"), ("integer", "string"))]
    assert inclusions(tables, attributes) == {(0, 1): (2, 3, 2)}

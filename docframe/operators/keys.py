"""MD8: keys and links that the data themselves show: minimal unique sets of columns, and inclusions between columns.

Keys.  Two rows that agree on a set of columns prove that it and all its subsets are no key: each pair
of rows gives evidence, the columns on which it differs, and a key must hold one of these of every pair.
Pairs of a bounded sample give the first evidence.  The smallest sets that meet all of it are tested on
all rows, several in a pass; where one fails, pairs that it can't tell apart are new evidence, so no
set is tested twice and few are tested at all, whatever the number of columns.

Inclusions.  One shuffle of the distinct values of all columns gives, for each value, the set of columns
that hold it; summed up per pair of columns, these tell which columns' values are all in which others.
Links to keys of several columns grow level by level from those of one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.scalars import to_date, to_float, to_int

#: Rows of the first evidence at most about, sets that are tested in one pass, and failing groups of values that a test looks into.
SAMPLE_ROWS, TESTED, LOOKED_INTO = 2000, 8, 64


# --- keys ---------------------------------------------------------------------------------------------


class Evidence:
    """Sets of columns, as bits, on which some pair of rows differs; only the least of them."""

    def __init__(self, n: int):
        self.n, self.sets = n, []

    def add(self, differs: Iterable[int]) -> None:
        for mask in set(differs):
            if not any(s & mask == s for s in self.sets):
                self.sets = [s for s in self.sets if s & mask != mask] + [mask]

    def add_rows(self, rows: Sequence[tuple]) -> None:
        """Each row against its neighbours in the order of every column, where pairs agree the most."""
        for c in range(self.n):
            order = sorted(rows, key=lambda r: (r[c], r))
            for near in (1, 2):
                self.add(self.differing(a, b) for a, b in zip(order, order[near:]))

    @staticmethod
    def differing(a: tuple, b: tuple) -> int:
        return sum(1 << k for k, (x, y) in enumerate(zip(a, b)) if x != y)

    def candidates(self, size: int) -> list[tuple[int, ...]]:
        """The sets of ``size`` columns that meet every piece of evidence, in order of their columns; smaller ones have failed."""
        if not self.sets:
            return list(combinations(range(self.n), size))
        sets, found = sorted(self.sets, key=int.bit_count), set()
        open_ = [(0, 0)]
        while open_:
            chosen, barred = open_.pop()
            unmet = next((s for s in sets if not s & chosen), None)
            if unmet is None:
                found.add(chosen)
            elif chosen.bit_count() < size:
                # the first column of the unmet set that is taken; those before it are barred
                open_ += [(chosen | 1 << k, barred | unmet & (1 << k) - 1) for k in range(self.n) if unmet >> k & 1 and not barred >> k & 1]
        return sorted(tuple(k for k in range(self.n) if m >> k & 1) for m in found if m.bit_count() == size)


def _digest(values: Sequence[Column]) -> Column:
    """Of several texts, none of them null."""
    return F.sha2(F.concat_ws("", *[F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in values]), 256)


def _failing(rows: DataFrame, sets: list[tuple[int, ...]]) -> dict[int, list[tuple[tuple, tuple]]]:
    """Of sets of columns (c0, c1 ... of rows), by number, those that aren't unique, with pairs of rows that agree on them.

    One pass for all sets counts digests of their values, with partial sums; another finds two rows for
    a bounded number of the digests that stand twice.
    """
    keyed = rows.select("*", F.array(*[_digest([F.col(f"c{k}") for k in s]) for s in sets]).alias("digests"))
    twice = keyed.select(F.posexplode("digests").alias("no", "digest")).groupBy("no", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    nth = F.row_number().over(Window.partitionBy("no").orderBy("digest"))
    picked = twice.withColumn("nth", nth).filter(F.col("nth") <= LOOKED_INTO).select("no", "digest").collect()
    if not picked:
        return {}
    asked = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in picked], "no int, digest string"))
    row = F.struct(*[c for c in rows.columns])
    pairs = keyed.select(row.alias("row"), F.posexplode("digests").alias("no", "digest")).join(asked, ["no", "digest"]).groupBy("no", "digest").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    found: dict[int, list[tuple[tuple, tuple]]] = {}
    for r in pairs.collect():
        found.setdefault(r.no, []).append((tuple(r.low), tuple(r.high)))
    return found


def smallest_key(df: DataFrame, columns: Sequence[str]) -> tuple[str, ...]:
    """The first of the smallest sets of columns, in their order, whose values together are unique; () if there is none, or no row.

    Nulls are values here.  Of the rows only digests of their columns' values reach the driver: a
    bounded sample, and pairs that refute a set.
    """
    rows = df.select(*[F.sha2(F.coalesce(F.concat(F.lit("="), _text(df, c)), F.lit("-")), 256).alias(f"c{k}") for k, c in enumerate(columns)])
    n = df.count()
    if not n or not columns:
        return ()
    evidence = Evidence(len(columns))
    evidence.add_rows([tuple(r) for r in (rows if n <= SAMPLE_ROWS else rows.sample(SAMPLE_ROWS / n, seed=5)).limit(2 * SAMPLE_ROWS).collect()])
    for size in range(1, len(columns) + 1):
        while tested := evidence.candidates(size)[:TESTED]:
            fails = _failing(rows, tested)
            for k, s in enumerate(tested):
                if k not in fails:
                    return tuple(columns[c] for c in s)
            evidence.add(Evidence.differing(a, b) for pairs in fails.values() for a, b in pairs)
    return ()


def _text(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return F.to_json(F.struct(F.col(f"`{column}`"))) if kind.startswith(("array", "map", "struct", "variant")) else F.col(f"`{column}`").cast("string")


# --- inclusions ---------------------------------------------------------------------------------------

#: A column, or several of one table: the table's name, the columns' names and their logical types.
Attribute = tuple[str, tuple[str, ...], tuple[str, ...]]
_FORMS = {"integer": to_int, "float": to_float, "date": to_date}


def inclusions(tables: dict[str, DataFrame], attributes: Sequence[Attribute]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Which attributes' values are all values of which others of the same types.

    By pair of their numbers: the distinct values of the first, the second, and those that both hold,
    equal to those of the first.  Values with a null part don't count; an attribute without values is
    in none.  Integers, floats and dates are compared as such, other values as texts.
    """
    held = []
    for name, df in tables.items():
        mine = [(k, a) for k, a in enumerate(attributes) if a[0] == name]
        if not mine:
            continue
        values = []
        for k, (_, columns, kinds) in mine:
            texts = [(_FORMS[kind](_text(df, c)) if kind in _FORMS else _text(df, c)).cast("string") for c, kind in zip(columns, kinds)]
            whole = reduce(Column.__and__, [t.isNotNull() for t in texts])
            values.append(F.struct(F.lit(k).alias("a"), F.when(whole, F.unhex(_digest([F.lit(" ".join(kinds)), *texts]))).alias("v")))
        held.append(df.select(F.inline(F.array(*values))).filter("v IS NOT NULL"))
    if not held:
        return {}
    sets = reduce(DataFrame.unionByName, held).groupBy("v").agg(F.array_sort(F.collect_set("a")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select("n", "s", F.explode("s").alias("a")).select("n", "a", F.explode("s").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    n = {(r.a, r.b): r.n for r in pairs.collect()}  # a number a pair of attributes
    return {(a, b): (n[a, a], n[b, b], m) for (a, b), m in n.items() if a != b and m == n[a, a]}


def links_to_keys(tables: dict[str, DataFrame], kinds: dict[tuple[str, str], str], keys: dict[str, tuple[str, ...]]) -> list[tuple[str, tuple[str, ...], str, tuple[str, ...], int, int]]:
    """Columns whose values are all values of a table's key, in any table, the key's own included: source table and columns, key table and columns, distinct values of both.

    kinds: logical type by table and column.  Keys of several columns are reached level by level: sets
    of columns are tried only where their first columns are in the key's first, and the last in its last.
    """
    one: list[Attribute] = [(t, (c,), (k,)) for (t, c), k in kinds.items()]
    wanted = {(t, c) for t, key in keys.items() for c in key}
    level = {(one[a][:2], one[b][:2]): n for (a, b), n in inclusions(tables, one).items() if (one[b][0], one[b][1][0]) in wanted}
    into: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for (t, (c,)), (p, (k,)) in level:
        into.setdefault((p, k), []).append((t, c))
    links = [(t, c, p, k, n[0], n[1]) for ((t, c), (p, k)), n in level.items() if keys[p] == k]
    reached = {((t, c), (p, k)) for (t, c), (p, k) in level if keys[p][0] == k[0]} | {((p, key[:1]), (p, key[:1])) for p, key in keys.items()}
    size = 1
    while reached := {(child, parent) for child, parent in reached if len(keys[parent[0]]) > size}:
        tried = set()
        for (t, c), (p, k) in reached:
            last = keys[p][size]
            for t2, c2 in [*into.get((p, last), []), (p, last)]:
                if t2 == t and c2 not in c and (t, (*c, c2)) != (p, (*k, last)):
                    tried.add(((t, (*c, c2)), (p, (*k, last))))
        whole = sorted({x for pair in tried for x in pair})
        attributes = [(t, c, tuple(kinds[t, x] for x in c)) for t, c in whole]
        found = {(whole[a], whole[b]): n for (a, b), n in inclusions(tables, attributes).items() if (whole[a], whole[b]) in tried}
        size += 1
        links += [(t, c, p, k, n[0], n[1]) for ((t, c), (p, k)), n in found.items() if keys[p] == k]
        reached = set(found) | {((p, key[:size]), (p, key[:size])) for p, key in keys.items() if len(key) > size}
    return sorted(links)

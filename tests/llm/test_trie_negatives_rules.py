"""Prefix trie, hard negatives and line rules against plain loops, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docframe.llm import hard_negatives as hn
from docframe.llm.hard_negatives import Best, Block, Windows, bounds, hilbert_keys, search_block
from docframe.llm.line_rules import drop_boilerplate, line_rules, repeat_words
from docframe.llm.prefix_trie import build, prefix_nodes, turn_sequences, with_shared_heads

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

# --- prefix trie -------------------------------------------------------------------------------------


def plain_rebuilt(rows):
    """conv_id to its rebuilt (role, text) turns; turn numbers differ within a conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + t[h[c] :] for c, t in own.items()}


def plain_nodes(rebuilt):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        hashed = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below), saved, hashed))
    return sorted(out, key=repr)


def conversations(rng, n):
    """Shared heads, copies, long ones, null roles, texts and turns; conversation 200 and its base have none to share."""
    rows, hot = [], [("user", "same"), ("assistant", "é" * 7)]
    for c in range(n):
        conv = c * 3 if c % 2 else c * 3 + 1
        turns = list(hot) if rng.random() < 0.4 else [(rng.choice(["user", None]), rng.choice(["a", "bb", None, "", "c c"])) for _ in range(rng.randint(1, 9))]
        turns += [("user", f"t{conv}")] * (rng.random() < 0.2)
        rows += [(conv, None if k == 0 and rng.random() < 0.2 else k, role, text) for k, (role, text) in enumerate(turns)]
    return rows + [(900, k, "user", f"long {k}") for k in range(300)] + [(None, 0, "user", "nobody's")]


@pytest.mark.parametrize(("shard_turns", "seed"), [(10**6, 1), (40, 2), (7, 3)])
def test_trie(spark, shard_turns, seed):
    rows = conversations(random.Random(seed), 90)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("shard", F.lit("x")).withColumn("ids", F.lit(1))
    got = prefix_nodes(with_shared_heads(turn_sequences(df)), shard_turns=shard_turns, least_turns=10**6)
    assert got.columns == NODE
    assert sorted(map(tuple, got.collect()), key=repr) == plain_nodes(plain_rebuilt(rows))


def test_trie_of_one_sequence_over_many_shards(spark):
    """All conversations alike: every node is a boundary node, and its members come from all shards."""
    rows = [(c, k, "user", f"t{k}") for c in range(200) for k in range(7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_nodes(with_shared_heads(turn_sequences(df)), shard_turns=50)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_nodes(plain_rebuilt(rows))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_nodes(with_shared_heads(turn_sequences(none))).count() == 0
    rows = [(c, 0, "user", "x") for c in range(101, 140)]  # their base is absent
    got = prefix_nodes(with_shared_heads(turn_sequences(spark.createDataFrame(rows, none.schema))), shard_turns=9)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_nodes(plain_rebuilt(rows))


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(1, 0, "user", x) for x in "abcabc"]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, two = (turn_sequences(df.orderBy(o)).collect() for o in ("text", F.desc("text")))
    assert one == two and len(one[0].turns) == 6


@given(st.lists(st.lists(st.integers(0, 5), max_size=6).map(tuple), unique=True, min_size=1))
def test_the_tree_is_balanced_and_finds_all(sequences):
    order = sorted(sequences)
    tree = build(order, [[k] for k in range(len(order))])
    for k, s in enumerate(order):
        path = tree.path(s)
        assert [tree.code[n] for n in path[1:]] == list(s) and tree.ends[path[-1]] == [k]
    assert len(tree.code) == len({s[:d] for s in order for d in range(len(s) + 1)})
    walked, parent = tree.walk()
    assert sorted(walked) == list(range(len(tree.code))) and all(walked.index(n) > walked.index(parent[n]) for n in walked[1:])


def test_medians_keep_alternatives_shallow():
    tree = build([(k,) for k in range(1023)], [[k] for k in range(1023)])

    def steps(code):
        child, n = tree.next[0], 1
        while tree.code[child] != code:
            child, n = tree.less[child] if code < tree.code[child] else tree.more[child], n + 1
        return n

    assert max(map(steps, range(1023))) == 10


# --- hard negatives ----------------------------------------------------------------------------------


def plain_negatives(rows, every=50, positives=5, negatives=3):
    ok = [(i, lab, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, lab, v in ok:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in ok if i != a)
        for s, i, _ in [x for x in scored if x[2] == lab][:positives]:
            fits = [x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


def vectors(rng, n, dims, scale):
    centres = rng.normal(size=(6, dims))
    rows = [(i, [float(np.float32(x)) for x in (centres[rng.integers(6)] + rng.normal(size=dims) * 0.7) * scale], int(rng.integers(3))) for i in range(n)]
    same = rows[7][1]
    rows += [(n + k, same, k % 3) for k in range(60)]  # one common vector
    rows += [(5000, None, 1), (5050, [None] * dims, 1), (5100, [float("nan")] * dims, 1), (5150, [float("inf")] * dims, 2), (None, same, 0), (5200, same, None), (5250, [0.0] * dims, 1), (-50, same[: dims // 2], 2), (-100, [], 0)]
    return rows


@pytest.mark.parametrize(("scale", "round_bytes"), [(1.0, 10**7), (1e-3, 2000), (1e6, 10**7)])
def test_negatives(spark, monkeypatch, scale, round_bytes):
    monkeypatch.setattr(hn, "BLOCK", 16)
    rows = vectors(np.random.default_rng(4), 400, 6, scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).withColumn("data", F.lit(1)).withColumn("cut", F.lit(2))
    got = hn.hard_negatives(df, round_bytes=round_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    assert hn.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 0


def test_labels_may_be_given(spark):
    rows = vectors(np.random.default_rng(5), 200, 4, 1.0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hn.hard_negatives(df, label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label")))
    assert sorted(map(tuple, got.collect())) == plain_negatives([(i, v, lab if lab is None or i is None or i % 7 else (lab + 1) % 3) for i, v, lab in rows])


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2), (1, 4), (5, 1)])
def test_hilbert_neighbours_touch(dims, bits):
    """The curve visits every cell once, and a step changes one coordinate by one."""
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(grid, bits)
    assert len(set(keys)) == len(grid)
    walk = grid[np.array(sorted(range(len(grid)), key=keys.__getitem__))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@settings(deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    data, anchors = np.floor(rng.normal(size=(20, 5)) * 300), np.floor(rng.normal(size=(4, 5)) * 300)
    least, most = bounds(anchors, data.min(0)[None], data.max(0)[None])
    scores = anchors @ data.T
    assert (least[:, 0] <= scores.min(1)).all() and (scores.max(1) <= most[:, 0]).all()


def test_bounds_save_reading():
    """Clustered vectors in blocks of a cluster: most blocks can't hold an entry of a window, and nothing is lost."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 500
    parts = [np.floor(c + rng.normal(size=(32, 8)) * 10) for c in centres]
    blocks = [Block(k % 2, np.arange(32) + 32 * k, p, p.min(0), p.max(0), 32 * k) for k, p in enumerate(parts)]
    anchors = np.stack([p[0] for p in parts])
    top = (anchors**2).sum(1).astype(np.int64)
    asked = Windows(np.arange(40) * 32, np.arange(40) % 2, anchors, np.arange(40), np.ones(40, np.int64), top // 2, top * 95 // 100, 3, False)
    best = Best(40, 3)
    read = sum(search_block(b, asked, best) for b in blocks)
    assert read < 40 * 40 / 8
    for k in range(40):
        all_ = sorted((-int(s), int(i)) for j, p in enumerate(parts) if j % 2 != k % 2 for i, s in zip(blocks[j].ids, p @ anchors[k]) if top[k] // 2 <= s <= top[k] * 95 // 100)[:3]
        assert [(-int(s), int(i)) for s, i in zip(best.scores[k], best.ids[k]) if i != np.iinfo(np.int64).max] == all_


def test_ties_of_many_blocks_go_to_the_smaller_id():
    one = np.array([[3.0, 4.0]] * 8)
    blocks = [Block(1, np.arange(8) + 8 * k, one, one.min(0), one.max(0), 8 * k) for k in (5, 3, 4)]
    asked = Windows(np.array([0]), np.array([0]), one[:1], np.array([0]), np.array([1]), np.array([0]), np.array([10**6]), 2, False)
    best = Best(1, 2)
    assert [search_block(b, asked, best) for b in blocks] == [1, 1, 0]  # the last has no smaller id
    assert best.ids.tolist() == [[24, 25]]


# --- line rules --------------------------------------------------------------------------------------


def plain_rules(rows, max_docs, max_share=0.001, min_left=0.5):
    norm = lambda s: " ".join(WORD.findall(s.lower()))
    hosts, where = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
        for line in {norm(x) for x in (text or "").split("\n")} - {""}:
            where[host, line].add(text)
    gone = {k for k, v in where.items() if len(v) > max_docs and len(v) > max_share * len(hosts[k[0]])}
    out = []
    for i, text, host in rows:
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        spans = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {k + j for k in range(len(words) - 4) if spans[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lost = sum(len(WORD.findall(x)) for x in lines if (host, norm(x)) in gone)
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed, lost, not failed and len(words) - lost >= max(10, min_left * len(words))))
    return sorted(out, key=repr)


def host_rows():
    rng = random.Random(6)
    some = lambda n: " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))
    banner, copied = "Read  More\tabout ünsere # COOKIES here", some(30) + "\n" + some(25)
    rows = [(k, (banner if k % 2 else banner.lower()) + "\n" + some(rng.choice([3, 12, 40])), "a") for k in range(12)]  # one line on all pages of a host
    rows += [(20 + k, copied, "a") for k in range(15)]  # copies alone make no line common
    rows += [(40 + k, f"{banner}\n{some(30)}\n{banner}\n\n  \n{banner}", "b") for k in range(2)]  # the same line is no boilerplate elsewhere
    rows += [(60, None, "a"), (61, "", None), (62, " \n\t\x0b", None), (None, some(20), None), (63, some(40_000), "c"), (64, "a\x85b\x1c c" * 20, "c"), (65, some(20), None), (65, some(20), None)]
    return rows + [(70 + k, "na ja und so weiter " * n + some(50), "d") for k, n in enumerate((1, 2, 3, 4, 9))]


def test_line_rules(spark):
    rows = host_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumn("key", F.lit(1)).withColumn("line", F.lit("x"))
    got = line_rules(df, max_docs=5).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept")
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == plain_rules(rows, 5)
    assert any(r[7] and not r[6] and not r[8] for r in got), "a depleted document is rejected"
    assert any(r[7] and r[8] for r in got), "a document that keeps enough stays"
    assert line_rules(df.limit(0)).count() == 0


def test_boilerplate_goes_from_texts(spark):
    rows = host_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumn("key", F.lit(1)).select("key", "text", "source", "doc_id")
    got = drop_boilerplate(df, max_docs=5)
    assert got.columns == df.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    verdicts = {r[0]: r for r in plain_rules(rows, 5)}
    assert set(texts) == {i for i, r in verdicts.items() if r[8]}
    for i, text, host in rows:
        if i in texts and i != 65:  # 65 is the id of two texts
            assert len(WORD.findall(texts[i])) == verdicts[i][1] - verdicts[i][7]
            assert verdicts[i][7] or texts[i] == text
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_repeated_words_of_overlapping_spans():
    assert repeat_words(b"a a a a a a".split()) == 6
    assert repeat_words(b"a b c d e x a b c d e".split()) == 10
    assert repeat_words(b"a b c d".split()) == 0 == repeat_words([])

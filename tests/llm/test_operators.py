"""The operators on Spark against brute force, and their defined results on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docframe.llm import language, quality
from docframe.llm.bpe import vocabulary_path
from docframe.llm.components import components
from docframe.llm.exact_dedup import drop_exact_copies, exact_groups
from docframe.llm.licenses import TEMPLATES, MARK, scan_licenses
from docframe.llm.mixing import mix, mix_plan
from docframe.llm.ngram_join import drop_near_duplicates, near_duplicates
from docframe.llm.packing import pack
from docframe.llm.phrases import remove_repeats
from docframe.llm.token_files import read_token_files, write_token_files
from docframe.llm.topk import exact_top_k

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join("w%d" % rng.randint(0, 5000) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, near copies, shared passages."""
    rng = random.Random(8)
    passage, base = sentence(rng, 60), sentence(rng, 120)
    near = base.split()
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, "one", "de", "b", 3), (5, "one", "de", None, 3), (5, "one", "de", None, 3),
        (None, "no id here at all but some words", None, "b", None), (6, sentence(rng, 60_000), "en", "c", None), (7, passage, "en", "a", None),
        (8, sentence(rng, 9) + " " + passage + "\n" + sentence(rng, 50), "en", "a", None), (9, passage + " " + passage, "en", "b", None),
        (10, base, "fr", "a", None), (11, base.replace(" ", "\n", 3), "fr", "b", None), (12, " ".join(near[:-2] + ["x", "y"]), "fr", "b", None), (13, " ".join(["z"] + near), "fr", "c", None),
    ]
    return rows + [(100 + k, sentence(rng, rng.randint(1, 80)), "en", rng.choice(["a", "b", "c", "d"]), None) for k in range(60)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (101, None, None), (102, 1, 0), (102, 0, 0)], "doc_id long, quality int, toxic int")


def test_exact_groups(spark, odd, none):
    rows = odd_rows()
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    got = exact_groups(odd).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups) and kept.filter("doc_id = 5").count() == 0
    assert exact_groups(none).count() == 0 and drop_exact_copies(none).count() == 0


def test_exact_groups_compare_texts_when_digests_collide(odd):
    weak = lambda text: F.length(text).cast("string")
    a = sorted(map(repr, exact_groups(odd).collect()))
    assert sorted(map(repr, exact_groups(odd, digest=weak).collect())) == a
    assert sorted(map(repr, drop_exact_copies(odd, digest=weak).collect())) == sorted(map(repr, drop_exact_copies(odd).collect()))


def water_fill(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark, odd, none):
    rows = odd_rows()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target = water_fill(sizes)
    got = mix_plan(odd.withColumn("target", F.lit(1)).withColumn("key", F.lit("k"))).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mix_plan(odd.repartition(7)).collect()))
    by = {r.source_size: r.target for r in got}
    assert all(abs(by[sizes[s]] - target[s]) < 1e-6 for s in sizes)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    largest = max(len(WORD.findall(t or "")) for _, t, *_ in rows)
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
    assert all(abs(taken[sizes[s]] - target[s]) <= largest / 2 for s in sizes)
    mixed = mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.select(F.sum(F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)))).first()[0] == sum(taken.values())
    assert mix_plan(none).count() == 0 and mix(none).count() == 0


def repeats(texts, k):
    words = [WORD.findall(t or "") for t in texts]
    n = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if n[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeated_phrases(spark, odd, none):
    rows = odd_rows()
    want = sorted((str(r[0]), *x) for r, x in zip(rows, repeats([r[1] for r in rows], 35)))
    for chunk in (4_000_000, 500, 1):
        got = remove_repeats(odd.withColumn("chunk", F.lit(1)), chunk_chars=chunk, common=chunk)
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    r = next(x for x in got.collect() if x.doc_id == 8)
    assert r.removed_spans == [9, 69] and hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert remove_repeats(none).count() == 0


def test_repeated_phrases_of_few_words(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["a " * 50, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, window=7, anchor=4).collect()}
    assert [got[k] for k in range(len(texts))] == repeats(texts, 7)


def test_words_that_differ_late_are_no_repeats(spark):
    """Words of the Thue-Morse kind: no polynomial over their letters tells them apart."""
    rows = []
    for k, n in enumerate((256, 512, 4096)):
        one = "".join("b" if bin(i).count("1") % 2 else "a" for i in range(n))
        two = one.translate(str.maketrans("ab", "ba"))
        around = [f"u{k}x{i}" for i in range(34)]
        rows += [(10 * k, " ".join([*around[:17], one, *around[17:]])), (10 * k + 1, " ".join([*around[:17], two, *around[17:]]))]
        rows += [(10 * k + 2, " ".join([one] * 40)), (10 * k + 3, " ".join([two] * 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert [got[k] for k, _ in rows] == repeats([t for _, t in rows], 35)
    assert not any(got[10 * k + j][1] for k in range(3) for j in (0, 1))
    assert {r.n_links for r in near_duplicates(df).collect()} == {0}


def shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicates(spark, odd, none):
    rows = [r for r in odd_rows() if r[0] is not None]
    sets = [(r[0], shingles(r[1])) for r in rows]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets):
            if i != j and s and len(s & t) >= 0.8 * len(s | t):
                links[i] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = sorted((r[0], find(r[0]), links[i]) for i, r in enumerate(rows))
    got = near_duplicates(odd.withColumn("rep", F.lit(1)).withColumn("digest", F.lit("x")))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.filter("doc_id IS NOT NULL").collect()) == want
    assert [(r.class_id, r.n_links) for r in got.filter("doc_id IS NULL").collect()] == [(None, 0)]
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(r[0] for r in rows if find(r[0]) == r[0])
    assert near_duplicates(none).count() == 0


def test_a_dense_group_is_cut_into_blocks(spark, monkeypatch):
    from docframe.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    rng = random.Random(5)
    base = sentence(rng, 200).split()
    texts = [" ".join(base[:150] + ["t%d" % k] + base[150:]) for k in range(40)] + [sentence(rng, 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(df).collect()}
    assert got == {k: (0, 39) for k in range(40)} | {40: (40, 0)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)] + [(7, 7)]
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: c for v, c in label.items() if v != c}


def brute_top(rows, queries, k):
    q = lambda v: [int(np.floor(256.0 * x)) for x in v]
    fine = [(i, q(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted((i, v) for i, v in fine if i in queries):
        asked.setdefault(i, v)
    out = []
    for i, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x * scale)) for x in rng.normal(0, 1, 8)]) for i in range(80)]
    rows += [(200 + i, rows[3][1]) for i in range(12)] + [(300, None), (301, [None] + rows[0][1][1:]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, rows[1][1]), (5, rows[5][1]), (40, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(5)
    asked = df.filter("vec_id % 20 = 0")
    got = sorted(map(tuple, exact_top_k(df, asked).collect()))
    assert got == brute_top(rows, {0, 20, 40, 60, 200, 220, 300}, 5)
    assert exact_top_k(df.filter("vec_id < 3"), df.filter("vec_id = 0")).count() == 2
    assert exact_top_k(df.limit(0), df.limit(0)).count() == 0
    assert sorted(map(tuple, exact_top_k(df, asked, lists=3, round_size=4).collect())) == got


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(k, [2.0**k, 1.0]) for k in range(40)] + [(50, [1e30, 0.0]), (51, [1.0, 0.5])], "vec_id long, embedding array<double>")
    got = exact_top_k(df.filter("vec_id < 24 OR vec_id = 51"), df.filter("vec_id = 20"), k=3).collect()
    assert [(r.vec_id, r.score) for r in got] == [(23, 256 * 256 * (2**43 + 1)), (22, 256 * 256 * (2**42 + 1)), (21, 256 * 256 * (2**41 + 1))]
    with pytest.raises(Exception, match="64-bit"):
        exact_top_k(df, df.filter("vec_id = 20")).collect()


def brute_ids(end):
    tok = Tokenizer.from_file(vocabulary_path())
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd, none, tmp_path):
    ids = brute_ids(0)
    write_token_files(odd.withColumn("shard", F.lit(1)), str(tmp_path / "a"), block_ids=500)
    got = read_token_files(spark, str(tmp_path / "a")).withColumn("crc", F.crc32("ids")).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.crc) for r in got) == sorted((str(r[0]), len(ids(r[1])), crc(ids(r[1]))) for r in odd_rows())
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    write_token_files(none, str(tmp_path / "b"))
    assert read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_pack(odd, none):
    ids, fill, by = brute_ids(1), defaultdict(list), defaultdict(list)
    for r in pack(odd).collect():
        fill[r.sequence_id].append((r.offset, r.length))
        by[str(r.doc_id)].append((r.start, r.length, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for pieces in fill.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
    want = defaultdict(list)
    for doc, text, *_ in odd_rows():
        want[str(doc)] += ids(text)
    for doc, w in want.items():
        pieces = sorted(by[doc], key=lambda p: (p[0], p[1]))
        if doc == "5":  # two rows of one text: each of their ids lies in two pieces
            assert sorted(x for p in pieces for x in p[2]) == sorted(w) and w == 2 * w[: len(w) // 2]
        else:
            assert [x for p in pieces for x in p[2]] == w
    assert sum(n for p in fill.values() for _, n in p) == sum(map(len, want.values())) and pack(none).count() == 0
    totals = Counter((str(doc), len(ids(text))) for doc, text, *_ in odd_rows())
    assert {(doc, n) for doc, found in by.items() for _, _, _, n in found} == set(totals)
    short = sorted(sum(n for _, n in p) for p in fill.values())
    assert sum(n < 2048 for n in short) <= odd.rdd.getNumPartitions() and short[-1] == 2048


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.identify(docs.withColumn("score", F.lit("x")))
    both = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(both) > 20 and np.mean([r.lang == r.lang_pred for r in both]) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.collect())
    found = {r.doc_id: r.lang_pred for r in language.identify(odd).collect()}
    assert [found[k] for k in (1, 2, 3)] == ["und"] * 3 and found[6] in {"en", "de", "fr"}
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark, odd, none, labels):
    docs, known = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.quality_scores(docs, known)
    both = got.join(known, "doc_id").filter("held_out").collect()
    assert len(both) > 10 and np.mean([r.predicted == r.quality for r in both]) >= 0.8
    rows = quality.quality_scores(odd.withColumn("label", F.lit(1)), labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in rows)
    assert quality.quality_scores(none, labels.limit(0)).count() == 0
    assert quality.drop_low_quality(none, labels).columns == none.columns


def test_licenses(spark):
    assert all(re.search(MARK, text) for _, text in TEMPLATES)
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code\nno notice"), ("a/b/c/y.py", None), ("a/b/z.py", "Licensed under the Apache License, Version 2.0.\ncode"),
        ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("top.py", "license to kill a mockingbird and so on"), (None, "Released under the MIT License."), ("a/LICENSE", "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(k, *r, "clash") for k, r in enumerate(rows)], "k int, path string, text string, license string")
    got = {r.k: (r.license, r.license_from) for r in scan_licenses(df).collect()}
    assert got == {0: ("MIT", "own"), 1: ("MIT", "inherited"), 2: ("GPL-3.0", "inherited"), 3: ("Apache-2.0", "own"), 4: ("GPL-3.0", "own"), 5: (None, None), 6: (None, None), 7: ("MIT", "own")}
    plans = scan_licenses(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plans.split("Physical Plan")[1])
    assert scan_licenses(df.limit(0)).count() == 0


CLASHES = ("gone_id", "digest", "rep", "c0", "c1", "salt", "key", "grp", "d_id", "d_text", "copy", "lo", "last", "_path", "a b", "group_size", "score", "ids")


def clashing(df):
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES])


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, odd, none, labels, tmp_path, empty):
    """Every stage takes nulls, long texts, ties, repeats, clashing names and empty tables, and keeps the columns."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing(none if empty else odd)
    counts = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        for given in (docs, clashing(none if empty else odd)):
            out = step(spark, given, str(tmp_path))
            assert out.columns == [*odd.columns, *CLASHES] and {r["a b"] for r in out.collect()} <= {"a b"}
        docs = step(spark, docs, str(tmp_path)).cache()
        counts.append(docs.count())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    assert counts == [0] * 5 and pieces.count() == 0 if empty else counts[1] >= counts[2] >= counts[3] and pieces.count() >= counts[4] > 0


def test_rows_without_words_are_mixed_once_at_most_per_epoch(spark):
    """A source whose target is its cap takes every document twice, those without words too."""
    rows = [(k, "w " * 30, "big") for k in range(50)] + [(100 + k, "x y z" if k % 2 else None, "small") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = Counter(r.doc_id for r in mix(docs, weights=(1, 5)).collect())
    assert {copies[100 + k] for k in range(20)} == {2}


def test_mixing_narrows_spans_of_keys(spark, odd, monkeypatch):
    from docframe.llm import mixing

    docs = spark.createDataFrame([(k, "w%d " % k * (1 + k % 7) + "#" * (k % 3 * 9), "ab"[k % 5 == 0]) for k in range(400)] + [(None, "same", "a")] * 60, "doc_id long, text string, source string")
    whole = sorted(map(repr, mix_plan(docs).collect()))
    monkeypatch.setattr(mixing, "CELLS", 4)
    monkeypatch.setattr(mixing, "SPAN_ROWS", 3)
    assert sorted(map(repr, mix_plan(docs).collect())) == whole
    assert mixing.stage is not None and len(whole) == 460


def test_clashing_names(spark, odd, labels):
    docs = clashing(odd)
    for plain, named in (
        (exact_groups(odd), exact_groups(docs)), (mix_plan(odd), mix_plan(docs)), (near_duplicates(odd), near_duplicates(docs)), (remove_repeats(odd, texts=False), remove_repeats(docs, texts=False)),
        (quality.quality_scores(odd, labels), quality.quality_scores(docs, labels)), (language.identify(odd), language.identify(docs)), (pack(odd).drop("sequence_id", "offset"), pack(docs).drop("sequence_id", "offset")),
    ):
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, named.collect()))
    files = docs.select(F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), "text", *CLASHES)
    assert scan_licenses(files).columns == ["path", "text", *CLASHES, "license", "license_score", "license_from"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    kept, at = {}, docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        at = step(spark, at, DATA).cache()
        assert at.columns == docs.columns
        kept[name] = at.collect()
    first = {r.doc_id for r in kept["quality"]}
    bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
    assert len(first & bad) > 0.95 * len(bad)
    assert [r.doc_id for r in kept["exact_dedup"]] and len(kept["exact_dedup"]) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in kept["quality"]})
    ids = {r.doc_id for r in kept["near_dedup"]}
    sets = [shingles(seen[i]) for i in ids]
    assert not any(len(s & t) >= 0.8 * len(s | t) for k, s in enumerate(sets) for t in sets[:k])
    assert {r.doc_id for r in kept["mix"]} <= ids and len(kept["mix"]) > len(ids)
    pieces = corpus_pipeline.run(spark, DATA)
    words = Counter(r.doc_id for r in kept["mix"])
    total = brute_ids(1)
    got = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {d: n * len(total(seen[d])) for d, n in words.items()}

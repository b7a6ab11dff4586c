"""Parts that need no cluster: coding, tokens, packing, shingles, automata, networks."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docframe.llm import language, ngram_join, phrases, quality, simple8b, topk
from docframe.llm.bpe import PieceEncoder, vocabulary_path
from docframe.llm.packing import Packer
from docframe.llm.shingles import Words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, raw = simple8b.encode(v)
    assert (simple8b.decode(words, raw) == v).all() and len(raw) == sum(x >> 60 > 0 for x in values)


@pytest.fixture(scope="module")
def pieces():
    return PieceEncoder(vocabulary_path(), cache_pieces=40)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aZé ñ\n\t.,'s|*_9²½日́  ")), max_size=60))
def test_ids_are_those_of_the_whole_text(pieces, text):
    whole = pieces._tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(pieces.encode([text])[0], "<u4").tolist() == whole


def test_ids_of_odd_texts(pieces):
    texts = [None, "", " ", "a " * 500, "<|endoftext|> x", "it's we'll  o'clock", "x\r\n y\x85z ​ q"]
    for t, ids in zip(texts, pieces.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == pieces._tok.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_packing_places_every_id_once(sizes):
    p, out, docs = Packer(5, 16), [], {}
    for k, n in enumerate(sizes):
        docs[k] = np.arange(n, dtype="<u4") + 1000 * k
        out += p.add(k, docs[k].tobytes())
    out += p.flush()
    got, fill = {k: {} for k in docs}, {}
    for doc, start, n, ids, total, sequence, offset in out:
        assert total == len(docs[doc]) and n == len(ids) // 4 and fill.get(sequence, 0) == offset and sequence >= 5
        fill[sequence] = offset + n
        got[doc].update(zip(range(start, start + n), np.frombuffer(ids, "<u4").tolist()))
        assert n > 0
    assert all(sorted(got[k].items()) == list(enumerate(docs[k].tolist())) for k in docs)
    assert sum(f < 16 for f in fill.values()) <= 1 and all(f <= 16 for f in fill.values())
    assert sum(fill.values()) == sum(sizes)


def test_flush_keeps_the_squares_least():
    """The pieces of the emptiest window go where the squares fall most, the fullest of equals."""
    p = Packer(0, 20)
    p.levels[[5, 12, 15]] = [1, 3, 1]
    assert p.fill_for(8) == 12 and p.fill_for(5) == 12 and p.fill_for(2) == 12
    p.levels[12] = 1
    assert p.fill_for(5) == 15 and p.fill_for(9) == 15
    p.levels[:] = 0
    assert p.fill_for(3) == 0


def test_levels_keep_the_squares_least():
    rng = np.random.default_rng(0)
    p = Packer(0, 20)
    for size in rng.integers(1, 20, 200).tolist():
        def cost(level, size=size):
            n = p.levels.copy()
            if level:
                n[level] -= 1
            if level + size < 20:
                n[level + size] += 1
            return int((n[1:20] ** 2).sum())

        options = [0, *[h for h in range(1, 20) if p.levels[h] and h + size <= 20]]
        assert cost(p.level_for(size)) == min(map(cost, options))
        p.add(0, b"\0" * 4 * size)


def test_run_hashes_depend_on_the_words_alone():
    a, b = Words([b"x a b c  d", b"", b"q"]), Words([b"a\tb c d", b"a b c e"])
    ra, rb = (w.runs(4)[w.starts(4)] for w in (a, b))
    assert ra[1] == rb[0] and ra[0] != rb[0] and rb[0] != rb[1]
    assert a.shingles(5)[1].tolist() == [1, 0, 1] and Words([b"a b c d", b"a b c d"]).shingles(9)[0].tolist()[0] == Words([b"z", b"a b c d"]).shingles(9)[0].tolist()[1]
    assert Words([]).shingles(5)[1].tolist() == [] and Words([b"", b" "]).shingles(5)[1].tolist() == [0, 0]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    words = [b"%d" % w for w in rng.integers(0, 9, 300)]
    one, two = b" ".join(words), b" ".join([b"z"] * 7 + words[100:180])
    w = Words([one, two])
    starts, hashes, _ = phrases.anchors_of_windows(w, 35, 20)
    by = dict(zip(starts.tolist(), hashes.tolist()))
    for k in range(80 - 34):
        assert by[100 + k] == by[300 + 7 + k]


def test_automata_locate_passages():
    machine, numbers = phrases.automaton([[b"b", b"c", b"d"], [b"c", b"d", b"e", b"f"]])
    assert list(phrases.covered(b"a b c d x b c b c d e f c".split(), machine, numbers)) == [0, 1, 1, 1, 0, 0, 0, 1, 1, 1, 1, 1, 0]
    assert list(phrases.covered([b"a"], *phrases.automaton([]))) == [0] and not phrases.covered([], machine, numbers)


def test_passages_of_an_anchor_are_confirmed_on_words():
    runs = lambda *pieces: phrases.recurring_runs([(p.encode(), n) for p, n in pieces], 3)
    assert runs(("a b c d", 1)) == [[]] and runs(("a b c d", 2)) == [[0, 4]]
    assert runs(("a b c d", 1), ("b c d e", 1)) == [[1, 4], [0, 3]]
    assert runs(("a b c d e f", 1), ("a b c", 1), ("d e f", 1)) == [[0, 3, 3, 6], [0, 3], [0, 3]]


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


@pytest.mark.parametrize("n", [256, 4096])
def test_words_of_one_structure_have_hashes_of_their_own(n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    w = Words([f"x {one}".encode(), f"x {two}".encode(), " ".join(one).encode(), " ".join(two).encode()])
    assert w.hashes[1] != w.hashes[3]
    long = w.runs(n)
    assert long[4] != long[4 + n]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999 and bands * rows <= 128


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=9), st.integers(1, 4))
def test_ngram_sets_and_overlaps(texts, n):
    want = [{tuple(t[i : i + n]) for i in range(max(1, len(t) - n + 1))} if t else set() for t in texts]
    sets = ngram_join.ngram_sets([[w.encode() for w in t] for t in texts], n)
    assert [len(s) for s in sets] == [len(s) for s in want]
    got = ngram_join.overlaps(sets)
    assert all(got[i, j] == len(a & b) for i, a in enumerate(want) for j, b in enumerate(want) if i != j)


def test_a_pair_counts_in_the_least_bucket_it_shares():
    buckets = [[1, 5, 9], [5, 9], [1, 9], [9]]
    pairs = [{(i, j) for i in range(4) for j in range(i) if ngram_join.first_shared(buckets, h)[i, j] and h in buckets[i] and h in buckets[j]} for h in (1, 5, 9)]
    assert pairs == [{(2, 0)}, {(1, 0)}, {(2, 1), (3, 0), (3, 1), (3, 2)}]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3), st.integers(1, 4), st.sampled_from([5, 2**27, 2**40]))
def test_threshold_leaves_few_entries_and_loses_none(seed, lists, k, most):
    rng = np.random.default_rng(seed)
    q, c = rng.integers(-most, most, (3, 7)), rng.integers(-most, most, (30, 7))
    own = np.zeros((3, 30), bool)
    own[0, 0] = True
    every = q.astype(object) @ c.astype(object).T
    a, b = topk.gather(q, c, own, k, lists)
    cuts = [sorted([int(every[i, j]) for j in b[a == i]])[-k] for i in range(3)]
    a, b, which = topk.collect(q, c, own, cuts, lists)
    best = {(i, j) for i in range(3) for j in range(30) if every[i, j] >= sorted(x for m, x in enumerate(every[i]) if not own[i, m])[-k] and not own[i, j]}
    assert best <= set(zip(a.tolist(), b.tolist())) and len(set(zip(a.tolist(), b.tolist()))) == len(a)
    part = np.abs(np.array(cuts, np.float64)).max() * 2.0**-40
    assert all(sum(int(q[i, d]) * int(c[j, d]) for d in range(7)[topk.slices(7, lists)[s]]) * lists >= cuts[i] - part for i, j, s in zip(a, b, which))
    assert topk.resolve(q, c, a, b).tolist() == [every[i, j] for i, j in zip(a, b)]


def test_the_cutoff_saves_work():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-256, 256, (50, 64)), rng.integers(-256, 256, (4000, 64))
    own = np.zeros((50, 4000), bool)
    a, b = topk.gather(q, c, own, 5, 2)
    scores = topk.resolve(q, c, a, b)
    a2, _, _ = topk.collect(q, c, own, [int(np.sort(scores[a == i])[-5]) for i in range(50)], 2)
    assert len(a) <= 50 * 10 and len(a2) < 0.15 * 50 * 4000


def test_networks_learn():
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good]
    model = quality.fit(good + bad, [1] * 80 + [0] * 80)
    assert model.scores(["beta alpha gamma. delta"], {})[0] > 0.8 > 0.3 > model.scores(["BETA!! ALPHA!! X!!"], {})[0]
    assert 0 <= model.scores([""], {})[0] <= 1 and quality.fit([], []).scores(["x"], {}).shape == (1,)
    net = language.fit(["the and with of that " * 20] * 20 + ["der und mit das ein " * 20] * 20, ["en"] * 20 + ["de"] * 20, steps=150)
    assert net.langs[int(net.probabilities(language.windows_of(b"das und mit der")).argmax())] == "de"
    assert language.fit([], []) is None


def small_net(rng, filters=5, langs=3):
    wide = max(language.WIDTHS) * language.EMBED
    return language.ByteConvNet(list("abc")[:langs], rng.normal(size=(256, language.EMBED)), rng.normal(size=(wide, filters)), rng.normal(size=filters), rng.normal(size=(filters, langs)), rng.normal(size=langs))


def plain_probabilities(net, window):
    """The network as loops: embed, slide, take the best place, rectify, softmax."""
    e = [net.embed[b] for b in window] + [net.embed[0]] * (max(language.WIDTHS) - 1)
    pooled = []
    for f in range(net.filters.shape[1]):
        best = max(sum(e[i + j][d] * net.filters[j * language.EMBED + d, f] for j in range(max(language.WIDTHS)) for d in range(language.EMBED)) for i in range(len(window)))
        pooled.append(max(best + net.bias[f], 0))
    z = [sum(p * net.out[f, k] for f, p in enumerate(pooled)) + net.out_bias[k] for k in range(len(net.langs))]
    total = sum(np.exp(x) for x in z)
    return [np.exp(x) / total for x in z]


def test_convolution_is_that_of_plain_loops():
    rng = np.random.default_rng(5)
    net, x = small_net(rng), rng.integers(0, 256, (4, 12)).astype(np.uint8)
    assert np.allclose(net.probabilities(x), [plain_probabilities(net, w) for w in x])


def differences(loss, params, tries, rng, step=1e-6):
    """Slopes of the loss by small steps, at some places of each array."""
    for k, p in enumerate(params):
        for _ in range(tries):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old = p[at]
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            yield k, at, (up - down) / (2 * step)


def test_gradients_of_the_language_network():
    rng = np.random.default_rng(6)
    net, x, y = small_net(rng), rng.integers(0, 4, (6, 10)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    grads = language.gradients(net, x, y)
    for k, at, slope in differences(loss, [net.embed[:4], net.filters, net.bias, net.out, net.out_bias], 12, rng):
        assert grads[k][at] == pytest.approx(slope, abs=1e-5)


def test_gradients_of_the_quality_network():
    rng = np.random.default_rng(7)
    params = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
    x, y = rng.normal(size=(8, 5)), rng.integers(0, 2, 8).astype(float)

    def loss():
        p = 1 / (1 + np.exp(-(np.maximum(x @ params[0] + params[1], 0) @ params[2] + params[3])))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.5e-4 * ((params[0] ** 2).sum() + (params[2] ** 2).sum())

    grads = quality.gradients(params, x, y)
    for k, at, slope in differences(loss, params, 8, rng):
        assert grads[k][at] == pytest.approx(slope, abs=1e-6)


def test_word_vectors_are_those_of_plain_loops():
    texts = ["the cat sat on the mat , the cat", "a cat and the dog 12 sat", "", "dog dog dog the cat"]
    rows, vectors, _ = quality.word_vectors(texts)
    tokens = [quality.tokens_of(t) for t in texts]
    counts = {w: sum(ts.count(w) for ts in tokens) for ts in tokens for w in ts}
    name = lambda w: w if counts[w] >= quality.LEAST_COUNT else quality.form(w)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-6)
    assert {w for w in rows if not w.startswith(" ")} == {w for w in counts if counts[w] >= quality.LEAST_COUNT and not w.startswith(" ")}
    for w, k in rows.items():
        context = np.zeros(quality.DIMS)
        for ts in tokens:
            for i, a in enumerate(ts):
                if name(a) == w:
                    for j in range(max(0, i - quality.REACH), min(len(ts), i + quality.REACH + 1)):
                        if j != i:
                            context += quality.index_vector(name(ts[j]))
        assert np.allclose(vectors[k], unit(quality.index_vector(w)) + unit(context), atol=1e-5)
    model = quality.QualityModel(rows, vectors, *[None] * 6)
    for text, got in zip(texts, model.pooled(texts, {})):
        ts = quality.tokens_of(text)
        assert np.allclose(got, np.mean([vectors[model.row(t)] for t in ts], axis=0) if ts else 0, atol=1e-5)


def test_crc_is_of_the_ids():
    p = PieceEncoder(vocabulary_path())
    ids = p.encode(["some text"])[0]
    assert zlib.crc32(ids) == zlib.crc32(np.array(p._tok.encode("some text", add_special_tokens=False).ids, "<u4").tobytes())

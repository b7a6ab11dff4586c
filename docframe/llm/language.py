"""Language identification by a byte convolutional network, trained and applied with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import fold_of
from docframe.session import ship

#: Bytes of a window; every text is read in as many as it fills, the last one padded with zeros.
WINDOW = 256
#: Filter widths, filters of each width, and numbers that stand for one byte.
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 6
#: Bounds of the training sample: documents of a language and of all, whose whole texts are read.
TRAIN_PER_LANG, TRAIN_DOCS = 800, 8000
UNKNOWN = "und"
#: Windows that go through the network at a time.
BATCH = 512
TEXTS = 256


@dataclass
class ByteConvNet:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (widest x EMBED) x all filters, zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """windows x positions x the embedded bytes that stand under the widest filter."""
        wide = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))
        e = self.embed[wide].reshape(len(windows), -1)
        n = windows.shape[1]
        return np.lib.stride_tricks.as_strided(e, (len(windows), n, max(WIDTHS) * EMBED), (e.strides[0], e.strides[1] * EMBED, e.strides[1]))

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        cols = self.columns(windows).reshape(len(windows) * windows.shape[1], -1)
        return np.maximum((cols @ self.filters).reshape(len(windows), windows.shape[1], -1).max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(self.pooled(windows) @ self.out + self.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: bytes) -> np.ndarray:
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fit(texts: list[str], langs: list[str], seed: int = 3, steps: int = 900, batch: int = 64) -> ByteConvNet | None:
    """Adam on softmax loss; every step draws as many windows of each language, a third of them cut short."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    per: list[list[np.ndarray]] = [[] for _ in names]
    for text, lang in zip(texts, langs):
        if body := text.encode():
            per[names.index(lang)].append(windows_of(body))
    pools = [np.concatenate(p) if p else np.zeros((1, WINDOW), np.uint8) for p in per]
    wide, total = max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat((np.arange(wide) < w * EMBED)[:, None], FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
    net = ByteConvNet(names, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.3, (wide, total)) * mask).astype(np.float32), np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    each = max(1, batch // len(names))
    y = np.repeat(np.arange(len(names)), each)
    for step in range(1, steps + 1):
        x = np.concatenate([p[rng.integers(0, len(p), each)] for p in pools]).copy()
        for k in np.flatnonzero(rng.random(len(x)) < 0.34):
            x[k, rng.integers(8, WINDOW) :] = 0
        grads = gradients(net, x, y)
        grads[1] *= mask
        for k, g in enumerate(grads):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.001 * (g * g - v[k])
            params[k] -= 8e-3 * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def gradients(net: ByteConvNet, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss of windows x with languages y, by the net's five arrays."""
    cols, (n, width), total = net.columns(x), x.shape, net.filters.shape[1]
    maps = (cols.reshape(n * width, -1) @ net.filters).reshape(n, width, total)
    top = maps.argmax(axis=1)
    best = np.take_along_axis(maps, top[:, None, :], 1)[:, 0, :] + net.bias
    pooled = np.maximum(best, 0)
    slope = _softmax(pooled @ net.out + net.out_bias)
    slope[np.arange(n), y] -= 1
    slope /= n
    back = (slope @ net.out.T) * (best > 0)
    under = cols[np.arange(n)[:, None], top]  # windows x filters x the embedded bytes under each filter's best place
    to_embed = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    hit = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))[np.arange(n)[:, None, None], top[:, :, None] + np.arange(max(WIDTHS))].ravel()
    by_embed = np.stack([np.bincount(hit, to_embed[:, d], 256) for d in range(EMBED)], 1).astype(net.embed.dtype)
    return [by_embed, np.einsum("bf,bfk->kf", back, under), back.sum(0), pooled.T @ slope, slope.sum(0)]


def train(docs: DataFrame, folds: int = 5, held_fold: int = 0, per_lang: int = TRAIN_PER_LANG, most: int = TRAIN_DOCS) -> ByteConvNet | None:
    """Fit on the whole texts of a bounded sample of rows outside the held-out fold whose lang is known.

    About per_lang documents of each language, chosen by a hash of the id, and ``most`` in all; of more
    than ``most`` languages those with the most documents, ties by name.  Null texts, null langs and
    empty texts teach nothing; rows that repeat an id are chosen together; other columns are ignored.
    Without such rows there is no network.
    """
    known = docs.select(docs["doc_id"].alias("d_id"), docs["text"].alias("d_text"), docs["lang"].alias("d_lang")).filter("d_text IS NOT NULL AND d_lang IS NOT NULL").filter(fold_of(F.col("d_id"), folds) != held_fold)
    counts = {r["d_lang"]: r["n"] for r in known.groupBy("d_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d_lang").limit(most).collect()}
    if not counts:
        return None
    each = min(per_lang, max(1, most // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, each / n) * (1 << 30)))])
    chosen = known.filter(F.pmod(F.xxhash64("d_id", F.lit(9)), F.lit(1 << 30)) < share[F.col("d_lang")])
    got = sorted(map(tuple, chosen.select(F.col("d_id").cast("string"), "d_text", "d_lang").collect()), key=lambda r: (r[0] or "", *r[1:]))
    return fit([text for _, text, _ in got], [lang for _, _, lang in got])


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """doc_id, lang_pred, score: the mean of the windows' probabilities, weighted by their bytes.

    Null texts and texts without letters are UNKNOWN with score 0, and so is all without a network; of
    languages that tie, the first by name.  Rows are judged one by one, so repeated rows get one answer
    each; other columns of docs, whatever their names, are ignored; an empty table gives no rows.  A
    long text is read whole, as all the windows that it fills.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                langs, scores = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows
                asked = [k for k, ok in enumerate(part.column(2).to_pylist()) if ok and model]
                texts = [part.column(1)[k].as_py().encode() for k in asked]
                if asked:
                    windows = [windows_of(t) for t in texts]
                    sizes = [len(w) for w in windows]
                    every = np.concatenate(windows)
                    p = np.concatenate([model.probabilities(every[b : b + BATCH]) for b in range(0, len(every), BATCH)])
                    weight = np.full(len(every), float(WINDOW))
                    ends = np.cumsum(sizes)
                    weight[ends - 1] = [max(1, len(t) - WINDOW * (n - 1)) for t, n in zip(texts, sizes)]
                    begins = ends - sizes
                    mean = np.add.reduceat(p * weight[:, None], begins) / np.add.reduceat(weight, begins)[:, None]
                    for k, q in zip(asked, mean):
                        langs[k], scores[k] = model.langs[int(q.argmax())], float(min(1.0, q.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    letters = F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False))
    return docs.select(docs["doc_id"].cast("long"), docs["text"], letters.alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, odd ones included; see train and predict."""
    found = predict(docs, train(docs))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")

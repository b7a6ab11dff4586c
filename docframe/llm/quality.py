"""Quality classifier: random-indexing word vectors, pooled per document, and a small network."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import fold_of, stage
from docframe.session import ship

#: Bound of the training sample: labelled rows, whose whole texts are read.
TRAIN_ROWS = 6000
#: Words that the sample holds as often have a vector of their own; others share that of their form.
LEAST_COUNT = 3
DIMS, NONZERO, REACH, HIDDEN = 64, 6, 2, 24
THRESHOLD = 0.7
_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
REPEATED = " again"
#: Words that a worker remembers the row of.
REMEMBERED = 300_000
TEXTS = 64


def tokens_of(text: str | None) -> list[str]:
    """Words, numbers and runs of marks; a word that stands again one or two places on is REPEATED."""
    found = _TOKENS.findall(text or "")
    again = [REPEATED if (a == b or a == c) and a.isalpha() else a for a, b, c in zip(found[2:], found[1:], found)]
    return found[:2] + again


def form(token: str) -> str:
    """What is left of a word when its letters don't matter."""
    if token[0].isalpha():
        case = "U" if token.isupper() and len(token) > 1 else "L" if token.islower() else "T" if token[1:].islower() or len(token) == 1 else "M"
        return f" {case}{min(len(token), 15) // 4}"
    return f" N{min(len(token), 4)}" if token[0].isdigit() else f" P{token[:2]}"


def index_hashes(token: str) -> list[int]:
    return [xxhash.xxh64_intdigest(token, seed=k) for k in range(NONZERO)]


def _entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs that hashes stand for."""
    return ((hashes >> np.uint64(1)) % np.uint64(DIMS)).astype(np.int64), np.where(hashes & np.uint64(1), 1.0, -1.0)


def index_vector(token: str) -> np.ndarray:
    """The sparse random vector of a word, a function of the word alone."""
    out = np.zeros(DIMS, np.float32)
    np.add.at(out, *_entries(np.array(index_hashes(token), np.uint64)))
    return out


@dataclass
class QualityModel:
    rows: dict[str, int]  # of words and forms; the last row is that of unseen forms
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def row(self, token: str) -> int:
        got = self.rows.get(token)
        return got if got is not None else self.rows.get(form(token), len(self.vectors) - 1)

    def pooled(self, texts: list[str], seen: dict[str, int]) -> np.ndarray:
        """The mean word vector of each text; zero for a text without words."""
        out = np.zeros((len(texts), DIMS), np.float32)
        for k, text in enumerate(texts):
            tokens = tokens_of(text)
            for at in range(0, len(tokens), 100_000):
                part = tokens[at : at + 100_000]
                if fresh := set(part).difference(seen):
                    if len(seen) + len(fresh) > REMEMBERED:
                        seen.clear()
                        fresh = set(part)
                    seen.update((t, self.row(t)) for t in fresh)
                out[k] += self.vectors[list(map(seen.__getitem__, part))].sum(axis=0)
            out[k] /= max(1, len(tokens))
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum((pooled - self.centre) / self.spread @ self.w1 + self.b1, 0)
        return (hidden @ self.w2 + self.b2) / self.temperature

    def scores(self, texts: list[str], seen: dict[str, int]) -> np.ndarray:
        return _sigmoid(self.logits(self.pooled(texts, seen)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray, list[np.ndarray]]:
    """Random indexing: a word's vector sums the index vectors of its neighbours and its own.

    Also the rows of each text's words.
    """
    numbers: dict[str, int] = {}
    found = [np.array([numbers.setdefault(w, len(numbers)) for w in tokens_of(t)], np.int32) for t in texts]
    counts = np.bincount(np.concatenate(found), minlength=len(numbers)) if found else []
    names = sorted(w for w, n in zip(numbers, counts) if n >= LEAST_COUNT) + sorted({form(w) for w in numbers})
    rows = {w: k for k, w in enumerate(names)}
    place = np.array([rows[w] if w in rows else rows[form(w)] for w in numbers], np.int32)
    ids = [place[f] for f in found]
    del numbers, found, place, counts
    hashes = np.fromiter((h for w in names for h in index_hashes(w)), np.uint64, len(names) * NONZERO).reshape(-1, NONZERO)
    dims, signs = (np.concatenate([x, np.zeros((1, NONZERO), x.dtype)]) for x in _entries(hashes))  # the last row is that of unseen forms
    own = sum(np.bincount(np.arange(len(dims)) * DIMS + dims[:, k], signs[:, k], len(dims) * DIMS) for k in range(NONZERO))
    # texts apart by rows of zeros, so that neighbours are of one text
    gap = np.full(REACH, len(names), np.int32)
    every = np.concatenate([x for i in ids for x in (i, gap)]).astype(np.int64) if ids else np.zeros(0, np.int64)
    context = np.zeros(len(dims) * DIMS)
    for step in range(1, REACH + 1):
        for a, b in ((every[:-step], every[step:]), (every[step:], every[:-step])):
            for k in range(NONZERO):
                context += np.bincount(a * DIMS + dims[b, k], signs[b, k], len(context))
    own, context = own.reshape(-1, DIMS), context.reshape(-1, DIMS)
    context[-1] = 0
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-6)
    return rows, (own + context).astype(np.float32), ids


def fit(texts: list[str], labels: list[int], seed: int = 11, epochs: int = 60, least_steps: int = 1500) -> QualityModel:
    """Train on all but every fifth row, over small samples more often; those rows calibrate the temperature."""
    rng = np.random.default_rng(seed)
    rows, vectors, ids = word_vectors(texts)
    model = QualityModel(rows, vectors, np.zeros(DIMS, np.float32), np.ones(DIMS, np.float32), rng.normal(0, 0.2, (DIMS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.2, HIDDEN).astype(np.float32), 0.0)
    if not texts:
        return model
    x = np.array([vectors[i].mean(axis=0) if len(i) else np.zeros(DIMS, np.float32) for i in ids])
    y = np.array(labels, np.float32)
    held = np.arange(len(y)) % 5 == 4
    model.centre, model.spread = x[~held].mean(0), x[~held].std(0) + 1e-3
    xs, ys = ((x - model.centre) / model.spread)[~held], y[~held]
    params = [model.w1, model.b1, model.w2, np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(epochs, -(-least_steps * 64 // max(64, len(ys))))):
        order = rng.permutation(len(ys))
        for at in range(0, len(order), 64):
            xb, yb = xs[order[at : at + 64]], ys[order[at : at + 64]]
            grads = gradients(params, xb, yb)
            step += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                params[k] -= 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])
    if held.any():
        z, t = model.logits(x[held]), y[held]
        loss = lambda c: -np.mean(t * np.log(_sigmoid(z / c) + 1e-9) + (1 - t) * np.log(1 - _sigmoid(z / c) + 1e-9))
        model.temperature = float(min(np.geomspace(0.5, 8, 40), key=loss))
    return model


def gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> list[np.ndarray]:
    """Of the mean log loss, with a small penalty on the weights, by both layers' weights and biases."""
    pre = x @ params[0] + params[1]
    hidden = np.maximum(pre, 0)
    slope = (_sigmoid(hidden @ params[2] + params[3]) - y) / len(y)
    back = slope[:, None] * params[2] * (pre > 0)
    return [x.T @ back + decay * params[0], back.sum(0), hidden.T @ slope + decay * params[2], slope.sum(keepdims=True)]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_fold: int = 2, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on the whole texts of at most about ``rows`` labelled documents outside the held-out fold.

    They are chosen by a hash of the id; the bound is the parameter, whatever the size of the tables.
    Null labels, ids and texts teach nothing; of several labels of an id the smallest counts; rows that
    repeat an id teach as often.  Other columns are ignored; empty tables give a model that scores all alike.
    """
    known = labels.select(labels["doc_id"].alias("l_id"), labels[label_col].cast("int").alias("label"))
    known = known.filter("l_id IS NOT NULL AND label IS NOT NULL").filter(fold_of(F.col("l_id"), folds) != held_fold).groupBy("l_id").agg(F.min("label").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = stage(known.filter(F.pmod(F.xxhash64("l_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))), "quality-sample")
    texts = docs.select(docs["doc_id"].alias("d_id"), docs["text"].alias("d_text")).filter("d_text IS NOT NULL").join(chosen, F.col("d_id") == F.col("l_id"))
    got = sorted(texts.select("d_id", "d_text", "label").collect(), key=lambda r: (r["d_id"], r["d_text"]))
    return fit([r["d_text"] for r in got], [r["label"] for r in got])


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score, predicted of every whole text; null counts as empty, and empty texts have a score.

    Rows are scored one by one, so repeated rows and equal texts score alike; other columns are
    ignored.  A long text is split into tokens as a whole by its task.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                p = sent.value.scores(part.column(1).to_pylist(), seen).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; see train and score."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text scores THRESHOLD at least, with all their columns, whatever their names.

    Null and empty texts, repeated rows and empty tables are treated as in score.
    """
    ship(docs.sparkSession)
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                kept = part.filter(pa.array(sent.value.scores(part.column(place).to_pylist(), seen) >= THRESHOLD))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)

"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  A line's potentials use its own features (shares of symbols, capitals,
digits, repeated words, ...) and those of the lines before and after it; transitions tie neighbours.
Forward-backward gives each line's marginal, and the document's score is their mean weighted by
line length, then calibrated.

Labels mark documents, not lines, so line tags are latent.  Training first fits a line's own features to
the label of its document, then sets each line's tag by these, with EVIDENCE log odds for the document's
label, and fits the whole field to the tags.  A good document can so have bad lines, and transitions
learn where tags change.

Training reads at most TRAIN_DOCS labelled documents, the ids of smallest hash.  Of each it takes one
window of at most TRAIN_LINES lines that begins at a line chosen by the id's hash; every fourth
document is held back, and calibration (a logistic curve) is fitted on the scores of these as wholes.
These bounds hold for learning alone.  Scoring reads every line of every document.

Cases: null and empty texts are one empty line and get a score like any other.  Labels that are null
or belong to no document are not used; several labels of one document count as the largest, and of
several texts under one id the one of smallest hash is used.  Without any usable label (or with one
kind only) the score is the share of good labels, 0.5 without any.  Repeated rows get equal scores; a
text is held whole by one task; extra columns of any name stay, but for score and predicted, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Texts, chunks, cut, plain_names, prefix_hash, range_hash, ship, words

TRAIN_DOCS = 3000
TRAIN_LINES = 30
ROUNDS = 150
WARM = 60
EVIDENCE = 1.0
THRESHOLD = 0.3

_CLASSES = np.zeros((6, 256), bool)
_CLASSES[0, 97:123] = True  # small letters
_CLASSES[1, 65:91] = True  # capitals
_CLASSES[2, 48:58] = True  # digits
_CLASSES[3, [ord(c) for c in "#$%&*!|@^~<>{}[]\\_=+/"]] = True  # symbols
_CLASSES[4, [ord(c) for c in ".,;:?'\"()-"]] = True  # punctuation
_CLASSES[5, 128:] = True  # beyond ASCII
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
N_OWN = 10
N_FEATURES = 3 * N_OWN + 3


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, first line of each row and the total)."""
    data, n = texts.data, texts.n
    breaks = np.flatnonzero(data == 10)
    row_of = np.searchsorted(texts.offsets, breaks, "right") - 1
    start = np.concatenate([texts.start, breaks + 1])
    order = np.lexsort((start, np.concatenate([np.arange(n), row_of])))
    start = start[order]
    first = np.concatenate([[0], np.cumsum(1 + np.bincount(row_of, minlength=n))]) if n else np.zeros(1, np.int64)
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    if n:
        end[first[1:] - 1] = texts.end
    size = (end - start).astype(np.float64)
    total = np.maximum(size, 1)
    own = np.zeros((len(start), N_OWN))
    sums = np.zeros(len(data) + 1, np.int64)
    for k, table in enumerate(_CLASSES):
        np.cumsum(table[data], out=sums[1:])
        own[:, k] = (sums[end] - sums[start]) / total
    letters = own[:, 0] + own[:, 1] + own[:, 5]
    own[:, 6] = own[:, 1] / np.maximum(letters, 1e-9)  # capitals among letters
    lower = Texts.__new__(Texts)
    lower.data, lower.offsets, lower.n = LOWER[data], texts.offsets, n
    w_start, w_end, _ = words(lower, _IS_WORD)
    h = range_hash(prefix_hash(lower.data), w_start, w_end)
    again = np.zeros(len(h) + 1, np.int64)
    again[2:] = np.cumsum(h[1:] == h[:-1]) if len(h) > 1 else again[2:]
    lo, hi = np.searchsorted(w_start, start), np.searchsorted(w_start, end)
    n_words = hi - lo
    pairs = np.maximum(n_words - 1, 1)
    own[:, 7] = np.where(n_words > 1, (again[hi] - again[np.minimum(lo + 1, len(h))]) / pairs, 0)  # words that repeat the one before
    own[:, 8] = np.log1p(size / np.maximum(n_words, 1)) * (n_words > 0)
    own[:, 9] = np.log1p(size)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge_b, edge_a = np.zeros(len(own)), np.zeros(len(own))
    if n:
        before[first[:-1]], after[first[1:] - 1] = 0, 0
        edge_b[first[:-1]], edge_a[first[1:] - 1] = 1, 1
    return np.column_stack([own, before, after, edge_b, edge_a, n_words > 0]), size, first


def _sweep(odds: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log messages (lines, 2) and the log normalizer of each row.

    All rows go on together, line by line; rows are sorted by length so that the live ones lead.
    """
    n_lines = np.diff(first)
    order = np.argsort(-n_lines, kind="stable")
    base, length = first[:-1][order], n_lines[order]
    emit = np.column_stack([np.zeros_like(odds), odds])
    ahead, back = emit.copy(), np.zeros_like(emit)
    longest = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(longest), "left")  # rows longer than t lines
    for t in range(1, longest):
        at = base[: live[t]] + t
        p = ahead[at - 1]
        for y in (0, 1):
            ahead[at, y] += np.logaddexp(p[:, 0] + move[0, y], p[:, 1] + move[1, y])
    for t in range(longest - 1, 0, -1):
        at = base[: live[t]] + t
        p = back[at] + emit[at]
        for y in (0, 1):
            back[at - 1, y] = np.logaddexp(p[:, 0] + move[y, 0], p[:, 1] + move[y, 1])
    last = ahead[first[1:] - 1] if len(length) else np.zeros((0, 2))
    return ahead, back, np.logaddexp(last[:, 0], last[:, 1])


@dataclass
class QualityModel:
    """Weights of the field and of the calibration; plain arrays, a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    move: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    prior: float | None = None

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability that each line is good."""
        odds = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        ahead, back, total = _sweep(odds, first, self.move)
        return np.exp(ahead[:, 1] + back[:, 1] - np.repeat(total, np.diff(first)))

    def score(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(first) - 1, self.prior)
        return 1 / (1 + np.exp(-(self.slope * self.odds(x, size, first) + self.shift)))

    def odds(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        weight = size + 1e-3  # a document of empty lines weighs them alike
        good = np.add.reduceat(self.marginals(x, first) * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        good = np.clip(good, 1e-4, 1 - 1e-4)
        return np.log(good / (1 - good))


def _pairs(ahead: np.ndarray, back: np.ndarray, norm: np.ndarray, odds: np.ndarray, move: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Expected counts of (tag, next tag)."""
    emit = np.column_stack([np.zeros_like(odds), odds])
    return np.array([[np.exp(ahead[inside - 1, a] + move[a, b] + emit[inside, b] + back[inside, b] - norm[inside]).sum() for b in (0, 1)] for a in (0, 1)])


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, ridge: float = 1e-2) -> QualityModel:
    """Maximum likelihood with a ridge, by Adam: of the documents' labels, then of the tags that follow from them."""
    if not len(label) or len(np.unique(label)) < 2:
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, np.zeros((2, 2)), prior=float(label.mean()) if len(label) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    y = np.repeat(label, np.diff(first)).astype(np.float64)
    goal = y
    inside = np.ones(len(y), bool)
    inside[first[:-1]] = False
    inside = np.flatnonzero(inside)
    theta = np.zeros(N_FEATURES + 1 + 4)
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(label)
    seen = np.array([[((1 - y[inside])).sum(), 0.0], [0.0, y[inside].sum()]])
    for step in range(1, rounds + 1):
        move = theta[-4:].reshape(2, 2)
        odds = z @ theta[:N_FEATURES] + theta[N_FEATURES]
        ahead, back, total = _sweep(odds, first, move)
        norm = np.repeat(total, np.diff(first))
        p = np.exp(ahead[:, 1] + back[:, 1] - norm)
        pair = _pairs(ahead, back, norm, odds, move, inside)
        warm = step < WARM
        if step == WARM:
            goal = (odds + EVIDENCE * (2 * y - 1) > 0).astype(np.float64)
            seen = np.zeros((2, 2))
            np.add.at(seen, (goal[inside - 1].astype(int), goal[inside].astype(int)), 1)
        grad = np.concatenate([z.T @ (p - goal), [(p - goal).sum()], (pair - seen).ravel()]) / n + ridge * theta
        if warm:  # neighbours would tell a line the label of its document, before tags are its own
            grad[N_OWN : N_FEATURES - 1] = grad[-4:] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return QualityModel(mean, scale, theta[:N_FEATURES], float(theta[N_FEATURES]), theta[-4:].reshape(2, 2).copy())


def calibrate(model: QualityModel, odds: np.ndarray, label: np.ndarray) -> None:
    """The logistic curve over the scores of documents that were held back."""
    if len(np.unique(label)) < 2:
        return
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a * odds + b)))
        a -= 0.05 * (((p - label) * odds).mean() + 1e-2 * (a - 1))
        b -= 0.05 * ((p - label).mean() + 1e-3 * b)
    model.slope, model.shift = float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS, n_lines: int = TRAIN_LINES) -> QualityModel:
    """Fit on labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    The sample is the `n_docs` labelled ids of smallest hash, the same however the tables are split.
    """
    ship(docs.sparkSession)
    labels, _, (doc_id, quality) = plain_names(labels, "doc_id", "quality")
    usable = labels.where(f"{quality} is not null and {doc_id} is not null").where(F.crc32(F.col(doc_id).cast("string")) % 5 != 0)
    picked = usable.groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg(F.max(quality).cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    picked = cut(picked)  # n_docs rows at most: they may be sent to every task
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    joined = joined.select("doc_id", "quality", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(3), "doc_id").alias("spot"), F.coalesce("text", F.lit("")).alias("text"))
    kept = F.pmod("spot", F.lit(4)) != 0

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x, _, first = line_features(Texts(part.column("text")))
                made = []
                for lo, hi, spot in zip(first[:-1].tolist(), first[1:].tolist(), part.column("spot").to_pylist(), strict=True):
                    at = lo + (spot // 4) % max(1, hi - lo - n_lines + 1)
                    made.append(x[at : min(hi, at + n_lines)].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "quality", "h")), pa.array(made, pa.binary())], ["doc_id", "quality", "h", "v"])

    def one_each(rows: DataFrame) -> list:
        return sorted(rows.groupBy("doc_id").agg(F.min_by(F.struct("quality", "v"), "h").alias("r")).select("doc_id", "r.*").collect(), key=lambda r: r["doc_id"])

    rows = one_each(joined.where(kept).mapInArrow(features, "doc_id bigint, quality int, h bigint, v binary"))
    x = [np.frombuffer(r["v"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int64)
    mark = lambda rows: np.array([min(1, max(0, r["quality"])) for r in rows], np.float64)
    model = fit(np.concatenate([np.zeros((0, N_FEATURES)), *x]), first, mark(rows))
    if model.prior is not None:
        return model

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "quality", "h")), pa.array(model.odds(*line_features(Texts(part.column("text")))))], ["doc_id", "quality", "h", "v"])

    rows = one_each(joined.where(~kept).mapInArrow(odds, "doc_id bigint, quality int, h bigint, v double"))
    calibrate(model, np.array([r["v"] for r in rows]), mark(rows))
    return model


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` plus score (0 to 1) and predicted (1: good)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs, names, (text,) = plain_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, 1 << 21):
                s = sent.value.score(*line_features(Texts(part.column(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int").toDF(*names, "score", "predicted")

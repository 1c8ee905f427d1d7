"""Quality classifier: naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams of the whole text: of its bytes, and of its pattern of
repeated words and lines. Each indicator is scaled by
its class log-count ratio r = log(p / |p|) - log(q / |q|) with add-one counts p, q over the
training texts of either class; rows are scaled to unit length and a linear hinge-loss model
is fitted on them by dual coordinate descent. A logistic curve over cross-fitted margins,
moved from the sample's class balance to that of all labels, gives the score.

Training rows are labelled rows with crc32(doc_id as text) mod 5 <> 0: of each class the
``per_class`` with the least seeded hash of doc_id (a documented bound: the fit runs on the
driver over at most 2 * per_class rows, each of at most 2^BITS bits whatever the text's length:
32 KiB, 128 MiB in all by default). The class balance is counted over all training labels. Scoring covers every whole text; only text is an input of a score.

A null or empty text has no n-grams and scores by the bias alone. A doc_id with several texts
trains with the one of least hash, with several labels with the smallest; null ids or labels
don't train. Without labels of both classes every text scores the share of label 1 (0.5
without any). Repeated rows score alike; extra columns are ignored or kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penawar.llm.common import columns_of, packed
from penawar.session import ship_package

BITS = 18
ORDERS = (2, 3, 4)
REPEATS = (1, 2, 4)
PER_CLASS = 2000
THRESHOLD = 0.3
SEED = 11


def _mark(seen: np.ndarray, b: np.ndarray, orders, salt: int, bits: int) -> None:
    for n in orders:
        if len(b) >= n:
            g = np.full(len(b) - n + 1, n + salt, np.uint32)
            for j in range(n):
                g = g * np.uint32(0x01000193) ^ b[j:len(b) - n + 1 + j]
            seen[(g * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)] = True


def ngram_ids(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct ids of the text's byte n-grams, and of the n-grams of its repetition pattern: which words
    equal the word before them, which lines a line before them."""
    raw = (text or "").encode("utf-8", "replace")
    seen = np.zeros(1 << bits, bool)
    _mark(seen, np.frombuffer(raw, np.uint8).astype(np.uint32), ORDERS, 0, bits)
    words = raw.split()
    _mark(seen, np.fromiter((x == y for x, y in zip(words, words[1:])), np.uint32, max(len(words) - 1, 0)), REPEATS, 100, bits)
    lines = [x for x in raw.splitlines() if x]
    known: set[bytes] = set()
    again = np.zeros(len(lines), np.uint32)
    for i, x in enumerate(lines):
        again[i] = x in known
        known.add(x)
    _mark(seen, again, REPEATS, 200, bits)
    return np.flatnonzero(seen).astype(np.int32)


def stored(ids: np.ndarray, bits: int = BITS) -> bytes:
    """A row of ids in at most 2^bits / 8 bytes: the ids, or one bit an id where those take less."""
    if 4 * len(ids) < (1 << bits) // 8:
        return ids.astype(np.int32).tobytes()
    marks = np.zeros(1 << bits, bool)
    marks[ids] = True
    return np.packbits(marks).tobytes()


class Rows:
    """Rows of n-gram ids as ``stored`` bytes; a row's ids are taken when needed."""

    def __init__(self, raw: list[bytes], bits: int = BITS):
        self.raw, self.bits = raw, bits

    @classmethod
    def of(cls, rows, bits: int) -> Rows:
        return rows if isinstance(rows, cls) else cls([stored(ids, bits) for ids in rows], bits)

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, i: int) -> np.ndarray:
        raw = self.raw[i]
        if len(raw) == (1 << self.bits) // 8:
            return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))).astype(np.int32)
        return np.frombuffer(raw, np.int32)

    def pick(self, at) -> Rows:
        return Rows([self.raw[i] for i in at], self.bits)


@dataclass
class Model:
    weights: np.ndarray  # weight times ratio, per n-gram id
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        norm = np.sqrt((self.ratios[ids].astype(np.float64) ** 2).sum())
        return float(self.weights[ids].sum(dtype=np.float64) / norm + self.bias) if norm > 0 else float(self.bias)

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(ngram_ids(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(rows: Rows | list[np.ndarray], y: np.ndarray, dim: int) -> np.ndarray:
    p, q = np.ones(dim), np.ones(dim)
    for ids, label in zip(rows, y):
        (p if label > 0 else q)[ids] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows, ratios, y, cost, epochs, seed):
    """min |w|^2 / 2 + sum cost_i * max(0, 1 - y_i w x_i), one dual variable at a time; the bias is a constant feature.

    Row i has the values ratios[rows[i]] scaled to unit length; they are taken when needed, never stored."""
    w, bias = np.zeros(len(ratios)), 0.0
    alpha = np.zeros(len(rows))
    sums = np.array([(ratios[ids] ** 2).sum() for ids in rows])
    scale = 1 / np.maximum(np.sqrt(sums), 1e-12)
    square = sums * scale ** 2 + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            ids = rows[i]
            v = ratios[ids] * scale[i]
            g = y[i] * (w[ids] @ v + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[ids] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def _fit_margins(rows, y, dim, cost, epochs, seed):
    r = log_count_ratios(rows, y, dim)
    w, bias = dual_coordinate_descent(rows, r, y, cost, epochs, seed)
    return r, w * r, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1 | margin), by Newton steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit(rows: Rows | list[np.ndarray], y: np.ndarray, odds: float | None = None, bits: int = BITS, cost: float = 1.0,
        epochs: int = 30, folds: int = 4, seed: int = SEED) -> Model:
    """``y`` in {-1, 1}; ``odds``: of label 1 among all labels (None: as in the sample)."""
    dim, rows = 1 << bits, Rows.of(rows, bits)
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    each = np.where(y > 0, cost * len(y) / (2 * max(n1, 1)), cost * len(y) / (2 * max(n0, 1)))
    r, w, bias = _fit_margins(rows, y, dim, each, epochs, seed)
    # margins of rows that the fold's model hasn't seen
    fold = np.empty(len(rows), int)
    for c in (-1, 1):
        where = np.flatnonzero(y == c)
        fold[where] = np.arange(len(where)) % folds
    margin = np.zeros(len(rows))
    for k in range(folds):
        tr, te = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(te) == 0 or len(set(y[tr])) < 2:
            tr, te = np.arange(len(rows)), te
        rk, wk, bk = _fit_margins(rows.pick(tr), y[tr], dim, each[tr], max(5, epochs // 3), seed + k + 1)
        m = Model(wk, rk, bk, 1.0, 0.0)
        for i in te:
            margin[i] = m.margin(rows[i])
    slope, offset = _logistic(margin, y)
    if odds:
        offset += np.log(odds / (n1 / n0))
    return Model(w.astype(np.float32), r.astype(np.float32), bias, slope, offset)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED):
    """(n-gram ids per row, labels in {-1, 1}, label counts): a bounded sample on the driver, in rows and in bytes."""
    spark = docs.sparkSession
    ship_package(spark)
    lab = (columns_of(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
           .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    counts = {r["quality"]: r["count"] for r in lab.groupBy("quality").count().collect()}
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    sample = None
    for c in (0, 1):
        part = lab.where(F.col("quality") == c).orderBy(*order).limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 * per_class rows are broadcast
    texts = (columns_of(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")
             .groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")))

    @F.pandas_udf("binary")
    def grams(text: pd.Series) -> pd.Series:
        return text.map(lambda t: stored(ngram_ids(t)))

    got = texts.select("doc_id", "quality", grams("text").alias("ids")).orderBy(*order).collect()
    rows = Rows([bytes(r.ids) for r in got])
    y = np.array([1 if r.quality else -1 for r in got])
    return rows, y, counts


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> Model:
    rows, y, counts = training_rows(docs, labels, per_class, seed)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if len(set(y.tolist())) < 2:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        zero = np.zeros(1 << BITS, np.float32)
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    return fit(rows, y, n1 / n0, seed=seed)


def scored(df: DataFrame, model: Model, text: Column) -> DataFrame:
    """``df`` plus score: one Arrow batch of texts at a time, the model broadcast (its size is fixed by BITS)."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return texts.map(m.score).astype("float64")

    return df.withColumn("score", score(F.coalesce(text, F.lit(""))))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, **params)
    d = scored(columns_of(docs, "doc_id", "text"), model, F.col("text"))
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """``docs`` with a score of at least ``threshold``, columns as they are."""
    model = train(docs, labels, **params)
    return scored(packed(docs).select("_row"), model, F.col("_row.text")).where(F.col("score") >= threshold).select("_row.*")

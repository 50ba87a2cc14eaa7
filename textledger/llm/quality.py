"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled good rows; all training rows, whatever their
labels, are the unlabelled ones. An additive model over binned style features
minimises the non-negative unbiased risk (Kiryo et al., 2017) with the logistic
loss. The class prior is estimated from positives and unlabelled rows alone:
wherever the threshold lies, unlabelled rows reach it at least ``prior`` times
as often as positives do, so the least such ratio bounds the prior from above;
it is taken on a fifth of the rows that the weights are not fitted to.

Training is distributed and reads every training row: texts are measured once
where they lie, to ``FEATURES`` codes of 12 bits, and each of ``ROUNDS`` Newton
steps is one pass over the codes that returns sums of a fixed size. No sample
is drawn, and bad labels are never looked at.

Nulls: a null text counts as empty, and empty texts are scored like any other;
rows without a label or an id only count as unlabelled. Without positives (or
without any on one side of the fifth) all score 0.5. Labels that repeat count
once, and as good if one of them is. Repeated rows are kept, each counts. An
empty table gives no rows. Extra columns, of any name, are ignored
(``keep_good`` returns them).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codes_of, column, keyed_sum, runs, settle, slices

#: Places of the bin edges among the training rows.
EDGES = (0.005, 0.02, 0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95, 0.98, 0.995)
BINS = len(EDGES) + 1
#: Scores from here on count as good.
THRESHOLD = 0.7
ROUNDS = 12
#: Penalties of the whole fit: on the differences of neighbouring bins' weights, and on weights.
SMOOTH, RIDGE = 20.0, 2.0
#: Thresholds for the prior leave out at most this share of the positives.
TAIL = 0.1
#: Levels of a feature's code, and of a score's in the prior's estimate.
LEVELS, STEPS = 1 << 12, 1 << 10
_CLASSES: np.ndarray | None = None
_N_CLASSES = 8
FEATURES = ["length", "lower", "upper", "digit", "space", "line", "stop", "rare", "other", "word_length", "distinct", "common", "packed", "ends", "bare"]
#: A feature x becomes the code LEVELS * x / (x + scale).
SCALES = np.array([8, 1, 1, 1, 1, 1, 1, 1, 1, 5, 1, 0.1, 0.5, 1, 1])


def _class_table() -> np.ndarray:
    """Code point to class: 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 sentence marks, 6 rarer ASCII marks, 7 other."""
    global _CLASSES
    if _CLASSES is None:
        table = np.full(0x110000, 7, np.uint8)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                table[cp] = 1 if ch.isupper() else 0
            elif ch.isdigit():
                table[cp] = 2
        for chars, k in (("\n\r\x0b\x0c ", 4), (" \t\xa0", 3), (".,;:!?'\"()-", 5), ("#$%&*+/<=>@[\\]^_`{|}~", 6)):
            for ch in chars:
                table[ord(ch)] = k
        _CLASSES = table
    return _CLASSES


def features(texts: list[str]) -> np.ndarray:
    """Style features of whole texts (texts x FEATURES)."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, j in runs(texts):
        some = texts[i:j]
        size = np.fromiter(map(len, some), np.int64, len(some))
        owner = np.repeat(np.arange(len(some)), size + 1)
        kinds = np.bincount(owner * _N_CLASSES + _class_table()[codes_of(some)], minlength=len(some) * _N_CLASSES).reshape(-1, _N_CLASSES).astype(float)
        kinds[:, 4] -= 1  # the separator
        n = np.maximum(size, 1)[:, None]
        out[i:j, 0] = np.log1p(size)
        out[i:j, 1:9] = kinds / n
        for row, text in zip(out[i:j], some):
            words = text.split()
            if words:
                seen = len(set(words))
                half = words[: max(1, len(words) // 2)]
                row[9] = (len(text) - len(words) + 1) / len(words)
                row[10] = seen / len(words) ** 0.8
                row[11] = max(words.count(half[0]), words.count(half[-1]), words.count(words[-1])) / len(words)
                row[13] = sum(w[-1] in ".,;:!?" for w in words) / len(words)
                row[14] = sum(not w[0].isalnum() and not w[-1].isalnum() for w in words) / len(words)
            raw = text.encode("utf-8", "surrogatepass")
            row[12] = len(zlib.compress(raw, 1)) / (len(raw) + 20)
    return out


def codes(texts: list[str]) -> np.ndarray:
    """Features as codes below LEVELS (texts x FEATURES)."""
    x = np.maximum(features(texts), 0)
    return np.minimum(x / (x + SCALES) * LEVELS, LEVELS - 1).astype(np.uint16)


class Scorer:
    """Weights by feature and bin, and a bias behind them."""

    def __init__(self, edges: np.ndarray, theta: np.ndarray | None = None):
        self.edges = edges
        self.theta = np.zeros(len(FEATURES) * BINS + 1) if theta is None else theta

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The places of the weights that each row of codes adds up."""
        return np.stack([np.searchsorted(e, c) + k * BINS for k, (e, c) in enumerate(zip(self.edges, x.T))] + [np.full(len(x), len(self.theta) - 1)], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.theta[self.cells(x)].sum(axis=1), -30, 30)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


class Sums:
    """What a Newton step needs of rows of codes: sums that rows add to, as one flat array."""

    SIZE = len(FEATURES) * BINS + 1
    #: counts; softplus sums of unlabelled and positive rows; gradients (unlabelled, positives' cells, positives weighted); curvature; histograms
    PARTS = (2, 2, SIZE, SIZE, SIZE, SIZE * SIZE, STEPS, STEPS)

    @staticmethod
    def of(model: Scorer, x: np.ndarray, good: np.ndarray, held: np.ndarray) -> np.ndarray:
        n = Sums.SIZE
        cells, z = model.cells(x), model.margins(x)
        soft, sig = np.logaddexp(0, z), 1 / (1 + np.exp(-z))
        fit, pos = ~held, ~held & good
        k = cells.shape[1]
        grad = lambda rows, w: np.bincount(cells[rows].ravel(), np.repeat(w[rows], k), n)
        curve = np.zeros(n * n)
        rows, w = cells[fit], (sig * (1 - sig))[fit]
        for i in range(k):
            for j in range(i, k):
                curve += np.bincount(rows[:, i] * n + rows[:, j], w, n * n)
        step = np.minimum((z + 16) * (STEPS / 32), STEPS - 1).clip(0).astype(np.int64)
        hist = lambda rows: np.bincount(step[rows], minlength=STEPS)
        return np.concatenate([[fit.sum(), pos.sum()], [soft[fit].sum(), soft[pos].sum()], grad(fit, sig), grad(pos, np.ones(len(z))), grad(pos, sig), curve, hist(held), hist(held & good)])

    @staticmethod
    def split(flat: np.ndarray) -> list[np.ndarray]:
        return np.split(flat, np.cumsum(Sums.PARTS)[:-1])


def _total(rows: DataFrame, model: Scorer) -> np.ndarray:
    """The sums over all rows of ``codes, good, held``: one row a task, added up in Spark."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def add(batches):
        total = np.zeros(sum(Sums.PARTS))
        for batch in slices(batches, 8192):
            x = np.frombuffer(b"".join(column(batch, "codes")), np.uint16).reshape(-1, len(FEATURES))
            total += Sums.of(shared.value, x, batch.column("good").to_numpy(zero_copy_only=False), batch.column("held").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in table.column("sums").to_pylist())
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(add, "sums binary").withColumn("salt", F.spark_partition_id() % 16)
    once = parts.groupBy("salt").applyInArrow(lambda t: merge(t), "sums binary")
    return sum(np.frombuffer(r["sums"], float) for r in once.collect())  # 16 rows at most


def _prior(unl: np.ndarray, pos: np.ndarray) -> float:
    """The least ratio of the shares of unlabelled and positive rows that reach a threshold (histograms of scores)."""
    above = lambda h: np.cumsum(h[::-1])[::-1] / h.sum()
    u, p = above(unl), above(pos)
    return float(np.clip((u / np.maximum(p, 1e-9))[p >= 1 - TAIL].min(), 0.02, 0.98))


def _penalty() -> np.ndarray:
    out = RIDGE * np.eye(Sums.SIZE)
    for i in range(len(FEATURES) * BINS - 1):
        if (i + 1) % BINS:
            out[i : i + 2, i : i + 2] += SMOOTH * np.array([[1, -1], [-1, 1]])
    return out


def fit(rows: DataFrame, edges: np.ndarray) -> tuple[Scorer, float] | None:
    """Minimise the risk prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) by Newton steps; returns the model and the prior.

    With the logistic loss the risk is convex where its second term is not
    negative. Where that term would be, the step goes up its gradient, as published.
    """
    model, prior, penalty = Scorer(edges), 0.5, _penalty()
    for _ in range(ROUNDS):
        (n_u, n_p), (soft_u, soft_p), g_u, c_p, g_p, curve, hist_u, hist_p = Sums.split(_total(rows, model))
        if not n_p or not hist_p.sum():
            return None
        if model.theta.any():
            prior = _prior(hist_u, hist_p)
        curve = curve.reshape(Sums.SIZE, Sums.SIZE)
        curve = (curve + np.triu(curve, 1).T + penalty) / n_u
        if soft_u / n_u - prior * soft_p / n_p < 0:
            up = np.linalg.solve(curve + 1e-3 * np.eye(Sums.SIZE), g_u / n_u - prior * g_p / n_p)
            model = Scorer(edges, model.theta + 0.3 * up)
        else:
            down = np.linalg.solve(curve, g_u / n_u - prior * c_p / n_p + penalty @ model.theta / n_u)
            model = Scorer(edges, model.theta - down * min(1, 2 / max(np.abs(down).max(), 1e-12)))
    return model, prior


def learn(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """Fit on training rows: ``docs`` of ``doc_id, text`` and ``labels`` of ``doc_id, quality``."""

    def measure(batches):
        for batch in slices(batches):
            rows = codes(column(batch, "text", ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "codes"])

    def levels(batches):
        table, seen = np.zeros(len(FEATURES) * LEVELS, np.int64), 0
        for batch in slices(batches, 8192):
            x = np.frombuffer(b"".join(column(batch, "codes")), np.uint16).reshape(-1, len(FEATURES))
            table += np.bincount((x + np.arange(len(FEATURES)) * LEVELS).ravel(), minlength=len(table))
            seen += len(x)
        yield from keyed_sum.emit(table, seen, LEVELS)

    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, codes binary")
    marked = measured.join(good, "doc_id", "left").select("codes", F.coalesce("good", F.lit(False)).alias("good"), (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0).alias("held"))
    rows = settle(marked, "measured")
    counts, n = keyed_sum.total(rows.select("codes").mapInArrow(levels, keyed_sum.SCHEMA), len(FEATURES) * LEVELS, LEVELS)
    if not n:
        return None
    upto = np.cumsum(counts.reshape(len(FEATURES), LEVELS), axis=1)
    edges = np.stack([np.searchsorted(u, np.array(EDGES) * n) for u in upto])
    found = fit(rows, edges)
    return found[0] if found else None


def _scored(batches, shared):
    for batch in slices(batches):
        texts = column(batch, "text", "")
        yield batch, shared.value.scores(codes(texts)) if shared.value else np.full(len(texts), 0.5)


def score(docs: DataFrame, model: Scorer | None) -> DataFrame:
    """``doc_id, score`` for every whole text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch, own in _scored(batches, shared):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Scorer | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores ``threshold`` or more (all, without a model)."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch, own in _scored(batches, shared):
            yield batch.filter(pa.array(own >= threshold))

    return docs.mapInArrow(keep, docs.schema)

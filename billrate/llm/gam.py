"""Quality by a generalised additive model with pairwise interactions, as lookup tables.

A text is measured by some twenty numbers (shares of symbols, capitals, short words, repeated
windows and lines, lengths).  Each is cut into bins at quantiles of the training rows, and the
model is a sum: a constant, one table a feature, one table for each chosen pair of features.

Tables grow by cyclic boosting: in every round each feature in turn gets one shallow tree (two
levels of cuts) fitted to the logistic loss that all tables together leave, and its leaves are
added to the feature's table at a small rate.  Then the pairs whose best two-way cut gains most
on what is left get tables the same way.  A part of the sample that no tree sees says after
which round to stop.  Scoring finds the bins and adds table cells, for all rows of a batch at
once.

The model learns from a bounded sample of labelled rows (``rows_per_class`` of each class,
drawn by a hash of the id; rows are weighed by how many they stand for).  Null, empty and blank
texts have zero in every feature and are scored by the tables.  Without labelled rows all scores
are 0.5, with one class alone they are that class.  A document labelled more than once is low
if any label says so.  A null id is never learned from and never held out.  Repeated rows score
alike, ties in a feature share a bin, an empty table gives no rows, extra columns are not read.
Texts are measured whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billrate.llm.common import arrow_map, slices
from billrate.session import stage

FEATURES = [
    "log_words", "word_length", "word_spread", "upper", "digits", "symbols", "stops", "exclaims", "bars", "high_bytes",
    "short_words", "long_words", "marked_words", "distinct", "top_word", "repeated", "dup_lines", "line_words",
    "sentence_words", "entropy",
]
_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 white space, 5 stop, 6 other sign, 7 high byte
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[list(b".,;:?'\"()-")] = 5
_CLASS[[c for c in range(33, 127) if _CLASS[c] == 0]] = 6
_CLASS[128:] = 7
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class GamParams:
    """``rows_per_class`` bounds the labelled sample."""

    rows_per_class: int = 2500
    bins: int = 48
    pair_bins: int = 12
    pairs: int = 8
    rounds: int = 300
    rate: float = 0.1
    ridge: float = 2.0
    patience: int = 25
    kept_out: int = 5  # one row in so many stops the rounds
    threshold: float = 0.3


@dataclass(frozen=True)
class GamModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pair_tables: dict[tuple[int, int], np.ndarray]
    constant: float | None
    params: GamParams


def held_out(doc_id: Column) -> Column:
    """True for the fold no model learns from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


# --- features ---------------------------------------------------------------


def features(text: bytes | None) -> list[float]:
    """The numbers named in ``FEATURES``; all zero for a text without words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kind = _CLASS[np.frombuffer(text, np.uint8)]
    by = np.bincount(kind, minlength=8).astype(float)
    solid, letters = by.sum() - by[4], max(by[1] + by[2] + by[7], 1.0)
    exclaims, bars = text.count(b"!"), text.count(b"|")
    length = np.fromiter(map(len, words), np.int64, n)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    counts = np.unique(h, return_counts=True)[1]
    share = counts / n
    covered = np.zeros(n, bool)
    if n > 3:
        grams = (h[:-2] * _A + h[1:-1]) * _B + h[2:]
        back, times = np.unique(grams, return_inverse=True, return_counts=True)[1:]
        twice = times[back] > 1
        for k in range(3):
            covered[k : n - 2 + k] |= twice
    lines = [x for x in text.split(b"\n") if x.strip()]
    sentences = text.count(b". ") + text.count(b".\n") + text.count(b"? ") + 1
    marked = np.fromiter((w[-1] for w in words), np.uint8, n)
    return [
        float(np.log1p(n)), float(length.mean()), float(length.std()), by[2] / letters, by[3] / solid,
        (by[6] - exclaims - bars) / solid, by[5] / solid, exclaims / solid, bars / n, by[7] / solid,
        float((length <= 3).mean()), float((length >= 12).mean()), float((_CLASS[marked] == 6).mean()),
        len(counts) / n, float(share.max()), float(covered.mean()), 1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))), float(np.log1p(n / sentences)),
        float(-(share * np.log(share)).sum() / np.log(n + 1)),
    ]


def measured(rows: DataFrame, keep: list[str], types: str) -> DataFrame:
    """Columns ``keep`` of ``rows`` (of the given types) and the array ``x`` of the features of ``text``."""
    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep))
            for start, some in slices(texts):
                x = pa.array([features(t) for t in some], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(start, len(some)) for k in range(len(keep))), x], names=[*keep, "x"]
                )

    return arrow_map(rows.select(*keep, F.col("text").cast("binary")), run, f"{types}, x array<double>")


# --- training ---------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, params: GamParams) -> DataFrame:
    """doc_id, text, quality and n (rows of the class) of the bounded sample."""
    marks = (
        labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg((F.min("quality") > 0).cast("int").alias("quality"))
        .filter(F.col("labelled").isNotNull() & ~held_out(F.col("labelled")))
    )
    counts = stage(marks.groupBy("quality").agg(F.count("*").alias("n")), "gam-counts")
    share = F.xxhash64(F.col("labelled"), F.lit(29)) / F.lit(2.0**64) + F.lit(0.5)
    drawn = (
        marks.join(F.broadcast(counts), "quality").filter(share < F.lit(params.rows_per_class) / F.col("n"))
        .orderBy(F.xxhash64("labelled", F.lit(29)), "labelled").limit(2 * params.rows_per_class + params.rows_per_class // 4)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled")).dropDuplicates(["doc_id", "text"])


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges: quantiles halfway to the next lower value, so that equal values share a bin."""
    values = np.unique(x)
    first = np.arange(1, len(values))
    if len(values) > bins:
        cuts = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")
        first = np.setdiff1d(np.searchsorted(values, cuts), [0])
    return (values[first] + values[first - 1]) / 2


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain of the best cut of histograms of gradient and weight, and how many bins lie below it."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g), np.cumsum(h)
    gains = _gain(a[:-1], b[:-1], ridge) + _gain(a[-1] - a[:-1], b[-1] - b[:-1], ridge) - _gain(a[-1], b[-1], ridge)
    k = int(gains.argmax())
    return float(gains[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Leaf value of every bin, of the tree that cuts greedily ``depth`` levels deep."""
    gain, k = best_cut(g, h, ridge)
    if not depth or gain <= 1e-12:
        return np.full(len(g), -g.sum() / (h.sum() + ridge))
    return np.concatenate([tree(g[:k], h[:k], ridge, depth - 1), tree(g[k:], h[k:], ridge, depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree over two features: one cut on one, one on the other in each half."""
    best = (0.0, np.full(g.shape, 0.0))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, a.shape[0]):
            gain, leaves = 0.0, np.empty(a.shape)
            for part in (slice(0, k), slice(k, None)):
                pg, ph = a[part].sum(axis=0), b[part].sum(axis=0)
                more, cut = best_cut(pg, ph, ridge)
                gain += more + _gain(pg.sum(), ph.sum(), ridge)
                leaves[part] = np.concatenate([
                    np.full(len(s), -s.sum() / (t.sum() + ridge)) for s, t in ((pg[:cut], ph[:cut]), (pg[cut:], ph[cut:]))
                ])
            gain -= _gain(a.sum(), b.sum(), ridge)
            if gain > best[0] + 1e-12:
                best = (gain, leaves.T if turned else leaves)
    return best


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Boost:
    """State of cyclic boosting: scores of all rows, and which rows the trees may see."""

    def __init__(self, y: np.ndarray, weight: np.ndarray, seen: np.ndarray, base: float, params: GamParams):
        self.y, self.params = y, params
        self.fit, self.check = weight * seen, weight * ~seen
        self.z = np.full(len(y), base)

    def histograms(self, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = _logistic(self.z)
        g = np.bincount(cell, self.fit * (p - self.y), minlength=n)
        return g, np.bincount(cell, self.fit * np.maximum(p * (1 - p), 1e-3), minlength=n)

    def loss(self) -> float:
        p = np.clip(_logistic(self.z), 1e-9, 1 - 1e-9)
        return float(-(self.check * np.where(self.y > 0, np.log(p), np.log(1 - p))).sum())

    def rounds(self, cells: list[np.ndarray], tables: list[np.ndarray], grow) -> list[np.ndarray]:
        """Add trees to all tables in turn, and return the tables as they were at the least loss."""
        best, since, low = [t.copy() for t in tables], 0, self.loss()
        kept = self.z.copy()
        for _ in range(self.params.rounds):
            for cell, t in zip(cells, tables, strict=True):
                g, h = self.histograms(cell, t.size)
                step = self.params.rate * grow(g.reshape(t.shape), h.reshape(t.shape))
                t += step
                self.z += step.ravel()[cell]
            now = self.loss()
            if now < low:
                best, since, low, kept = [t.copy() for t in tables], 0, now, self.z.copy()
            elif (since := since + 1) >= self.params.patience:
                break
        self.z = kept
        return best


def _cells(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: rows by features."""
    return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seen: np.ndarray, params: GamParams = GamParams()) -> GamModel:
    """Tables for rows ``x`` of class ``y``; trees see rows where ``seen``, the others stop the rounds."""
    ridge = params.ridge
    mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    edges = [bin_edges(x[:, k], params.bins) for k in range(x.shape[1])]
    coarse = [bin_edges(x[:, k], params.pair_bins) for k in range(x.shape[1])]
    cell, wide = _cells(x, edges), _cells(x, coarse)
    boost = _Boost(y, weight, seen, base, params)
    tables = [np.zeros(len(e) + 1) for e in edges]
    tables = boost.rounds(list(cell.T), tables, lambda g, h: tree(g, h, ridge))

    def joint(i, j):
        return wide[:, i] * (len(coarse[j]) + 1) + wide[:, j], (len(coarse[i]) + 1, len(coarse[j]) + 1)

    gains = []
    for i, j in combinations(range(x.shape[1]), 2):
        at, shape = joint(i, j)
        g, h = boost.histograms(at, shape[0] * shape[1])
        gains.append((-pair_tree(g.reshape(shape), h.reshape(shape), ridge)[0], i, j))
    chosen = [(i, j) for gain, i, j in sorted(gains)[: params.pairs] if gain < 0]
    joined = [joint(i, j) for i, j in chosen]
    pairs = boost.rounds([at for at, _ in joined], [np.zeros(s) for _, s in joined], lambda g, h: pair_tree(g, h, ridge)[1])
    return GamModel(base, edges, tables, coarse, dict(zip(chosen, pairs, strict=True)), None, params)


def train(docs: DataFrame, labels: DataFrame, params: GamParams = GamParams()) -> GamModel:
    """Learn from the labelled rows outside the held-out fold."""
    sample = training_rows(docs, labels, params).select("doc_id", "quality", "n", "text")
    got = measured(sample, ["doc_id", "quality", "n"], "doc_id long, quality int, n long").toArrow()
    order = np.lexsort((np.array([xxhash.xxh64_intdigest(str(v)) for v in got.column("x").to_pylist()], np.uint64),
                        got.column("doc_id").to_numpy()))
    y = got.column("quality").to_numpy()[order].astype(float)
    if not len(y) or y.min() == y.max():
        return GamModel(0.0, [], [], [], {}, float(y[0]) if len(y) else 0.5, params)
    x = np.array(got.column("x").to_pylist())[order]
    ids = got.column("doc_id").to_pylist()
    mixed = np.array([xxhash.xxh64_intdigest(str(ids[k]), 5) % params.kept_out for k in order.tolist()])
    sampled = np.bincount(y.astype(int), minlength=2)
    weight = got.column("n").to_numpy()[order] / sampled[y.astype(int)]
    return learn(x, y, weight / weight.mean(), mixed != 0, params)


# --- scoring ----------------------------------------------------------------


def raw_scores(x: np.ndarray, model: GamModel) -> np.ndarray:
    """Sum of the model's table cells for each row of features."""
    cell, wide = _cells(x, model.edges), _cells(x, model.pair_edges)
    z = np.full(len(x), model.base)
    for k, t in enumerate(model.tables):
        z += t[cell[:, k]]
    for (i, j), t in model.pair_tables.items():
        z += t[wide[:, i], wide[:, j]]
    return z


def score_rows(x: np.ndarray, model: GamModel) -> np.ndarray:
    return _logistic(raw_scores(x, model)) if model.constant is None else np.full(len(x), model.constant)


def _scored(batches: Iterator[pa.RecordBatch], model: GamModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch.column(2)):
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            s = score_rows(x, model)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k).slice(start, len(texts)) for k in range(2)), pa.array(s),
                pa.array((s >= model.params.threshold).astype(np.int32)),
            ], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, model: GamModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary"))
    return arrow_map(
        rows, lambda batches: _scored(batches, sent.value), "doc_id long, held_out boolean, score double, predicted int"
    )

"""Toxicity by a subsequence string kernel, a Nyström map and a linear support vector machine.

The kernel of two words sums their common subsequences of three characters, each weighted
by a decay to the power of the stretch it spans, over the norm of both words; letters put
in between or left out lower it but do not hide an insult.  Characters spaced out one by one
are read as one word.  The kernel of a sentence and a landmark is that of the sentence's best
word.  Landmarks are words of the training sentences, and the Nyström map (the kernel to all
landmarks times the inverse root of the landmarks' own kernel) feeds a squared-hinge SVM.

Labels mark documents, so training picks, in turns, the sentence of each toxic document
that the machine finds worst, against all sentences of clean documents.  A document
scores by its worst sentence and by all that lie beyond the margin; a logistic curve turns
that into a probability.

The model learns from a bounded sample of labelled rows, as many toxic as clean ones.
Null and empty texts score like a sentence without a known word.  Without labelled rows all
scores are 0, with one class alone they are that class.  A document labelled more than once is
toxic if any label says so.  Repeated rows score alike; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billrate.llm.common import arrow_map, held_out, may_learn, slices
from billrate.session import stage

_SINGLES = re.compile(r"(?<!\S)(?:\w[^\w\s]? ){2,}\w(?!\w)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_END = re.compile(r"[.!?][\"')\]]*$")


@dataclass(frozen=True)
class ToxicityParams:
    """``rows_per_class`` and ``max_chars`` (longer texts are no training rows) bound the sample."""

    rows_per_class: int = 1000
    max_chars: int = 20_000
    length: int = 4
    max_span: int = 7
    decay: float = 0.5
    landmarks: int = 48
    piece: int = 16
    sentence_words: int = 64
    turns: int = 4
    cached_words: int = 300_000
    threshold: float = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    landmarks: tuple[str, ...]
    weights: np.ndarray  # of the kernel values: Nyström root times SVM weights
    bias: float
    curve: np.ndarray
    constant: float | None
    params: ToxicityParams


# --- kernel -----------------------------------------------------------------


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, with a mark at either end so that a kernel sees
    where a word begins."""
    text = "".join(f"<{w}>" for w in words)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


@lru_cache(64)
def _places(size: int, length: int, decay: float, max_span: int) -> tuple[np.ndarray, np.ndarray]:
    """Choices of ``length`` of ``size`` places within ``max_span``, and the decay by the stretch of each."""
    at = np.array(list(combinations(range(size), length)), np.int64).reshape(-1, length)
    at = at[at[:, -1] - at[:, 0] < max_span]
    return at, (decay ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


def _norms(s: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """Root of the kernel of each word with itself, by dynamic programming over both places."""
    lam, size = np.float32(params.decay), s.shape[1]
    zero = np.zeros(len(s), np.float32)
    before = [[zero + 1] * (size + 1)] + [[zero] * (size + 1) for _ in range(params.length - 1)]
    total = zero
    for i in range(size):
        same = [(s[:, i] == s[:, j]) * (lam * lam) for j in range(size)]
        after = [before[0]]
        for d in range(1, params.length):
            run, row = zero, [zero]
            for j in range(size):
                run = lam * run + same[j] * before[d - 1][j]
                row.append(lam * before[d][j + 1] + run)
            after.append(row)
        for j in range(size):
            total = total + same[j] * before[params.length - 1][j]
        before = after
    return np.sqrt(total)


def _pieces(word: str, size: int) -> list[str]:
    return [word] if len(word) <= size else [word[a : a + size] for a in range(0, len(word) - size // 2, size // 2)]


class Landmarks:
    """Subsequences of the landmarks with their weights, looked up by their characters."""

    def __init__(self, landmarks: list[str], params: ToxicityParams):
        self.params, self.n = params, len(landmarks)
        chars = sorted({c for w in landmarks for c in f"<{w}>"})
        self.base = len(chars) + 1
        self.ids = np.zeros(0x110000, np.int64)
        self.ids[[ord(c) for c in chars]] = np.arange(1, self.base)
        rows: dict[int, np.ndarray] = {}
        for k, w in enumerate(landmarks):
            codes = _codes([w])
            at, weight = _places(codes.shape[1], params.length, params.decay, params.max_span)
            norm = _norms(codes, params)[0]
            for key, v in zip(self._keys(self.ids[codes], at)[0].tolist(), weight.tolist(), strict=True):
                rows.setdefault(key, np.zeros(self.n, np.float32))[k] += v / norm
        self.place = np.full(self.base**params.length, -1, np.int32)
        self.place[list(rows)] = np.arange(len(rows))
        self.weights = np.array(list(rows.values()), np.float32).reshape(len(rows), self.n)

    def _keys(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = np.zeros((len(ids), len(at)), np.int64)
        for k in range(self.params.length):
            key *= self.base
            key += ids[:, at[:, k]]
        return key

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normed kernel of each word with each landmark; a long word counts by its best piece."""
        out = np.zeros((len(words), self.n), np.float32)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for k, w in enumerate(words):
            for x in _pieces(w, self.params.piece):
                if len(x) >= 2:
                    by_length.setdefault(len(x), []).append((k, x))
        for size, rows in by_length.items():
            at, weight = _places(size + 2, self.params.length, self.params.decay, self.params.max_span)
            step = max(1, 400_000 // max(len(at), 1))
            for a in range(0, len(rows), step):
                codes = _codes([x for _, x in rows[a : a + step]])
                found = self.place[self._keys(self.ids[codes], at)]
                word, choice = np.nonzero(found >= 0)
                if not len(word):
                    continue
                some, starts = np.unique(word, return_index=True)
                value = self.weights[found[word, choice]] * weight[choice][:, None]
                got = np.add.reduceat(value, starts, axis=0) / _norms(codes[some], self.params)[:, None]
                np.maximum.at(out, [rows[a + k][0] for k in some.tolist()], got)
        return out


# --- sentences --------------------------------------------------------------


def tokens(text: str | None) -> list[str]:
    """Words in lower case, with their marks; line ends are full stops and spaced letters one word."""
    if not text:
        return []
    text = text.lower().replace("\n", " . ")
    return _SINGLES.sub(lambda m: re.sub(r"[\W_]", "", m[0]), text).split()


class Words:
    """Kernel rows of words met so far, bounded; one per worker and model."""

    def __init__(self, landmarks: list[str], params: ToxicityParams):
        self.landmarks, self.params = Landmarks(landmarks, params), params
        self.clear()

    def clear(self):
        self.ids: dict[str, int] = {}  # of words as written
        self.plain: dict[str, int] = {}  # of words without marks at their ends
        self.rows = np.zeros((0, self.landmarks.n), np.float32)
        self.row_of = np.zeros(0, np.int64)
        self.ends = np.zeros(0, bool)

    def learn(self, found: list[str]):
        distinct = set(found)
        new = [w for w in distinct if w not in self.ids]
        if len(self.ids) + len(new) > self.params.cached_words:
            self.clear()
            new = list(distinct)
        self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        plain = [_EDGE.sub("", w) for w in new]
        fresh = [w for w in set(plain) if w not in self.plain]
        self.plain.update(zip(fresh, range(len(self.plain), len(self.plain) + len(fresh)), strict=True))
        self.rows = np.concatenate([self.rows, self.landmarks.kernel(fresh)])
        self.row_of = np.concatenate([self.row_of, np.array([self.plain[w] for w in plain], np.int64)])
        self.ends = np.concatenate([self.ends, np.array([bool(_END.search(w)) for w in new], bool)])

    def sentences(self, texts: list[list[str]]):
        """Features of the sentences of all texts, and the text of each."""
        flat = [w for t in texts for w in t]
        self.learn(flat)
        get = self.ids.__getitem__
        ids = np.fromiter(map(get, flat), np.int64, len(flat))
        sizes = np.array([len(t) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        if not len(ids):
            return np.zeros((0, self.landmarks.n), np.float32), owner
        begin = np.ones(len(ids), bool)
        begin[1:] = self.ends[ids[:-1]] | (owner[1:] != owner[:-1])
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(begin, np.arange(len(ids)), 0))
        begin |= place % self.params.sentence_words == 0
        starts = np.flatnonzero(begin)
        out = []
        step = 4096  # sentences at a time
        for a in range(0, len(starts), step):
            lo = starts[a]
            hi = starts[a + step] if a + step < len(starts) else len(ids)
            out.append(np.maximum.reduceat(self.rows[self.row_of[ids[lo:hi]]], starts[a : a + step] - lo, axis=0))
        return np.concatenate(out), owner[starts]


# --- training ---------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> DataFrame:
    """text, toxic and the weight of a row: how many rows of its class it stands for."""
    marks = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(may_learn(F.col("labelled")))
    # Ids alone are joined, weighed and drawn; only the drawn rows' texts are read.
    short = F.length("text") <= params.max_chars
    keys = stage(
        docs.filter(short).select("doc_id", F.xxhash64("text").alias("tk"))
        .join(marks, F.col("doc_id") == F.col("labelled")).select("doc_id", "tk", "toxic"), "toxic-rows",
    )
    counts = stage(keys.groupBy("toxic").agg(F.count("*").alias("n")), "toxic-counts")
    share = F.xxhash64(F.col("doc_id"), F.lit(13)) / F.lit(2.0**64) + F.lit(0.5)
    ids = (
        keys.join(counts, "toxic").filter(share < F.lit(params.rows_per_class) / F.col("n"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(13)), "doc_id", "tk")
        .limit(2 * params.rows_per_class + params.rows_per_class // 4).distinct()
    )
    texts = docs.filter(short).select("doc_id", "text", F.xxhash64("text").alias("tk"))
    return texts.join(F.broadcast(ids), ["doc_id", "tk"]).select("doc_id", "tk", "text", "toxic", "n")


def _odds(texts: list[list[str]], y: np.ndarray) -> dict[str, float]:
    """Smoothed log odds of words to be in toxic documents."""
    bad, good = Counter(), Counter()
    for t, label in zip(texts, y, strict=True):
        (bad if label else good).update({_EDGE.sub("", w) for w in t})
    n_bad, n_good = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    return {
        w: float(np.log((n + 0.5) / (n_bad + 1)) - np.log((good[w] + 0.5) / (n_good + 1)))
        for w, n in bad.items() if n >= 3 and len(w) >= 3
    }


def _choose(odds: dict[str, float], texts: list[list[str]], params: ToxicityParams) -> list[str]:
    """Landmarks: telling words that are not alike, then words drawn from all training texts."""
    ranked = [w for w in sorted(odds, key=lambda w: (-odds[w], w)) if odds[w] > 0][:400]
    near = Landmarks(ranked, params).kernel(ranked) if ranked else np.zeros((0, 0))
    chosen: list[int] = []
    for k in range(len(ranked)):
        if len(chosen) >= params.landmarks * 3 // 4:
            break
        if not chosen or near[k, chosen].max() < 0.8:
            chosen.append(k)
    out = [ranked[k][: params.piece] for k in chosen]
    others = sorted({_EDGE.sub("", w)[: params.piece] for t in texts for w in t if len(w) > 4} - set(out))
    others = [w for w in others if len(w) >= params.length]
    rng = np.random.default_rng(3)
    extra = rng.permutation(len(others))[: params.landmarks - len(out)]
    return out + [others[k] for k in extra]


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton steps; y is -1 or 1, c the weight of a row."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x1.shape[1])
    keep = np.eye(x1.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x1 @ w) < 1
        a, ca = x1[active], c[active]
        new = np.linalg.solve(keep + (a * ca[:, None]).T @ a, (a * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _gather(f: np.ndarray, owner: np.ndarray, n: int, bias: float) -> np.ndarray:
    """What a document's sentences say together: the worst, all beyond the margin, how many."""
    worst = np.full(n, -np.inf)
    np.maximum.at(worst, owner, f)
    worst[np.isneginf(worst)] = bias
    beyond = np.bincount(owner, np.maximum(f + 1, 0), minlength=n)
    count = np.bincount(owner, minlength=n)
    return np.stack([worst, np.log1p(beyond), np.log1p(count), np.ones(n)], axis=1)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Logistic curve over what sentences say together, by damped Newton steps."""
    w, keep = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = _logistic(x @ w)
        grad = x.T @ (c * (p - y)) + keep @ w
        step = np.linalg.solve((x * (c * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + keep, grad)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return w


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn from the labelled rows outside the held-out fold."""
    got = training_rows(docs, labels, params).toArrow().sort_by([("doc_id", "ascending"), ("tk", "ascending")])
    y = np.array([int(v > 0) for v in got.column("toxic").to_pylist()])
    texts = [tokens(t) for t in got.column("text").to_pylist()]
    none = np.zeros(0)
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel((), none, 0.0, none, float(y.max()) if len(y) else 0.0, params)
    sampled = np.bincount(y, minlength=2)
    stands = np.array([n / sampled[k] for n, k in zip(got.column("n").to_pylist(), y, strict=True)])
    stands /= stands.mean()
    odds = _odds(texts, y)
    landmarks = _choose(odds, texts, params)
    words = Words(landmarks, params)
    x, owner = [], []
    for a in range(0, len(texts), 200):
        part, own = words.sentences(texts[a : a + 200])
        x.append(part)
        owner.append(own + a)
    x, owner = np.concatenate(x), np.concatenate(owner)
    values, vectors = np.linalg.eigh(words.landmarks.kernel(landmarks).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    mapped = x @ root
    worst = x[:, : max(1, params.landmarks * 3 // 4)].max(axis=1)  # first guess: most like a telling word
    for _ in range(params.turns):
        order = np.lexsort((-worst, owner))
        first = np.concatenate([[True], owner[order][1:] != owner[order][:-1]])
        witness = order[first & (y[owner[order]] == 1)]
        clean = np.flatnonzero(y[owner] == 0)
        rows = np.concatenate([witness, clean])
        target = np.concatenate([np.ones(len(witness)), -np.ones(len(clean))])
        c = np.where(target > 0, 1.0, max(len(witness), 1) / max(len(clean), 1) * 2)
        w, b = _svm(mapped[rows], target, c)
        worst = mapped @ w + b
    curve = _curve(_gather(worst, owner, len(y), b), y, stands)
    return ToxicityModel(tuple(landmarks), root @ w, b, curve, None, params)


# --- scoring ----------------------------------------------------------------


@lru_cache(2)
def _worker_words(landmarks: tuple[str, ...], params: ToxicityParams) -> Words:
    """Words met by this worker process, in all its tasks."""
    return Words(list(landmarks), params)


def score_texts(texts: list[str | None], model: ToxicityModel, words: Words) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x, owner = words.sentences([tokens(t) for t in texts])
    f = x @ model.weights + model.bias
    return _logistic(_gather(f, owner, len(texts), model.bias) @ model.curve)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        words = _worker_words(m.landmarks, m.params)
        for batch in batches:
            for start, texts in slices(batch.column(2), 2 << 20):
                s = score_texts(texts, m, words)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(start, len(texts)) for k in range(2)), pa.array(s),
                    pa.array((s >= m.params.threshold).astype(np.int32)),
                ], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")

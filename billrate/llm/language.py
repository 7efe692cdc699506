"""Language identification with averaged hashed subword embeddings.

A text is lower-cased, everything but letters becomes a blank, and each run of one
to four characters is hashed to a bucket with an embedding.  The mean embedding goes
through a linear softmax.  Embeddings and softmax are learned by stochastic gradient
descent in numpy on a bounded sample of labelled rows, with as many rows of each
language; a fifth of the sample is kept back to fit the temperature of the scores and
the score under which a prediction is rejected.  As embedding and softmax are both
linear, they fold into one table of buckets by languages, which is all that a task
needs to predict whole texts.

Null texts, empty texts and texts without a letter are ``und`` with score 0 and are
rejected.  Without any labelled row everything is ``und``, and only texts without a
letter are rejected.  Repeated rows are predicted alike; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billrate.llm.common import arrow_map, may_learn, ship
from billrate.session import stage

LETTER = r"\p{L}"
UND = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class LanguageParams:
    """``rows_per_lang`` and ``max_rows`` bound the sample, ``max_grams`` its row size."""

    rows_per_lang: int = 400
    max_rows: int = 2000
    max_grams: int = 4096
    bits: int = 16
    order: int = 4
    dim: int = 16
    epochs: int = 15
    rate: float = 0.3
    false_reject: float = 0.002
    reject_below: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    table: np.ndarray  # buckets x languages, softmax already applied to the embeddings
    bias: np.ndarray
    temperature: float
    threshold: float
    params: LanguageParams


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of other characters than letters are one blank."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = letter[:1]
    return np.where(letter, raw, 32)[keep]


def _buckets(codes: np.ndarray, params: LanguageParams) -> Iterator[np.ndarray]:
    """Bucket of the gram that starts at each place, for each length; zeros follow the text."""
    h = np.zeros(len(codes), np.uint64)
    for n in range(params.order):
        h *= _STEP
        h[: len(codes) - n] += codes[n:]
        h += np.uint64(n + 1)
        yield ((h * _MIX) >> np.uint64(64 - params.bits)).astype(np.int32)


def _gram_counts(text: str, params: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    codes = _codes(text).astype(np.uint64)
    ids, counts = np.unique(np.concatenate(list(_buckets(codes, params))), return_counts=True)
    if len(ids) > params.max_grams:
        pick = np.random.default_rng(len(codes)).choice(len(ids), params.max_grams, replace=False)
        ids, counts = ids[pick], counts[pick]
    return ids, counts


def training_rows(docs: DataFrame, params: LanguageParams) -> DataFrame:
    """The bounded sample: rows of each language by the hash of their id, rarest languages whole.

    If more than ``max_rows`` are drawn, languages give rows in turn until the bound is met, so
    the largest draws are cut and no language before another has as many rows.
    """
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & may_learn(F.col("doc_id"))
    )
    share = F.xxhash64(F.col("doc_id"), F.lit(params.seed)) / F.lit(2.0**64) + F.lit(0.5)
    # Ids alone are weighed and drawn; the rates are written, so their size decides the join.
    keys = rows.select("doc_id", F.xxhash64("text").alias("tk"), "lang")
    counts = stage(keys.groupBy("lang").agg(F.count("*").alias("n")), "lang-counts")
    drawn = (
        keys.join(counts, "lang").filter(share < F.lit(params.rows_per_lang) / F.col("n"))
        .select("doc_id", "tk", "lang").distinct()
    )
    order = [F.xxhash64(F.col("doc_id"), F.lit(params.seed)), "doc_id", "tk"]
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(*order))  # some rows_per_lang a language
    ids = drawn.withColumn("turn", turn).orderBy("turn", *order, "lang").limit(params.max_rows).drop("turn")
    return (
        rows.withColumn("tk", F.xxhash64("text"))
        .join(F.broadcast(ids), ["doc_id", "tk", "lang"], "left_semi")  # max_rows at most
        .select("doc_id", "tk", "lang", "text")
    )


def _collect_sample(docs: DataFrame, params: LanguageParams) -> list[tuple]:
    def grams(batches):
        for batch in batches:
            out = {"doc_id": [], "tk": [], "lang": [], "ids": [], "counts": []}
            for doc_id, tk, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, counts = _gram_counts(text, params)
                for key, value in zip(out, (doc_id, tk, lang, ids, counts), strict=True):
                    out[key].append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(out["doc_id"], pa.int64()), pa.array(out["tk"], pa.int64()),
                pa.array(out["lang"], pa.string()), pa.array(out["ids"], pa.list_(pa.int32())),
                pa.array(out["counts"], pa.list_(pa.int32())),
            ], names=list(out))

    sample = training_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), params)
    got = arrow_map(sample, grams, "doc_id long, tk long, lang string, ids array<int>, counts array<int>").toArrow()
    rows = {}
    for doc_id, tk, lang, ids, counts in zip(
        *(got.column(c).to_pylist() for c in ("doc_id", "tk", "lang")),
        *(([x.values.to_numpy() for x in got.column(c)]) for c in ("ids", "counts")), strict=True,
    ):
        if len(ids):
            rows[(doc_id, tk, lang)] = (lang, ids, counts)
    return [rows[k] for k in sorted(rows)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _descend(rows, langs, params: LanguageParams):
    """Stochastic gradient descent, one document a step; returns the folded table and the bias."""
    rng = np.random.default_rng(params.seed)
    emb = rng.uniform(-1 / params.dim, 1 / params.dim, (1 << params.bits, params.dim))
    out, bias = np.zeros((len(langs), params.dim)), np.zeros(len(langs))
    steps, done = params.epochs * max(len(rows), 1), 0
    for _ in range(params.epochs):
        for k in rng.permutation(len(rows)):
            lang, ids, counts = rows[k]
            rate = params.rate * (1 - done / steps)
            done += 1
            mean = (counts / counts.sum()) @ emb[ids]
            grad = _softmax(out @ mean + bias)
            grad[langs.index(lang)] -= 1
            back = grad @ out
            out -= rate * np.outer(grad, mean)
            bias -= 0.01 * rate * grad
            emb[ids] -= rate * back
    return (emb @ out.T).astype(np.float32), bias


def _calibrate(rows, langs, folded, bias, params: LanguageParams) -> tuple[float, float]:
    """Temperature of least log loss, and the score under which few right predictions fall."""
    if not rows:
        return 1.0, params.reject_below
    z = np.array([(c / c.sum()) @ folded[i] + bias for _, i, c in rows])
    y = np.array([langs.index(lang) for lang, _, _ in rows])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = _softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    low = np.quantile(right, params.false_reject) if len(right) else 0.0
    return float(temperature), float(min(low, params.reject_below))


def train(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from text and lang of the rows outside the held-out fold."""
    rows = _collect_sample(docs, params)
    langs = tuple(sorted({lang for lang, _, _ in rows}))
    kept = [r for k, r in enumerate(rows) if k % 5 == 4] if len(rows) >= 50 else []
    learn = [r for k, r in enumerate(rows) if k % 5 != 4] if kept else rows
    folded, bias = _descend(learn, langs, params)
    temperature, threshold = _calibrate(kept or rows, langs, folded, bias, params)
    return LanguageModel(langs, folded, bias, temperature, threshold, params)


def _scores(texts: pd.Series, model: LanguageModel) -> np.ndarray:
    """Calibrated probabilities of each text, a row of zeros for texts without a letter."""
    out = np.zeros((len(texts), len(model.langs)))
    block = max(1 << 14, (1 << 20) // len(model.langs))
    pad = np.zeros(model.params.order, np.uint32)
    for first, run in _runs(texts, block):
        codes, owner, totals = [], [], {}
        for k, text in run:
            c = _codes(text)
            if len(c):
                codes += [c, pad]
                owner.append((k, len(c)))
        if not owner:
            continue
        codes = np.concatenate(codes).astype(np.uint64)
        starts = np.cumsum([0] + [n + len(pad) for _, n in owner])
        for a in range(0, len(codes), block):
            b = min(a + block, len(codes))
            sums = np.zeros((b - a, len(model.langs)), np.float32)
            for ids in _buckets(codes[a : b + len(pad)], model.params):
                sums += model.table[ids[: b - a]]
            for j in range(np.searchsorted(starts, a, "right") - 1, len(owner)):
                lo, hi = max(starts[j], a), min(starts[j] + owner[j][1], b)
                if starts[j] >= b:
                    break
                if hi > lo:
                    part = sums[lo - a : hi - a].sum(axis=0, dtype=np.float64)
                    totals[j] = totals.get(j, 0) + part
        for j, (k, n) in enumerate(owner):
            z = totals[j] / (n * model.params.order) + model.bias
            out[k] = _softmax(z / model.temperature)
    return out


def _runs(texts: pd.Series, limit: int) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    run, size = [], 0
    for k, text in enumerate(texts):
        if run and size + len(text) > limit:
            yield run[0][0], run
            run, size = [], 0
        run.append((k, text))
        size += len(text)
    if run:
        yield run[0][0], run


def classify(docs: DataFrame, model: LanguageModel, text: str = "text", name: str = "lang_id") -> DataFrame:
    """``docs`` with a struct column ``name``: lang_pred, score and rejected."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            p = _scores(texts, m)
            score = p.max(axis=1)
            lettered = score > 0
            names = np.array(m.langs, object)[p.argmax(axis=1)]
            yield pd.DataFrame({
                "lang_pred": np.where(lettered, names, UND), "score": score,
                "rejected": score < m.threshold,
            })

    lettered = F.coalesce(F.col(text).rlike(LETTER), F.lit(False))
    known = F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score")
    if not model.langs:
        return docs.withColumn(name, F.struct(*known, (~lettered).alias("rejected")))
    got = predict(F.when(lettered, F.col(text)).otherwise(""))
    return docs.withColumn(name, got)

"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-cased words, each with a 64-bit hash.  A seed is a fixed mask over a few
places; its hash sums the words under the ones and ignores the rest, so a substituted word
under a zero does not break it.  The masks are complete: however the substitutions that
``agree`` allows fall in a window, one mask keeps all its ones on equal words somewhere in it.  The benchmark's seed hashes set bits
of a filter of fixed size, which is sent to the executors; documents emit a seed only if the
filter knows it, and those few seeds are joined with the benchmark's by hash.  Each pair of
document, item and offset is then laid side by side: an overlap is a stretch of
``window`` words (of the whole item, if it is shorter) of which ``agree`` or more are equal
place by place.  Items under ``long`` words have masks of their own; items under ``least``
words are no evidence and match nothing.

Null and empty texts hold no overlap.  Repeated rows of documents get the same verdict, repeated
items count once; an empty benchmark clears everything.  Extra columns are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billrate.llm.common import arrow_map, doc_key, slices
from billrate.session import shuffled_if_large, stage

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_STEP = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class SeedParams:
    """Masks of items of ``long`` words or more, and of shorter ones.

    Complete for windows of 15 to 20 and of 8 to 14 words at ``agree`` 0.8, as a test enumerates.
    """

    masks: tuple[str, ...] = ("1111011", "110010111", "11000010111")
    short_masks: tuple[str, ...] = ("111011", "11001011", "11111")
    window: int = 20
    agree: float = 0.8
    least: int = 8
    long: int = 15
    filter_bits: int = 26
    probes: int = 3


def word_hashes(text: bytes | None) -> np.ndarray:
    words = _WORD.findall(text.decode("utf-8", "replace").lower().encode()) if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words))


def _factor(place: int, mask: int) -> np.uint64:
    return np.uint64(((place * 2 + 1) * _STEP ^ (mask * 0xD1B54A32D192ED03)) % (1 << 64) | 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def seeds(words: np.ndarray, params: SeedParams, short: bool = False):
    """``(hashes, places)`` of each mask that fits; ``short``: the masks of short items."""
    for m, mask in enumerate(params.short_masks if short else params.masks):
        n = len(words) - len(mask) + 1
        if n > 0:
            h = np.zeros(n, np.uint64)
            for k, on in enumerate(mask):
                if on == "1":
                    h += words[k : k + n] * _factor(k, m + 1 + 1000 * short)
            yield _mix(h), np.arange(n, dtype=np.int32)


def benchmark_seeds(items: DataFrame, params: SeedParams) -> DataFrame:
    """One row per seed of each item: h, item_id, q (place), short (of an item under ``long`` words)."""
    def run(batches):
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = word_hashes(text)
                if len(words) < params.least:
                    continue
                short = len(words) < params.long
                h, q = (np.concatenate(x) for x in zip(*seeds(words, params, short), strict=True))
                n = len(h)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h.view(np.int64)), pa.array([item] * n, pa.int64()), pa.array(q),
                    pa.array([short] * n, pa.bool_()),
                ], names=["h", "item_id", "q", "short"])

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).distinct()
    return arrow_map(rows, run, "h long, item_id long, q int, short boolean").distinct()


def _bits(h: np.ndarray, params: SeedParams):
    """The filter bits of a hash."""
    for k in range(params.probes):
        yield (_mix(h + np.uint64(k * _STEP % (1 << 64))) >> np.uint64(64 - params.filter_bits)).astype(np.int64)


def seed_filter(found: DataFrame, params: SeedParams) -> np.ndarray:
    """Bits of all benchmark seeds, ``2 ** filter_bits`` whatever the benchmark's size."""
    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate(list(_bits(h, params)))) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["w", "b"]
            )

    words = arrow_map(found.select("h"), run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (params.filter_bits - 6), np.uint64)
    at = words.column("w").to_numpy()
    bits[at] = words.column("b").to_numpy().view(np.uint64)
    return bits


def _known(h: np.ndarray, bits: np.ndarray, params: SeedParams) -> np.ndarray:
    """Places of the hashes that the filter knows."""
    at = np.arange(len(h))
    for bit in _bits(h, params):
        bit = bit[at]
        at = at[(bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1]
        if not len(at):
            break
    return at


def document_hits(docs: DataFrame, found: DataFrame, params: SeedParams) -> DataFrame:
    """One row per document with seeds the filter knows: dk, tk, its word hashes and the seeds."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(seed_filter(found, params))
    kinds = [r[0] for r in found.select("short").distinct().collect()]  # masks that any item needs

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                out = {"row": [], "words": [], "h": [], "p": []}
                for k, text in enumerate(texts):
                    words = word_hashes(text)
                    hits = []
                    for h, p in (x for short in kinds for x in seeds(words, params, short)):
                        at = _known(h, bits.value, params)
                        if len(at):
                            hits.append((h[at].view(np.int64), p[at]))
                    if hits:
                        h, p = (np.concatenate(x) for x in zip(*hits, strict=True))
                        for key, value in zip(out, (start + k, words.view(np.int64), h, p), strict=True):
                            out[key].append(value)
                if out["row"]:
                    ids = [batch.column(c).take(pa.array(out["row"])) for c in range(2)]
                    yield pa.RecordBatch.from_arrays([
                        *ids, pa.array(out["words"], pa.list_(pa.int64())), pa.array(out["h"], pa.list_(pa.int64())),
                        pa.array(out["p"], pa.list_(pa.int32())),
                    ], names=["dk", "tk", "words", "h", "p"])

    keyed = docs.select(*doc_key(), F.col("text").cast("binary"))
    return arrow_map(keyed, run, "dk long, tk long, words array<long>, h array<long>, p array<int>")


def _best(doc: np.ndarray, item: np.ndarray, offset: int, params: SeedParams) -> tuple[int, int, int]:
    """Most equal places in a window on the diagonal, the window and where it begins in the document."""
    width = min(params.window, len(item))
    lo, hi = max(offset, 0), min(offset + len(item), len(doc))
    if hi - lo < width:
        return 0, width, lo
    same = np.concatenate([[0], np.cumsum(doc[lo:hi] == item[lo - offset : hi - offset])])
    sums = same[width:] - same[:-width]
    at = int(sums.argmax())
    return int(sums[at]), width, lo + at


def overlaps(docs: DataFrame, items: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """Verified overlaps, the best one of each document and item: dk, tk, item_id, equal, width, place."""
    found = stage(benchmark_seeds(items, params), "bench-seeds")
    hits = stage(document_hits(docs, found, params).dropDuplicates(["dk", "tk"]), "seed-hits")
    seen = hits.select("dk", "tk", F.explode(F.arrays_zip("h", "p")).alias("s"))
    diagonals = stage(
        seen.select("dk", "tk", F.col("s.h").alias("h"), F.col("s.p").alias("p")).join(found, "h")
        .select("dk", "tk", "item_id", (F.col("p") - F.col("q")).alias("shift")).distinct(), "seed-pairs",
    )

    def hash_items(batches):
        for batch in batches:
            words = [word_hashes(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "item"]
            )

    texts = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).distinct()
    worded = stage(arrow_map(texts, hash_items, "item_id long, item array<long>"), "bench-words")

    def verify(batches):
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            kept, best = [], []
            for k, shift in enumerate(cols["shift"].to_pylist()):
                doc, item = (cols[c][k].values.to_numpy(zero_copy_only=False) for c in ("words", "item"))
                got = _best(doc, item, shift, params)
                if got[0] >= params.agree * got[1]:
                    kept.append(k)
                    best.append(got)
            pick = pa.array(kept, pa.int64())
            equal, width, place = zip(*best, strict=True) if best else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(cols[c].take(pick) for c in ("dk", "tk", "item_id")), *(pa.array(x, pa.int32()) for x in (equal, width, place))],
                names=["dk", "tk", "item_id", "equal", "width", "place"],
            )

    laid = (
        shuffled_if_large(diagonals).join(hits.select("dk", "tk", "words"), ["dk", "tk"])
        .join(worded, "item_id").select("dk", "tk", "item_id", "shift", "words", "item")
    )
    proved = arrow_map(laid, verify, "dk long, tk long, item_id long, equal int, width int, place int")
    best = F.max(F.struct("equal", "width", (-F.col("place")).alias("back"))).alias("b")
    return proved.groupBy("dk", "tk", "item_id").agg(best).select(
        "dk", "tk", "item_id", "b.equal", "b.width", (-F.col("b.back")).alias("place")
    )


def flagged(docs: DataFrame, items: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """One row per document with an overlap: dk, tk, n_items, most (equal words) and the least item of those."""
    best = F.min(F.struct((-F.col("equal")).alias("e"), "item_id")).alias("b")
    return overlaps(docs, items, params).groupBy("dk", "tk").agg(F.count("*").alias("n_items"), best).select(
        "dk", "tk", "n_items", (-F.col("b.e")).alias("most"), F.col("b.item_id").alias("item_id")
    )


def mark(docs: DataFrame, items: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """``docs`` with a struct column ``leak``: contaminated, n_items, most, item_id."""
    dk, tk = doc_key()
    keyed = docs.select(*[c for c in docs.columns if c.lower() != "leak"], dk.alias("_dc_dk"), tk.alias("_dc_tk"))
    seen = shuffled_if_large(stage(flagged(docs, items, params), "leaks"))
    named = seen.select(F.col("dk").alias("_dc_dk"), F.col("tk").alias("_dc_tk"),
                        F.struct("n_items", "most", "item_id").alias("_dc"))
    leak = F.struct(
        F.col("_dc").isNotNull().alias("contaminated"), F.coalesce("_dc.n_items", F.lit(0)).alias("n_items"),
        F.coalesce("_dc.most", F.lit(0)).alias("most"), F.col("_dc.item_id").alias("item_id"),
    )
    return keyed.join(named, ["_dc_dk", "_dc_tk"], "left").withColumn("leak", leak).drop("_dc", "_dc_dk", "_dc_tk")


def clear(docs: DataFrame, items: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """``docs`` without the documents that hold an overlap."""
    dk, tk = doc_key()
    seen = shuffled_if_large(stage(flagged(docs, items, params), "leaks")).select(F.col("dk").alias("_dc_dk"), F.col("tk").alias("_dc_tk"))
    keyed = docs.select("*", dk.alias("_dc_dk"), tk.alias("_dc_tk"))
    return keyed.join(seen, ["_dc_dk", "_dc_tk"], "left_anti").select(*docs.columns)

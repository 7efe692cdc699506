"""SimHash near-duplicates, found by anchor-point covering.

The 64-bit fingerprint of a document sums the bits of the XXH64 of its word shingles.
The first 46 bits are two blocks of 23, each covered by the perfect binary Golay code:
every 23-bit word is within 3 bits of just one of its 4,096 code words, so pairs of code
words are 2^24 anchors with covering radius 3 in either block.  Each fingerprint lives at
its nearest anchor and is copied to every anchor within the radius plus the threshold;
if two fingerprints differ in ``t`` bits or fewer, the copies of each reach the home of
the other, whatever the remaining 18 bits are.  Fingerprints are compared at the anchor,
home against copies, and only pairs within the threshold come out of that join.  Exact
copies share one fingerprint and are never paired.  Links are closed to components by
star rounds.

Null, empty and blank texts have fingerprint zero and link like any other; a null id takes
part and never becomes a component's name unless all ids are null.  Repeated rows share a
fingerprint.  Extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billrate.llm.common import NO_ID, arrow_map, doc_key, slices
from billrate.llm.components import components
from billrate.session import shuffled, shuffled_if_large, stage

THRESHOLD = 2
SHINGLE = 3
SEED = 42
# The generator polynomial of the (23, 12) Golay code, radius 3.
GENERATOR, LENGTH, RADIUS = 0b101011100011, 23, 3
BLOCKS = 2


# --- fingerprints -----------------------------------------------------------


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text given as UTF-8."""
    words = text.lower().split() if text else []  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 15):
        part = words[a : min(a + (1 << 15), n) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [part]
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n)
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tk (a hash of the text) and fp, the signed 64-bit fingerprint, of every row."""
    def run(batches):
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                fps = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
                ids = [batch.column(k).slice(start, len(texts)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, fps], names=["doc_id", "tk", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("binary"))
    return arrow_map(keyed, run, "doc_id long, tk long, fp long")


# --- anchors ----------------------------------------------------------------


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of the word as a polynomial over the generator; zero for code words."""
    x = x.copy()
    for bit in range(LENGTH - 1, LENGTH - 13, -1):
        x ^= np.where((x >> bit) & 1, GENERATOR << (bit - 11), 0)
    return x


@lru_cache(4)
def _errors(extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error words of weight up to radius plus ``extra``, by syndrome: words, weights over
    the radius, and where each syndrome's run begins."""
    words = np.arange(1 << LENGTH, dtype=np.int64)
    weight = np.bitwise_count(words)
    words = words[weight <= RADIUS + extra]
    weight = np.bitwise_count(words).astype(np.int64)
    syndrome = _syndrome(words)
    order = np.lexsort((words, weight, syndrome))
    starts = np.searchsorted(syndrome[order], np.arange((1 << 11) + 1))
    return words[order], np.maximum(weight[order] - RADIUS, 0), starts


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Row number and anchor, for all anchors of each fingerprint within radius plus ``threshold``.

    With threshold 0 that is the nearest anchor alone.  A pair's differing bits fall on the
    blocks together, so what one block takes over the radius the other cannot.
    """
    u = fps.view(np.uint64)
    words, over, starts = _errors(threshold)
    row = np.arange(len(u))
    anchor, spent = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
    for b in range(BLOCKS):
        block = ((u >> np.uint64(64 - LENGTH * (b + 1))) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
        s = _syndrome(block)
        first, n = starts[s][row], (starts[s + 1] - starts[s])[row]
        pick = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, anchor, spent = (np.repeat(x, n) for x in (row, anchor, spent))
        spent = spent + over[pick]
        keep = spent <= threshold
        # The code is systematic, so the upper 12 bits name a code word.
        code = (block[row] ^ words[pick]) >> 11
        row, anchor, spent = row[keep], ((anchor << 12) | code)[keep], spent[keep]
    return row, anchor


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``(u, v)``, u > v, of distinct fingerprints within ``threshold`` bits.

    Each such pair comes out once: the home of u meets the copy of v.
    """
    def cover(reach):
        def run(batches):
            for batch in batches:
                fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for a in range(0, len(fps), 2048):
                    row, anchor = anchors(fps[a : a + 2048], reach)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fps[a : a + 2048][row]), pa.array(anchor.astype(np.int32))], names=["fp", "anchor"]
                    )
        return arrow_map(distinct.select("fp"), run, "fp long, anchor int")

    homes, copies = cover(0).withColumnRenamed("fp", "u"), cover(threshold).withColumnRenamed("fp", "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold
    # Some 60 copies a fingerprint, which their estimate does not know.
    return homes.join(shuffled(copies), "anchor").filter((F.col("u") > F.col("v")) & near).select("u", "v")


def groups(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, tk, fp, root (the group) and component_id, its least id."""
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    roots = stage(components(links(nodes, threshold)), "fp-roots")
    rooted = stage(
        nodes.join(shuffled_if_large(roots), nodes.fp == roots.node, "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "fp-rooted",
    )
    names = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "fp-names")
    named = stage(rooted.join(shuffled_if_large(names), "root").select("fp", "root", "component_id"), "fp-named")
    return marked.join(shuffled_if_large(named), "fp").select("doc_id", "tk", "fp", "root", "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group: the one of the least id.

    Of several rows with that id, and in a group without ids, the least fingerprint and text
    hash decides; rows equal in id and text stay once.
    """
    found = groups(docs, threshold, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "fp", "tk")
    best = found.groupBy("root").agg(F.min(order).alias("b"))
    winners = stage(
        best.select(F.coalesce("b.doc_id", F.lit(NO_ID)).alias("_sh_dk"), F.col("b.tk").alias("_sh_tk")), "kept"
    )
    dk, tk = doc_key()
    keyed = docs.select("*", dk.alias("_sh_dk"), tk.alias("_sh_tk"))
    keys = ["_sh_dk", "_sh_tk"]
    return keyed.join(shuffled_if_large(winners), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)

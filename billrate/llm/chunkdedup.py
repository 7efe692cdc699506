"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where its upper bits are zero, so
bounds depend on the sixteen bytes before them and find themselves again after an
insertion.  Chunks are known by a 96-bit digest.  A chunk is a later copy if the digest
occurs in a document of a lower id, or earlier in its own document.  Runs of adjacent
later copies of ``min_run`` bytes or more are cut out of the text; shorter ones stay, as
stock phrases are no copied passages.

Null and empty texts have no chunks and stay.  Rows of one id are one document; rows
without id are ordered by their texts' hash, before all others.  Rows equal in id and text
are cut alike.  Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from billrate.llm.common import arrow_map, ship, slices
from billrate.session import stage

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 11) & 0xFFFF for b in range(256)], np.uint16)


@dataclass(frozen=True)
class ChunkParams:
    min_size: int = 24
    bits: int = 5
    max_size: int = 256
    min_run: int = 96


def bounds(raw: bytes, params: ChunkParams = ChunkParams()) -> np.ndarray:
    """Ends of the chunks of ``raw``; the last is its length.  No character is split."""
    data = np.frombuffer(raw, np.uint8)
    h = GEAR[data]
    for k in (1, 2, 4, 8):  # doubles the window: sixteen bytes fill a 16-bit hash
        if len(h) > k:
            h[k:] += h[:-k] << np.uint16(k)
    whole = np.ones(len(data), bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    cuts = (np.flatnonzero((h >> np.uint16(16 - params.bits) == 0) & whole) + 1).tolist()
    ends, last = [], 0
    for c in [*cuts, len(raw)]:
        if c - last > params.max_size:  # far from any bound: even pieces
            while c - last > params.max_size:
                last += params.max_size
                while not whole[last - 1]:
                    last += 1
                ends.append(last)
        if c - last >= params.min_size or c == len(raw):
            if c > last:
                ends.append(c)
            last = c
    return np.array(ends, np.int64)


def _doc_order():
    """Place of a document: its id; without one, a number below all ids from the text's hash."""
    text_place = F.lit(-(2**62)) - F.pmod(F.xxhash64("text"), F.lit(2**61))
    return F.coalesce(F.col("doc_id").cast("long"), text_place).alias("dk")


def chunks(docs: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """One row per chunk: dk, tk, start, stop (bytes), digest (a, b), again (seen before in its document)."""
    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column(2)):
                rows, start, stop, a, b, again = [], [], [], [], [], []
                for k, raw in enumerate(texts):
                    if not raw:
                        continue
                    ends = bounds(raw, params).tolist()
                    seen, last = set(), 0
                    for end in ends:
                        digest = xxhash.xxh3_128_digest(raw[last:end])
                        start.append(last)
                        a.append(digest[:8])
                        b.append(digest[8:12])
                        again.append(digest in seen)
                        seen.add(digest)
                        last = end
                    stop += ends
                    rows += [first + k] * len(ends)
                pick = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pick), batch.column(1).take(pick), pa.array(start, pa.int32()),
                    pa.array(stop, pa.int32()), pa.array(np.frombuffer(b"".join(a), np.int64)),
                    pa.array(np.frombuffer(b"".join(b), np.int32)), pa.array(again, pa.bool_()),
                ], names=["dk", "tk", "start", "stop", "a", "b", "again"])

    keyed = docs.select(_doc_order(), F.xxhash64("text").alias("tk"), F.col("text").cast("binary"))
    return arrow_map(keyed, run, "dk long, tk long, start int, stop int, a long, b int, again boolean")


def copied_runs(docs: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Runs to cut: dk, tk, start, stop, the union of adjacent later copies of ``min_run`` bytes or more."""
    found = stage(chunks(docs, params), "chunks")
    shared = stage(
        found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("dk").alias("first")).filter("n > 1").drop("n"),
        "chunks-shared",
    )
    later = (
        found.join(shared, ["a", "b"]).filter(F.col("again") | (F.col("dk") > F.col("first")))
        .select("dk", "tk", "start", "stop").distinct()
    )
    doc = Window.partitionBy("dk", "tk").orderBy("start")
    fresh = F.coalesce(F.lag("stop").over(doc) != F.col("start"), F.lit(True)).cast("int")
    return (
        later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(doc))
        .groupBy("dk", "tk", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .filter(F.col("stop") - F.col("start") >= params.min_run).drop("run")
    )


@F.pandas_udf(StringType())
def _without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, runs in batches:
        out = []
        for text, cut in zip(texts, runs, strict=True):
            if text is None or cut is None:
                out.append(None)
                continue
            raw, parts, last = text.encode(), [], 0
            for r in cut:
                parts.append(raw[last : r["start"]])
                last = r["stop"]
            out.append(b"".join([*parts, raw[last:]]).decode())
        yield pd.Series(out, dtype=object)


def cut_copies(docs: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """``docs`` with copied runs cut from ``text`` and a struct column ``chunk_cut``: n_runs, n_bytes."""
    runs = stage(
        copied_runs(docs, params).groupBy("dk", "tk").agg(
            F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"),
            F.sum(F.col("stop") - F.col("start")).alias("n_bytes"),
        ), "chunk-runs",
    ).select(F.col("dk").alias("_cd_dk"), F.col("tk").alias("_cd_tk"), F.col("runs").alias("_cd_runs"),
             F.col("n_bytes").alias("_cd_bytes")).hint("merge")  # grows with the documents: the same join at every size
    names = [c for c in docs.columns if c.lower() != "chunk_cut"]
    joined = docs.select(*names, _doc_order().alias("_cd_dk"), F.xxhash64("text").alias("_cd_tk")).join(
        runs, ["_cd_dk", "_cd_tk"], "left"
    )
    ship(docs.sparkSession)
    cut = _without(F.when(F.col("_cd_runs").isNotNull(), F.col("text")), F.col("_cd_runs"))
    text = F.when(F.col("_cd_runs").isNull(), F.col("text")).otherwise(cut).alias("text")
    info = F.struct(
        F.coalesce(F.size("_cd_runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce("_cd_bytes", F.lit(0)).cast("long").alias("n_bytes"),
    ).alias("chunk_cut")
    return joined.select(*[text if c == "text" else F.col(c) for c in names], info)

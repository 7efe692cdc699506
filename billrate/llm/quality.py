"""Quality rules: base rules on one document, and line frequency across documents.

Lines are normalised (lower case, digits as one zero, white space as one blank) and
hashed; for every host the documents that hold a line are counted, each once.  A line
in more documents of its host than ``max(least, share * documents of the host)`` is
removed.  A document that loses more than ``depleted`` of its words is rejected, as are
those that fail the base rules.

The host of a document is its source.  Null texts have no words, so they fail the base
rules; a null source is a host of its own.  Repeated rows are documents of their own.  Extra
columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billrate.llm.common import arrow_map, slices
from billrate.session import stage

SYMBOLS = b"#*$%&|<>"
_DIGITS = re.compile(rb"[0-9]+")
_SPACE = bytes(range(9, 14)) + b" "
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class QualityParams:
    least: int = 20
    share: float = 0.01
    depleted: float = 0.7
    min_words: int = 50
    repeat_share: int = 50


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = (w[:-2] * _A + w[1:-1]) * _B + w[2:]
    _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
    # Each window's first place spreads over its three words.
    first = np.concatenate([counts[back] > 1, [False, False]])
    covered = first.copy()
    covered[1:] |= first[:-1]
    covered[2:] |= first[:-2]
    return int(covered.sum())


def measures(text: bytes | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and for each distinct
    normalised line its hash and how many words it has in all."""
    if not text:
        return 0, 0, 0, 0, 0, [], []
    words = text.split()
    solid = text.translate(None, _SPACE)
    chars = len(solid.decode("utf-8", "replace"))
    symbols = sum(solid.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))
    seen, lines, dup = set(), {}, 0
    for line in text.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        dup += line in seen
        seen.add(line)
        plain = _DIGITS.sub(b"0", b" ".join(parts).decode("utf-8", "replace").lower().encode())
        h = xxhash.xxh64_intdigest(plain)
        h -= (h >> 63) << 64
        lines[h] = lines.get(h, 0) + len(parts)
    return len(words), chars, symbols, dup, _repeat_words(words), list(lines), list(lines.values())


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, the measures, and the lines (hash, words) of every row."""
    def run(batches):
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                cols = list(zip(*map(measures, texts), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(start, len(texts)) for k in range(2)),
                     *(pa.array(c, pa.int64()) for c in cols[:5]),
                     pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.list_(pa.int64()))],
                    names=["doc_id", "host", *_FIELDS, "lines", "line_words"],
                )

    fields = ", ".join(f"{f} long" for f in _FIELDS)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("binary"))
    return arrow_map(rows, run, f"doc_id long, host string, {fields}, lines array<long>, line_words array<long>"
    )


def assess(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, n_removed (words), kept."""
    # The written table fixes the row numbers.
    rows = stage(measured(docs).withColumn("row", F.monotonically_increasing_id()), "quality-rows")
    hosts = stage(rows.groupBy("host").agg(F.count("*").alias("n_docs")), "quality-hosts").select(
        F.col("host").alias("named"), "n_docs"
    )
    lines = rows.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", "host", F.col("l.lines").alias("h"), F.col("l.line_words").alias("words")
    )
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > params.least)
    common = stage(
        counts.join(hosts, F.col("host").eqNullSafe(F.col("named")))
        .filter(F.col("n") > F.greatest(F.lit(float(params.least)), F.lit(params.share) * F.col("n_docs")))
        .select(F.col("host").alias("named"), F.col("h").alias("line")), "quality-lines",
    )
    removed = stage(
        lines.join(common, (F.col("h") == F.col("line")) & F.col("host").eqNullSafe(F.col("named")))
        .groupBy("row").agg(F.sum("words").alias("n_removed")), "quality-removed",
    )
    failed = (F.col("n_words") < params.min_words) | (
        100 * F.col("n_repeat_words") > params.repeat_share * F.col("n_words")
    )
    return (
        rows.drop("lines", "line_words").join(removed, "row", "left")
        .withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_removed") <= params.depleted * F.col("n_words")))
        .drop("row", "host")
    )

"""Repeated line runs, by a suffix array over line-ID sequences, in native expressions.

Every document is the sequence of its non-blank lines, each named by a 128-bit hash.
Suffixes that begin with a line found nowhere else are settled at once.  The others are
ranked by distributed prefix doubling: the rank of a suffix over 2k lines is the place of
the pair (rank over k lines here, rank over k lines k lines on) in a range-sorted list of
the distinct pairs.  Only pairs that occur twice or more stay, as all others are settled;
"end of document" ranks before every line, so suffixes that are equal to their end stay
equal.  The suffixes of one rank over h lines are an interval of the suffix array whose
longest common prefix is h or more, and each interval knows its first suffix in the order
of documents.  A suffix that is not the first of its interval begins a later copy of h
lines; all later copies of one document, joined where they overlap, are its maximal
repeated runs, and they are deleted.

``min_lines`` is the shortest run, a power of two, as intervals are known at such depths;
a longer run of any length is covered by overlapping copies of that depth.  A line of more
than fifty words is a passage by itself and counts as a run, whatever stands around it.

Null and blank texts have no lines and stay as they are.  Rows equal in id and text are one
document and are cut alike; a null id comes first in the order.  A document of which
nothing is left has an empty text.  Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billrate.llm.common import doc_key
from billrate.session import shuffled_if_large, stage

MIN_LINES = 2
LONG = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){50}[^\x20\x09-\x0D]"
END = -1
POS = ["dk", "tk", "i"]


def line_sequences(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: document key, i (place among them), n (their number),
    o (place among all lines), the line's name (a, b) and whether it is ``long``."""
    line = F.transform(
        F.split("text", "\n", -1),
        lambda x, o: F.struct(o.alias("o"), F.xxhash64(x).alias("a"), F.xxhash64(F.reverse(x), x).alias("b"),
                              x.rlike(r"[^\x20\x09-\x0D]").alias("full"), x.rlike(LONG).alias("long")),
    )
    lines = docs.select(*doc_key(), F.filter(line, lambda s: s["full"]).alias("lines"))
    return lines.select("dk", "tk", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "s")).select(
        "dk", "tk", "i", "n", "s.o", "s.a", "s.b", "s.long"
    )


def _pair_up(suffixes: DataFrame, step: int) -> DataFrame:
    """Adds ``r2``, the rank ``step`` lines on; drops suffixes that are settled there."""
    on = suffixes.select("dk", "tk", (F.col("i") - step).alias("i"), F.col("r").alias("r2")).filter("i >= 0")
    ends = F.col("i") + step >= F.col("n")
    return (
        suffixes.join(shuffled_if_large(on), POS, "left")
        .withColumn("r2", F.when(ends, F.lit(END).cast("long")).otherwise(F.col("r2")))
        .filter("r2 is not null")
    )


def _intervals(suffixes: DataFrame, by: list[str], label: str) -> DataFrame:
    """The distinct keys found twice or more, ranked in their order, each with its first suffix."""
    first = F.min(F.struct("dk", "tk", "i")).alias("first")
    many = stage(suffixes.groupBy(*by).agg(F.count("*").alias("size"), first).filter("size > 1"), f"{label}-many")
    # Ids grow with the partition and within it, so they are ranks after a range sort.
    ordered = many.repartitionByRange(*by).sortWithinPartitions(*by)
    return stage(ordered.withColumn("rank", F.monotonically_increasing_id()), f"{label}-ranked")


def _ranked(suffixes: DataFrame, by: list[str], label: str) -> DataFrame:
    intervals = shuffled_if_large(_intervals(suffixes, by, label))
    here = F.struct("dk", "tk", "i")
    return stage(
        suffixes.join(intervals, by).select(
            "dk", "tk", "i", "n", "o", "long", F.col("rank").alias("r"), (here > F.col("first")).alias("later")
        ), label,
    )


def suffix_intervals(docs: DataFrame):
    """Yields ``(depth, suffixes)`` for depth 1, 2, 4, ...: the suffixes that share their first
    ``depth`` lines (or all they have) with another, with rank ``r`` and ``later``.  The last
    has every repeated suffix settled."""
    named = stage(line_sequences(docs), "line-names")
    seqs = _ranked(named, ["a", "b"], "suffixes-1")
    # Rows equal in id and text would pair up with each other.
    now, depth = stage(seqs.dropDuplicates(POS), "suffixes-once"), 1
    while True:
        yield depth, now
        if now.filter(F.col("i") + depth < F.col("n")).isEmpty():
            return
        paired = stage(_pair_up(now, depth), "suffix-pairs")
        depth *= 2
        now = _ranked(paired, ["r", "r2"], f"suffixes-{depth}")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Maximal later runs: dk, tk, start and stop (line places, stop exclusive), n_lines
    (non-blank ones) and depth, the deepest interval that a suffix of the run lies in."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines is a power of two")
    copies = None
    for depth, suffixes in suffix_intervals(docs):
        if 1 < depth < min_lines:
            continue
        enough = F.col("n") - F.col("i") >= min_lines if depth >= min_lines else F.col("long")
        late = suffixes.filter(F.col("later") & enough).select(
            "dk", "tk", "i", F.least(F.lit(depth), F.col("n") - F.col("i")).alias("h")
        )
        copies = late if copies is None else copies.unionByName(late)
    deepest = copies.groupBy(*POS).agg(F.max("h").alias("h"))
    doc = Window.partitionBy("dk", "tk").orderBy("i")
    reach = F.max(F.col("i") + F.col("h")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("i") > reach, 1).when(reach.isNull(), 1).otherwise(0)
    return (
        deepest.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(doc))
        .groupBy("dk", "tk", "run")
        .agg(F.min("i").alias("start"), F.max(F.col("i") + F.col("h")).alias("stop"), F.max("h").alias("depth"))
        .withColumn("n_lines", F.col("stop") - F.col("start"))
        .drop("run")
    )


def cut_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from ``text``, and a struct column
    ``line_cut``: n_lines, n_removed, n_runs and longest (the deepest interval)."""
    runs = stage(
        repeated_runs(docs, min_lines).groupBy("dk", "tk").agg(
            F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"),
            F.sum("n_lines").alias("removed"), F.max("depth").alias("longest"),
        ), "line-runs",
    ).select(F.col("dk").alias("_ld_dk"), F.col("tk").alias("_ld_tk"), F.col("runs").alias("_ld_runs"),
             F.col("removed").alias("_ld_removed"), F.col("longest").alias("_ld_longest"))
    runs = runs.hint("merge")  # grows with the documents: the same join at every size
    dk, tk = doc_key()
    keyed = docs.select("*", dk.alias("_ld_dk"), tk.alias("_ld_tk"))
    joined = keyed.join(runs, ["_ld_dk", "_ld_tk"], "left")
    full = r"[^\x20\x09-\x0D]"
    lines = F.split("text", "\n", -1)
    places = F.transform(F.filter(F.transform(lines, lambda x, o: F.struct(o.alias("o"), x.rlike(full).alias("f"))),
                                  lambda s: s["f"]), lambda s: s["o"])
    at = lambda k: F.element_at(F.col("_ld_runs"), k)
    stop = lambda k: F.get(F.col("_ld_places"), at(F.greatest(k, F.lit(1)))["stop"] - 1) + 1
    wide = joined.withColumn("_ld_lines", lines).withColumn("_ld_places", F.when(F.col("_ld_runs").isNotNull(), places))
    count = F.size("_ld_runs")
    # Kept stretches lie between the runs: from the line after one to the line before the next.
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(stop(k))
    end = lambda k: F.when(k == count, F.size("_ld_lines")).otherwise(
        F.get(F.col("_ld_places"), at(F.least(k + 1, count))["start"])
    )
    kept = F.transform(
        F.sequence(F.lit(0), count),
        lambda k: F.slice(F.col("_ld_lines"), begin(k) + 1, F.greatest(F.lit(0), end(k) - begin(k))),
    )
    cut = F.when(F.col("_ld_runs").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(kept), "\n"))
    n_lines = F.size(F.filter(F.coalesce("_ld_lines", F.array().cast("array<string>")), lambda x: x.rlike(full)))
    info = F.struct(
        n_lines.cast("long").alias("n_lines"),
        F.coalesce("_ld_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(count, F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce("_ld_longest", F.lit(0)).cast("long").alias("longest"),
    )
    others = [cut.alias("text") if c == "text" else F.col(c) for c in docs.columns if c.lower() != "line_cut"]
    return wide.select(*others, info.alias("line_cut"))

"""Row numbers and orderings that never put one big group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billrate.session import stage


# ``monotonically_increasing_id`` holds the partition above this bit.
_PART_BIT = 33


def in_place(df: DataFrame, out_col: str) -> DataFrame:
    """Add the 1-based place of each row of a sorted frame.

    The frame is written once with each row's partition and place in it; the
    partitions are then shifted by the counts of those before them.
    """
    placed = stage(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", _PART_BIT)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, however many rows the frame has.
    shifts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    local = F.col("_at").bitwiseAND(F.lit((1 << _PART_BIT) - 1))
    return placed.join(F.broadcast(shifts), part == F.col("_part")).select(
        *[F.col(c) for c in df.columns],
        (local + F.col("_shift") + 1).cast("bigint").alias(out_col),
    )


def numbered(
    df: DataFrame, order_col: str, out_col: str, keys: list[str] | None = None
) -> DataFrame:
    """Add the 1-based position by ``order_col``, within ``keys`` if given.

    One range-partitioned sort numbers all rows; within keys, the number of
    the key's first row is taken off.  The sort samples its input first, so
    stage an input that is costly to work out.
    """
    keys = keys or []
    placed = in_place(df.orderBy(*keys, order_col), out_col)
    if not keys:
        return placed
    first = placed.groupBy(*keys).agg(F.min(out_col).alias("_first"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return placed.alias("l").join(first.alias("r"), same).select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col(f"l.{out_col}") - F.col("r._first") + 1).alias(out_col),
    )


def with_sequence(df: DataFrame, order_col: str = "id") -> DataFrame:
    """Report number 1..n in id order as ``seq_no``."""
    return numbered(df, order_col, "seq_no")


def next_sort_order(additions: DataFrame, item_quotas: DataFrame) -> DataFrame:
    """Add ``sort_order``: each item's link count onwards, in ``seq`` order."""
    links = item_quotas.groupBy(F.col("project_item_id").alias("item_id")).agg(
        F.count(F.lit(1)).alias("_links")
    )
    ranked = numbered(additions, "seq", "_rank", ["item_id"])
    order = (F.col("_rank") - 1 + F.coalesce(F.col("_links"), F.lit(0))).cast("int")
    return (
        ranked.join(links, "item_id", "left")
        .select(*[F.col(c) for c in additions.columns], order.alias("sort_order"))
    )


def latest_override(overrides: DataFrame, key: str = "item_id") -> DataFrame:
    """Last edit per key by ``edit_seq``."""
    rest = [c for c in overrides.columns if c != key]
    last = F.max_by(F.struct(*rest), F.col("edit_seq")).alias("last")
    return overrides.groupBy(key).agg(last).select(key, *[f"last.{c}" for c in rest])


def links_in_order(item_quotas: DataFrame, item_id: int) -> DataFrame:
    """Links of one item by sort order."""
    return item_quotas.filter(F.col("project_item_id") == item_id).orderBy("sort_order", "id")


def newest_first(df: DataFrame, ts_col: str) -> DataFrame:
    return df.orderBy(F.desc(ts_col), "id")


def top_candidates(scored: DataFrame, k: int, partials: int = 32) -> DataFrame:
    """The ``k`` best quotas per item text: score descending, then id.

    Each item's candidates are first cut down in ``partials`` shares, so an
    item with very many candidates is not ranked in one task.
    """
    best = [F.desc("score"), F.asc("qid")]
    share = F.pmod(F.xxhash64("qid"), F.lit(partials))
    first = Window.partitionBy("tid", "_share").orderBy(*best)
    last = Window.partitionBy("tid").orderBy(*best)
    return (
        scored.withColumn("_share", share)
        .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
        .drop("_share")
    )


def top_keywords(weights: DataFrame, n: int = 20) -> DataFrame:
    """Heaviest learned keywords."""
    return (
        weights.select("keyword", "weight", "success_rate", "match_count", "total_count")
        .orderBy(F.desc("weight"), "keyword").limit(n)
    )

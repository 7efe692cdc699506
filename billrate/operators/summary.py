"""Totals, counts and the per-item view of multi-quota links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billrate.functions.money import MONEY, MULTI_LABEL


def total_amount(items: DataFrame) -> DataFrame:
    return items.agg(
        F.coalesce(F.sum("total_price"), F.lit(0)).cast("decimal(38,2)").alias("total_amount")
    )


def match_summary(items: DataFrame) -> DataFrame:
    """Items and totals per status; a missing status counts as 0."""
    return items.groupBy(F.coalesce("match_status", F.lit(0)).alias("match_status")).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("total_price").cast("decimal(38,2)").alias("amount"),
    )


def link_counts(item_quotas: DataFrame) -> DataFrame:
    return item_quotas.groupBy("project_item_id").agg(F.count(F.lit(1)).alias("n_links"))


def quota_lists(item_quotas: DataFrame) -> DataFrame:
    """Links of each item as one array in sort order.

    The array is the result here; it holds one item's links.
    """
    link = F.struct(
        "sort_order", "id", "quota_id", "quota_code", "quota_name",
        "quota_feature_value", "unit_price",
    )
    return item_quotas.groupBy(F.col("project_item_id").alias("item_id")).agg(
        F.sort_array(F.collect_list(link)).alias("links")
    )


def with_item_quotas(items: DataFrame, item_quotas: DataFrame) -> DataFrame:
    """Items with ``links``, filled for multi-quota items that have some."""
    # Only links of multi-quota items are gathered.
    multi = items.filter(F.col("match_status") == 3).select(
        F.col("id").alias("project_item_id")
    )
    lists = quota_lists(item_quotas.join(multi, "project_item_id", "left_semi"))
    joined = items.join(lists, items["id"] == lists["item_id"], "left")
    return joined.select(*[items[c] for c in items.columns], "links")


def joined_codes(links: Column) -> Column:
    return F.array_join(F.transform(links, lambda x: x["quota_code"]), "; ", "null")


def joined_names(links: Column) -> Column:
    return F.array_join(F.transform(links, lambda x: x["quota_name"]), "; ", "null")


def multi_label(links: Column) -> Column:
    return F.when(F.size(links) > 0, F.lit(MULTI_LABEL)).otherwise(F.lit(""))


def detail_lines(links: Column) -> Column:
    """One numbered line per link with code, name and price."""
    def line(x: Column, i: Column) -> Column:
        price = F.coalesce(x["unit_price"], F.lit(0).cast(MONEY)).cast("string")
        return F.concat(
            (i + 1).cast("string"), F.lit(". "), F.coalesce(x["quota_code"], F.lit("null")),
            F.lit(" - "), F.coalesce(x["quota_name"], F.lit("null")),
            F.lit(" (单价: "), price, F.lit("元)"),
        )

    return F.array_join(F.transform(links, line), "\n")

"""Manual matches, price overrides and multi-quota links as change-sets.

Each function takes base tables and a table of edits and returns new tables;
edits that name unknown rows come back as rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billrate.functions.money import MONEY, line_total
from billrate.operators.ranking import latest_override, next_sort_order
from billrate.schemas import ITEM_QUOTA_FIELDS, conform
from billrate.session import stage


def _replace(items: DataFrame, edits: DataFrame, flag: str, values: dict[str, Column]) -> DataFrame:
    """Items left-joined to edits, with ``values`` where ``flag`` is set."""
    joined = items.join(edits, items["id"] == edits["item_id"], "left")
    touched = F.col(flag).isNotNull()
    return joined.select(*[
        F.when(touched, values[c]).otherwise(items[c]).alias(c) if c in values
        else items[c]
        for c in items.columns
    ])


def _without_links(item_quotas: DataFrame, edits: DataFrame) -> DataFrame:
    gone = edits.select(F.col("item_id").alias("project_item_id")).distinct()
    return item_quotas.join(gone, "project_item_id", "left_anti").select(*item_quotas.columns)


def apply_manual_match(
    items: DataFrame, item_quotas: DataFrame, overrides: DataFrame, quotas: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set one quota by hand: returns (items, item_quotas, rejects).

    ``overrides`` has (item_id, quota_id, edit_seq); the last valid edit of an
    item wins.  Its multi-quota links go.
    """
    known = overrides.join(
        items.select(F.col("id").alias("item_id")), "item_id", "left_semi"
    )
    picked = quotas.select(
        F.col("id").alias("quota_id"), F.col("quota_code").alias("new_code"),
        F.col("quota_name").alias("new_name"), F.col("feature_value").alias("new_feature"),
        F.col("unit_price").alias("new_price"),
    )
    # The latest edit is settled before the wide columns join in.
    valid = known.join(picked.select("quota_id"), "quota_id", "left_semi")
    last = latest_override(valid.select("item_id", "quota_id", "edit_seq"))
    edits = last.join(picked, "quota_id")
    rejects = overrides.join(valid.select("edit_seq"), "edit_seq", "left_anti")
    total = F.coalesce(line_total(F.col("quantity"), F.col("new_price")), F.col("total_price"))
    out = _replace(items, edits, "quota_id", {
        "matched_quota_id": F.col("quota_id"), "matched_quota_code": F.col("new_code"),
        "matched_quota_name": F.col("new_name"),
        "matched_quota_feature_value": F.col("new_feature"),
        "matched_unit_price": F.col("new_price"), "match_status": F.lit(2),
        "total_price": total,
    })
    return out, _without_links(item_quotas, edits), rejects


def apply_price_override(
    items: DataFrame, item_quotas: DataFrame, prices: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set a price by hand: returns (items, item_quotas, rejects).

    ``prices`` has (item_id, price, edit_seq).  The matched quota stays.
    """
    valid = prices.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    rejects = prices.join(valid.select("edit_seq"), "edit_seq", "left_anti")
    edits = latest_override(valid.select("item_id", "price", "edit_seq"))
    price = F.col("price").cast(MONEY)
    out = _replace(items, edits, "edit_seq", {
        "matched_unit_price": price, "match_status": F.lit(2),
        "total_price": F.coalesce(line_total(F.col("quantity"), price), F.col("total_price")),
    })
    return out, _without_links(item_quotas, edits), rejects


def link_prices(item_quotas: DataFrame) -> DataFrame:
    """Price sum of each item's links; links without a price count as 0."""
    return item_quotas.groupBy(F.col("project_item_id").alias("item_id")).agg(
        F.coalesce(F.sum("unit_price"), F.lit(0)).cast(MONEY).alias("link_price")
    )


def reprice_multi(
    items: DataFrame, item_quotas: DataFrame, item_ids: DataFrame | None = None
) -> DataFrame:
    """Reprice items from their links; ``item_ids`` (item_id) narrows it.

    An item without links loses price and total.
    """
    sums = link_prices(item_quotas)
    if item_ids is None:
        edits = items.select(F.col("id").alias("item_id")).withColumn("hit", F.lit(True))
    else:
        edits = item_ids.select("item_id").distinct().withColumn("hit", F.lit(True))
    edits = edits.join(sums, "item_id", "left")
    return _replace(items, edits, "hit", {
        "matched_unit_price": F.col("link_price"),
        "total_price": line_total(F.col("quantity"), F.col("link_price")),
    })


def add_item_quotas(
    items: DataFrame, item_quotas: DataFrame, additions: DataFrame, quotas: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add quotas to items: returns (items, item_quotas, rejects).

    ``additions`` has (link_id, item_id, quota_id, seq).  A pair that exists,
    or was added earlier in the batch, is rejected.
    """
    first = additions.groupBy("item_id", "quota_id").agg(F.min("seq").alias("seq"))
    # Five later steps start from these rows.
    fresh = stage(
        additions.join(first, ["item_id", "quota_id", "seq"], "left_semi")
        .join(
            item_quotas.select(F.col("project_item_id").alias("item_id"), "quota_id"),
            ["item_id", "quota_id"], "left_anti",
        )
        .join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
        .join(quotas.select(F.col("id").alias("quota_id")), "quota_id", "left_semi")
        .select("link_id", "item_id", "quota_id", "seq"),
        "fresh-links",
    )
    rejects = additions.join(fresh.select("seq"), "seq", "left_anti")
    placed = next_sort_order(fresh, item_quotas)
    new = placed.join(
        quotas.select(
            F.col("id").alias("quota_id"), "quota_code", "quota_name",
            F.col("feature_value").alias("quota_feature_value"), "unit_price",
        ),
        "quota_id",
    )
    links = item_quotas.unionByName(conform(
        new, ITEM_QUOTA_FIELDS, id=F.col("link_id"), project_item_id=F.col("item_id")
    ))
    touched = fresh.select("item_id").distinct()
    out = reprice_multi(items, links, touched)
    return _with_status(out, touched, 3), links, rejects


def _with_status(items: DataFrame, item_ids: DataFrame, status: int) -> DataFrame:
    edits = item_ids.withColumn("hit", F.lit(True))
    return _replace(items, edits, "hit", {"match_status": F.lit(status)})


def remove_item_quotas(
    items: DataFrame, item_quotas: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop links by ``id``; the items are repriced and keep their status."""
    gone = ids.select("id").distinct()
    touched = item_quotas.join(gone, "id", "left_semi").select(
        F.col("project_item_id").alias("item_id")
    )
    links = item_quotas.join(gone, "id", "left_anti").select(*item_quotas.columns)
    return reprice_multi(items, links, touched), links


def clear_item_quotas(
    items: DataFrame, item_quotas: DataFrame, item_ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop all links of items; they become unmatched and lose their price."""
    edits = item_ids.select("item_id").distinct().withColumn("hit", F.lit(True))
    none = F.lit(None).cast(MONEY)
    out = _replace(items, edits, "hit", {
        "match_status": F.lit(0), "matched_unit_price": none, "total_price": none,
    })
    return out, _without_links(item_quotas, edits)

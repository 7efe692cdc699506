"""Ids that a batch of removals names in vain.

A removal by id that finds nothing, or a row of someone else, changes nothing; these functions
say which ids that holds for and why, one row for each distinct id, null included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN, FOREIGN = "unknown", "foreign"


def unknown_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, reason) of the asked ids that no row of ``table`` has.

    For links to remove, items whose links are to be cleared, catalogue rows and versions to
    delete.
    """
    asked = ids.select("id").distinct()
    return asked.join(table.select("id"), "id", "left_anti").withColumn("reason", F.lit(UNKNOWN))


def undeletable_items(items: DataFrame, ids: DataFrame, user_id: int) -> DataFrame:
    """(id, reason) of the asked ids that are no item, or an item of another user or of none."""
    asked = ids.select("id").distinct()
    owned = items.select("id", (F.coalesce(F.col("user_id") == user_id, F.lit(False))).alias("_own"))
    reason = F.when(F.col("_own").isNull(), UNKNOWN).otherwise(FOREIGN)
    return asked.join(owned, "id", "left").filter("_own is null or not _own").select("id", reason.alias("reason"))

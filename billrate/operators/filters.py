"""Scopes, lookups, searches and other row filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billrate.functions.text import is_blank

SETTLED = (2, 3)


def scope_user(items: DataFrame, user_id: int | None) -> DataFrame:
    """Rows of one user; all rows for None."""
    return items if user_id is None else items.filter(F.col("user_id") == user_id)


def scope_version(quotas: DataFrame, version_id: int | None = None) -> DataFrame:
    """Catalogue of one version; all versions for None."""
    return quotas if version_id is None else quotas.filter(F.col("version_id") == version_id)


def like_any(df: DataFrame, kw: str, cols: tuple[str, ...], ignore_case: bool = False) -> DataFrame:
    """Rows of which any of ``cols`` is LIKE %kw%; wildcards in ``kw`` keep their meaning.

    A backslash before anything but a wildcard or itself stands for itself.
    """
    pattern = "%" + re.sub(r"\\\\|\\(?![%_])", r"\\\\", kw) + "%"
    hit = F.lit(False)
    for c in cols:
        hit = hit | (F.col(c).ilike(pattern) if ignore_case else F.col(c).like(pattern))
    return df.filter(hit)


def search_quotas(
    quotas: DataFrame, kw: str, version_id: int | None = None, ignore_case: bool = False
) -> DataFrame:
    """Name or feature LIKE %kw%, see ``like_any``."""
    return like_any(scope_version(quotas, version_id), kw, ("quota_name", "feature_value"), ignore_case)


def contains_filter(df: DataFrame, col: str, kw: str, ignore_case: bool = False) -> DataFrame:
    """Literal substring filter."""
    c, w = F.col(col), F.lit(kw)
    return df.filter(F.contains(F.lower(c), F.lower(w)) if ignore_case else F.contains(c, w))


def lookup(df: DataFrame, **eq) -> DataFrame:
    """Equality filter on any columns."""
    for name, value in eq.items():
        df = df.filter(F.col(name) == value)
    return df


def _open(status: Column) -> Column:
    # Written so that the file scan can apply it.
    return status.isNull() | ~status.isin(*SETTLED)


def eligible(status: Column, unit: Column) -> Column:
    """Not settled by hand and has a unit."""
    return _open(status) & unit.isNotNull() & ~is_blank(unit)


def eligible_items(items: DataFrame) -> DataFrame:
    return items.filter(eligible(F.col("match_status"), F.col("unit")))


def unitless_items(items: DataFrame) -> DataFrame:
    """Open items without a unit, set to unmatched."""
    rows = items.filter(_open(F.col("match_status")) & is_blank(F.col("unit")))
    return rows.withColumn("match_status", F.lit(0))


def grep_rows(df: DataFrame, kw: str, cols: list[str]) -> DataFrame:
    """Case-insensitive substring over the displayed columns."""
    shown = F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
    return df.filter(F.contains(F.lower(shown), F.lit(kw.lower())))


def rules(df: DataFrame, rule_type: str, min_conf: float | None = None) -> DataFrame:
    """Rules of a type above a confidence, best first."""
    out = df.filter(F.col("rule_type") == rule_type)
    if min_conf is not None:
        out = out.filter(F.col("confidence") > min_conf)
    return out.orderBy(F.desc("confidence"), "source_text")


def records_by_type(df: DataFrame, match_type: int | None = None) -> DataFrame:
    """Match records, newest first."""
    out = df if match_type is None else df.filter(F.col("match_type") == match_type)
    return out.orderBy(F.desc("create_time"), "id")


def validate_items(items: DataFrame) -> DataFrame:
    """Add ``reject_reason``: null for good rows.

    ``quantity`` and ``unit_price`` may arrive as text.
    """
    def bad_number(c: str) -> Column:
        number = F.col(c).try_cast("decimal(18,2)")
        return F.col(c).isNotNull() & (number.isNull() | (number < 0))

    reason = F.when(is_blank(F.col("item_name")), "name missing")
    if "quantity" in items.columns:
        qty = F.col("quantity")
        reason = reason.when(
            qty.isNotNull() & qty.try_cast("decimal(18,2)").isNull(), "quantity not a number"
        )
    if "unit_price" in items.columns:
        reason = reason.when(bad_number("unit_price"), "price not valid")
    return items.withColumn("reject_reason", reason)

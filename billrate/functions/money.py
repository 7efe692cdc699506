"""Cell coercion, decimal totals and report defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billrate.functions.text import jtrim

MONEY = "decimal(18,2)"

# Report words.
STATUS_TEXT = {0: "未匹配", 1: "已匹配", 2: "手动修改", 3: "多定额匹配"}
MULTI_LABEL = "多定额组合"


def as_text(c: Column) -> Column:
    """Trimmed text cell, empty for null."""
    return F.coalesce(jtrim(c), F.lit(""))


def number_as_text(c: Column) -> Column:
    """Numeric cell as text; whole numbers print without a fraction.

    A number beyond 64 bits, infinity and NaN print as they are.
    """
    whole = c.try_cast("long")
    return F.coalesce(
        F.when(c == whole, whole.cast("string")).otherwise(c.cast("string")), F.lit("")
    )


def flag_as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def as_amount(c: Column) -> Column:
    """Number cell; 0 for null or text that is no plain number."""
    trimmed = jtrim(c)
    number = trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.coalesce(F.when(number, trimmed.try_cast(MONEY)), F.lit(0).cast(MONEY))


def line_total(quantity: Column, price: Column) -> Column:
    """Exact product rounded half up to two places; null if either is null or it has over 16 digits."""
    return (quantity.cast(MONEY) * price.cast(MONEY)).try_cast(MONEY)


def status_text(c: Column) -> Column:
    out = F.lit("")
    for code, word in STATUS_TEXT.items():
        out = F.when(c == code, word).otherwise(out)
    return out


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast(MONEY))


def ui_text(c: Column) -> Column:
    """Screen default for a missing text."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("无")).otherwise(c)


def learning_weight(match_type: Column) -> Column:
    """Manual matches count fully, automatic ones half."""
    return F.when(match_type.isin(2, 3), F.lit(1.0)).otherwise(F.lit(0.5))

"""Readers for catalogue and bill files with a fixed column order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billrate.functions.money import as_amount, as_text, flag_as_text, number_as_text
from billrate.schemas import ITEM_FIELDS, QUOTA_FIELDS, conform

QUOTA_LAYOUT = (
    "quota_code", "quota_name", "feature_value", "unit", "unit_price", "labor_cost",
    "material_cost", "machine_cost", "remark",
)
ITEM_LAYOUT = ("item_code", "item_name", "feature_value", "unit", "quantity", "remark")
AMOUNTS = {"unit_price", "labor_cost", "material_cost", "machine_cost", "quantity"}


def _raw(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """Read a table whose columns count by position.

    A large CSV file is split among tasks; ``multiLine=True`` reads cells with line breaks,
    each file in one task.
    """
    if fmt == "csv":
        base = dict(
            header=True, inferSchema=False, quote='"', escape='"',
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
        return spark.read.options(**base | options).csv(path)
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=path, **options).load()
    return spark.read.format(fmt).options(**options).load(path)


def _text_cell(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind == "string":
        return as_text(c)
    if kind == "boolean":
        return flag_as_text(c)
    if kind in ("date", "timestamp"):
        return F.coalesce(c.cast("string"), F.lit(""))
    return number_as_text(c)


def _amount_cell(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind == "string":
        return as_amount(c)
    zero = F.lit(0).cast("decimal(18,2)")
    if kind in ("boolean", "date", "timestamp"):
        return zero
    return F.coalesce(c.try_cast("decimal(18,2)"), zero)


def from_layout(df: DataFrame, layout: tuple[str, ...]) -> DataFrame:
    """Name columns by position and coerce their cells.

    A remark column the table does not have stays null; other missing
    columns read as empty or 0.
    """
    out = []
    for pos, name in enumerate(layout):
        if pos < len(df.columns):
            cell = _amount_cell if name in AMOUNTS else _text_cell
            value = cell(df, df.columns[pos])
        elif name == "remark":
            value = F.lit(None).cast("string")
        else:
            value = F.lit(0).cast("decimal(18,2)") if name in AMOUNTS else F.lit("")
        out.append(value.alias(name))
    return df.select(*out)


def load_quotas(
    spark: SparkSession, path: str, fmt: str = "csv", version_id: int | None = None, **options
) -> DataFrame:
    """Catalogue rows; ids are left to the table they are stored in."""
    rows = from_layout(_raw(spark, path, fmt, **options), QUOTA_LAYOUT)
    return conform(rows, QUOTA_FIELDS, version_id=F.lit(version_id))


def load_items(
    spark: SparkSession, path: str, fmt: str = "csv", user_id: int | None = None, **options
) -> DataFrame:
    rows = from_layout(_raw(spark, path, fmt, **options), ITEM_LAYOUT)
    return conform(rows, ITEM_FIELDS, user_id=F.lit(user_id), match_status=F.lit(0))


def load_quotas_into_version(
    spark: SparkSession, path: str, fmt: str, version_id: int, versions: DataFrame, **options
) -> DataFrame:
    """Load into a version that must exist."""
    if versions.filter(F.col("id") == version_id).isEmpty():
        raise ValueError(f"no version {version_id}")
    return load_quotas(spark, path, fmt, version_id, **options)

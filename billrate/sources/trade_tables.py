"""Bill and catalogue tables derived from the trade test tables.

``part`` stands for the catalogue and ``lineitem`` for the bill.  The ``zh``
form spells each word in Chinese, so that n-grams, core words, synonyms and
conflicting types all come into play.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billrate.schemas import ITEM_FIELDS, QUOTA_FIELDS, conform

# The spelling of the test words.
ZH_WORDS = {
    "hot": "热成像", "red": "抓拍", "blue": "普通", "cold": "监控", "new": "高清",
    "old": "标准", "large": "大型", "small": "小型",
    "ring": "摄像机", "bolt": "录像机", "gizmo": "网络硬盘录像机", "widget": "NVR",
    "gear": "混凝土浇筑", "rod": "钢筋绑扎", "plate": "模板安装", "anvil": "监控摄像头",
}
ZH_FEATURES = {
    "ECONOMY": "C30厚度200mm", "LARGE": "16路8T(含硬盘)", "MEDIUM": "200万像素 红外",
    "PROMO": "监控 系统设备", "SMALL": "", "STANDARD": "HRB400直径12mm",
}


def _recode(c: Column, words: dict[str, str]) -> Column:
    out = F.lit("")
    for word, other in words.items():
        out = F.when(c == word, other).otherwise(out)
    return out


def _zh_name(c: Column) -> Column:
    return F.concat(
        _recode(F.substring_index(c, " ", 1), ZH_WORDS),
        _recode(F.substring_index(c, " ", -1), ZH_WORDS),
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quotas(spark: SparkSession, sf_dir: str, zh: bool = False) -> DataFrame:
    part = read(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    return conform(
        part, QUOTA_FIELDS,
        id=F.col("p_partkey"),
        quota_code=F.concat(F.lit("Q"), F.col("p_partkey").cast("string")),
        quota_name=_zh_name(F.col("p_name")) if zh else F.col("p_name"),
        feature_value=_recode(F.col("p_type"), ZH_FEATURES) if zh else F.col("p_type"),
        unit=F.lit("EA"),
        unit_price=price,
        labor_cost=(price * F.lit("0.30").cast("decimal(3,2)")).cast("decimal(18,2)"),
        material_cost=(price * F.lit("0.60").cast("decimal(3,2)")).cast("decimal(18,2)"),
        version_id=F.substring(F.col("p_brand"), 7, 10).cast("bigint"),
    )


def bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one bill item is made from: the lines of an (order, line), summed up."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"),
            F.min("l_returnflag").alias("flag"),
            F.min("l_tax").cast("decimal(4,2)").alias("tax"),
            F.min("l_discount").cast("decimal(4,2)").alias("discount"),
        )
    )


def with_part(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))


def item_values(zh: bool = False) -> dict[str, Column]:
    """Columns of a bill item over ``with_part``.

    Return flag decides how the name departs from the catalogue; tax and
    discount decide which rows lack a unit or carry a status.
    """
    name = _zh_name(F.col("p_name")) if zh else F.col("p_name")
    noun = F.substring_index("p_name", " ", -1)
    noun = _recode(noun, ZH_WORDS) if zh else noun
    suffix = "（含支架）" if zh else " (x)"
    swap = F.concat(noun, F.lit(" "), name)
    return dict(
        id=F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        user_id=F.col("l_suppkey"),
        item_code=F.concat(F.lit("I"), F.col("l_orderkey").cast("string")),
        item_name=F.when(F.col("flag") == "N", F.concat(name, F.lit(suffix)))
        .when(F.col("flag") == "R", swap).otherwise(name),
        feature_value=_recode(F.col("p_type"), ZH_FEATURES) if zh else F.col("p_type"),
        unit=F.when(F.col("tax") == 0.08, None).when(F.col("tax") == 0.07, " ").otherwise("EA"),
        match_status=F.when(F.col("discount") == 0.10, 2).when(F.col("discount") == 0.09, 3)
        .when(F.col("discount") == 0.08, None).otherwise(0),
    )


def items(spark: SparkSession, sf_dir: str, zh: bool = False) -> DataFrame:
    """One bill item per (order, line)."""
    return conform(with_part(spark, sf_dir, bill_lines(spark, sf_dir)), ITEM_FIELDS, **item_values(zh))

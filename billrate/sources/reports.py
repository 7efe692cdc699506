"""Priced-bill and catalogue reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billrate.functions.money import or_blank, or_zero, status_text
from billrate.operators import summary as S
from billrate.operators.ranking import with_sequence
from billrate.session import stage

# Report headings.
ITEM_HEADINGS = [
    "序号", "清单编码", "清单名称", "项目特征值", "单位", "工程量",
    "匹配定额编码", "匹配定额名称", "定额项目特征", "单价", "合价", "匹配状态", "备注", "多定额明细",
]
QUOTA_HEADINGS = [
    "序号", "定额编码", "定额名称", "项目特征值", "单位",
    "单价", "人工费", "材料费", "机械费", "备注",
]


def export_items(items: DataFrame, item_quotas: DataFrame) -> DataFrame:
    """The priced bill of all users, one row per item."""
    # Only the ids are sorted; the wide rows meet their number and links by one shuffle on id.
    bill = stage(items, "bill")
    df = S.with_item_quotas(bill.join(with_sequence(bill.select("id")), "id"), item_quotas)
    multi = F.col("match_status") == 3
    links = F.col("links")

    def shown(plain: str, joined):
        many = F.when(F.size(links) > 0, joined).otherwise(F.lit(""))
        return F.when(multi, many).otherwise(or_blank(F.col(plain)))

    return df.select(
        "seq_no",
        *[or_blank(F.col(c)).alias(c) for c in ("item_code", "item_name", "feature_value", "unit")],
        or_zero(F.col("quantity")).alias("quantity"),
        shown("matched_quota_code", S.joined_codes(links)).alias("quota_codes"),
        shown("matched_quota_name", S.joined_names(links)).alias("quota_names"),
        shown("matched_quota_feature_value", S.multi_label(links)).alias("quota_feature"),
        or_zero(F.col("matched_unit_price")).alias("unit_price"),
        or_zero(F.col("total_price")).alias("total_price"),
        status_text(F.col("match_status")).alias("status"),
        or_blank(F.col("remark")).alias("remark"),
        F.when(multi & (F.size(links) > 0), S.detail_lines(links)).otherwise(F.lit(""))
        .alias("detail"),
    )


def export_quotas(quotas: DataFrame) -> DataFrame:
    texts = ("quota_code", "quota_name", "feature_value", "unit")
    amounts = ("unit_price", "labor_cost", "material_cost", "machine_cost")
    return with_sequence(quotas).select(
        "seq_no",
        *[or_blank(F.col(c)).alias(c) for c in texts],
        *[or_zero(F.col(c)).alias(c) for c in amounts],
        or_blank(F.col("remark")).alias("remark"),
    )


def write_report(report: DataFrame, path: str, headings: list[str], fmt: str = "csv") -> None:
    """Write a report under its headings, in report order across files."""
    named = report.orderBy("seq_no").toDF(*headings)
    writer = named.write.mode("overwrite")
    if fmt == "csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    else:
        writer.format(fmt).save(path)

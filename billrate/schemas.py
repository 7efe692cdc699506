"""Column types of the tables the engine works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTA_FIELDS = {
    "id": "bigint", "quota_code": "string", "quota_name": "string",
    "feature_value": "string", "unit": "string", "unit_price": "decimal(18,2)",
    "labor_cost": "decimal(18,2)", "material_cost": "decimal(18,2)",
    "machine_cost": "decimal(18,2)", "remark": "string", "version_id": "bigint",
}
ITEM_FIELDS = {
    "id": "bigint", "user_id": "bigint", "item_code": "string", "item_name": "string",
    "feature_value": "string", "unit": "string", "quantity": "decimal(18,2)",
    "matched_quota_id": "bigint", "matched_quota_code": "string",
    "matched_quota_name": "string", "matched_quota_feature_value": "string",
    "matched_unit_price": "decimal(18,2)", "total_price": "decimal(18,2)",
    "match_status": "int", "remark": "string",
}
ITEM_QUOTA_FIELDS = {
    "id": "bigint", "project_item_id": "bigint", "quota_id": "bigint",
    "quota_code": "string", "quota_name": "string", "quota_feature_value": "string",
    "unit_price": "decimal(18,2)", "sort_order": "int",
}
VERSION_FIELDS = {
    "id": "bigint", "version_name": "string", "description": "string",
    "create_time": "timestamp", "update_time": "timestamp",
}
RECORD_FIELDS = {
    "id": "bigint", "item_name": "string", "item_feature_value": "string",
    "quota_name": "string", "quota_feature_value": "string", "match_score": "double",
    "match_type": "int", "item_keywords": "array<string>",
    "quota_keywords": "array<string>", "common_keywords": "array<string>",
    "learning_weight": "double", "create_time": "timestamp", "update_time": "timestamp",
}
WEIGHT_FIELDS = {
    "keyword": "string", "weight": "double", "match_count": "int", "total_count": "int",
    "success_rate": "double", "is_core_concept": "boolean", "update_time": "timestamp",
}
RULE_FIELDS = {
    "rule_type": "string", "source_text": "string", "target_text": "string",
    "rule_value": "array<string>", "confidence": "double", "usage_count": "int",
    "create_time": "timestamp", "update_time": "timestamp",
}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def conform(df: DataFrame, fields: dict[str, str], **values: Column) -> DataFrame:
    """Typed projection onto ``fields``; absent columns become null."""
    def pick(name: str) -> Column:
        if name in values:
            return values[name]
        return F.col(name) if name in df.columns else F.lit(None)

    return df.select(*[pick(n).cast(t).alias(n) for n, t in fields.items()])

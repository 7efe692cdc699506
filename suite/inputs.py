"""Tables for the registered queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billrate.functions.money import line_total
from billrate.schemas import ITEM_FIELDS, ITEM_QUOTA_FIELDS, QUOTA_FIELDS, RECORD_FIELDS, VERSION_FIELDS, conform
from billrate.sources import trade_tables as TT

NOW = "2025-01-01 00:00:00"
LINK_BASE = 10_000_000


def settled_items(spark: SparkSession, sf: str) -> DataFrame:
    """A bill as it stands after earlier work: discount decides the status,
    and the line's own part is the matched quota.
    """
    q = TT.quotas(spark, sf)
    q = q.select(
        F.col("id").alias("part"), "quota_code", "quota_name",
        F.col("feature_value").alias("quota_feature"), F.col("unit_price").alias("price"),
    )
    lines = TT.bill_lines(spark, sf)
    base = TT.item_values()
    odd = TT.read(spark, sf, "lineitem").filter(~F.col("l_linenumber").between(0, 9))
    if odd.isEmpty():
        # Every id is one (order, line), and both catalogue joins go by one key: items are not moved by id.
        df = TT.with_part(spark, sf, lines.filter(base["id"].isNotNull())).join(q, F.col("l_partkey") == F.col("part"))
    else:
        same = lines.select(base["id"].alias("same_id"), F.col("l_partkey").alias("own"), F.col("discount").alias("d"), F.col("tax").alias("t"))
        df = TT.with_part(spark, sf, lines).join(same, base["id"] == F.col("same_id")).join(q, F.col("own") == F.col("part"))
        # Items of one id take each other's settlement.
        return _settled(df, base, F.col("d"), F.col("t"))
    return _settled(df, base, F.col("discount"), F.col("tax"))


def _settled(df: DataFrame, base: dict, d, t) -> DataFrame:
    status = (
        F.when(d == 0.10, 2).when(d == 0.09, 3).when(d == 0.08, None)
        .when(d >= 0.06, 0).otherwise(1)
    )
    held = (d != 0.08) & ~((d == 0.09) & (t < 0.04))
    price = F.when(held, F.col("price"))
    quantity = F.col("quantity").cast(ITEM_FIELDS["quantity"])
    return conform(
        df, ITEM_FIELDS, **{**base, "match_status": status},
        matched_quota_id=F.when(held, F.col("part")),
        matched_quota_code=F.when(held, F.col("quota_code")),
        matched_quota_name=F.when(held, F.col("quota_name")),
        matched_quota_feature_value=F.when(held, F.col("quota_feature")),
        matched_unit_price=price, total_price=line_total(quantity, price),
    )


def item_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Links of multi-quota items: the distinct parts of the item's order."""
    lines = TT.read(spark, sf, "lineitem")
    multi = (
        lines.groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_discount").cast("decimal(4,2)").alias("d")).filter(F.col("d") == 0.09)
        .select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"))
    )
    parts = lines.select("l_orderkey", "l_partkey").distinct()
    # An order has a handful of lines, so its parts are few.
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey")) - 1
    parts = parts.withColumn("sort_order", order)
    q = TT.quotas(spark, sf).select(
        F.col("id").alias("l_partkey"), "quota_code", "quota_name",
        F.col("feature_value").alias("quota_feature_value"), "unit_price",
    )
    df = multi.join(parts, "l_orderkey").join(q, "l_partkey")
    return conform(
        df, ITEM_QUOTA_FIELDS, id=F.col("item") * LINK_BASE + F.col("l_partkey"),
        project_item_id=F.col("item"), quota_id=F.col("l_partkey"),
    )


def turns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A bill and a catalogue whose texts nearly all differ: what users say, and all other turns."""
    said = TT.read(spark, sf, "conversations").withColumn(
        "id", F.col("conv_id").cast("bigint") * 1000 + F.col("turn")
    )
    user = F.col("role") == "user"
    items = conform(
        said.filter(user), ITEM_FIELDS, item_name=F.col("text"), unit=F.lit("EA"),
        quantity=F.col("turn") + 1, match_status=F.lit(0),
    )
    quotas = conform(
        said.filter(~user), QUOTA_FIELDS, quota_code=F.col("role"), quota_name=F.col("text"),
        unit_price=F.length("text"),
    )
    return items, quotas


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """One edit per order: some orders hit the same item, some a missing one."""
    o = TT.read(spark, sf, "orders")
    return o.select(
        (F.expr("(o_orderkey div 2) * 20 + 1") + F.col("o_custkey") % 7).alias("item_id"),
        F.col("o_custkey").alias("quota_id"), F.col("o_orderkey").alias("edit_seq"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        "o_orderstatus", "o_orderpriority",
    )


def additions(spark: SparkSession, sf: str) -> DataFrame:
    return edits(spark, sf).select(
        (F.col("edit_seq") + 10**15).alias("link_id"), "item_id", "quota_id",
        F.col("edit_seq").alias("seq"),
    )


def dated_records(spark: SparkSession, sf: str) -> DataFrame:
    """A log of match records, several of every day and of every type."""
    o = TT.read(spark, sf, "orders")
    days = F.make_dt_interval(days=(F.col("o_orderkey") % 100).cast("int"))
    return conform(
        o, RECORD_FIELDS, id=F.col("o_orderkey"), item_name=F.col("o_orderpriority"),
        match_type=F.col("o_custkey") % 3 + 1,
        create_time=F.to_timestamp(F.lit("2024-01-01")) + days,
    )


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """One version per brand, dated by its largest part size."""
    part = TT.read(spark, sf, "part").groupBy("p_brand").agg(F.max("p_size").alias("size"))
    stamp = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(days=F.col("size"))
    return conform(
        part, VERSION_FIELDS, id=F.substring("p_brand", 7, 10).cast("bigint"),
        version_name=F.col("p_brand"), create_time=stamp, update_time=stamp,
    )


def probe_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct Chinese item texts beside the text of another catalogue row."""
    i = TT.items(spark, sf, zh=True).select("user_id", "item_name", "feature_value")
    q = TT.quotas(spark, sf, zh=True).select(
        F.col("id").alias("user_id"), "quota_name",
        F.col("feature_value").alias("quota_feature"),
    )
    return i.join(q, "user_id").drop("user_id").distinct()


def value_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Replacement rules typed in by each customer, with faulty lines among them."""
    c = TT.read(spark, sf, "customer")
    text = F.concat(
        F.lit("${name}="), F.col("c_name"), F.lit("\n ${seg} = "), F.col("c_mktsegment"),
        F.lit("=x \n\nno rule\nplain=1\n${empty}= \n${name}="), F.col("c_name"),
        F.lit("!\n${nation}="), F.col("c_nationkey").cast("string"),
    )
    return c.select("c_custkey", "c_nationkey", text.alias("rules"))

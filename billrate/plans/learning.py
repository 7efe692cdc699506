"""Learning keyword weights and synonym rules from past matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billrate.functions import text as T
from billrate.functions.money import learning_weight
from billrate.schemas import RECORD_FIELDS, RULE_FIELDS, WEIGHT_FIELDS, conform

MIN_RECORDS = 10
MIN_MANUAL = 5
RULE_CONFIDENCE = 0.7
GROUP_SHARE = 0.6
BACKFILL_SCORE = 0.5
COPY_SHARES = 256


def learning_pairs(items: DataFrame, item_quotas: DataFrame, quotas: DataFrame) -> DataFrame:
    """Matched (item, quota) text pairs.

    A matched quota id comes first, even on a multi-quota item; only without
    one do the links count.  Pairs whose quota is gone drop out.
    """
    settled = items.filter(F.col("match_status") > 0)
    single = settled.filter(F.col("matched_quota_id").isNotNull()).select(
        "item_name", F.col("feature_value").alias("item_feature_value"),
        F.col("matched_quota_id").alias("quota_id"), F.col("match_status").alias("match_type"),
    )
    multi = (
        settled.filter(F.col("matched_quota_id").isNull() & (F.col("match_status") == 3))
        .select("id", "item_name", F.col("feature_value").alias("item_feature_value"))
        .join(item_quotas.select(F.col("project_item_id").alias("id"), "quota_id"), "id")
        .select("item_name", "item_feature_value", "quota_id", F.lit(3).alias("match_type"))
    )
    texts = quotas.select(
        F.col("id").alias("quota_id"), "quota_name",
        F.col("feature_value").alias("quota_feature_value"),
    )
    return (
        single.unionByName(multi).join(texts, "quota_id").drop("quota_id")
        .withColumn("match_score", F.lit(BACKFILL_SCORE))
    )


def match_pairs(matched: DataFrame) -> DataFrame:
    """Pairs from a match result that carries ``match_score``."""
    return matched.filter(F.col("match_score").isNotNull()).select(
        "item_name", F.col("feature_value").alias("item_feature_value"),
        F.col("matched_quota_name").alias("quota_name"),
        F.col("matched_quota_feature_value").alias("quota_feature_value"),
        F.col("match_status").alias("match_type"), "match_score",
    )


def manual_pairs(items: DataFrame, overrides: DataFrame, quotas: DataFrame) -> DataFrame:
    """Pairs set by hand, one for every edit whose item and quota exist, at score 1.

    ``overrides`` is as in ``apply_manual_match``; an edit overruled later in
    the batch was made all the same and counts.
    """
    named = items.select(
        F.col("id").alias("item_id"), "item_name", F.col("feature_value").alias("item_feature_value")
    )
    texts = quotas.select(
        F.col("id").alias("quota_id"), "quota_name",
        F.col("feature_value").alias("quota_feature_value"),
    )
    return (
        overrides.select("item_id", "quota_id").join(named, "item_id").join(texts, "quota_id")
        .select(
            "item_name", "item_feature_value", "quota_name", "quota_feature_value",
            F.lit(2).alias("match_type"), F.lit(1.0).alias("match_score"),
        )
    )


def _both(name: str, feature: str) -> Column:
    return F.concat(T.extract_keywords(F.col(name)), T.extract_keywords(F.col(feature)))


def collect_match_records(pairs: DataFrame, now: str) -> DataFrame:
    """One learning record per matched pair.

    Equal pairs share their texts, so keywords are worked out once per
    distinct pair and expanded again; a pair with very many copies is counted
    and expanded in ``COPY_SHARES`` shares.
    """
    texts = ["item_name", "item_feature_value", "quota_name", "quota_feature_value"]
    share = F.pmod(F.spark_partition_id(), F.lit(COPY_SHARES))
    counted = (
        pairs.withColumn("_share", share)
        .groupBy(*texts, "match_type", "match_score", "_share")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    lists = (
        counted.withColumn("item_keywords", _both(texts[0], texts[1]))
        .withColumn("quota_keywords", _both(texts[2], texts[3]))
    )
    common = T.common_keywords(F.col("item_keywords"), F.col("quota_keywords"))
    lists = lists.withColumn("common_keywords", T.sort_keywords(common))
    stamp = F.lit(now).cast("timestamp")
    records = lists.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    return conform(
        records, RECORD_FIELDS, learning_weight=learning_weight(F.col("match_type")),
        create_time=stamp, update_time=stamp,
    )


def backfill_records(
    items: DataFrame, item_quotas: DataFrame, quotas: DataFrame, now: str
) -> DataFrame:
    """Records of everything matched so far; repeats are not removed."""
    return collect_match_records(learning_pairs(items, item_quotas, quotas), now)


def _fewer_than(df: DataFrame, n: int) -> bool:
    return df.limit(n).count() < n


def _empty(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return conform(df.limit(0), fields)


def no_weights(df: DataFrame) -> DataFrame:
    return _empty(df, WEIGHT_FIELDS)


def keyword_weights(
    records: DataFrame,
    existing: DataFrame | None = None,
    min_records: int = MIN_RECORDS,
    now: str | None = None,
) -> DataFrame:
    """Weight of every keyword the two sides of a match share.

    Counters of a keyword seen now are recomputed in full; half weights do
    not add up to matches.  Existing keywords not seen now stay.
    """
    if _fewer_than(records, min_records):
        return existing if existing is not None else no_weights(records)
    return weights_of(keyword_counts(records), existing, now)


def keyword_counts(records: DataFrame) -> DataFrame:
    """How often each keyword was shared, and how often in a full match; counts of parts add up."""
    return (
        records.select(F.explode("common_keywords").alias("keyword"), "learning_weight")
        .groupBy("keyword").agg(
            F.sum(F.floor("learning_weight")).alias("match_count"),
            F.count(F.lit(1)).alias("total_count"),
        )
    )


def weights_of(counts: DataFrame, existing: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """Weights from the counts of all records, beside existing ones of keywords not among them."""
    counts = counts.withColumn("success_rate", F.col("match_count") / F.col("total_count"))
    raw = F.lit(1.0) + (F.col("success_rate") - 0.5) * 2.0
    weighed = counts.withColumn("weight", F.greatest(F.lit(0.5), F.least(F.lit(2.0), raw)))
    stamp = F.lit(now).cast("timestamp")
    if existing is None:
        return conform(
            weighed, WEIGHT_FIELDS, is_core_concept=F.lit(False), update_time=stamp
        )
    flags = existing.select("keyword", F.col("is_core_concept").alias("old_core"))
    fresh = conform(
        weighed.join(flags, "keyword", "left"), WEIGHT_FIELDS,
        is_core_concept=F.coalesce(F.col("old_core"), F.lit(False)), update_time=stamp,
    )
    kept = existing.join(weighed.select("keyword"), "keyword", "left_anti")
    return conform(kept, WEIGHT_FIELDS).unionByName(fresh)


def discover_synonyms(records: DataFrame, rules: DataFrame, now: str | None = None) -> DataFrame:
    """New synonym rules from manual matches onto the same quota.

    A keyword gets at most one rule, from the group that trusts it most.
    """
    manual = records.filter(F.col("match_type") == 2)
    if _fewer_than(manual, MIN_MANUAL):
        return _empty(rules, RULE_FIELDS)
    null = F.lit("null")
    key = F.concat(
        F.coalesce("quota_name", null), F.lit("|"), F.coalesce("quota_feature_value", null)
    )
    manual = manual.select(key.alias("quota_key"), "item_name", "item_keywords")
    groups = manual.groupBy("quota_key").agg(F.count(F.lit(1)).alias("rows"))
    # Names are made distinct first, so a big group is only ever counted.
    named = manual.select(
        "quota_key", "item_name", F.explode("item_keywords").alias("keyword")
    ).distinct()
    counted = named.groupBy("quota_key", "keyword").agg(F.count(F.lit(1)).alias("names"))
    trusted = rules.filter(
        (F.col("rule_type") == "synonym") & (F.col("confidence") > RULE_CONFIDENCE)
    )
    blocked = trusted.select(F.col("source_text").alias("keyword")).union(
        trusted.select(F.col("target_text").alias("keyword"))
    )
    ratio = F.col("names") / F.col("rows")
    found = (
        counted.filter(F.col("names") >= 2).join(groups, "quota_key")
        .filter((F.col("rows") >= 2) & (F.col("names") >= F.col("rows") * GROUP_SHARE))
        .join(blocked.distinct(), "keyword", "left_anti")
        .withColumn("confidence", F.lit(RULE_CONFIDENCE) + ratio * 0.3)
        .groupBy("keyword").agg(
            F.min_by(
                F.struct("quota_key", "confidence"), F.struct(-F.col("confidence"), "quota_key")
            ).alias("best")
        )
        .select("keyword", "best.quota_key", "best.confidence")
    )
    stamp = F.lit(now).cast("timestamp")
    # The names are part of the rule; only those of accepted rules are gathered.
    values = (
        named.join(found, ["quota_key", "keyword"])
        .groupBy("keyword", "confidence")
        .agg(F.sort_array(F.collect_list(F.coalesce("item_name", null))).alias("rule_value"))
    )
    return conform(
        values, RULE_FIELDS, rule_type=F.lit("synonym"), source_text=F.col("keyword"),
        target_text=F.col("keyword"), usage_count=F.lit(0), create_time=stamp,
        update_time=stamp,
    )


def run_learning(
    records: DataFrame, rules: DataFrame, weights: DataFrame, now: str
) -> tuple[DataFrame, DataFrame]:
    """Both learning steps: returns (weights, rules)."""
    learned = keyword_weights(records, weights, now=now)
    return learned, rules.unionByName(discover_synonyms(records, rules, now))


def weight_map(weights: DataFrame) -> DataFrame:
    """Learned weights for lookup by keyword."""
    return weights.select("keyword", "weight")


def synonym_map(rules: DataFrame) -> DataFrame:
    """Word and its synonyms from trusted rules.

    Of several rules for a word the one with the lowest confidence counts, as
    later entries replace earlier ones in falling order.  A rule whose value
    is null, as after a failed parse, is skipped.
    """
    trusted = rules.filter(
        (F.col("rule_type") == "synonym") & (F.col("confidence") > RULE_CONFIDENCE)
        & F.col("rule_value").isNotNull()
    )
    return trusted.groupBy("source_text").agg(
        F.array_distinct(F.min_by("rule_value", F.struct("confidence", "rule_value")))
        .alias("synonyms")
    )


def synonym_listing(rules: DataFrame) -> DataFrame:
    """Synonym rules, best first."""
    return (
        rules.filter(F.col("rule_type") == "synonym")
        .select("source_text", "target_text", "confidence", "usage_count")
        .orderBy(F.desc("confidence"), "source_text")
    )


def rules_from_json(df: DataFrame) -> DataFrame:
    """Decode a JSON ``rule_value``; text that is no list becomes null."""
    return df.withColumn("rule_value", F.from_json("rule_value", "array<string>"))


def rules_to_json(df: DataFrame) -> DataFrame:
    return df.withColumn("rule_value", F.to_json("rule_value"))

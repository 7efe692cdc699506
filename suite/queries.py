"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billrate.functions import money as M
from billrate.functions import score as S
from billrate.functions import templates as TP
from billrate.functions import text as T
from billrate.operators import filters as FL
from billrate.operators import maintenance as MT
from billrate.operators import pricing as PR
from billrate.operators import ranking as RK
from billrate.operators import rejects as RJ
from billrate.operators import summary as SM
from billrate.plans import incremental as IC
from billrate.plans import learning as LN
from billrate.plans import matching as MA
from billrate.plans import rematch as RM
from billrate.plans.templates import render_batch
from billrate.schemas import ITEM_FIELDS, QUOTA_FIELDS
from billrate.session import stage, staging_root
from billrate.sources import imports as IM
from billrate.sources import reports as RP
from billrate.sources import tables as TB
from billrate.sources import trade_tables as TT
from billrate.sources.shards import ShardedTable
from billrate.sources.textindex import TextIndex
from suite import inputs as IN

ITEM_VIEW = [
    "id", "matched_quota_id", "matched_quota_code", "matched_quota_name",
    "matched_quota_feature_value", "matched_unit_price", "total_price", "match_status",
]
QUERIES = {}


def _store(spark):
    """A new folder for stored tables."""
    return f"{staging_root(spark)}/store-{uuid.uuid4().hex}"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- matching ---------------------------------------------------------------


def _matched(spark, sf, zh, **options):
    out = MA.match_items(
        TT.items(spark, sf, zh), TT.quotas(spark, sf, zh), with_score=True, **options
    )
    return out.select(*ITEM_VIEW, F.round("match_score", 9).alias("score"))


@query
def match_items(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf, False)


@query
def match_items_zh(spark, sf):
    return _matched(spark, sf, True)


@query
def match_items_exhaustive(spark, sf):
    return _matched(spark, sf, True, early_accept=None)


def _weights(spark, sf):
    """Keyword weights learned from the settled bill."""
    return LN.keyword_weights(_records(spark, sf), now=IN.NOW)


@query
def match_items_learned(spark, sf):
    return _matched(spark, sf, False, weights=LN.weight_map(_weights(spark, sf)))


@query
def top_candidates(spark, sf):
    items = MA.item_texts(FL.eligible_items(TT.items(spark, sf)))
    quotas = MA.quota_texts(TT.quotas(spark, sf))
    best = RK.top_candidates(MA.scored_pairs(items, quotas, ranks=3).filter("score >= 0.3"), 3)
    names = items.select(
        "tid", F.col("profile.name").alias("item_name"),
        F.col("profile.feature").alias("feature_value"),
    )
    return best.join(names, "tid").select(
        "item_name", "feature_value", "qid", "rank", F.round("score", 9).alias("score")
    )


@query
def match_turns(spark, sf):
    out = MA.match_items(*IN.turns(spark, sf), with_score=True)
    return out.select(
        "id", "matched_quota_id", "matched_quota_code", "total_price", "match_status",
        F.round("match_score", 9).alias("score"),
    )


def _changed_catalogue(spark, sf):
    """Suppliers rename rows and bring new ones, customers set prices; a nation's row leaves and
    comes back under a lower id.
    """
    base = TT.quotas(spark, sf)
    customer = TT.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("decimal(18,2)").alias("price")
    )
    prices = base.join(customer, "id").select(
        *[F.col("price").alias(c) if c == "unit_price" else F.col(c) for c in base.columns],
        F.lit("update").alias("op"), (F.col("id") - 10**9).alias("edit_seq"),
    )
    nations = TT.read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    back = base.join(nations, "id", "left_semi").withColumns({
        "id": F.lit(-(10**9)) - F.col("id"), "op": F.lit("insert"), "edit_seq": F.col("id") + 10**9,
    })
    changes = _quota_changes(spark, sf).unionByName(prices).unionByName(back)
    return MT.delete_quotas(MT.upsert_quotas(base, changes)[0], nations)


@query
def rematch_items(spark, sf):
    """The bill after a batch of catalogue changes; equals a full match against the new catalogue."""
    items, before = TT.items(spark, sf), TT.quotas(spark, sf)
    after = stage(_changed_catalogue(spark, sf), "changed-quotas")
    out, _ = RM.rematch_items(items, RM.first_winners(items, before), before, after, with_score=True)
    return out.select(*ITEM_VIEW, F.round("match_score", 9).alias("score"))


@query
def rematch_turns(spark, sf):
    """What users say, first matched against what assistants say, then against the system's turns too."""
    items, after = IN.turns(spark, sf)
    before = after.filter(F.col("quota_code") == "assistant")
    out, _ = RM.rematch_items(items, RM.first_winners(items, before), before, after, with_score=True)
    return out.select(
        "id", "matched_quota_id", "matched_quota_code", "total_price", "match_status",
        F.round("match_score", 9).alias("score"),
    )


@query
def match_items_scoped(spark, sf):
    """One user's settled bill against one version; earlier values stay where nothing matches."""
    out = MA.match_items(
        IN.settled_items(spark, sf), TT.quotas(spark, sf), version_id=5, user_id=7
    )
    return out.select(*ITEM_VIEW)


@query
def match_items_cleared(spark, sf):
    out = MA.match_items(
        IN.settled_items(spark, sf), TT.quotas(spark, sf), version_id=5, user_id=7,
        clear_stale=True,
    )
    return out.select(*ITEM_VIEW)


@query
def match_summary(spark, sf):
    return SM.match_summary(IN.settled_items(spark, sf))


# --- text functions ---------------------------------------------------------


@query
def clean_text(spark, sf):
    return TT.read(spark, sf, "documents").select(
        "doc_id", T.clean_text(F.col("text")).alias("cleaned")
    )


@query
def extract_keywords(spark, sf):
    return TT.read(spark, sf, "documents").select(
        "doc_id", F.array_join(T.extract_keywords(F.col("text")), "|").alias("keywords")
    )


@query
def extract_keywords_zh(spark, sf):
    names = TT.items(spark, sf, zh=True).select("item_name", "feature_value").distinct()
    return names.select(
        "item_name", "feature_value",
        F.array_join(T.extract_keywords(F.col("item_name")), "|").alias("name_keywords"),
        F.array_join(T.extract_keywords(F.col("feature_value")), "|").alias("feature_keywords"),
    )


@query
def han_ngrams(spark, sf):
    q = TT.quotas(spark, sf, zh=True)
    grams = F.sort_array(F.array_distinct(T.han_ngrams(F.col("quota_name"))))
    return q.select("id", F.array_join(grams, "|").alias("grams"))


@query
def keyword_flags(spark, sf):
    words = TT.items(spark, sf, zh=True).select("item_name").distinct().select(
        F.explode(T.keyword_set(F.col("item_name"))).alias("keyword")
    ).distinct()
    k = F.col("keyword")
    return words.select(
        "keyword", T.is_core(k).alias("core"), T.synonym_group(k).alias("synonym_group"),
        T.is_synonym(k, F.lit("录像机")).alias("like_recorder"),
    )


@query
def type_conflicts(spark, sf):
    p = IN.probe_pairs(spark, sf).select("item_name", "quota_name").distinct()
    return p.select("*", T.has_type_conflict(F.col("item_name"), F.col("quota_name"))
                    .alias("conflict"))


@query
def keyword_similarity(spark, sf):
    p = IN.probe_pairs(spark, sf).select("item_name", "quota_name").distinct()
    a, b = T.keyword_set(F.col("item_name")), T.keyword_set(F.col("quota_name"))
    return p.select(
        "item_name", "quota_name", F.round(S.keyword_similarity(a, b), 9).alias("score")
    )


@query
def common_keywords(spark, sf):
    p = IN.probe_pairs(spark, sf).select("item_name", "quota_name").distinct()
    a, b = T.keyword_set(F.col("item_name")), T.keyword_set(F.col("quota_name"))
    both = T.sort_keywords(T.common_keywords(a, b))
    return p.select("item_name", "quota_name", F.array_join(both, "|").alias("common"))


@query
def text_match_score(spark, sf):
    p = IN.probe_pairs(spark, sf).select("item_name", "quota_name").distinct()
    score = S.text_match_score(F.col("item_name"), F.col("quota_name"))
    return p.select("item_name", "quota_name", F.round(score, 9).alias("score"))


def _profiled_pairs(spark, sf):
    p = S.with_profile(IN.probe_pairs(spark, sf), "item_name", "feature_value")
    p = p.withColumnRenamed("profile", "i")
    return S.with_profile(p, "quota_name", "quota_feature").withColumnRenamed("profile", "q")


@query
def pair_score(spark, sf):
    return _profiled_pairs(spark, sf).select(
        "item_name", "feature_value", "quota_name", "quota_feature",
        F.round(S.pair_score(F.col("i"), F.col("q")), 9).alias("score"),
    )


# --- filters ----------------------------------------------------------------


@query
def scope_user(spark, sf):
    return FL.scope_user(TT.items(spark, sf), 7).select("id", "item_name", "quantity")


@query
def scope_version(spark, sf):
    return FL.scope_version(TT.quotas(spark, sf), 5).select("id", "quota_code", "unit_price")


@query
def search_quotas(spark, sf):
    return FL.search_quotas(TT.quotas(spark, sf), "r_n").select("id", "quota_name")


@query
def search_quotas_ignore_case(spark, sf):
    hits = FL.search_quotas(TT.quotas(spark, sf), "econ%y", ignore_case=True)
    return hits.select("id", "quota_name", "feature_value")


@query
def search_stored(spark, sf):
    index = TextIndex(f"{staging_root(spark)}/search-{uuid.uuid4().hex}")
    index.write(TT.quotas(spark, sf))
    found = None
    for kw, fold in (("r_n", False), ("ring", False), ("econ%y", True), ("STEEL", True), ("no such text", False)):
        hits = index.like(spark, kw, fold).select(F.lit(kw).alias("term"), "id", "quota_name")
        found = hits if found is None else found.unionByName(hits)
    return found


@query
def search_documents_stored(spark, sf):
    index = TextIndex(f"{staging_root(spark)}/search-{uuid.uuid4().hex}", "doc_id", ("text",))
    index.write(TT.read(spark, sf, "documents").select("doc_id", "text"))
    return index.contains(spark, "text", "License", ignore_case=True).select("doc_id")


@query
def contains_filter(spark, sf):
    docs = TT.read(spark, sf, "documents")
    return FL.contains_filter(docs, "text", "THE ", ignore_case=True).select("doc_id")


@query
def lookup(spark, sf):
    hits = FL.lookup(TT.items(spark, sf), match_status=2, item_name="red bolt")
    return hits.select("id", "item_code")


@query
def eligible_items(spark, sf):
    return FL.eligible_items(TT.items(spark, sf)).select("id", "unit")


@query
def unitless_items(spark, sf):
    return FL.unitless_items(TT.items(spark, sf)).select("id", "match_status")


@query
def grep_rows(spark, sf):
    q = TT.quotas(spark, sf)
    return FL.grep_rows(q, "LARGE", ["quota_code", "quota_name", "feature_value"]).select("id")


@query
def validate_items(spark, sf):
    p = TT.read(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") == 0, " ").otherwise(F.col("c_name")).alias("item_name"),
        F.col("c_acctbal").cast("string").alias("unit_price"),
        F.when(F.col("c_nationkey") == 1, F.col("c_name")).otherwise(F.col("c_nationkey").cast("string"))
        .alias("quantity"),
    )
    return FL.validate_items(p).select("c_custkey", "reject_reason")


# --- overrides and links ----------------------------------------------------


def _base(spark, sf):
    return IN.settled_items(spark, sf), IN.item_quotas(spark, sf)


@query
def manual_match(spark, sf):
    items, links = _base(spark, sf)
    out, _, _ = PR.apply_manual_match(
        items, links, IN.edits(spark, sf), TT.quotas(spark, sf)
    )
    return out.select(*ITEM_VIEW)


@query
def manual_match_links(spark, sf):
    items, links = _base(spark, sf)
    _, kept, _ = PR.apply_manual_match(items, links, IN.edits(spark, sf), TT.quotas(spark, sf))
    return kept.select("id", "project_item_id", "quota_id")


@query
def manual_match_rejects(spark, sf):
    items, links = _base(spark, sf)
    _, _, bad = PR.apply_manual_match(items, links, IN.edits(spark, sf), TT.quotas(spark, sf))
    return bad.select("item_id", "quota_id", "edit_seq")


@query
def price_override(spark, sf):
    items, links = _base(spark, sf)
    out, _, _ = PR.apply_price_override(items, links, IN.edits(spark, sf))
    return out.select(*ITEM_VIEW)


@query
def price_override_links(spark, sf):
    _, kept, _ = PR.apply_price_override(*_base(spark, sf), IN.edits(spark, sf))
    return kept.select("id", "project_item_id", "quota_id")


@query
def price_override_rejects(spark, sf):
    _, _, bad = PR.apply_price_override(*_base(spark, sf), IN.edits(spark, sf))
    return bad.select("item_id", "price", "edit_seq")


@query
def add_item_quotas(spark, sf):
    items, links = _base(spark, sf)
    _, new, _ = PR.add_item_quotas(
        items, links, IN.additions(spark, sf), TT.quotas(spark, sf)
    )
    return new


@query
def add_item_quotas_items(spark, sf):
    items, links = _base(spark, sf)
    out, _, _ = PR.add_item_quotas(
        items, links, IN.additions(spark, sf), TT.quotas(spark, sf)
    )
    return out.select(*ITEM_VIEW)


@query
def add_item_quotas_rejects(spark, sf):
    items, links = _base(spark, sf)
    _, _, bad = PR.add_item_quotas(
        items, links, IN.additions(spark, sf), TT.quotas(spark, sf)
    )
    return bad.select("link_id", "item_id", "quota_id")


def _some_links(spark, sf):
    """Links onto parts of the larger sizes."""
    big = TT.read(spark, sf, "part").filter("p_size > 25").select(
        F.col("p_partkey").alias("quota_id")
    )
    return IN.item_quotas(spark, sf).join(big, "quota_id", "left_semi")


@query
def remove_item_quotas(spark, sf):
    items, links = _base(spark, sf)
    out, _ = PR.remove_item_quotas(items, links, _some_links(spark, sf).select("id"))
    return out.select(*ITEM_VIEW)


@query
def clear_item_quotas(spark, sf):
    items, links = _base(spark, sf)
    ids = _some_links(spark, sf).select(F.col("project_item_id").alias("item_id"))
    out, _ = PR.clear_item_quotas(items, links, ids)
    return out.select(*ITEM_VIEW)


@query
def remove_item_quotas_links(spark, sf):
    _, kept = PR.remove_item_quotas(*_base(spark, sf), _some_links(spark, sf).select("id"))
    return kept.select("id", "project_item_id", "sort_order")


@query
def clear_item_quotas_links(spark, sf):
    ids = _some_links(spark, sf).select(F.col("project_item_id").alias("item_id"))
    _, kept = PR.clear_item_quotas(*_base(spark, sf), ids)
    return kept.select("id", "project_item_id", "sort_order")


@query
def reprice_multi(spark, sf):
    items, links = _base(spark, sf)
    return PR.reprice_multi(items, links).select(*ITEM_VIEW)


@query
def with_item_quotas(spark, sf):
    items, links = _base(spark, sf)
    shown = SM.with_item_quotas(items, links)
    return shown.select(
        "id", SM.joined_codes(F.col("links")).alias("codes"),
        SM.joined_names(F.col("links")).alias("names"),
        SM.detail_lines(F.col("links")).alias("detail"),
    )


@query
def latest_override(spark, sf):
    return RK.latest_override(IN.edits(spark, sf).select("item_id", "quota_id", "edit_seq"))


@query
def next_sort_order(spark, sf):
    return RK.next_sort_order(IN.additions(spark, sf), IN.item_quotas(spark, sf)).select(
        "link_id", "item_id", "sort_order"
    )


@query
def links_of_item(spark, sf):
    links = IN.item_quotas(spark, sf)
    item = links.agg(F.min("project_item_id")).first()[0]
    shown = RK.links_in_order(links, item).select("id", "sort_order", "quota_code")
    return RK.in_place(shown, "position")


@query
def mark_added(spark, sf):
    hits = FL.search_quotas(TT.quotas(spark, sf), "ring")
    item = IN.item_quotas(spark, sf).agg(F.min("project_item_id")).first()[0]
    return MT.mark_added(hits, IN.item_quotas(spark, sf), item).select("id", "already_added")


# --- totals and reports -----------------------------------------------------


@query
def total_amount(spark, sf):
    return SM.total_amount(IN.settled_items(spark, sf)).select(
        F.col("total_amount").cast("decimal(18,2)").alias("total_amount")
    )


@query
def link_counts(spark, sf):
    return SM.link_counts(IN.item_quotas(spark, sf))


@query
def export_items(spark, sf):
    return RP.export_items(*_base(spark, sf))


@query
def export_quotas(spark, sf):
    return RP.export_quotas(TT.quotas(spark, sf))


@query
def with_sequence(spark, sf):
    return RK.with_sequence(TT.items(spark, sf).select("id"))


@query
def newest_versions(spark, sf):
    shown = RK.newest_first(IN.versions(spark, sf), "create_time").select("id", "version_name")
    return RK.in_place(shown, "position")


# --- learning ---------------------------------------------------------------


def _records(spark, sf):
    """The stored learning records; learning reads them several times."""
    items, links = _base(spark, sf)
    return stage(LN.backfill_records(items, links, TT.quotas(spark, sf), IN.NOW), "records")


@query
def learning_pairs(spark, sf):
    items, links = _base(spark, sf)
    return LN.learning_pairs(items, links, TT.quotas(spark, sf))


@query
def match_records(spark, sf):
    return _records(spark, sf).select(
        "item_name", "item_feature_value", "quota_name", "quota_feature_value",
        "match_score", "match_type", "learning_weight",
        F.to_json("item_keywords").alias("item_keywords"),
        F.to_json("quota_keywords").alias("quota_keywords"),
        F.to_json("common_keywords").alias("common_keywords"),
    )


@query
def manual_match_records(spark, sf):
    """What manual matches teach: one record for each edit that named known rows."""
    pairs = LN.manual_pairs(TT.items(spark, sf), IN.edits(spark, sf), TT.quotas(spark, sf))
    return LN.collect_match_records(pairs, IN.NOW).select(
        "item_name", "item_feature_value", "quota_name", "quota_feature_value", "match_score",
        "match_type", "learning_weight", F.to_json("common_keywords").alias("common_keywords"),
    )


@query
def matched_records(spark, sf):
    """What an automatic match teaches."""
    matched = MA.match_items(TT.items(spark, sf), TT.quotas(spark, sf), with_score=True)
    return LN.collect_match_records(LN.match_pairs(matched), IN.NOW).select(
        "item_name", "quota_name", "match_type", F.round("match_score", 9).alias("match_score"),
        "learning_weight",
    )


@query
def records_by_type(spark, sf):
    shown = FL.records_by_type(IN.dated_records(spark, sf), 2).select("id", "create_time")
    return RK.in_place(shown, "position").select(
        "id", F.date_format("create_time", "yyyy-MM-dd").alias("day"), "position"
    )


@query
def keyword_weights(spark, sf):
    return _weights(spark, sf).select(
        "keyword", F.round("weight", 9).alias("weight"), "match_count", "total_count",
        F.round("success_rate", 9).alias("success_rate"), "is_core_concept",
    )


def _no_rules(spark):
    from billrate.schemas import RULE_FIELDS, ddl

    return spark.createDataFrame([], ddl(RULE_FIELDS))


@query
def keyword_weights_in_batches(spark, sf):
    """Weights after three runs over a log that grows in between."""
    log = stage(_records(spark, sf).withColumn("id", F.monotonically_increasing_id()), "record-log")
    ends = log.agg(F.percentile_approx("id", [0.3, 0.6], F.lit(100)).alias("ends")).first()["ends"] or []
    state = None
    for end in ends:
        state = IC.advance(log.filter(F.col("id") <= end), state)
    weights = IC.learned_weights(IC.advance(log, state), now=IN.NOW)
    return weights.select(
        "keyword", F.round("weight", 9).alias("weight"), "match_count", "total_count",
        F.round("success_rate", 9).alias("success_rate"), "is_core_concept",
    )


def _rules(spark, sf):
    return LN.discover_synonyms(_records(spark, sf), _no_rules(spark), IN.NOW)


@query
def discover_synonyms(spark, sf):
    return _rules(spark, sf).select(
        "rule_type", "source_text", "target_text", F.to_json("rule_value").alias("rule_value"),
        F.round("confidence", 9).alias("confidence"),
    )


@query
def stored_rules(spark, sf):
    """Rules stored with their values as JSON text, read back and decoded."""
    root = _store(spark)
    TB.write_table(LN.rules_to_json(_rules(spark, sf)), root, "rules")
    text = TB.read_table(spark, root, "rules").withColumn("stored", F.col("rule_value"))
    return LN.rules_from_json(text).select(
        "source_text", "stored", F.size("rule_value").alias("n_values"), F.array_max("rule_value").alias("last_value")
    )


@query
def run_learning(spark, sf):
    records = _records(spark, sf)
    old = LN.keyword_weights(records, now=IN.NOW)
    weights, rules = LN.run_learning(records, _no_rules(spark), old, IN.NOW)
    a = weights.select(F.lit("weight").alias("kind"), "keyword", F.round("weight", 9).alias("v"))
    b = rules.select(
        F.lit("rule").alias("kind"), F.col("source_text").alias("keyword"),
        F.round("confidence", 9).alias("v"),
    )
    return a.unionByName(b)


@query
def top_keywords(spark, sf):
    shown = RK.top_keywords(_weights(spark, sf)).select(
        "keyword", F.round("weight", 9).alias("weight"), "match_count", "total_count"
    )
    return RK.in_place(shown, "position")


@query
def synonym_map(spark, sf):
    return LN.synonym_map(_rules(spark, sf)).select(
        "source_text", F.to_json(F.sort_array("synonyms")).alias("synonyms")
    )


@query
def rules_above(spark, sf):
    shown = FL.rules(_rules(spark, sf), "synonym", 0.71).select("source_text")
    return RK.in_place(shown, "position")


@query
def synonym_listing(spark, sf):
    shown = LN.synonym_listing(_rules(spark, sf)).select("source_text", "usage_count")
    return RK.in_place(shown, "position")


@query
def weighted_similarity(spark, sf):
    p = IN.probe_pairs(spark, sf).select("item_name", "quota_name").distinct()
    weights = F.create_map(
        F.lit("录像机"), F.lit(2.0), F.lit("混凝土浇筑"), F.lit(1.5), F.lit("监控"), F.lit(0.5)
    )
    a, b = T.keyword_set(F.col("item_name")), T.keyword_set(F.col("quota_name"))
    return p.select(
        "item_name", "quota_name",
        F.round(S.weighted_similarity(a, b, weights), 9).alias("score"),
    )


# --- sources and maintenance ------------------------------------------------


@query
def load_quotas(spark, sf):
    return IM.load_quotas(spark, f"{sf}/part.parquet", "parquet", version_id=7).drop("id")


@query
def load_quotas_csv(spark, sf):
    path = f"{staging_root(spark)}/catalogue-{uuid.uuid4().hex}"
    rows = TT.quotas(spark, sf, zh=True).select(*IM.QUOTA_LAYOUT)
    rows.write.option("header", True).csv(path)
    return IM.load_quotas(spark, path, "csv", version_id=7).drop("id")


@query
def load_items(spark, sf):
    rows = IM.load_items(spark, f"{sf}/customer.parquet", "parquet", user_id=3)
    return rows.select(
        "user_id", "item_code", "item_name", "feature_value", "unit", "quantity", "remark"
    )


@query
def load_quotas_into_version(spark, sf):
    rows = IM.load_quotas_into_version(
        spark, f"{sf}/part.parquet", "parquet", 5, IN.versions(spark, sf)
    )
    return rows.select("quota_code", "quota_name", "version_id")


@query
def insert_items(spark, sf):
    new = TT.read(spark, sf, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("item_name"),
        F.lit("kg").alias("unit"), F.col("s_acctbal").cast("decimal(18,2)").alias("quantity"),
    )
    return MT.insert_items(TT.items(spark, sf), new, 11).select(
        "id", "user_id", "item_name", "unit", "quantity", "match_status", "remark"
    )


def _patches(spark, sf):
    e = IN.edits(spark, sf)
    owner = TT.items(spark, sf).select(F.col("id").alias("item_id"), "user_id")
    prio = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    return e.join(owner, "item_id").select(
        "item_id", "edit_seq",
        F.when(prio == "5-LOW", -1).otherwise(F.col("user_id")).cast("bigint").alias("user_id"),
        F.when(prio == "1-URGENT", " ").otherwise(F.concat(F.lit("n "), prio)).alias("item_name"),
        (status == "F").alias("set_item_name"),
        F.when(prio != "2-HIGH", F.col("price")).alias("quantity"),
        (status != "F").alias("set_quantity"),
    )


@query
def patch_items(spark, sf):
    out, _ = MT.patch_items(IN.settled_items(spark, sf), _patches(spark, sf))
    return out.select("id", "item_name", "quantity", "total_price", "match_status")


@query
def patch_items_rejects(spark, sf):
    _, bad = MT.patch_items(IN.settled_items(spark, sf), _patches(spark, sf))
    return bad.select("item_id", "edit_seq")


def _quota_changes(spark, sf):
    s = TT.read(spark, sf, "supplier")
    price = F.col("s_acctbal").cast("decimal(18,2)")
    insert = F.col("s_nationkey") < 5
    return s.select(
        F.when(insert, -F.col("s_suppkey") - 1)
        .when(F.col("s_nationkey") == 24, F.col("s_suppkey") + 10**9)
        .otherwise(F.col("s_suppkey")).alias("id"),
        F.when(insert, "insert").otherwise("update").alias("op"),
        F.col("s_suppkey").alias("edit_seq"), F.lit("S").alias("quota_code"),
        F.col("s_name").alias("quota_name"), F.lit(None).cast("string").alias("feature_value"),
        F.lit("t").alias("unit"), price.alias("unit_price"), price.alias("labor_cost"),
        price.alias("material_cost"), price.alias("machine_cost"),
        F.lit("changed").alias("remark"), F.lit(99).cast("bigint").alias("version_id"),
    )


@query
def upsert_quotas(spark, sf):
    out, _ = MT.upsert_quotas(TT.quotas(spark, sf), _quota_changes(spark, sf))
    return out


@query
def upsert_quotas_rejects(spark, sf):
    _, bad = MT.upsert_quotas(TT.quotas(spark, sf), _quota_changes(spark, sf))
    return bad.select("id", "op", "edit_seq")


@query
def delete_quotas(spark, sf):
    ids = TT.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return MT.delete_quotas(TT.quotas(spark, sf), ids).select("id", "quota_code")


def _version_changes(spark, sf):
    """New and renamed versions: some names are borne, set free, or claimed in vain before."""
    n = TT.read(spark, sf, "nation")
    key = F.col("n_nationkey").cast("bigint")
    r = F.col("n_regionkey")

    def brand(k):
        return F.concat(F.lit("Brand#"), k.cast("string"))

    return n.select(
        F.when(r < 2, key + 100).when(key == 4, key + 900).when(key == 19, 9).otherwise(key)
        .alias("id"),
        F.when(r < 2, "insert").otherwise("update").alias("op"),
        F.when(r == 0, brand(key - 3)).when((r == 1) & (key % 2 == 0), brand(key))
        .when(r == 3, " ").when(key == 19, "moved").when(r == 4, "shared")
        .otherwise(F.col("n_name")).alias("version_name"),
        F.when(r != 2, F.col("n_name")).alias("description"), key.alias("edit_seq"),
    )


@query
def upsert_versions(spark, sf):
    out, _ = MT.upsert_versions(IN.versions(spark, sf), _version_changes(spark, sf), IN.NOW)
    return out.select("id", "version_name", "description")


@query
def upsert_versions_rejects(spark, sf):
    _, bad = MT.upsert_versions(IN.versions(spark, sf), _version_changes(spark, sf), IN.NOW)
    return bad.select("id", "op", "edit_seq")


def _old_versions(spark, sf):
    """Versions named like a nation of the first region."""
    n = TT.read(spark, sf, "nation").filter("n_regionkey = 0")
    return n.select(F.col("n_nationkey").cast("bigint").alias("id"))


@query
def delete_versions(spark, sf):
    _, quotas, _ = MT.delete_versions(
        IN.versions(spark, sf), TT.quotas(spark, sf), _old_versions(spark, sf)
    )
    return quotas.select("id", "version_id")


@query
def delete_versions_kept(spark, sf):
    kept, _, _ = MT.delete_versions(
        IN.versions(spark, sf), TT.quotas(spark, sf), _old_versions(spark, sf)
    )
    return kept.select("id", "version_name")


@query
def delete_versions_count(spark, sf):
    _, _, n = MT.delete_versions(
        IN.versions(spark, sf), TT.quotas(spark, sf), _old_versions(spark, sf)
    )
    return n


@query
def delete_items(spark, sf):
    items, links = _base(spark, sf)
    ids = IN.edits(spark, sf).select(F.col("item_id").alias("id"))
    out, _ = MT.delete_items(items, links, ids, 7)
    return out.select("id", "user_id")


@query
def delete_items_links(spark, sf):
    ids = IN.edits(spark, sf).select(F.col("item_id").alias("id"))
    _, kept = MT.delete_items(*_base(spark, sf), ids, 7)
    return kept.select("id", "project_item_id")


def _item_ids(spark, sf):
    return IN.edits(spark, sf).select(F.col("item_id").alias("id"))


@query
def remove_item_quotas_rejects(spark, sf):
    """Links asked by item and part: some items hold no such link."""
    e = IN.edits(spark, sf)
    ids = e.select((F.col("item_id") * IN.LINK_BASE + F.col("quota_id")).alias("id"))
    ids = ids.unionByName(_some_links(spark, sf).select("id"))
    return RJ.unknown_ids(IN.item_quotas(spark, sf), ids)


@query
def clear_item_quotas_rejects(spark, sf):
    return RJ.unknown_ids(IN.settled_items(spark, sf), _item_ids(spark, sf))


@query
def delete_items_rejects(spark, sf):
    return RJ.undeletable_items(IN.settled_items(spark, sf), _item_ids(spark, sf), 7)


@query
def delete_quotas_rejects(spark, sf):
    ids = TT.read(spark, sf, "supplier").select((F.col("s_suppkey") * 50).alias("id"))
    return RJ.unknown_ids(TT.quotas(spark, sf), ids)


@query
def delete_versions_rejects(spark, sf):
    ids = TT.read(spark, sf, "nation").select((F.col("n_nationkey").cast("bigint") * 3).alias("id"))
    return RJ.unknown_ids(IN.versions(spark, sf), ids)


@query
def clear_items(spark, sf):
    """Rows left by table once the bill is emptied."""
    bill, links = MT.clear_items(*_base(spark, sf))
    left = {"items": bill, "links": links, "quotas": TT.quotas(spark, sf)}
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("kept"), "n_rows")
        for k, df in left.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def stored_quotas(spark, sf):
    """One version of the catalogue, stored by version and read back."""
    root = _store(spark)
    TB.write_table(TT.quotas(spark, sf), root, "quotas")
    kept = FL.scope_version(TB.read_table(spark, root, "quotas"), 5)
    return kept.select("id", "quota_code", "unit_price", F.col("version_id").cast("bigint").alias("version_id"))


@query
def upsert_quotas_stored(spark, sf):
    """A batch of new and changed catalogue rows, merged into a sharded table."""
    kept = ShardedTable(spark, _store(spark), QUOTA_FIELDS, shards=16)
    kept.write(TT.quotas(spark, sf))
    kept.merge(_quota_changes(spark, sf), MT.upsert_quotas)
    return kept.read()


@query
def delete_quotas_stored(spark, sf):
    kept = ShardedTable(spark, _store(spark), QUOTA_FIELDS, shards=16)
    kept.write(TT.quotas(spark, sf))
    ids = TT.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    kept.merge(ids, lambda rows, gone: (MT.delete_quotas(rows, gone), RJ.unknown_ids(rows, gone)))
    return kept.read().select("id", "quota_code")


@query
def patch_items_stored(spark, sf):
    kept = ShardedTable(spark, _store(spark), ITEM_FIELDS, shards=16)
    kept.write(IN.settled_items(spark, sf))
    kept.merge(_patches(spark, sf), MT.patch_items, key="item_id")
    return kept.read().select("id", "item_name", "quantity", "total_price", "match_status")


@query
def price_override_bucketed(spark, sf):
    """Prices set by hand on a bill stored in buckets, which the edits join in place."""
    items, links = _base(spark, sf)
    kept = TB.write_bucketed(items, f"bill_{uuid.uuid4().hex}", _store(spark))
    return PR.apply_price_override(kept, links, IN.edits(spark, sf))[0].select(*ITEM_VIEW)


# --- templates --------------------------------------------------------------


def _replacement_sets(spark, sf):
    """Stored replacement sets, and those of some customers still to be stored."""
    sets = IN.value_rules(spark, sf).select(
        F.col("c_custkey").alias("id"), "c_nationkey",
        F.to_json(TP.parse_replacements(F.col("rules"))).alias("replacements"),
    )
    late = F.col("c_nationkey") < 5
    return sets.filter(~late), sets.filter(late)


@query
def save_replacement_sets(spark, sf):
    return MT.save_replacement_sets(*_replacement_sets(spark, sf)).select(
        "id", F.get_json_object("replacements", "$['${nation}']").alias("nation")
    )


@query
def delete_replacement_sets(spark, sf):
    old, _ = _replacement_sets(spark, sf)
    return MT.delete_replacement_sets(old, old.filter("c_nationkey > 20").select("id")).select("id")



@query
def parse_replacements(spark, sf):
    parsed = TP.parse_replacements(F.col("rules"))
    return IN.value_rules(spark, sf).select("c_custkey", F.explode(parsed).alias("k", "v"))


@query
def replacements_from_json(spark, sf):
    parsed = TP.replacements_from_json(F.col("props"))
    return TT.read(spark, sf, "events").select("event_id", F.explode(parsed).alias("k", "v"))


@query
def render_batch_query(spark, sf):
    rules = IN.value_rules(spark, sf)
    n = TT.read(spark, sf, "nation")
    templates = n.select(
        F.col("n_nationkey").alias("template_id"),
        F.concat(F.lit("Dear ${name} of "), "n_name",
                 F.lit(" (${nation}), ${seg} ${empty} ${name}")).alias("text"),
    )
    sets = rules.select(
        F.col("c_custkey").alias("set_id"),
        TP.parse_replacements(F.col("rules")).alias("replacements"),
    )
    jobs = rules.select(
        F.col("c_nationkey").alias("template_id"), F.col("c_custkey").alias("set_id")
    )
    return render_batch(templates, sets, jobs)


QUERIES["render_batch"] = QUERIES.pop("render_batch_query")


@query
def status_texts(spark, sf):
    items = TT.items(spark, sf)
    return items.select(
        "id", M.status_text(F.col("match_status")).alias("status"),
        M.ui_text(F.col("unit")).alias("unit"),
        M.learning_weight(F.col("match_status")).alias("learning_weight"),
    )

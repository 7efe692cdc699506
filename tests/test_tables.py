"""Overrides, links, maintenance, learning, sources and templates."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from billrate.functions import money as M
from billrate.functions import templates as TP
from billrate.operators import filters as FL
from billrate.operators import maintenance as MT
from billrate.operators import pricing as PR
from billrate.operators import ranking as RK
from billrate.plans import learning as LN
from billrate.plans.matching import match_items
from billrate.schemas import (
    ITEM_FIELDS, ITEM_QUOTA_FIELDS, QUOTA_FIELDS, RECORD_FIELDS, RULE_FIELDS, WEIGHT_FIELDS,
    conform, ddl,
)
from billrate.sources import imports as IM
from billrate.sources import reports as RP
from billrate.sources import tables as TB

NOW = "2025-01-01 00:00:00"


def rows(spark, fields, data):
    return spark.createDataFrame(
        [tuple(d.get(f) for f in fields) for d in data], ddl(fields)
    )


@pytest.fixture
def quotas(spark):
    return rows(spark, QUOTA_FIELDS, [
        dict(id=1, quota_code="Q001", quota_name="混凝土浇筑", feature_value="C30厚度200mm",
             unit="m³", unit_price=D("350.00"), version_id=1),
        dict(id=2, quota_code="Q002", quota_name="钢筋绑扎", feature_value="HRB400直径12mm",
             unit="t", unit_price=D("4500.00"), version_id=2),
        dict(id=3, quota_code="Q003", quota_name="no price", version_id=2),
    ])


@pytest.fixture
def items(spark):
    return rows(spark, ITEM_FIELDS, [
        dict(id=1, user_id=5, item_code="I001", item_name="混凝土浇筑",
             feature_value="C30厚度200mm", unit="m³", quantity=D("100.00"), match_status=0),
        dict(id=2, user_id=5, item_name="钢筋绑扎", feature_value="HRB400直径12mm", unit="t",
             quantity=D("50.00"), match_status=None),
        dict(id=3, user_id=6, item_name="混凝土浇筑", unit=" ", quantity=D("1.00"),
             match_status=1, matched_quota_id=1, total_price=D("9.00")),
        dict(id=4, user_id=6, item_name="zzz", unit="t", quantity=D("1.00"), match_status=1,
             matched_quota_id=2, matched_unit_price=D("2.00"), total_price=D("2.00")),
        dict(id=5, user_id=6, item_name="混凝土浇筑", unit="t", quantity=None, match_status=2,
             matched_quota_id=2, total_price=D("7.00")),
        dict(id=6, user_id=6, item_name="no price", unit="t", quantity=D("2.00"),
             match_status=0, total_price=D("8.00")),
    ])


@pytest.fixture
def links(spark):
    return rows(spark, ITEM_QUOTA_FIELDS, [
        dict(id=10, project_item_id=1, quota_id=2, quota_code="Q002", quota_name="钢筋绑扎",
             unit_price=D("4500.00"), sort_order=0),
    ])


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_match_examples_and_kept_values(spark, items, quotas):
    got = by_id(match_items(items, quotas, with_score=True))
    assert (got[1]["matched_quota_code"], got[1]["total_price"]) == ("Q001", D("35000.00"))
    assert got[1]["match_score"] == pytest.approx(0.85)  # below 1 even for equal texts
    assert got[2]["total_price"] == D("225000.00")
    # Unmatched rows keep their old match columns.
    assert (got[3]["match_status"], got[3]["total_price"]) == (0, D("9.00"))
    assert (got[4]["match_status"], got[4]["matched_quota_id"]) == (0, 2)
    assert (got[5]["match_status"], got[5]["matched_quota_id"]) == (2, 2)
    # A quota without a price leaves the old total.
    assert (got[6]["match_status"], got[6]["total_price"]) == (1, D("8.00"))


def test_clear_stale_and_empty_catalogue(items, quotas):
    got = by_id(match_items(items, quotas.limit(0), clear_stale=True))
    assert [got[i]["match_status"] for i in range(1, 7)] == [0, 0, 0, 0, 2, 0]
    assert got[4]["total_price"] is None and got[5]["total_price"] == D("7.00")


def test_scopes(items, quotas):
    got = by_id(match_items(items, quotas, version_id=2, user_id=5))
    assert set(got) == {1, 2}
    assert got[1]["match_status"] == 0 and got[2]["match_status"] == 1


def test_input_order_does_not_matter(items, quotas):
    a = by_id(match_items(items, quotas))
    b = by_id(match_items(items.repartition(7), quotas.orderBy(F.desc("id"))))
    assert a == b


def test_manual_match(spark, items, links, quotas):
    edits = spark.createDataFrame(
        [(1, 1, 1), (1, 2, 2), (1, 99, 3), (77, 1, 4)],
        "item_id bigint, quota_id bigint, edit_seq bigint",
    )
    out, kept, bad = PR.apply_manual_match(items, links, edits, quotas)
    row = by_id(out)[1]
    assert (row["matched_quota_id"], row["match_status"]) == (2, 2)
    assert row["total_price"] == D("450000.00")
    assert kept.count() == 0
    assert sorted(r["edit_seq"] for r in bad.collect()) == [3, 4]


def test_price_override_keeps_quota_and_total_without_quantity(spark, items, links):
    prices = spark.createDataFrame(
        [(5, D("3.00"), 1), (4, D("1.155"), 2)], "item_id bigint, price decimal(18,3), edit_seq bigint"
    )
    out, _, _ = PR.apply_price_override(items, links, prices)
    got = by_id(out)
    assert (got[5]["matched_quota_id"], got[5]["total_price"]) == (2, D("7.00"))
    assert got[4]["matched_unit_price"] == D("1.16")


def test_add_and_remove_links(spark, items, links, quotas):
    additions = spark.createDataFrame(
        [(100, 1, 1, 1), (101, 1, 2, 2), (102, 1, 1, 3), (103, 2, 3, 4), (104, 2, 1, 5)],
        "link_id bigint, item_id bigint, quota_id bigint, seq bigint",
    )
    out, new, bad = PR.add_item_quotas(items, links, additions, quotas)
    assert sorted(r["link_id"] for r in bad.collect()) == [101, 102]
    order = {r["id"]: r["sort_order"] for r in new.collect()}
    assert order == {10: 0, 100: 1, 103: 0, 104: 1}
    got = by_id(out)
    assert (got[1]["match_status"], got[1]["matched_unit_price"]) == (3, D("4850.00"))
    assert got[1]["matched_quota_id"] is None
    assert got[2]["total_price"] == D("17500.00")  # the missing price counts as 0
    ids = spark.createDataFrame([(100,), (10,)], "id bigint")
    again, left = PR.remove_item_quotas(out, new, ids)
    row = by_id(again)[1]
    assert (row["match_status"], row["matched_unit_price"], row["total_price"]) == (3, None, None)
    cleared, left = PR.clear_item_quotas(
        again, left, spark.createDataFrame([(2,)], "item_id bigint")
    )
    assert by_id(cleared)[2]["match_status"] == 0 and left.count() == 0


def test_multi_item_with_a_single_quota_learns_that_quota(spark, items, links, quotas):
    """Adding links leaves the single quota, and learning prefers it."""
    additions = spark.createDataFrame(
        [(100, 4, 1, 1), (101, 1, 1, 2)],
        "link_id bigint, item_id bigint, quota_id bigint, seq bigint",
    )
    out, new, _ = PR.add_item_quotas(items, links, additions, quotas)
    pairs = LN.learning_pairs(out.filter("id in (1, 4)"), new, quotas).collect()
    got = sorted((p["item_name"], p["quota_name"], p["match_type"]) for p in pairs)
    assert got == [
        ("zzz", "钢筋绑扎", 3), ("混凝土浇筑", "混凝土浇筑", 3), ("混凝土浇筑", "钢筋绑扎", 3)
    ]


def test_report(items, links):
    multi = items.withColumn("match_status", F.when(F.col("id") == 1, 3).otherwise(F.col("match_status")))
    got = {r["seq_no"]: r for r in RP.export_items(multi, links).collect()}
    assert got[1]["quota_codes"] == "Q002" and got[1]["quota_feature"] == "多定额组合"
    assert got[1]["detail"] == "1. Q002 - 钢筋绑扎 (单价: 4500.00元)"
    assert (got[2]["status"], got[2]["unit_price"], got[2]["item_code"]) == ("", D("0.00"), "")
    assert got[5]["status"] == "手动修改"


def test_numbering_in_pieces(spark):
    df = spark.range(0, 5000).select((F.col("id") * F.col("id")).alias("id"))
    got = [r["seq_no"] for r in RK.with_sequence(df).orderBy("id").collect()]
    assert got == list(range(1, 5001))


def test_csv_round_trip(spark, items, links, quotas, tmp_path):
    path = str(tmp_path / "bill")
    RP.write_report(RP.export_items(items, links), path, RP.ITEM_HEADINGS)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == RP.ITEM_HEADINGS and back.count() == 6


def test_import_cells(spark, tmp_path):
    file = tmp_path / "q.csv"
    file.write_text(
        "code,name,feature,unit,price,labor\n Q1 ,n,,m, 12.5 ,abc\nQ2,x,y,z,1e3,\n", "utf-8"
    )
    got = IM.load_quotas(spark, str(file), "csv", 4).orderBy("quota_code").collect()
    assert (got[0]["quota_code"], got[0]["feature_value"], got[0]["unit_price"]) == (
        "Q1", "", D("12.50"))
    assert (got[0]["labor_cost"], got[0]["machine_cost"], got[0]["remark"]) == (
        D("0.00"), D("0.00"), None)
    assert got[1]["unit_price"] == D("1000.00") and got[1]["version_id"] == 4
    table = tmp_path / "items"
    spark.sql("select 7.0D a, true b, 2.5D c, 't' d, true e, 'r' f").write.parquet(str(table))
    item = IM.load_items(spark, str(table), "parquet", 9).first()
    assert (item["item_code"], item["item_name"], item["feature_value"]) == ("7", "true", "2.5")
    assert (item["quantity"], item["remark"], item["user_id"]) == (D("0.00"), "r", 9)


def test_import_into_missing_version(spark, quotas):
    with pytest.raises(ValueError):
        IM.load_quotas_into_version(spark, "/nowhere", "csv", 9, spark.range(3).toDF("id"))


def test_catalogue_is_stored_by_version(spark, quotas, tmp_path):
    TB.write_table(quotas, str(tmp_path), "quotas")
    back = FL.scope_version(TB.read_table(spark, str(tmp_path), "quotas"), 2)
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(version_id" in back._jdf.queryExecution().toString()


def test_rounding_half_up(spark):
    got = spark.sql("select 1.15BD q, 0.10BD p").select(M.line_total(F.col("q"), F.col("p")))
    assert got.first()[0] == D("0.12")


def test_search_wildcards_and_case(quotas):
    assert FL.search_quotas(quotas, "no_pr").count() == 1
    assert FL.search_quotas(quotas, "NO").count() == 0
    assert FL.search_quotas(quotas, "NO", ignore_case=True).count() == 1
    assert FL.contains_filter(quotas, "quota_name", "no_pr").count() == 0


def test_patch_and_versions(spark, items):
    patches = spark.createDataFrame(
        [(1, 5, 1, "a", True, None, True), (1, 5, 2, " ", True, D("2.00"), True),
         (4, 5, 3, "b", True, None, False), (4, 6, 4, None, False, D("3.00"), True)],
        "item_id bigint, user_id bigint, edit_seq bigint, item_name string, "
        "set_item_name boolean, quantity decimal(18,2), set_quantity boolean",
    )
    out, bad = MT.patch_items(items, patches)
    got = by_id(out)
    assert (got[1]["item_name"], got[1]["quantity"]) == ("a", D("100.00"))
    assert got[4]["total_price"] == D("6.00")
    assert sorted(r["edit_seq"] for r in bad.collect()) == [2, 3]


def test_versions_judged_in_order(spark):
    versions = spark.sql(
        "select id, concat('v', id) version_name, 'd' description, timestamp'2024-01-01' create_time, "
        "timestamp'2024-01-01' update_time from (select explode(array(1L, 2L, 3L)) id)"
    )
    changes = spark.createDataFrame(
        [("update", 999, "X", None, 1), ("insert", 50, "X", None, 2),   # a refused claim is none
         ("update", 1, "Y", None, 3), ("insert", 51, "v1", None, 4),    # a rename frees the name
         ("update", 2, "v3", None, 5), ("update", 3, "Z", None, 6), ("update", 2, "v3", "e", 7),
         ("update", 50, "W", "f", 8), ("insert", 52, "X", None, 9),     # of a version of this batch
         ("update", 53, None, "g", 10), ("insert", 53, "V", None, 11), ("update", 53, " ", "h", 12),
         ("insert", 54, "Y", None, 13), ("insert", 55, None, None, 14), ("insert", 56, "U", None, None)],
        "op string, id bigint, version_name string, description string, edit_seq bigint",
    )
    out, bad = MT.upsert_versions(versions, changes, "2025-01-01 00:00:00")
    got = {r["id"]: (r["version_name"], r["description"]) for r in out.collect()}
    assert got == {
        1: ("Y", "d"), 2: ("v3", "e"), 3: ("Z", "d"), 50: ("W", "f"), 51: ("v1", None),
        52: ("X", None), 53: ("V", "h"),
    }
    assert sorted((r["edit_seq"] or 0) for r in bad.collect()) == [0, 1, 5, 10, 13, 14]


def test_numbering_within_keys_and_pieces(spark):
    df = spark.range(20_000).selectExpr(
        "id * 7919 % 20000 as o", "if(id % 3 = 0, null, if(id % 5 = 0, 'b', 'hot')) as k"
    ).repartition(7)
    got = RK.numbered(df, "o", "n", ["k"]).collect()
    for key in (None, "b", "hot"):
        group = sorted((r["o"], r["n"]) for r in got if r["k"] == key)
        assert [n for _, n in group] == list(range(1, len(group) + 1))
    assert RK.numbered(df.limit(0), "o", "n", ["k"]).count() == 0


def test_replacement_sets(spark):
    sets = spark.sql("select 1L id, 'a' template_name union all select 2L, 'b'")
    more = MT.save_replacement_sets(sets, spark.sql("select 3L id, 'c' template_name"))
    left = MT.delete_replacement_sets(more, spark.sql("select 2L id"))
    assert sorted(r["id"] for r in left.collect()) == [1, 3]


def test_delete_items_only_own(spark, items, links):
    ids = spark.sql("select explode(array(1L, 4L)) id")
    out, left = MT.delete_items(items, links, ids, 5)
    assert set(by_id(out)) == {2, 3, 4, 5, 6} and left.count() == 0


def _records(spark, n, match_type, weight):
    return rows(spark, RECORD_FIELDS, [
        dict(id=i, item_name=f"n{i % 3}", quota_name="q", match_type=match_type,
             item_keywords=["ab", f"w{i % 3}"], common_keywords=["ab"], learning_weight=weight)
        for i in range(n)
    ])


def test_learning_limits(spark):
    rules = spark.createDataFrame([], ddl(RULE_FIELDS))
    assert LN.keyword_weights(_records(spark, 9, 1, 0.5)).count() == 0
    auto = LN.keyword_weights(_records(spark, 10, 1, 0.5), now=NOW).first()
    assert (auto["weight"], auto["match_count"], auto["total_count"]) == (0.5, 0, 10)
    old = rows(spark, WEIGHT_FIELDS, [
        dict(keyword="zz", weight=1.5, match_count=1, total_count=1),
        dict(keyword="ab", weight=1.5, match_count=9, total_count=9, is_core_concept=True),
    ])
    both = {r["keyword"]: r for r in LN.keyword_weights(
        _records(spark, 10, 2, 1.0), old, now=NOW).collect()}
    assert both["zz"]["weight"] == 1.5
    assert (both["ab"]["weight"], both["ab"]["total_count"], both["ab"]["is_core_concept"]) == (
        2.0, 10, True)
    assert LN.discover_synonyms(_records(spark, 4, 2, 1.0), rules, NOW).count() == 0
    assert LN.discover_synonyms(_records(spark, 9, 1, 0.5), rules, NOW).count() == 0
    found = LN.discover_synonyms(_records(spark, 5, 2, 1.0), rules, NOW)
    rule = found.first()
    assert found.count() == 1 and rule["source_text"] == "ab"
    assert rule["rule_value"] == ["n0", "n1", "n2"]
    assert rule["confidence"] == pytest.approx(0.7 + 3 / 5 * 0.3)
    assert LN.discover_synonyms(_records(spark, 5, 2, 1.0), found, NOW).count() == 0


def test_synonym_map_last_wins_and_skips_bad_json(spark):
    raw = spark.sql(
        "select 'synonym' rule_type, 'a' source_text, 'a' target_text, '[\"x\"]' rule_value, "
        "0.9D confidence union all select 'synonym', 'a', 'a', '[\"y\"]', 0.8D "
        "union all select 'synonym', 'b', 'b', 'oops', 0.9D"
    )
    rules = conform(LN.rules_from_json(raw), RULE_FIELDS)
    got = {r["source_text"]: r["synonyms"] for r in LN.synonym_map(rules).collect()}
    assert got == {"a": ["y"]}


def test_templates(spark):
    text = " ${a} = 1=2 \nx=1\n${b}=\n${a}=3\n\n${c}=${a}"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = [r[0] for r in df.select(TP.parse_replacements(F.col("t"))).collect()]
    assert got == [{"${a}": "3", "${c}": "${a}"}, {}]
    filled = df.limit(1).select(TP.render_template(
        F.lit("${a} ${b} ${c}"), TP.parse_replacements(F.col("t"))).alias("v"))
    assert filled.first()["v"] == "3 ${b} ${a}"
    stored = spark.createDataFrame([('{"名": " v ", "e": ""}',), ("bad",)], "j string")
    maps = [r[0] for r in stored.select(TP.replacements_from_json(F.col("j"))).collect()]
    assert maps == [{"${名}": "v"}, {}]

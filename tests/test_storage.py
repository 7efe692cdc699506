"""Sharded and bucketed tables, and learning from a growing log."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from billrate.operators import maintenance as MT
from billrate.operators import pricing as PR
from billrate.operators import rejects as RJ
from billrate.plans import incremental as IC
from billrate.plans import learning as LN
from billrate.schemas import ITEM_FIELDS, ITEM_QUOTA_FIELDS, QUOTA_FIELDS, RECORD_FIELDS, conform, ddl
from billrate.session import stage
from billrate.sources import shards, trade_tables
from billrate.sources.shards import ShardedTable
from billrate.sources.tables import write_bucketed
from suite import inputs


def _quotas(spark, n):
    return conform(spark.range(n), QUOTA_FIELDS, quota_name=F.concat(F.lit("q"), F.col("id")), unit_price=F.col("id"))


def _files(path):
    return {os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def _sorted(df):
    return sorted(map(str, df.collect()))


def _delete(rows, ids):
    return MT.delete_quotas(rows, ids), RJ.unknown_ids(rows, ids)


def test_merges_rewrite_only_the_shards_they_touch(spark, tmp_path):
    path = str(tmp_path / "quotas")
    kept = ShardedTable(spark, path, QUOTA_FIELDS, shards=8)
    base = _quotas(spark, 200)
    kept.write(base)
    before = _files(path)
    changes = conform(
        spark.sql("select 5L id, 'update' op, 1L edit_seq union all select 900, 'insert', 2 union all select 901, 'update', 3"),
        {**QUOTA_FIELDS, "op": "string", "edit_seq": "bigint"}, quota_name=F.lit("new"),
    )
    want, rejects = MT.upsert_quotas(base, changes)
    got = kept.merge(changes, MT.upsert_quotas)
    assert _sorted(kept.read()) == _sorted(want) and _sorted(got) == _sorted(rejects)
    touched = kept.touched(changes)
    still = {f for f in before if int(re.search(r"shard=(\d+)", f).group(1)) not in touched}
    gone = before - _files(path)
    assert still and not gone & still and gone == before - still


def test_emptied_shards_and_empty_batches(spark, tmp_path):
    kept = ShardedTable(spark, str(tmp_path / "quotas"), QUOTA_FIELDS, shards=8)
    kept.write(_quotas(spark, 6))
    ids = spark.range(3, 9)
    assert sorted(r["id"] for r in kept.merge(ids, _delete).collect()) == [6, 7, 8]
    assert sorted(r["id"] for r in kept.read().collect()) == [0, 1, 2]
    files = _files(kept.path)
    assert kept.merge(ids.limit(0), _delete).count() == 0 and _files(kept.path) == files
    kept.merge(spark.range(9), _delete)
    assert kept.read().count() == 0
    kept.merge(conform(_quotas(spark, 2).withColumn("op", F.lit("insert")).withColumn("edit_seq", F.col("id")),
                       {**QUOTA_FIELDS, "op": "string", "edit_seq": "bigint"}), MT.upsert_quotas)
    assert kept.read().count() == 2


def test_a_change_must_stay_within_its_keys(spark, tmp_path):
    kept = ShardedTable(spark, str(tmp_path / "quotas"), QUOTA_FIELDS, shards=64)
    kept.write(_quotas(spark, 4))
    with pytest.raises(ValueError, match="no change names"):
        kept.merge(spark.range(1), lambda rows, ids: (_quotas(spark, 90), ids))
    assert kept.read().count() == 4


def _moved(plan, table):
    """Whether an exchange of the plan lies above a scan of ``table``."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[\s:+\-*()0-9]*", line).group()) for line in lines]
    for i, line in enumerate(lines):
        if re.search(r"\bExchange\b", line):
            for k in range(i + 1, len(lines)):
                if depth[k] <= depth[i]:
                    break
                if table in lines[k]:
                    return True
    return False


def test_change_sets_join_a_bucketed_bill_in_place(spark, tmp_path):
    plain = conform(spark.range(500), ITEM_FIELDS, quantity=F.col("id"), total_price=F.lit(1), user_id=F.lit(7))
    bill = write_bucketed(plain, "bucketed_bill", str(tmp_path / "bill"))
    links = spark.createDataFrame([], ddl(ITEM_QUOTA_FIELDS))
    edits = spark.range(0, 900, 3).select(F.col("id").alias("item_id"), F.col("id").alias("edit_seq"), F.lit(2).alias("price"))
    patches = edits.select("item_id", "edit_seq", F.lit(7).cast("bigint").alias("user_id"), F.lit("n").alias("item_name"),
                           F.lit(True).alias("set_item_name"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        overridden = PR.apply_price_override(bill, links, edits)[0]
        patched = MT.patch_items(bill, patches)[0]
        shown = overridden._jdf.queryExecution().executedPlan().toString()
        assert not _moved(shown, "bucketed_bill") and "bucketed_bill" in shown
        copy = PR.apply_price_override(plain.repartition(5), links, edits)[0]
        assert "Exchange" in copy._jdf.queryExecution().executedPlan().toString()
        assert _sorted(overridden) == _sorted(copy)
        assert _sorted(patched) == _sorted(MT.patch_items(plain, patches)[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop table bucketed_bill")


def test_learning_in_any_batches_equals_the_whole_log(spark):
    rng = random.Random(3)
    rows = [(k, rng.sample(["a", "b", "c", "d", "e"], rng.randint(0, 4)), rng.choice([0.5, 1.0])) for k in range(60)]
    log = conform(spark.createDataFrame(rows, "id bigint, common_keywords array<string>, learning_weight double"), RECORD_FIELDS)
    want = _sorted(LN.keyword_weights(log, now="2025-01-01"))
    for ends in ([4, 5, 59], [30, 30, 59]):
        state = None
        for end in ends:
            state = IC.advance(log.filter(F.col("id") <= end), state)
            if end < 9:
                assert IC.learned_weights(state).count() == 0
        assert _sorted(IC.learned_weights(state, now="2025-01-01")) == want
    empty = IC.advance(log.limit(0))
    assert IC.learned_weights(empty).count() == 0
    assert _sorted(IC.learned_weights(IC.advance(log, empty), now="2025-01-01")) == want


def test_a_merge_writes_rows_once_and_moves_them_into_place(spark, tmp_path, monkeypatch):
    kept = ShardedTable(spark, str(tmp_path / "quotas"), QUOTA_FIELDS, shards=8)
    kept.write(_quotas(spark, 100))
    staged = {}

    def watch(df, label, **kw):
        out = stage(df, label, **kw)
        if label == "shard-rows":
            staged.update({os.path.basename(f): os.path.getsize(f) for f in _files(out.inputFiles()[0].split("file://")[-1].rsplit("/", 2)[0])})
        return out

    monkeypatch.setattr(shards, "stage", watch)
    kept.merge(spark.range(10), _delete)
    stored = {os.path.basename(f) for f in _files(kept.path)}
    assert staged and set(staged) <= stored  # the files written first are those in place
    assert sorted(r["id"] for r in kept.read().collect()) == list(range(10, 100))
    assert not [d for d in os.listdir(kept.path) if d.startswith("_old")]


@pytest.mark.parametrize("number", [3, 12])
def test_settled_bill_by_line_equals_the_join_by_id(spark, tmp_path, number):
    # (1, 12) and (2, 2) have one id, 22: its items take each other's settlement.
    rows = [(1, number, 5, 7, 2.0, "N", 0.02, 0.09), (2, 2, 6, 8, 3.0, "R", 0.01, 0.04), (2, 2, 5, 8, 1.0, "A", 0.03, 0.1),
            (None, 1, 5, 7, 1.0, "N", 0.0, 0.0), (4, None, 6, 7, 1.0, "N", 0.0, 0.0), (5, 1, None, 7, 1.0, "N", 0.0, 0.0), (6, 1, 9, None, None, None, None, None)]
    cols = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_tax double, l_discount double"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(5, "red bolt", "LARGE", 10.0, "Brand#12"), (6, "new rod", None, 7.5, "Brand#13"), (6, "new rod", "SMALL", 7.5, "Brand#13"), (9, None, "x", None, None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_retailprice double, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    base = trade_tables.items(spark, str(tmp_path))
    got = inputs.settled_items(spark, str(tmp_path))
    # What each item's id stands for, spelled out by joins on the id.
    lines = trade_tables.bill_lines(spark, str(tmp_path)).selectExpr("l_orderkey * 10 + l_linenumber id", "l_partkey part", "discount")
    q = trade_tables.quotas(spark, str(tmp_path)).selectExpr("id part", "quota_name", "unit_price price")
    held = "case when discount <> 0.08 and discount <> 0.09 then"
    want = base.drop("matched_quota_name").join(lines, "id").join(q, "part").selectExpr(
        "id", "item_name", "feature_value", "quantity", f"{held} quota_name end matched_quota_name", f"{held} cast(quantity * price as decimal(18,2)) end total_price",
    )
    clear = got.filter("match_status is null or match_status <> 3 or matched_quota_name is null")
    assert got.count() == want.count() > 2
    assert _sorted(clear.select(want.columns).filter("total_price is not null")) == _sorted(want.filter("total_price is not null"))


def test_a_merge_after_a_broken_one_finds_the_old_rows(spark, tmp_path):
    kept = ShardedTable(spark, str(tmp_path / "quotas"), QUOTA_FIELDS, shards=4)
    kept.write(_quotas(spark, 40))
    number = kept.touched(spark.range(1))[0]
    os.rename(f"{kept.path}/shard={number}", f"{kept.path}/_old-shard={number}")
    kept.merge(spark.range(1), _delete)
    assert sorted(r["id"] for r in kept.read().collect()) == list(range(1, 40))
    assert not [d for d in os.listdir(kept.path) if d.startswith("_old")]

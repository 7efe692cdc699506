"""Tables that grow with the documents are not sent to the driver by an estimate that is too low."""

from pyspark.sql import functions as F

from billrate import session
from billrate.llm import linedup, neardup, simhash
from billrate.session import stage


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_at_anchors_are_shuffled_whatever_their_estimate(spark):
    # Some 60 copies a fingerprint, which the estimate takes for one.
    prints = stage(spark.range(50).select(F.xxhash64("id").alias("fp")), "prints")
    plan = _plan(simhash.links(prints))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_only_tiny_staged_tables_may_be_broadcast(spark, monkeypatch):
    small, large = (stage(spark.range(n).select("id", F.xxhash64("id").alias("x")), "sized") for n in (10, 200_000))
    plans = [_plan(spark.range(9).join(session.shuffled_if_large(t), "id")) for t in (small, large)]
    assert ["Broadcast" in p for p in plans] == [True, False]


def test_steps_of_the_pipeline_shuffle_what_is_not_tiny(spark, monkeypatch):
    monkeypatch.setattr(session, "TRUSTED_BYTES", 0, raising=False)
    suffixes = stage(spark.createDataFrame([(1, 1, 0, 2, 5), (1, 1, 1, 2, 6)], "dk long, tk long, i int, n int, r long"), "suffixes")
    nodes = stage(spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "node long, fp long"), "nodes")
    roots = stage(spark.createDataFrame([(2, 1)], "node long, root long"), "roots")
    pairs = nodes.select(F.col("node").alias("u"), (F.col("fp") - 6).alias("v"))
    for df in (linedup._pair_up(suffixes, 1), neardup._apart(pairs, roots)):
        plan = _plan(df)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan

"""Tables of words that grow with the texts are not sent to the driver by an estimate that is too low."""

import test_match as TM
from pyspark.sql import functions as F

from billrate import session
from billrate.plans import cells, relation
from billrate.plans.relation import KeywordRelation

SAID = [(k, f"red bolt number {k} of steel", "") for k in range(20)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_by_their_substrings_are_shuffled_whatever_their_estimate(spark, monkeypatch):
    plans, real = {}, relation.stage_together

    def caught(**frames):
        plans.update({label: _plan(df) for label, df in frames.items()})
        return real(**frames)

    monkeypatch.setattr(relation, "stage_together", caught)
    made = KeywordRelation(*TM._frames(spark, SAID, SAID))
    assert made.related.count() > 0
    assert "SortMergeJoin" in plans["related"] and "Broadcast" not in plans["related"]


def test_too_many_rows_are_never_broadcast(spark):
    few = session.stage(spark.range(10), "few")
    plans = [_plan(spark.range(9).join(session.broadcast_if_small(few, max_rows=n), "id")) for n in (10, 9)]
    assert ["Broadcast" in p for p in plans] == [True, False]


def test_cells_shuffle_what_is_not_tiny(spark, monkeypatch):
    monkeypatch.setattr(session, "TRUSTED_BYTES", 0, raising=False)
    plans, real = {}, cells.stage

    def caught(df, label, *args, **kw):
        plans[label] = _plan(df)
        return real(df, label, *args, **kw)

    monkeypatch.setattr(cells, "stage", caught)
    left, right = TM._frames(spark, SAID, SAID)
    best = KeywordRelation(left, right).celled().groupBy("tid").agg(F.max_by("qid", "score").alias("qid"))
    assert all(r.tid == r.qid for r in best.collect())
    for label in ("cell-items", "cell-quotas", "cell-pairs"):
        assert "SortMergeJoin" in plans[label] and "Broadcast" not in plans[label]

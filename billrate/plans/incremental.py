"""Keyword weights kept up to date from a growing log of records.

The state holds a keyword's counts and how far the log has been read.  Counts
of disjoint parts of the log add up, so each run reads only what came since,
and the weights equal those learned from the whole log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billrate.plans import learning as LN
from billrate.session import stage


@dataclass(frozen=True)
class LearningState:
    """``counts`` (keyword, match_count, total_count) and the one row ``progress`` (n_records, mark).

    Both are tables, to be stored between runs.
    """

    counts: DataFrame
    progress: DataFrame


def advance(log: DataFrame, state: LearningState | None = None, by: str = "id") -> LearningState:
    """The state after the records of ``log`` beyond its mark; without a state, after all of them.

    ``by`` must rise from batch to batch: a record at or below the mark, or
    without a value, counts as read.
    """
    mark = state and state.progress.first()["mark"]
    new = log.filter(F.col(by).isNotNull() if mark is None else F.col(by) > F.lit(mark))
    counts = LN.keyword_counts(new)
    progress = new.agg(F.count(F.lit(1)).alias("n_records"), F.max(by).alias("mark"))
    if state is not None:
        sums = [F.sum(c).alias(c) for c in ("match_count", "total_count")]
        counts = state.counts.unionByName(counts).groupBy("keyword").agg(*sums)
        progress = state.progress.unionByName(progress).agg(F.sum("n_records").alias("n_records"), F.max("mark").alias("mark"))
    return LearningState(stage(counts, "keyword-counts"), stage(progress, "learning-progress"))


def learned_weights(
    state: LearningState, existing: DataFrame | None = None, min_records: int = LN.MIN_RECORDS, now: str | None = None
) -> DataFrame:
    """What ``keyword_weights`` gives for the whole log."""
    if state.progress.first()["n_records"] < min_records:
        return existing if existing is not None else LN.no_weights(state.counts)
    return LN.weights_of(state.counts, existing, now)

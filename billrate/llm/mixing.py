"""Mixing sources to target weights, by native expressions only.

Sizes in words are summed per source.  The sources, in code-point order with null last,
share ``budget`` times all words by weight; a target stops at ``cap`` times its source,
and what is cut goes to the others by weight until none is above.  That rest point needs
no rounds: with the sources ordered by size over weight, those whose cap is below the
common level are a leading run, so one cumulative sum finds the level.  A document is then
taken ``floor(rate)`` times, and once more if a hash of its id falls under the fraction.

A null text has size 0, a null source is a source of its own, and a null id draws by the
text's hash.  Repeated rows draw alike.  An empty table gives an empty mix.  Sources of no
words have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billrate.llm.common import WORD
from billrate.session import stage

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2.0
SEED = "mix-1"


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP
) -> DataFrame:
    """One row per source: source, source_size and target.  Grows with the sources only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "place")
    whole = Window.partitionBy()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = (
        totals.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(cap))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(whole))
    )
    # If all sources up to here are full, what is left for those after them, per weight.
    rest = F.col("all_words") * F.lit(budget) - F.sum("cap").over(by_level)
    after = F.sum("weight").over(whole) - F.sum("weight").over(by_level)
    before = F.coalesce(F.lag("next_level").over(by_level), F.lit(budget) * F.col("all_words") / F.sum("weight").over(whole))
    levelled = placed.withColumn(
        "next_level", F.when(after > 0, rest / F.when(after > 0, after))
    ).withColumn("share", before)
    # The first source that is not full sets the level of all later ones.
    open_at = F.when(F.col("level") > F.col("share"), F.struct("level", "place", "share"))
    return (
        levelled.withColumn("first_open", F.min(open_at).over(whole))
        .withColumn(
            "target",
            F.when(F.col("level") > F.col("share"), F.col("first_open.share") * F.col("weight"))
            .otherwise(F.col("cap")),
        )
        .select("source", "source_size", "target")
    )


def draw(doc_id: str = "doc_id", text_hash: str = "text_hash", seed: str = SEED):
    """Uniform number of [0, 1) by the id, the same in every run."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.col(text_hash), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, text_hash, size, source_size, target, copies, taken."""
    sizes = stage(
        docs.select(
            "doc_id", "source", n_words().alias("size"),
            F.when(F.col("doc_id").isNull(), F.md5(F.col("text"))).alias("text_hash"),
        ), "mix-sizes",
    )
    targets = stage(source_targets(sizes, **options), "mix-targets")
    named = targets.withColumnRenamed("source", "named")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))
    return (
        sizes.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
        .withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .withColumn(
            "copies",
            (F.floor("rate") + F.when(draw() < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"),
        )
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with ``copy`` from 0.

    A column ``copy`` of ``docs`` gives way to it.
    Works out each row's copies from the source rates; only the rates are joined to the texts.
    """
    sizes = stage(docs.select("source", n_words().alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sizes")
    targets = stage(source_targets(sizes, **options), "mix-targets")
    safe = F.when(F.col("source_size") > 0, F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))
    rates = targets.select(F.col("source").alias("_mix_source"), F.coalesce(safe, F.lit(0.0)).alias("_mix_rate"))
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col("_mix_source")))
    rate = F.col("_mix_rate")
    copies = (
        joined.withColumn("_mix_hash", F.when(F.col("doc_id").isNull(), F.md5(F.col("text"))))
        .withColumn("_mix_n", (F.floor(rate) + F.when(draw("doc_id", "_mix_hash") < rate - F.floor(rate), 1).otherwise(0)).cast("int"))
        .filter("_mix_n > 0")
    )
    kept = [c for c in docs.columns if c.lower() != "copy"]
    return copies.select(*kept, F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1)).alias("copy"))

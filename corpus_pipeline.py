"""A corpus from raw documents: five stages, each on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billrate.llm import decontaminate, language, linedup, mixing, neardup
from billrate.llm.common import table
from billrate.session import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; what the model rejects goes."""
    model = language.train(docs)
    return language.classify(docs, model, name="_lang").filter("not _lang.rejected").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those that consist of such copies go."""
    cut = linedup.cut_runs(docs).filter("line_cut.n_removed = 0 or line_cut.n_removed < line_cut.n_lines")
    changed = F.col("line_cut.n_removed") > 0
    counted = {"n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))}
    if "n_chars" in docs.columns:
        cut = cut.withColumns(counted)
    return cut.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more.

    Candidates come from SimHash anchors; as 0.8 is some ten of 64 bits, MinHash bands add those
    beyond their two.  All are checked on the whole shingle sets.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clear(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, numbered by ``copy``."""
    return mixing.emit(docs)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("source_mix", source_mix),
]
# Hashes, a learned model and string alignment have no SQL form; a brute-force version tests it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Filling many templates with many sets of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billrate.functions.templates import render_template


def render_batch(templates: DataFrame, sets: DataFrame, jobs: DataFrame) -> DataFrame:
    """One filled text per job.

    ``templates`` has (template_id, text), ``sets`` (set_id, replacements) and
    ``jobs`` the wanted (template_id, set_id) pairs.
    """
    filled = jobs.join(templates, "template_id").join(sets, "set_id")
    return filled.select(
        "template_id", "set_id",
        render_template(F.col("text"), F.col("replacements")).alias("text"),
    )

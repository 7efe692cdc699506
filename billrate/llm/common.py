"""Pieces shared by the operators: words, document keys, folds, arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billrate.session import ship

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold no model learns from; a null id is in neither fold (false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """True for rows a model may learn from; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Key ``(dk, tk)`` of a document: its integer id (null comes first) and a hash of its text.

    Rows equal in both are one document to the operators that use this key.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("dk"),
        F.xxhash64(F.col(text)).alias("tk"),
    ]


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """Cut a column into runs of about ``limit`` bytes, so work arrays stay small.

    Yields the first row number and the values (null as None); a longer text is a run of its own.
    """
    start, size, run = 0, 0, []
    for i, x in enumerate(texts):
        value = x.as_py()
        if run and size + len(value or "") > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(value)
        size += len(value or "")
    if run:
        yield start, run

"""Stored tables: catalogue by version, bill by user, and the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PARTITION = {"quotas": "version_id"}


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(f"{root}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A database table; give ``partitionColumn`` and bounds to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_table(
    df: DataFrame, root: str, name: str, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Write a table; the catalogue is laid out by version, so that a match
    against one version reads only that version's files.
    """
    writer = df.write.mode(mode).format(fmt)
    if name in _PARTITION:
        writer = writer.partitionBy(_PARTITION[name])
    writer.save(f"{root}/{name}")


def write_bucketed(df: DataFrame, name: str, path: str, key: str = "id", buckets: int | None = None) -> DataFrame:
    """Store ``df`` as table ``name`` in sorted buckets by ``key``, and read it back.

    A change-set joins such a table by key without moving it.  There should be
    at least ``spark.sql.shuffle.partitions`` buckets, the default here, or a
    join may shuffle the table to that number.  Each bucket is written by one task.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    dealt.mode("overwrite").option("path", path).saveAsTable(name)
    return spark.table(name)

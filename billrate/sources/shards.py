"""Tables stored in shards by a hash of the key, so that a batch of changes rewrites only some.

A merge reads the shards its changes fall in, hands them to a change function
such as ``upsert_quotas``, and replaces those shards; the files of all others
keep their names.  That is right for any function that judges a key by the rows
of that key alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billrate.schemas import ddl
from billrate.session import stage

SHARD = "shard"


class ShardedTable:
    """A stored table of ``fields``, dealt to ``shards`` folders by ``key``.

    The number of shards belongs to the layout: a table must be opened with
    the number it was written with.  It should be chosen such that a shard is
    a few files; a shard larger than that is written by several tasks.
    """

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, str], key: str = "id", shards: int = 64):
        self.spark, self.path, self.fields, self.key, self.shards = spark, path, fields, key, shards

    def _shard(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast(self.fields[self.key])), F.lit(self.shards)).cast("int")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        # Rebalancing joins small shards in a task and splits large ones.
        return rows.select(*self.fields).withColumn(SHARD, self._shard(self.key)).hint("rebalance", F.col(SHARD))

    def write(self, rows: DataFrame) -> None:
        """Store ``rows`` in place of what was there."""
        writer = self._numbered(rows).write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy(SHARD).parquet(self.path)

    def read(self, shards: list[int] | None = None) -> DataFrame:
        """All rows, or those of some shards, whose folders alone are then read."""
        rows = self.spark.read.schema(f"{ddl(self.fields)}, {SHARD} int").parquet(self.path)
        if shards is not None:
            rows = rows.filter(F.col(SHARD).isin(shards))
        return rows.drop(SHARD)

    def touched(self, changes: DataFrame, key: str | None = None) -> list[int]:
        """Numbers of the shards that the keys of ``changes`` fall in: at most ``shards``."""
        found = changes.select(self._shard(key or self.key).alias(SHARD)).distinct().collect()
        return sorted(r[SHARD] for r in found)

    def merge(
        self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
        key: str | None = None,
    ) -> DataFrame:
        """Apply ``change(rows, changes) -> (rows, rejects)`` to the shards ``changes`` fall in.

        ``key`` is the column of ``changes`` that holds the key of the rows.
        Returns the rejects.  The new rows stand in a staged table before
        anything is replaced, so a batch that fails halfway can be run again.
        """
        changes = stage(changes, "shard-changes")
        numbers = self.touched(changes, key)
        self._recover(numbers)
        rows, rejects = change(self.read(numbers), changes)
        rejects = stage(rejects, "shard-rejects")
        new = stage(self._numbered(rows), "shard-rows", by=SHARD)
        filled = {r[SHARD] for r in new.select(SHARD).distinct().collect()}
        if not filled <= set(numbers):
            raise ValueError("the change brought rows of keys that no change names")
        self._replace(new, numbers, filled)
        return rejects

    def _recover(self, numbers: list[int]) -> None:
        """Bring back the old rows of shards that a broken batch had set aside but not replaced."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for number in numbers:
            here, old = path(root, f"{SHARD}={number}"), path(root, f"_old-{SHARD}={number}")
            if files.exists(old) and not files.exists(here) and not files.rename(old, here):
                raise OSError(f"cannot bring back {here}")

    def _replace(self, new: DataFrame, numbers: list[int], filled: set[int]) -> None:
        """Put the folders of the staged rows in the place of the stored ones; those not filled go."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        root, staged = path(self.path), path(new.inputFiles()[0]).getParent().getParent() if filled else None
        files = root.getFileSystem(conf)
        moved = staged is None or files.getUri().equals(staged.getFileSystem(conf).getUri())
        if not moved:  # another store: the rows have to be copied
            writer = new.hint("rebalance", F.col(SHARD)).write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy(SHARD).parquet(self.path)
        for number in numbers:
            here = path(root, f"{SHARD}={number}")
            if number in filled and not moved:
                continue
            # Readers skip names that begin with an underscore; the old rows go last.
            old = path(root, f"_old-{SHARD}={number}")
            files.delete(old, True)
            if files.exists(here) and not files.rename(here, old):
                raise OSError(f"cannot replace {here}")
            if number in filled and not files.rename(path(staged, f"{SHARD}={number}"), here):
                raise OSError(f"cannot fill {here}")
            files.delete(old, True)
        self.spark.catalog.refreshByPath(self.path)

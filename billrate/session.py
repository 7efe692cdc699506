"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import cache, partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table may be sent whole to every executor only below these bounds.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20
# Up to this estimate the optimizer may take a staged table for small.
TRUSTED_BYTES = 1 << 20

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, app: str = "billrate", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, as the session names it.

    Only a local session without the setting gets a folder of its own, which
    goes when the program ends; the session's settings stay as they are.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    root = tempfile.mkdtemp(prefix="billrate-stage-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


# Paths of the tables staged outside of any ``temporary`` block, and of those in the block at hand.
_staged: list[str] = []
_here: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def _current() -> list[str]:
    mine = _here.get()
    return _staged if mine is None else mine


def _drop(spark: SparkSession, staged: list[str]) -> int:
    paths = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    gone = 0
    while staged:
        path = paths(staged.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def drop_staged(spark: SparkSession) -> int:
    """Remove the tables that this program has staged, and say how many.

    To be called once the results built on them are written, as they can no
    longer be read afterwards.  Tables of ``temporary`` blocks are not touched.
    """
    return _drop(spark, _staged)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged in this block go when it ends, those of other blocks and threads stay.

    Gives a function that stages a table which outlives the block::

        with temporary(spark) as keep:
            result = keep(work_of_many_steps(docs), "result")
    """
    outer, mine = _current(), []
    token = _here.set(mine)
    try:
        yield partial(stage, into=outer)
    finally:
        _here.reset(token)
        _drop(spark, mine)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so their Python can import it."""
    context = spark.sparkContext
    if not getattr(context, "_billrate_sent", False):
        root = Path(__file__).resolve().parents[1]
        base = Path(tempfile.mkdtemp(prefix="billrate-zip-"), "billrate")
        context.addPyFile(shutil.make_archive(str(base), "zip", root, "billrate"))
        context._billrate_sent = True


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly before a step that costs far more than their bytes suggest.

    The partition number is given, or AQE would merge small rows into a few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def stage(df: DataFrame, label: str, by: str | None = None, into: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Later steps then start from files that survive a lost executor, and the
    optimizer sees true sizes.  With ``by``, each value of that column has a
    folder of its own, so a filter on it reads no others.  ``into`` is the list
    that the path is put on, as ``temporary`` gives it.
    """
    spark = df.sparkSession
    path = os.path.join(staging_root(spark), f"{label}-{uuid.uuid4().hex}")
    (_current() if into is None else into).append(path)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_together(**frames: DataFrame) -> list[DataFrame]:
    """Stage several independent tables at the same time."""
    with ThreadPoolExecutor(len(frames)) as pool:
        jobs = [pool.submit(copy_context().run, stage, df, label.replace("_", "-")) for label, df in frames.items()]
        return [job.result() for job in jobs]


def broadcast_if_small(
    staged: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> DataFrame:
    """Broadcast hint for a staged table with few rows and few bytes.

    The count reads only file footers; the bytes are measured, as JSON, only
    where the rows are few.  Larger tables are joined by a shuffle, whatever the
    files' size.
    """
    if staged.count() > max_rows:
        return shuffled(staged)
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    return F.broadcast(staged) if (staged.agg(size).first()[0] or 0) <= max_bytes else shuffled(staged)


def shuffled(df: DataFrame) -> DataFrame:
    """Merge hint for a table that grows with the input, so that no join sends it whole to the driver.

    Estimates go by the bytes of files, which are compressed, and by the width of
    columns, so they are far too low where an explode or an arrow map multiplies rows.
    """
    return df.hint("merge")


def shuffled_if_large(staged: DataFrame) -> DataFrame:
    """``shuffled`` for a staged table, or columns of one, unless it is tiny; starts no job.

    A table of a few MB of files can be many times that in memory.
    """
    size = staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return shuffled(staged) if int(str(size)) > TRUSTED_BYTES else staged

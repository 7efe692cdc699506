"""Searches that read only a part of a stored table: postings of letter pairs and triples."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from billrate.operators.filters import contains_filter, like_any
from billrate.session import broadcast_if_small, ship, stage

_TOKEN = re.compile(r"\\[\\%_]|[%_]|.", re.S)
# Letters whose lower case depends on their place or has more than one letter.
_ODD = set("Σσςİ")
# Texts whose postings are gathered together, and texts of which one task writes the postings.
SLICE_BYTES, FILE_BYTES = 8 << 20, 32 << 20


def literal_runs(kw: str) -> list[str]:
    """The stretches of a LIKE pattern that a hit holds letter by letter."""
    runs = [""]
    for token in _TOKEN.findall(kw):
        if token in "%_":
            runs.append("")
        else:
            runs[-1] += token[-1]
    return [r for r in runs if r]


def grams(runs: list[str]) -> list[str]:
    """Triples of every run, or the pair of a run of two, in lower case."""
    found = set()
    for run in runs:
        size = 3 if len(run) > 2 else 2
        found |= {run[k : k + size] for k in range(len(run) - size + 1)}
    return sorted({g.lower() for g in found if not _ODD & set(g) and len(g.lower()) == len(g)})


def gram_rows(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The letter pairs and triples of the texts, and one after the other the rows that hold each.

    The rows of gram ``g`` are those from place ``ends[g]`` on to ``ends[g + 1]``.
    """
    points = np.frombuffer("".join(x or "" for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = [len(x or "") for x in texts]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letters = np.flatnonzero(np.bincount(points))
    place = np.zeros(int(letters[-1]) + 1 if len(letters) else 1, np.int32)
    place[letters] = np.arange(len(letters))
    at = place[points]
    found, counts, held = [], [], []
    for size in (2, 3):
        n = max(0, len(points) - size + 1)
        whole = row[:n] == row[len(row) - n :]  # not beyond the end of its text
        code = np.zeros(n, np.int64)  # a Unicode letter takes 21 bits at most
        for k in range(size):
            code *= len(letters)
            code += at[k : k + n]
        code = code[whole]
        if len(letters) ** size * len(texts) >= 1 << 63:
            codes, code = np.unique(code, return_inverse=True)
        else:
            codes = None
        code *= len(texts)
        code += row[:n][whole]
        code.sort()
        both = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
        gram, rows = np.divmod(both, max(1, len(texts)))
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        gram = gram[first] if codes is None else codes[gram[first]]
        said = np.stack([letters[gram // len(letters) ** (size - 1 - k) % len(letters)] for k in range(size)], axis=1) if len(gram) else letters[:0]
        said = said.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        found += [said[k : k + size] for k in range(0, len(said), size)]
        counts.append(np.diff(np.append(first, len(rows))))
        held.append(rows)
    return found, np.cumsum(np.concatenate([[0], *counts])), np.concatenate(held)


def _postings(cols: int):
    """Arrow function: of rows of a key and ``cols`` lower-case texts, which texts hold which gram.

    One row for each gram of a slice of rows, with the keys of all that hold it, so a gram is
    written once for many texts.
    """
    def slices(texts: pa.Array):
        start, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if i > start and size + n > SLICE_BYTES:
                yield start, i
                start, size = i, 0
            size += n
        if start < len(texts):
            yield start, len(texts)

    def run(batches):
        for batch in batches:
            for col in range(cols):
                for a, b in slices(batch.column(col + 1)):
                    found, ends, rows = gram_rows(batch.column(col + 1).slice(a, b - a).to_pylist())
                    keys = batch.column(0).slice(a, b - a).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), col), pa.int32()), pa.array(found, pa.string()),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)], names=["col", "gram", "keys"],
                    )

    return run


@dataclass(frozen=True)
class TextIndex:
    """A stored copy of a table, laid out by key, and the postings of its texts, laid out by gram.

    Both have ``parts`` folders; a search reads the folders of its grams, then the folders that
    the keys found lie in, and tests the whole condition on those rows.  A term without two
    letters in a row reads the whole copy.  Null texts are no hit; keys may be null or repeated.
    """

    root: str
    key: str = "id"
    cols: tuple[str, ...] = ("quota_name", "feature_value")
    parts: int = 64

    def _place(self) -> Column:
        return F.pmod(F.crc32(F.coalesce(F.col(self.key).cast("string"), F.lit(""))), F.lit(self.parts)).alias("_p")

    def write(self, df: DataFrame) -> None:
        """Write the copy and the postings; both replace what was there."""
        df.limit(0).write.mode("overwrite").parquet(f"{self.root}/schema")
        spark = df.sparkSession
        ship(spark)
        texts = [F.lower(c) for c in self.cols]
        size = df.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in texts).cast("long"))).first()[0] or 0
        # The numbers are given by the size of the texts: AQE goes by compressed bytes, and postings
        # and short texts shrink so much that it would put nearly all of them into one task.
        files = -(-size // FILE_BYTES)
        tasks = max(files, int(spark.conf.get("spark.sql.shuffle.partitions")))
        cuts = max(1, -(-files // self.parts))
        rows = df.select("*", self._place())
        cut = F.pmod(F.xxhash64(self.key, *self.cols), F.lit(cuts))
        rows = rows.repartition(tasks, "_p", cut).sortWithinPartitions("_p", self.key)
        rows.write.mode("overwrite").partitionBy("_p").parquet(f"{self.root}/rows")
        layout = StructType().add("col", "integer").add("gram", "string").add("keys", ArrayType(df.schema[self.key].dataType))
        # A scan goes by compressed bytes and by files, so the texts are dealt before the long step.
        dealt = df.repartition(tasks, self.key, *self.cols).select(self.key, *texts)
        found = dealt.mapInArrow(_postings(len(texts)), layout)
        found = found.withColumn("_b", F.pmod(F.crc32("gram"), F.lit(self.parts)))
        # The first key is part of the order, so a very common gram is spread over several files.
        cut = F.pmod(F.xxhash64("gram", F.col("keys")[0]), F.lit(cuts))
        laid = found.repartition(tasks, "_b", cut).sortWithinPartitions("_b", "gram")
        laid.write.mode("overwrite").partitionBy("_b").parquet(f"{self.root}/grams")

    def _rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "rows", self._schema(spark).add("_p", "integer"))

    def _schema(self, spark: SparkSession) -> StructType:
        return spark.read.parquet(f"{self.root}/schema").schema

    def _read(self, spark: SparkSession, name: str, schema: StructType) -> DataFrame:
        # Of an empty table there are no files to take the schema from.
        return spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def candidates(self, spark: SparkSession, runs: list[str]) -> DataFrame:
        """Rows of which a text holds all grams of ``runs``: every hit and perhaps others."""
        rows, sought = self._rows(spark), grams(runs)
        if not sought:
            return rows
        folders = sorted({crc32(g.encode()) % self.parts for g in sought})
        layout = StructType().add("keys", ArrayType(self._schema(spark)[self.key].dataType))
        layout = layout.add("col", "integer").add("gram", "string").add("_b", "integer")
        posted = self._read(spark, "grams", layout).filter(F.col("_b").isin(folders) & F.col("gram").isin(sought))
        posted = posted.select("col", "gram", F.explode("keys").alias("key"))
        # Rows with one key may come from several slices.
        keys = posted.groupBy("key", "col").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(sought))
        keys = stage(keys.select("key").distinct().select(F.col("key").alias(self.key)).select(self.key, self._place()), "text-keys")
        places = [r[0] for r in keys.select("_p").distinct().collect()]  # ``parts`` numbers at most
        same = rows[self.key].eqNullSafe(keys[self.key])
        return rows.filter(F.col("_p").isin(places)).join(broadcast_if_small(keys.drop("_p")), same, "left_semi")

    def like(self, spark: SparkSession, kw: str, ignore_case: bool = False) -> DataFrame:
        """Rows of which a text is LIKE %kw%, as ``search_quotas`` gives them."""
        return like_any(self.candidates(spark, literal_runs(kw)), kw, self.cols, ignore_case).drop("_p")

    def contains(self, spark: SparkSession, col: str, kw: str, ignore_case: bool = False) -> DataFrame:
        """Rows whose ``col`` holds ``kw`` as it stands, as ``contains_filter`` gives them."""
        return contains_filter(self.candidates(spark, [kw] if kw else []), col, kw, ignore_case).drop("_p")

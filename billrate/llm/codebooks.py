"""Vector code compression: integer codebooks for the parts of vectors, by exact matrix products.

Components become integers, and vectors are cut into equal consecutive parts.  For each part
position a codebook starts as that part of the vectors of least id, and rounds of nearest entry
and floored mean move it.  All distances are exact: integers are broken into limbs, short
enough that a sum of limb products stays within 2^53, where float64 products are exact.  The
products of limb pairs are put together in int64, or, where a distance may not fit, carried
into limbs again and compared from the highest limb down.  Among equal distances the first
entry wins.

A round reads the table once: each task adds up its own rows by entry, Spark sums these, and
only the sums (parts x entries x width numbers) reach the driver.

Rows whose vector is null or holds a null or non-finite component (or one that is not finite
once scaled) are dropped.  Shorter vectors count as if zeros followed, up to the greatest
length, and that is filled up to a multiple of ``parts``.  Equal ids are one id for the start,
with its least vector; a null id starts no entry but is encoded.  Without any id there are no
codebooks, and codes and errors are null.  Fewer ids than ``entries`` give that many entries.
An error over a long's range is null, as is the sum for its label.  Repeated rows come out
each; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billrate.llm.common import arrow_map
from billrate.session import broadcast_if_small, stage

ROWS = 2048  # rows whose distances to all entries are held at once


@dataclass(frozen=True)
class CodeParams:
    """``entries`` is 256 at most, as a code has two hex digits a part."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


@dataclass(frozen=True)
class Shape:
    """What all tasks have to agree on: width of a part, bits of a limb and number of limbs."""

    width: int
    bits: int
    limbs: int

    @property
    def fits(self) -> bool:
        """Any squared distance is below 2^62."""
        return 2 * (self.bits * self.limbs + 1) + (max(self.width, 1) - 1).bit_length() <= 62


def shape_of(length: int, greatest: float, parts: int) -> Shape:
    width = -(-length // parts)
    bits = (53 - (max(width, 1) - 1).bit_length()) // 2
    limbs = 1
    while greatest > 2.0 ** (bits * limbs):
        limbs += 1
    return Shape(width, bits, limbs)


def split(v: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """Limbs of integers held as float64, lowest first; all but the last are not negative."""
    out = []
    for _ in range(shape.limbs - 1):
        high = np.floor(v * 2.0**-shape.bits)
        out.append(v - high * 2.0**shape.bits)
        v = high
    return [*out, v]


def split_integers(v: list[int], shape: Shape) -> list[list[int]]:
    """As ``split``, for Python's integers of any size: one list a limb."""
    mask = (1 << shape.bits) - 1
    low = [[x >> (shape.bits * k) & mask for x in v] for k in range(shape.limbs - 1)]
    return [*low, [x >> (shape.bits * (shape.limbs - 1)) for x in v]]


def _squares(a: list[np.ndarray], b: list[np.ndarray], product) -> list[np.ndarray]:
    """Coefficient of each power of the limb base in the sum of products, in int64."""
    out: list = [0] * (2 * len(a) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] = out[i + j] + product(x, y).astype(np.int64)
    return out


def distances(x: list[np.ndarray], c: list[np.ndarray]) -> list[np.ndarray]:
    """Squared distances of rows to entries, as int64 coefficients of powers of the limb base."""
    dot = _squares(x, c, lambda a, b: a @ b.T)
    own = _squares(x, x, lambda a, b: np.einsum("ij,ij->i", a, b))
    far = _squares(c, c, lambda a, b: np.einsum("ij,ij->i", a, b))
    return [o[:, None] - 2 * d + f[None, :] for d, o, f in zip(dot, own, far, strict=True)]


def nearest(x: list[np.ndarray], c: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, list]:
    """First nearest entry of each row, and its squared distance (int64, or any size as int)."""
    parts = distances(x, c)
    rows = np.arange(len(x[0]))
    if shape.fits:
        total = sum(p << (shape.bits * k) for k, p in enumerate(parts))
        best = total.argmin(axis=1)
        return best, total[rows, best]
    mask = (1 << shape.bits) - 1
    for k in range(len(parts) - 1):
        parts[k + 1] = parts[k + 1] + (parts[k] >> shape.bits)
        parts[k] = parts[k] & mask
    open_ = np.ones(parts[0].shape, bool)
    for p in reversed(parts):
        low = np.where(open_, p, np.iinfo(np.int64).max).min(axis=1)
        open_ &= p == low[:, None]
    best = open_.argmax(axis=1)
    found = [p[rows, best].tolist() for p in parts]
    return best, [sum(v << (shape.bits * k) for k, v in enumerate(row)) for row in zip(*found, strict=True)]


# --- tables -----------------------------------------------------------------


def integers(vector: Column, params: CodeParams) -> Column:
    """Floored multiples of ``scale``, as doubles, which hold them exactly."""
    def floored(x):
        y = x.cast("double") * F.lit(float(params.scale))
        # beyond 2^52 a double is an integer, and floor() would leave a long's range
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, floored)


def kept(vectors: DataFrame, params: CodeParams = CodeParams(), vec_id: str = "vec_id", vector: str = "embedding",
         label: str = "label") -> DataFrame:
    """vec_id, label and the integers (as doubles) of every row whose vector is whole."""
    finite = F.forall("v", lambda y: F.coalesce(F.abs(y) < float("inf"), F.lit(False)))  # NaN is above all
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("raw"))
        .filter("raw is not null").select("vec_id", "label", integers(F.col("raw"), params).alias("v")).filter(finite)
    )


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy()
    if (ends == length).all():
        return values.reshape(len(ends), length)
    out = np.zeros((len(ends), length))
    start = np.concatenate([[0], np.cumsum(ends)[:-1]])
    row = np.repeat(np.arange(len(ends)), ends)
    out[row, np.arange(len(values)) - np.repeat(start, ends)] = values
    return out


def _parts(v: np.ndarray, shape: Shape, params: CodeParams):
    """For each part position, the limbs of that part of the rows."""
    for p in range(params.parts):
        yield split(v[:, p * shape.width : (p + 1) * shape.width], shape)


def _limbs_of(books: list, shape: Shape) -> list[list[np.ndarray]]:
    """For each part position, the limbs of its entries as float64 matrices."""
    out = []
    for book in books:
        flat = [x for entry in book for x in entry]
        out.append([np.array(limb, np.float64).reshape(len(book), shape.width) for limb in split_integers(flat, shape)])
    return out


def _sums(rows: DataFrame, books: list, shape: Shape, params: CodeParams) -> DataFrame:
    """part, entry, place and the sum there over all rows nearest to the entry; place -1 counts them."""
    sent = rows.sparkSession.sparkContext.broadcast(_limbs_of(books, shape))
    n = len(books[0])

    def run(batches):
        c, width = sent.value, shape.width * shape.limbs
        total, count = np.zeros((params.parts, n, width), np.int64), np.zeros((params.parts, n), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                v = _matrix(batch.column(0).slice(a, ROWS), shape.width * params.parts)
                for p, x in enumerate(_parts(v, shape, params)):
                    best, _ = nearest(x, c[p], shape)
                    np.add.at(total[p], best, np.hstack(x).astype(np.int64))
                    count[p] += np.bincount(best, minlength=n)
        part, entry = np.nonzero(count)
        sums = np.hstack([count[part, entry][:, None], total[part, entry]])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(part, width + 1).astype(np.int32)), pa.array(np.repeat(entry, width + 1).astype(np.int32)),
            pa.array(np.tile(np.arange(-1, width, dtype=np.int32), len(part))), pa.array(sums.ravel()),
        ], names=["part", "entry", "place", "s"])

    found = arrow_map(rows.select("v"), run, "part int, entry int, place int, s long")
    return found.groupBy("part", "entry", "place").agg(F.sum("s").alias("s"))


def fit(rows: DataFrame, shape: Shape, params: CodeParams = CodeParams()) -> list:
    """The codebooks: for each part position a list of entries, each a list of integers."""
    named = rows.filter("vec_id is not null")
    first = named.select("vec_id").distinct().orderBy("vec_id").limit(params.entries)
    start = named.join(F.broadcast(first), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    fill = [0] * (shape.width * params.parts)
    vectors = [([int(x) for x in r.v] + fill)[: len(fill)] for r in start]
    books = [[v[p * shape.width : (p + 1) * shape.width] for v in vectors] for p in range(params.parts)]
    for _ in range(params.rounds if vectors else 0):
        sums: dict = {}
        for r in _sums(rows, books, shape, params).collect():  # parts x entries x width numbers
            sums.setdefault((r.part, r.entry), {})[r.place] = r.s
        for (p, e), found in sums.items():
            whole = [
                sum(found[k * shape.width + i] << (shape.bits * k) for k in range(shape.limbs)) for i in range(shape.width)
            ]
            books[p][e] = [s // found[-1] for s in whole]
    return books


def digest(books: list) -> str:
    said = ",".join(str(x) for book in books for entry in book for x in entry)
    return hashlib.sha256(said.encode()).hexdigest()


def encode(rows: DataFrame, books: list, shape: Shape, params: CodeParams = CodeParams()) -> DataFrame:
    """vec_id, label, code and error of every row."""
    sent = rows.sparkSession.sparkContext.broadcast(_limbs_of(books, shape))
    top = np.iinfo(np.int64).max

    def run(batches):
        c = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                v = _matrix(some.column(2), shape.width * params.parts)
                codes, error = [], [0] * len(v)
                for p, x in enumerate(_parts(v, shape, params)):
                    best, far = nearest(x, c[p], shape)
                    codes.append(best.astype(np.uint8))
                    error = [e + int(f) for e, f in zip(error, far, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array([row.tobytes().hex() for row in np.stack(codes, axis=1)], pa.string()),
                    pa.array([e if e <= top else None for e in error], pa.int64()),
                ], names=["vec_id", "label", "code", "error"])

    return arrow_map(rows.select("vec_id", "label", "v"), run, f"vec_id long, label {_type(rows)}, code string, error long")


def _type(rows: DataFrame) -> str:
    return rows.schema["label"].dataType.simpleString()


def compress(vectors: DataFrame, params: CodeParams = CodeParams(), **columns: str) -> DataFrame:
    """One row per kept row: vec_id, label, code, error, label_error, codebooks_sha256."""
    rows = kept(vectors, params, **columns)
    size = rows.agg(
        F.max(F.size("v")).alias("length"), F.max(F.array_max(F.transform("v", lambda y: F.abs(y)))).alias("greatest")
    ).first()
    shape = shape_of(size.length or 0, size.greatest or 0.0, params.parts)
    books = fit(rows, shape, params)
    sha = F.lit(digest(books)).alias("codebooks_sha256")
    if not books[0]:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"))]
        return rows.select("vec_id", "label", *none, sha)
    coded = stage(encode(rows, books, shape, params), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    by_label = stage(
        coded.groupBy(F.col("label").alias("of")).agg(F.when(F.count("error") == F.count("*"), total).alias("label_error")),
        "code-labels",
    )
    return (
        coded.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("of")), "left")
        .select("vec_id", "label", "code", "error", "label_error", sha)
    )

"""Exact distances and codebooks against Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from billrate.llm import codebooks

VECTORS = "vec_id long, embedding array<float>, label int"


def compress_by_hand(rows, params):
    """The contract with Python integers of any size."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(params.scale * float(np.float32(x))) for x in v], label))
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = -(-longest // params.parts)
    kept = [(i, v + [0] * (width * params.parts - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    start = [first[i] for i in sorted(first)[: params.entries]]
    books = [[cut(v, p) for v in start] for p in range(params.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(params.rounds):
        new = []
        for p in range(params.parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, p), []).append(cut(v, p))
            new.append([
                [sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])
            ])
        books[:] = new
    coded = []
    for i, v, label in kept:
        best = [near(v, p) for p in range(params.parts)]
        coded.append((i, label, "".join(f"{e:02x}" for e in best), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(best))))
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    total = lambda label: sum(r[3] for r in coded if r[1] == label)
    long = lambda x: x if x < 2**63 else None
    out = [(i, label, code, long(e), None if any(r[3] >= 2**63 for r in coded if r[1] == label) else long(total(label)), sha)
           for i, label, code, e in coded]
    return sorted(out, key=str)


def got(spark, rows, params):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return sorted((tuple(r) for r in codebooks.compress(df, params).collect()), key=str)


@pytest.mark.parametrize("spread", [1.0, 3e4, 3e9, 3e30])
def test_compression_equals_whole_numbers(spark, spread):
    rng = random.Random(4)
    rows = [
        (k if k % 17 else None, [float(np.float32(rng.gauss(0, spread))) for _ in range(8)], rng.choice([0, 1, None]))
        for k in range(120)
    ]
    rows += [(5, rows[5][1], 0), (5, rows[7][1], 1), (200, [0.0] * 8, 2), (201, [0.0] * 8, 2), (202, [1e-3] * 6, 2)]
    rows += [(300, None, 0), (301, [1.0, None] * 4, 0), (302, [float("nan")] * 8, 0), (303, [float("-inf")] * 8, 0)]
    params = codebooks.CodeParams(entries=20)
    want = compress_by_hand(rows, params)
    assert got(spark, rows, params) == want and len(want) == 125


def test_limbs_give_exact_distances():
    rng = random.Random(5)
    for bits in (8, 20, 27, 40, 70, 140):
        x = [[float(rng.randrange(-(2**bits), 2**bits)) for _ in range(16)] for _ in range(30)]
        c = [[float(rng.randrange(-(2**bits), 2**bits)) for _ in range(16)] for _ in range(9)]
        c += [list(c[3]), list(x[0])]  # equal entries: the first wins
        shape = codebooks.shape_of(64, max(abs(v) for r in x + c for v in r), 4)
        best, found = codebooks.nearest(codebooks.split(np.array(x), shape), codebooks.split(np.array(c), shape), shape)
        for row, e, d in zip(x, best, found, strict=True):
            far = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, entry, strict=True)) for entry in c]
            assert int(d) == min(far) and e == far.index(min(far))


def test_limbs_of_floats_and_of_integers_agree():
    shape = codebooks.shape_of(64, 2.0**60, 4)
    values = [-(2**60), -1, 0, 1, 2**60, 12345678901234567, -(2**24)]
    by_float = codebooks.split(np.array([float(v) for v in values]), shape)
    by_integer = codebooks.split_integers([int(float(v)) for v in values], shape)
    assert [x.tolist() for x in by_float] == by_integer
    assert shape.width * 2.0 ** (2 * shape.bits) <= 2.0**53


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codebooks.compress(empty).count() == 0
    nameless = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0], None)], VECTORS)
    assert [(r.code, r.error, r.label_error) for r in codebooks.compress(nameless).collect()] == [(None, None, None)] * 2
    clash = spark.createDataFrame([(1, [0.5] * 4, 7, "x", "y", "z")], VECTORS + ", code string, v string, of string")
    row = codebooks.compress(clash).first()
    assert (row.code, row.error, row.label_error) == ("00000000", 0, 0)
    hollow = spark.createDataFrame([(1, [], 7), (2, [], None)], VECTORS)
    assert [r.code for r in codebooks.compress(hollow).collect()] == ["00000000"] * 2

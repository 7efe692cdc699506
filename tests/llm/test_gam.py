"""The additive model: cuts against all cuts, sums against single look-ups, held-out accuracy."""

import math
import random
from bisect import bisect_right
from itertools import product

import numpy as np

from billrate.llm import gam
from billrate.llm.common import table
from billrate.llm.queries import QUERIES

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def value(g, h, cells, ridge):
    return sum(g[c] for c in cells) ** 2 / (sum(h[c] for c in cells) + ridge)


def test_best_cut_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(2, 9))
        g, h = rng.normal(size=n), rng.random(n)
        gains = [value(g, h, range(k), 1) + value(g, h, range(k, n), 1) - value(g, h, range(n), 1) for k in range(1, n)]
        gain, k = gam.best_cut(g, h, 1.0)
        assert math.isclose(gain, max(gains)) and k == gains.index(max(gains)) + 1


def test_pair_tree_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(25):
        a, b = (int(v) for v in rng.integers(2, 5, 2))
        g, h = rng.normal(size=(a, b)), rng.random((a, b))
        best = 0.0
        for turned in (False, True):
            x, w = (g.T, h.T) if turned else (g, h)
            for k, low, high in product(range(1, x.shape[0]), range(1, x.shape[1]), range(1, x.shape[1])):
                parts = [x[:k, :low], x[:k, low:], x[k:, :high], x[k:, high:]]
                weights = [w[:k, :low], w[:k, low:], w[k:, :high], w[k:, high:]]
                gain = sum(p.sum() ** 2 / (q.sum() + 1) for p, q in zip(parts, weights, strict=True)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, gain)
        gain, leaves = gam.pair_tree(g, h, 1.0)
        assert math.isclose(gain, best) and leaves.shape == g.shape and len(np.unique(leaves)) <= 4


def test_interactions_are_learned_and_scores_are_sums_of_cells():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    params = gam.GamParams(pairs=1, patience=60)
    model = gam.learn(x[:2000], y[:2000], np.ones(2000), np.arange(2000) % 5 > 0, params)
    assert list(model.pair_tables) == [(0, 1)]
    assert ((gam.score_rows(x[2000:], model) > 0.5) == y[2000:]).mean() > 0.9
    for row, score in zip(x[:50], gam.score_rows(x[:50], model), strict=True):
        z = model.base + sum(t[bisect_right(e.tolist(), v)] for v, e, t in zip(row, model.edges, model.tables, strict=True))
        for (i, j), t in model.pair_tables.items():
            z += t[bisect_right(model.pair_edges[i].tolist(), row[i]), bisect_right(model.pair_edges[j].tolist(), row[j])]
        assert math.isclose(score, 1 / (1 + math.exp(-z)))


def test_equal_values_share_a_bin():
    x = np.array([0.0] * 50 + [1.0] * 3 + [2.0] * 40 + list(np.linspace(3, 4, 30)))
    edges = gam.bin_edges(x, 8)
    assert len(edges) < 8 and not np.isin(x, edges).any()
    assert gam.bin_edges(np.zeros(9), 8).tolist() == []


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op13_quality_model"](spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    low, good = [r for r in got if r.quality == 0], [r for r in got if r.quality == 1]
    assert len(low) > 5 and len(good) > 40
    assert sum(a.score < b.score for a in low for b in good) > 0.98 * len(low) * len(good)
    assert sum(r.predicted == r.quality for r in got) > 0.97 * len(got)


def test_labels_names_and_other_columns_are_no_input(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = gam.train(docs, labels)
    plain = {r.doc_id: r.score for r in gam.score(docs, model).collect()}
    moved = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "'x' as lang", "'y' as source", "0.5 as score", "1 as held_out")
    assert {r.doc_id - 1000000: r.score for r in gam.score(moved, model).collect()} == plain
    again = gam.train(docs.repartition(5), labels.repartition(3))
    assert {r.doc_id: r.score for r in gam.score(docs, again).collect()} == plain


def test_rows_without_words_or_labels(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abcd") * (k % 5 + 1) for _ in range(30)) + "###" * (k % 2)) for k in range(60)]
    rows += [(90, None), (91, ""), (92, " \n\t"), (None, "some words"), (0, rows[0][1]), (93, "long text " * 50_000)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(60)] + [(4, 0, None), (None, 1, 1), (90, None, 0)], LABELS)
    got = gam.score(docs, gam.train(docs, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (90, 91, 92)}) == 1
    assert not next(r for r in got if r.doc_id is None).held_out
    none = gam.train(docs, marks.filter("false"))
    assert {r.score for r in gam.score(docs, none).collect()} == {0.5}
    assert {r.score for r in gam.score(docs, gam.train(docs, marks.filter("quality = 0"))).collect()} == {0.0}
    assert gam.score(docs.filter("false"), none).count() == 0

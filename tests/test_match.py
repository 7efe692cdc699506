"""The blocked match against a scorer that compares all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from billrate.operators.ranking import top_candidates
from billrate.plans import blocking
from billrate.plans.matching import best_match, item_texts, leading_pairs, quota_texts, scored_pairs, sought_pairs
from billrate.plans.relation import KeywordRelation
from suite import inputs

WORDS = [
    "摄像机", "摄像头", "录像机", "NVR", "nvr", "网络硬盘录像机", "监控", "热成像", "抓拍", "普通",
    "混凝土", "浇筑", "C30", "16路", "8T", "mm", "(a)", "（支架）", "x", "1", "abc", "abcd", " ",
    "，", "-", "ABCDEFGHIJKLMNOPQRSTU", "包括", "ring", "Ring", "ri", "系统",
]


def _texts(rng, n, empty):
    out = []
    for i in range(n):
        name = "".join(rng.choices(WORDS, k=rng.randint(1, 3)))
        feature = "".join(rng.choices(WORDS, k=rng.randint(1, 3)))
        out.append((
            i, None if rng.random() < empty else name, "" if rng.random() < 0.4 else feature
        ))
    return out


def _frames(spark, items, quotas):
    i = spark.createDataFrame(items, "id bigint, item_name string, feature_value string")
    q = spark.createDataFrame(quotas, "id bigint, quota_name string, feature_value string")
    return item_texts(i), quota_texts(q)


WAYS = {
    "summed": lambda i, q, early: leading_pairs(i, q, early),
    "sought": lambda i, q, early: scored_pairs(i, q, early_accept=early, direct_rows=0),
}


def _check(spark, items, quotas, early, way="summed"):
    left, right = _frames(spark, items, quotas)
    winners = best_match(WAYS[way](left, right, early), early)
    got = {
        (r["n"], r["f"]): (r["qid"], r["score"])
        for r in left.join(winners, "tid").select(
            F.col("profile.name").alias("n"), F.col("profile.feature").alias("f"),
            "qid", "score",
        ).collect()
    }
    want = {}
    for _, n, f in items:
        hit = brute.best((n, f), quotas, early)
        if hit:
            want[((n or "").strip(brute.LOW), (f or "").strip(brute.LOW))] = hit
    assert got.keys() == want.keys()
    for key, (qid, score) in want.items():
        assert got[key][0] == qid, (key, got[key], (qid, score))
        assert got[key][1] == pytest.approx(score, abs=1e-12)


@pytest.mark.parametrize("way,seed,early", [
    ("summed", 1, 0.8), ("summed", 3, None), ("sought", 1, 0.8), ("sought", 2, 0.8), ("sought", 3, None),
])
def test_match_equals_all_pairs(spark, way, seed, early):
    rng = random.Random(seed)
    _check(spark, _texts(rng, 250, 0.15), _texts(rng, 150, 0.15), early, way)


@pytest.mark.parametrize("way", WAYS)
def test_catalogue_without_keywords(spark, way):
    rng = random.Random(9)
    bare = ["1", "x", "(a)", "", "5-5", "(1)2", "，"]
    quotas = [(i, rng.choice(bare), rng.choice(bare)) for i in range(60)]
    _check(spark, _texts(rng, 200, 0.2), quotas, 0.8, way)


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(blocking, "GRID_PAIRS", 50)
    monkeypatch.setattr(blocking, "GRID_SIDE", 7)
    rng = random.Random(5)
    _check(spark, _texts(rng, 200, 0.1), _texts(rng, 120, 0.1), 0.8, "sought")


def test_texts_inside_others_meet_without_a_keyword_of_their_own(spark):
    # Edge parts of an inner text may be cut, joined or too long in the outer one.
    longer = "abcdefghijklmnopqrstuvwxyz"
    items = [(1, f"{longer} steel", ""), (2, "5T pipe long bend", ""), (3, "ab(cd", "")]
    quotas = [(1, "xyz steel", ""), (2, "T pipe", ""), (3, "abcdefghij", ""), (4, "pipe long bend", ""), (5, "b(c", "")]
    for way in WAYS:
        _check(spark, items, quotas, None, way)


@pytest.mark.parametrize("direct_rows", [None, 0])
def test_learned_weights_equal_all_pairs(spark, direct_rows):
    rng = random.Random(7)
    items, quotas = _texts(rng, 120, 0.1), _texts(rng, 80, 0.1)
    left, right = _frames(spark, items, quotas)
    words = sorted({k for _, n, f in items for k in brute.keywords(n) | brute.keywords(f)})
    known = {k: 0.5 + rng.randrange(16) / 10 for k in words[::2]}
    weights = spark.createDataFrame(list(known.items()), "keyword string, weight double")
    scored = scored_pairs(left, right, weights, early_accept=0.8, direct_rows=direct_rows)
    got = {
        (r["n"], r["f"]): (r["qid"], r["score"])
        for r in left.join(best_match(scored), "tid").select(
            F.col("profile.name").alias("n"), F.col("profile.feature").alias("f"), "qid", "score",
        ).collect()
    }
    want = {}
    for _, n, f in items:
        hit = brute.best((n, f), quotas, 0.8, known)
        if hit:
            want[((n or "").strip(brute.LOW), (f or "").strip(brute.LOW))] = hit
    assert got.keys() == want.keys() and len(want) > 50
    for key, (qid, score) in want.items():
        assert got[key][1] == pytest.approx(score, abs=1e-9)
        assert got[key][0] == qid or score < 0.8, key


@pytest.mark.parametrize("direct_rows", [None, 0])
def test_top_candidates_equal_all_pairs(spark, direct_rows):
    rng = random.Random(11)
    items, quotas = _texts(rng, 80, 0.1), _texts(rng, 150, 0.2)
    left, right = _frames(spark, items, quotas)
    best = top_candidates(scored_pairs(left, right, ranks=3, direct_rows=direct_rows).filter("score >= 0.3"), 3)
    got = {}
    for r in best.join(left.select("tid", F.col("profile.name").alias("n"), F.col("profile.feature").alias("f")), "tid").collect():
        got.setdefault((r["n"], r["f"]), {})[r["rank"]] = round(r["score"], 9)
    texts = {}
    for i, n, f in quotas:
        texts.setdefault(((n or "").strip(brute.LOW), (f or "").strip(brute.LOW)), (i, n, f))
    for _, n, f in items:
        key = ((n or "").strip(brute.LOW), (f or "").strip(brute.LOW))
        if brute.keywords(key[0]) | brute.keywords(key[1]):
            scores = sorted((round(brute.pair_score((n, f), q[1:]), 9) for q in texts.values()), reverse=True)
            want = [s for s in scores[:3] if s >= 0.3]
            assert sorted(got.get(key, {}).values(), reverse=True) == want, key


def test_candidate_share_falls_as_both_sides_grow(spark):
    items, quotas = inputs.turns(spark, "/root/testdata/sf0.01")
    share = []
    for part in ("id % 4 = 0", "id % 2 = 0"):
        left, right = item_texts(items.filter(part)), quota_texts(quotas.filter(part))
        pairs = sought_pairs(left, right, early_accept=0.8).count()
        share.append(pairs / left.count() / right.count())
    assert share[1] < share[0] < 1


def test_related_rows_bound_the_summed_rows(spark):
    rng = random.Random(12)
    left, right = _frames(spark, _texts(rng, 60, 0.1), _texts(rng, 40, 0.1))
    relation = KeywordRelation(left, right)
    filed = relation.filed()
    assert 0 < relation.asked.join(filed, ["part", "kid"]).count() <= relation.rows()
    assert filed.count() == filed.select("qid", "part", "kid").distinct().count()

import random

import pytest
from pyspark.sql import functions as F

import brute
from billrate.functions import score as S
from billrate.functions import text as T
from test_match import WORDS


def one(spark, value, *args):
    row = spark.range(1).select(value(*[F.lit(a).cast("string") for a in args]).alias("v"))
    return row.first()["v"]


@pytest.mark.parametrize("text,want", [
    ("C30,厚度200mm", ["厚度mm", "厚度"]),
    ("nvr x", ["NVR", "nvr"]),
    ("包括m³", ["包括m"]),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ ab-cd", ["ab", "cd"]),
    (None, []),
    (" \t\u0001", []),
])
def test_extract_keywords(spark, text, want):
    assert one(spark, T.extract_keywords, text) == want


@pytest.mark.parametrize("a,b,want", [
    ("混凝土浇筑", "混凝土浇筑", 1.0),
    ("热成像抓拍", "热成像抓拍", 0.0),  # conflict comes before equality
    ("(a)", "x", 0.3),  # nothing left is contained in anything
    ("NVR", "录像机", 0.375),
    ("", "x", 0.0),
])
def test_text_match_score(spark, a, b, want):
    assert one(spark, S.text_match_score, a, b) == pytest.approx(want, abs=1e-12)


def test_similarity_is_asymmetric(spark):
    def sim(a, b):
        return S.keyword_similarity(T.keyword_set(a), T.keyword_set(b))

    assert one(spark, sim, "混凝土浇筑", "混凝土浇筑") == 0.5
    assert one(spark, sim, "网络硬盘录像机", "录像机") == pytest.approx(0.5525)
    assert one(spark, sim, "录像机", "网络硬盘录像机") == pytest.approx(0.26)


def test_trim_takes_control_characters_only(spark):
    assert one(spark, T.jtrim, "\u0001 \tx　 ") == "x　"


def test_random_texts_against_brute_force(spark):
    rng = random.Random(11)
    extra = WORDS + ["　", "\t", "\u000b", "【", "]", "3路", "12", "é", "ﾅ", ".", "、"]
    texts = ["".join(rng.choices(extra, k=rng.randint(0, 7))) for _ in range(400)]
    pairs = [(a, rng.choice(texts)) for a in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(
        "a", "b", T.keyword_set(F.col("a")).alias("k"),
        S.text_match_score(F.col("a"), F.col("b")).alias("s"),
    ).collect()
    for r in got:
        assert set(r["k"]) == brute.keywords(r["a"]), r["a"]
        assert len(set(r["k"])) == len(r["k"])
        assert r["s"] == pytest.approx(brute.text_score(r["a"], r["b"]), abs=1e-12), r


def test_weighted_similarity(spark):
    row = spark.sql("select array('aa','bb','cc') a, array('aa','cc') b, map('aa', 2.0D) w")
    got = row.select(S.weighted_similarity(F.col("a"), F.col("b"), F.col("w")).alias("s"))
    assert got.first()["s"] == pytest.approx(3 / 4)

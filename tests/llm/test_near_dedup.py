"""The near-copy stage against all pairs, by five-word shingles and similarity 0.8."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from billrate.llm import neardup


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def least_of_groups(rows):
    cut, root = {i: sets(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in cut.items():
        for b, y in cut.items():
            if b < a and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {find(i) for i in root}


def test_near_copies_equal_all_pairs(spark, sf):
    rng, rows = random.Random(8), []
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    for base in (words(n) for n in (20, 60, 120, 400) for _ in range(12)):
        rows.append(" ".join(base))
        for swaps in range(1, 6):  # similarities over and under 0.8
            said = list(base)
            for _ in range(max(1, len(base) * swaps // 100)):
                said[rng.randrange(len(said))] = "other"
            rows.append(" ".join(said))
    big = words(200)
    rows += [" ".join([*big[:150], f"n{k}", *big[150:]]) for k in range(80)]
    rows += ["", " \n", None, "one two", "One  two", "one two three"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_of_groups(rows)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == want
    assert 60 < len(want) < len(rows) - 150


def test_no_pair_of_a_bucket_is_left_unchecked(spark):
    # One band of one minimum: every document shares it, and most are not like the leader.
    rng = random.Random(9)
    rows = []
    for k in range(12):
        base = "same five words come first " + " ".join(f"w{rng.randrange(9000)}" for _ in range(30))
        rows += [(2 * k, base), (2 * k + 1, f"{base} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = neardup.NearParams(bands=200, rows=1)
    assert {r.doc_id for r in neardup.keep_one(docs, many).collect()} == least_of_groups(rows) == set(range(0, 24, 2))


def test_families_below_the_similarity_make_no_square_of_pairs(spark):
    # Texts of one template that differ in some words each: they meet in buckets, but none is a link.
    rng = random.Random(10)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]

    def family(n):
        rows = []
        for k in range(n):
            said = list(base)
            for at in rng.sample(range(200), 6):
                said[at] = f"x{k}a{at}"
            rows.append((k, " ".join(said)))
        return spark.createDataFrame(rows, "doc_id long, text string")

    pairs = []
    checked = neardup.verified

    def counted(docs, nodes, found, params):
        pairs[-1] += found.count()
        return checked(docs, nodes, found, params)

    neardup.verified = counted
    try:
        for n in (60, 120):
            pairs.append(0)
            assert neardup.keep_one(family(n)).count() == n
    finally:
        neardup.verified = checked
    assert pairs[1] < 3 * pairs[0]


def test_families_about_the_similarity_equal_all_pairs(spark):
    # One template with a changed word or more in each text: crowded buckets, links and none.
    rng, rows = random.Random(11), []
    for n, size in ((60, 50), (50, 90), (40, 47), (30, 23)):
        base = [f"w{rng.randrange(9000)}" for _ in range(n)]
        for k in range(size):
            said = list(base)
            for at in rng.sample(range(n), rng.choice((0, 1, 1, 2, 3))):
                said[at] = f"x{n}a{k}b{at}"
            cut = rng.choice((0, 0, 1, 4))
            rows.append(" ".join(said[cut:]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_of_groups(rows)
    assert 20 < len(want) < len(rows) - 20
    # Many bands of one minimum, so that all texts of a family meet.
    params = neardup.NearParams(bands=60, rows=1, crowd=1)
    assert {r.doc_id for r in neardup.keep_one(docs, params).collect()} == want


def test_differences_join_all_links_of_one_group(spark):
    # Every node is a component of its own and in one group with all others, whatever its template.
    rng, rows = random.Random(12), []
    for _ in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(12, 70))]
        for k in range(14):
            rows.append(" ".join(base[rng.randrange(3) : len(base) - rng.randrange(3)] + [f"end{k % 5}"] * (k % 2)))
    rows = sorted(set(rows))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    marked = neardup.signatures(docs).withColumn("row", F.struct(F.col("doc_id").alias("dk"), "tk")).cache()
    first = marked.agg(F.min("node")).first()[0]
    met = marked.select("node", F.lit(first).alias("leader"), F.col("node").alias("root"))
    params = neardup.NearParams()
    edges = [(r.u, r.v) for r in neardup._close(neardup._differences(docs, marked, met, params), params).collect()]
    root = {r.node: r.node for r in marked.collect()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        low, high = sorted((find(u), find(v)))
        root[high] = low
    assert len({find(i) for i in root}) == len(least_of_groups(list(enumerate(rows))))


def test_simhash_anchors_lead_to_near_copies_without_minhash(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 2000)]
    far = [f"w{k}" for k in rng.integers(0, 10**6, 2000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(["begin", *words])), (4, " ".join(far)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = neardup.signatures(docs).cache()
    of = {r.node: r.doc_id for r in nodes.collect()}
    found = neardup.anchored(nodes).collect()
    assert found and all({of[r.u], of[r.v]} <= {1, 2, 3} for r in found)
    # No bucket has two of them: the anchors alone lead to the copies.
    alone = neardup.NearParams(bands=1, rows=2000)
    assert [r.doc_id for r in neardup.keep_one(docs, alone).orderBy("doc_id").collect()] == [1, 4, 5]


def test_sets_are_cut_once_for_all_steps(spark, monkeypatch):
    # Links, pairs of small buckets and a crowded bucket: every step reads the same sets.
    rng = random.Random(12)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    rows = []
    for k in range(14):
        said = list(base)
        for at in rng.sample(range(120), 4 if k % 2 else 1):
            said[at] = f"x{k}a{at}"
        rows.append((k, " ".join(said)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    calls, cut = [], neardup._sets
    monkeypatch.setattr(neardup, "_sets", lambda *a: calls.append(1) or cut(*a))
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == least_of_groups(rows)
    assert len(calls) == 1


def test_few_shingles_are_sent_to_other_classes(spark, monkeypatch):
    # One template, changes from a few words: differences share shingles, components large and small.
    rng = random.Random(13)
    base = [f"w{rng.randrange(9000)}" for _ in range(60)]
    rows = []
    for k in range(240):
        said = list(base)
        for at in rng.sample(range(60), rng.choice((0, 1, 1, 3, 4, 5))):
            said[at] = f"v{rng.randrange(6)}"
        rows.append((k, " ".join(said if k % 3 else [*said[:30], *(f"u{at}" for at in range(30)), *said[30:]])))
    sent, differences, kept = [], [], neardup.stage

    def seen(df, label, *args, **more):
        out = kept(df, label, *args, **more)
        if label == "near-sent":
            sent.extend(out.collect())
        if label == "near-differences":
            differences.append(out.agg(F.sum(F.size("d"))).first()[0])
        return out

    monkeypatch.setattr(neardup, "stage", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    params = neardup.NearParams(bands=60, rows=1)
    assert {r.doc_id for r in neardup.keep_one(docs, params).collect()} == least_of_groups(rows)
    assert 0 < len(sent) < differences[0] / 4

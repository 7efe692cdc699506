"""Near copies by the Jaccard similarity of their word shingles.

Documents are sets of five-word shingles, each with a 64-bit hash; equal sets are one node.
Candidates come from SimHash: every node has a fingerprint of its set, and the anchors of
``simhash`` lead to all pairs of fingerprints within two bits.  A pair of similarity 0.8 differs in
some ten bits, so MinHash adds those further apart: ``bands`` buckets a node, each over ``rows``
minima, so a pair of similarity ``s`` meets with probability 1 - (1 - s^rows)^bands (all but 1.5e-5
at 0.8).  Every candidate is checked on the whole sets, so no pair below ``least`` is a link.  Every
bucket has a leader.  A node is first held against the leader it meets most often, then against its
other leaders that are not in its component yet; last, nodes of a bucket that lie in different
components are compared: in buckets of up to ``crowd`` nodes pair by pair, in others by what they
differ in.

Crowded buckets that share nodes are one group, and the shingles that more than half of its nodes
hold are its centre.  A node is given by its difference d to the centre.  Sets of n and m shingles
are a link if they differ in r (n + m) shingles or fewer, r = (1 - least) / (1 + least), and what
they differ in has |d1| + |d2| - 2 |d1 & d2| shingles whatever the centre is.  With the excess
e = |d| - r n of a node, a link needs (e1 + e2) / 2 common shingles in d1 and d2.  So

* nodes whose excesses add up to zero or less are links, and all of them are links of the node of
  least excess as well, so that one joins them to one component;
* others share a shingle of their differences that has, in the order from the rarest on, (e1 + e2) / 2
  shingles or more from it to the end in both.  Nodes are put into classes of excess, large components
  apart; a shingle of a node is sent to a class only if either has enough shingles left there, and if
  the class holds it in another component.

Copies of one template cost as much as what they differ in; a group of unlike texts has no centre,
and what is left is the rarest-first prefix join of whole sets.  Both are exact.

Texts under five words are one shingle of all their words.  Null, empty and blank texts have
the empty set and are one group.  Ids may be null; repeated rows share a node.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billrate.llm import simhash
from billrate.llm.common import NO_ID, arrow_map, doc_key, slices
from billrate.llm.components import components
from billrate.session import broadcast_if_small, shuffled_if_large, stage, temporary

LARGE = 16  # nodes of a component that is a side of its own among the differences of a group


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5
    least: float = 0.8
    bands: int = 28
    rows: int = 5
    seed: int = 42
    crowd: int = 4  # nodes of larger buckets are compared by their differences


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, params: NearParams = NearParams()) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text given as UTF-8."""
    words = text.lower().split() if text else []  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(params.seed)), np.uint64, len(words))
    size = min(params.shingle, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k, factor in enumerate(_odd(size, params.seed)):
        out += h[k : k + n] * factor
    return np.unique(_mix(out))


def buckets(found: np.ndarray, params: NearParams = NearParams()) -> np.ndarray:
    """One number per band; two sets meet in a band if they have the same."""
    n = params.bands * params.rows
    factor, flip = _odd(n, params.seed + 1)[:, None], _odd(n, params.seed + 2)[:, None]
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 1024):  # small enough for the cache
        np.minimum(low, ((found[a : a + 1024] ^ flip) * factor).min(axis=1), out=low)
    joined = (_mix(low).reshape(params.bands, params.rows) * _odd(params.rows, params.seed + 3)).sum(axis=1, dtype=np.uint64)
    return _mix(joined + np.arange(params.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if over half of the shingles have it."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(found), 1 << 15):
        part = found[a : a + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big", signed=True)


def signatures(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """doc_id, tk, node (digest of the shingle set), size, fingerprint and buckets of the set, of every row."""
    def run(batches):
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                sets = [shingles(t, params) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(start, len(texts)) for k in range(2)),
                    pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) for s in sets], pa.int64()),
                    pa.array([buckets(s, params) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ], names=["doc_id", "tk", "node", "size", "fp", "buckets"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("binary"))
    return arrow_map(keyed, run, "doc_id long, tk long, node long, size long, fp long, buckets array<long>")


def _ordered(u, v):
    return F.greatest(u, v).alias("u"), F.least(u, v).alias("v")


def _sets(docs: DataFrame, nodes: DataFrame, needed: DataFrame, params: NearParams) -> DataFrame:
    """The shingle sets (node, set) of the nodes in ``needed``, from one document each."""
    shown = nodes.join(shuffled_if_large(needed), "node").select("node", F.col("row.dk").alias("dk"), F.col("row.tk").alias("tk"))

    def cut(batches):
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                sets = pa.array([shingles(t, params).view(np.int64) for t in texts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), sets], names=["node", "set"])

    keyed = docs.select(*doc_key(), F.col("text").cast("binary").alias("raw"))
    # The same join at every size: the documents are dealt by key once for all steps.
    texts = keyed.join(stage(shown, "near-needed").hint("merge"), ["dk", "tk"]).select("node", "raw").dropDuplicates(["node"])
    return stage(arrow_map(texts, cut, "node long, set array<long>"), "near-sets")


def verified(sets: DataFrame, nodes: DataFrame, pairs: DataFrame, params: NearParams) -> DataFrame:
    """The pairs (u, v) of nodes whose whole shingle ``sets`` have similarity ``least`` or more."""
    sizes = shuffled_if_large(nodes.select("node", "size"))
    fit = stage(
        pairs.join(sizes.toDF("u", "a"), "u").join(sizes.toDF("v", "b"), "v")
        .filter(F.least("a", "b") >= params.least * F.greatest("a", "b")).select("u", "v"), "near-pairs",
    )

    def check(batches):
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            keep = []
            for a, b in zip(cols["set"], cols["other"], strict=True):
                x, y = (s.values.to_numpy(zero_copy_only=False) for s in (a, b))
                # each is distinct: what is in both comes twice
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same >= params.least * (len(both) - same))
            yield pa.RecordBatch.from_arrays([cols["u"], cols["v"]], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    laid = shuffled_if_large(fit).join(sets.toDF("u", "set"), "u").join(sets.toDF("v", "other"), "v").select("u", "v", "set", "other")
    return stage(arrow_map(laid, check, "u long, v long"), "near-links")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of nodes that are not in one component; a node without a root is one by itself."""
    roots = shuffled_if_large(roots)
    of = lambda c: roots.toDF(c, f"r{c}")
    joined = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return joined.filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")


def _differences(
    docs: DataFrame, nodes: DataFrame, met: DataFrame, params: NearParams, sets: DataFrame | None = None
) -> DataFrame:
    """g (group), node, root, size, d (difference to the group's centre), e (excess) and its class.

    ``met`` has (node, leader, root).  A class is a quarter of what the centre allows wide.
    """
    r = (1 - params.least) / (1 + params.least)
    of = components(met.select(F.col("node").alias("u"), F.col("leader").alias("v"))).toDF("node", "g")
    sizes = shuffled_if_large(nodes.select("node", "size"))
    known = met.select("node", "root").distinct().join(shuffled_if_large(of), "node").join(sizes, "node")
    if sets is None:
        sets = _sets(docs, nodes, met.select("node").distinct(), params)
    held = stage(known.join(sets, "node"), "near-held")
    among = held.groupBy("g").agg(F.count("*").alias("m"))
    often = held.select("g", F.explode("set").alias("x")).groupBy("g", "x").agg(F.count("*").alias("n"))
    # At most twice the mean size of the group's sets.
    centre = often.join(among, "g").filter("2 * n > m").groupBy("g").agg(F.collect_list("x").alias("centre"))
    centre = broadcast_if_small(stage(centre, "near-centres"))
    mid = F.coalesce("centre", F.array().cast("array<long>"))
    d = F.concat(F.array_except("set", mid), F.array_except(mid, "set"))
    wide = F.greatest(F.lit(1.0), F.size(mid) * F.lit(r / 4))
    e = F.size("d") - F.lit(r) * F.col("size")
    return stage(
        held.join(centre, "g", "left").withColumn("d", d).withColumn("e", e).withColumn("wide", wide)
        .select("g", "node", "root", "size", "d", "e", "wide", F.floor(F.col("e") / F.col("wide")).alias("c")), "near-differences",
    )


def _close(found: DataFrame, params: NearParams) -> DataFrame:
    """Links (u, v) between the components (root) of ``found`` that join all its links."""
    least = stage(found.groupBy("g").agg(F.min(F.struct("e", "node", "root", "c")).alias("z")), "near-least")
    known = found.select("g", "node", "root", "e", "c", "wide").join(broadcast_if_small(least), "g")
    near = known.filter((F.col("e") + F.col("z.e") <= 1e-6) & (F.col("root") != F.col("z.root")))
    near = stage(near.select("g", "root", *_ordered(F.col("node"), F.col("z.node"))), "near-least-links")
    # What these links have joined is one component from here on.
    joined = near.select("g", "root").distinct().withColumn("one", F.lit(True))
    root = F.when(F.col("one"), F.col("z.root")).otherwise(F.col("root")).alias("root")
    known = known.join(shuffled_if_large(joined), ["g", "root"], "left")
    known = known.select("g", "node", root, "e", "c", "wide", F.col("z.c").alias("low"))
    # Nodes of one component never meet: a large one is a side of its own, all others are one side.
    large = known.groupBy("g", "root").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE)
    large = stage(large.select("g", "root", F.col("root").alias("side")), "near-large")
    facts = known.join(large, ["g", "root"], "left").withColumn("side", F.coalesce("side", F.lit(NO_ID)))

    found = shuffled_if_large(found)
    shingle = found.select("g", "node", F.explode("d").alias("x"))
    # Shingles of one node alone are its rarest: they take places but meet nothing.
    often = shingle.groupBy("g", "x").agg(F.count("*").alias("n")).filter("n > 1")
    one = Window.partitionBy("g", "node")
    rest = F.count("*").over(one) - F.row_number().over(one.orderBy("n", "x")) + 1
    # ``room`` is the most that the excess of a partner may be whose first common shingle this is.
    placed = (
        shingle.join(often, ["g", "x"]).select("g", "node", "x", rest.alias("rest")).join(shuffled_if_large(facts), ["g", "node"])
        .withColumn("room", 2 * F.col("rest") + F.lit(2e-6) - F.col("e"))
        .withColumn("reach", F.floor(F.col("room") / F.col("wide"))).filter("reach >= low")
        .select("g", "x", "c", "side", "node", "root", "e", "room", "reach")
    )
    placed = shuffled_if_large(stage(placed, "near-placed"))
    by_class = placed.groupBy("g", "x", "c", "side").agg(
        F.max("reach").alias("reach"), F.min("root").alias("first"), F.max("root").alias("last")
    )
    partners = by_class.groupBy("g", "x").agg(F.collect_list(F.struct("c", "side", "reach", "first", "last")).alias("partners"))

    def meets(p):
        other = (p["first"] != F.col("root")) | (p["last"] != F.col("root"))
        return (p["c"] <= F.col("reach")) & (p["reach"] >= F.col("c")) & other

    sent = placed.join(partners, ["g", "x"]).withColumn("p", F.explode(F.filter("partners", meets)))
    both = ["node", "root", "e", "room"]
    to = [F.col("p.c").alias("to"), F.col("p.side").alias("to_side")]
    sent = shuffled_if_large(stage(sent.select("g", "x", "c", "side", *to, *both), "near-sent"))
    other = sent.toDF("g", "x", "to", "to_side", "c", "side", *[f"{k}2" for k in both])
    met = (
        sent.join(other, ["g", "x", "c", "side", "to", "to_side"])
        .filter("node < node2 and root != root2 and e2 <= room and e <= room2").select("g", "node", "node2").distinct()
    )
    side = found.select("g", "node", "size", "d")
    same = (F.col("size") + F.col("size2") - F.size("d") - F.size("d2")) / 2 + F.size(F.array_intersect("d", "d2"))
    far = (
        met.join(side, ["g", "node"]).join(side.toDF("g", "node2", "size2", "d2"), ["g", "node2"])
        .filter(same >= F.lit(params.least) * (F.col("size") + F.col("size2") - same) - 1e-6)
        .select(*_ordered(F.col("node"), F.col("node2")))
    )
    return stage(near.select("u", "v").unionByName(far), "near-close")


def anchored(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes whose fingerprints are within the threshold of ``simhash``.

    The least node of a fingerprint stands for all that have it.
    """
    prints = shuffled_if_large(stage(nodes.groupBy("fp").agg(F.min("node").alias("node")), "near-prints"))
    of = lambda c: prints.toDF(c, f"n{c}")
    near = simhash.links(prints).join(of("u"), "u").join(of("v"), "v").select(*_ordered(F.col("nu"), F.col("nv")))
    same = nodes.select("node", "fp").join(prints.toDF("fp", "other"), "fp").filter("node != other")
    return stage(near.unionByName(same.select(*_ordered(F.col("node"), F.col("other")))), "near-anchored")


def links(docs: DataFrame, nodes: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """Verified pairs that join all candidate pairs of similarity ``least`` or more to components."""
    met = nodes.select("node", F.explode("buckets").alias("bucket"))
    leader = F.min(F.struct(F.xxhash64("node", "bucket").alias("o"), "node")).alias("l")
    led = met.groupBy("bucket").agg(F.count("*").alias("n"), leader).filter("n > 1").select("bucket", F.col("l.node").alias("leader"))
    members = stage(shuffled_if_large(met).join(led, "bucket"), "near-members")
    tried = stage(
        members.filter(F.col("node") != F.col("leader")).groupBy("node", "leader").agg(F.count("*").alias("times")), "near-tried"
    )
    most = F.max_by("leader", F.struct("times", "leader")).alias("leader")
    chosen = tried.groupBy("node").agg(most).select(*_ordered(F.col("node"), F.col("leader")))
    chosen = stage(chosen.unionByName(anchored(nodes)).distinct(), "near-chosen")
    # Every node that may be in a pair of any step; the sets are cut once.
    pairs = chosen.unionByName(tried.select(F.col("node").alias("u"), F.col("leader").alias("v")))
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = _sets(docs, nodes, needed, params)
    first = verified(sets, nodes, chosen, params)
    others = tried.select(*_ordered(F.col("node"), F.col("leader"))).distinct()
    others = stage(_apart(others, components(first)).join(chosen, ["u", "v"], "left_anti"), "near-others")
    found = stage(first.unionByName(verified(sets, nodes, others, params)), "near-led")
    roots = shuffled_if_large(stage(components(found), "near-led-roots"))

    split = stage(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-split")
    torn = split.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"))
    torn = stage(torn.filter("x < y").select("bucket", "n"), "near-torn")
    open_ = stage(split.join(shuffled_if_large(torn), "bucket").select("bucket", "node", "leader", "root", "n"), "near-open")
    crowded = F.col("n") > params.crowd
    few = open_.filter(~crowded).select("bucket", "node", "root")
    facing = few.join(few.toDF("bucket", "node2", "root2"), "bucket").filter("node < node2 and root != root2")
    across = stage(facing.select(*_ordered(F.col("node"), F.col("node2"))).distinct(), "near-across")
    if not across.isEmpty():
        found = stage(found.unionByName(verified(sets, nodes, across, params)), "near-few")
    dense = stage(open_.filter(crowded).select("node", "leader", "root").distinct(), "near-dense")
    if not dense.isEmpty():
        found = found.unionByName(_close(_differences(docs, nodes, dense, params, sets), params))
    return found


def groups(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, tk, node and root (the group)."""
    marked = stage(signatures(docs, params), "signatures")
    row = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("dk"), "tk")).alias("row")
    nodes = stage(marked.groupBy("node").agg(row, *[F.first(c).alias(c) for c in ("size", "fp", "buckets")]), "near-nodes")
    with temporary(docs.sparkSession) as keep:
        roots = keep(components(links(docs, nodes, params)), "near-roots")
    return (
        marked.select("doc_id", "tk", "node").join(shuffled_if_large(roots), "node", "left")
        .select("doc_id", "tk", "node", F.coalesce("root", "node").alias("root"))
    )


def keep_one(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """``docs`` with one document of each group: the one of the least id.

    Of several rows with that id, and in a group without ids, the least node and text hash
    decides; rows equal in id and text stay once.
    """
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node", "tk")
    with temporary(docs.sparkSession) as keep:
        best = groups(docs, params).groupBy("root").agg(F.min(order).alias("b"))
        winners = keep(
            best.select(F.coalesce("b.doc_id", F.lit(NO_ID)).alias("_nd_dk"), F.col("b.tk").alias("_nd_tk")), "kept"
        )
    dk, tk = doc_key()
    keyed = docs.select("*", dk.alias("_nd_dk"), tk.alias("_nd_tk"))
    keys = ["_nd_dk", "_nd_tk"]
    return keyed.join(shuffled_if_large(winners), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)

"""SQL expressions for the text functions, written for the SQL checker.

They follow the definitions on their own path (nested loops over lists, all
pairs), so that an error in the Spark plan does not repeat here.
"""

from __future__ import annotations

CORE = ["摄像机", "摄像头", "录像机", "NVR", "硬盘录像机", "网络硬盘录像机", "监控", "设备", "系统", "装置"]
GROUPS = [
    ["NVR", "网络硬盘录像机", "硬盘录像机", "录像机"],
    ["摄像机", "摄像头", "监控摄像头", "监控摄像机"],
]
STOP = ["kg", "mm", "cm", "dm", "km", "包括", "包含"]
TYPES = ["热成像", "抓拍", "普通"]


def strings(words):
    return ", ".join(f"'{w}'" for w in words)


def num(x):
    return f"CAST({x} AS DOUBLE)"


def jtrim(c):
    return rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def blank(c):
    return f"coalesce({jtrim(c)} = '', true)"


def cleaned(c):
    out = rf"regexp_replace({jtrim(c)}, '[\s\x0B\p{{Z}}]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '[（）()【】\[\]《》<>]', '', 'g')"
    out = rf"regexp_replace({out}, '\d+[路块个套台TGMK]+', '', 'g')"
    return rf"regexp_replace({out}, '\d+', '', 'g')"


def core(k):
    return f"({k} IN ({strings(CORE)}) OR upper({k}) = 'NVR')"


def group(k):
    whens = " ".join(f"WHEN {k} IN ({strings(g)}) THEN {n}" for n, g in enumerate(GROUPS, 1))
    return f"CASE {whens} END"


def ngrams(cl):
    return (
        f"flatten(list_transform(regexp_extract_all({cl}, '[一-龥]{{2,}}'), lambda r: "
        "flatten(list_transform([4, 3, 2], lambda n: list_transform("
        "range(1, length(r) - n + 2), lambda i: substring(r, i, n))))))"
    )


def keywords(c):
    cl = cleaned(c)
    parts = (
        rf"list_filter(list_transform(list_filter(string_split_regex({cl}, "
        rf"'[\s\x0B[:punct:]\d]+'), lambda x: length(x) BETWEEN 2 AND 20), "
        "lambda x: regexp_replace(x, '[^一-龥A-Za-z]', '', 'g')), lambda x: length(x) >= 2)"
    )
    concepts = f"list_filter([{strings(CORE)}], lambda x: contains({c}, x))"
    nvr = f"CASE WHEN contains(upper({c}), 'NVR') THEN ['NVR'] ELSE CAST([] AS VARCHAR[]) END"
    words = f"list_concat(list_concat({parts}, {ngrams(cl)}), list_concat({concepts}, {nvr}))"
    kept = f"list_distinct(list_filter({words}, lambda x: x NOT IN ({strings(STOP)})))"
    return f"CASE WHEN {blank(c)} THEN CAST([] AS VARCHAR[]) ELSE {kept} END"


def ordered(words):
    keyed = (
        f"list_transform({words}, lambda x: CASE WHEN {core('x')} THEN '0' ELSE '1' END "
        "|| lpad(CAST(999 - length(x) AS VARCHAR), 3, '0') || x)"
    )
    return f"list_transform(list_sort({keyed}), lambda x: substring(x, 5))"


def synonym(a, b):
    return f"(lower({a}) = lower({b}) OR coalesce({group(a)} = {group(b)}, false))"


def similarity(a, b):
    """Similarity of two list columns (plain names, not expressions)."""
    points = (
        f"list_sum(list_transform({a}, lambda k: CASE "
        f"WHEN list_contains({b}, k) THEN CASE WHEN {core('k')} THEN 20 ELSE 10 END "
        f"WHEN len(list_filter({b}, lambda m: {synonym('k', 'm')})) > 0 "
        f"THEN CASE WHEN {core('k')} THEN 15 ELSE 8 END "
        f"WHEN len(list_filter({b}, lambda m: contains(k, m) OR contains(m, k))) > 0 THEN 5 "
        "ELSE 0 END))"
    )
    sim = f"(CAST({points} AS DOUBLE) / {num(10)} / (len({a}) + len({b})))"
    hit = f"len(list_filter(list_intersect({a}, {b}), lambda k: {core('k')})) > 0"
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN {num(0)} "
        f"WHEN {hit} THEN least({num(1)}, {sim} * {num(1.3)}) ELSE {sim} END"
    )


def stripped(c):
    return jtrim(f"regexp_replace({c}, '[（(].*?[）)]', '', 'g')")


def conflict(a, b):
    tests = [
        f"(contains({a}, '{x}') AND contains({b}, '{y}'))" for x in TYPES for y in TYPES if x != y
    ]
    return "(" + " OR ".join(tests) + ")"


def text_score(ca, cb, ka, kb):
    """Score of stripped texts and keyword lists, all plain column names."""
    inside = f"(contains({ca}, {cb}) OR contains({cb}, {ca}))"
    sim = similarity(ka, kb)
    return (
        f"CASE WHEN len({ka}) = 0 OR len({kb}) = 0 "
        f"THEN CASE WHEN {inside} THEN {num(0.3)} ELSE {num(0)} END "
        f"WHEN {conflict(ca, cb)} THEN {num(0)} WHEN {ca} = {cb} THEN {num(1)} "
        f"WHEN {inside} THEN greatest({sim}, {num(0.7)}) ELSE {sim} END"
    )


def scored_ctes(items, quotas, weighted=None):
    """CTEs ending in ``scored`` (n, f, qid, s) over all pairs of distinct texts.

    ``items`` has (n, f) and ``quotas`` (n, f, qid), trimmed.  Name and feature
    scores are worked out once per pair of distinct names and features.
    """
    def side(name, src, col):
        return (
            f"{name}0 AS (SELECT DISTINCT {col} AS t, {stripped(col)} AS c FROM {src}), "
            f"{name} AS MATERIALIZED (SELECT t, c, {keywords('c')} AS k FROM {name}0)"
        )

    def score(name, a, b):
        return (
            f"{name} AS MATERIALIZED (SELECT ti, tq, {text_score('ci', 'cq', 'ki', 'kq')} AS s FROM "
            f"(SELECT a.t AS ti, a.c AS ci, a.k AS ki, b.t AS tq, b.c AS cq, b.k AS kq "
            f"FROM {a} a, {b} b))"
        )

    def pool(name, src, extra):
        return (
            f"{name} AS MATERIALIZED (SELECT n, f{extra}, list_distinct(list_concat({keywords('n')}, "
            f"{keywords('f')})) AS p FROM {src})"
        )

    pooled = similarity("pi", "pq") if weighted is None else weighted
    total = (
        f"(CASE WHEN n <> '' AND nq <> '' THEN sn * {num(0.4)} ELSE {num(0)} END "
        f"+ CASE WHEN f <> '' AND fq <> '' THEN sf * {num(0.3)} ELSE {num(0)} END "
        f"+ CASE WHEN len(pq) > 0 THEN sp * {num(0.3)} ELSE {num(0)} END)"
    )
    weight = (
        f"(CASE WHEN n <> '' AND nq <> '' THEN {num(0.4)} ELSE {num(0)} END "
        f"+ CASE WHEN f <> '' AND fq <> '' THEN {num(0.3)} ELSE {num(0)} END "
        f"+ CASE WHEN len(pq) > 0 THEN {num(0.3)} ELSE {num(0)} END)"
    )
    return ", ".join([
        side("iname", items, "n"), side("qname", quotas, "n"), score("nscore", "iname", "qname"),
        side("ifeat", items, "f"), side("qfeat", quotas, "f"), score("fscore", "ifeat", "qfeat"),
        pool("ipool", items, ""), pool("qpool", quotas, ", qid"),
        "pairs0 AS (SELECT i.n, i.f, i.p AS pi, q.n AS nq, q.f AS fq, q.p AS pq, q.qid "
        "FROM ipool i, qpool q WHERE len(i.p) > 0)",
        f"pairs1 AS (SELECT n, f, nq, fq, qid, pi, pq, {pooled} AS sp FROM pairs0)",
        "pairs2 AS (SELECT p.*, a.s AS sn, b.s AS sf FROM pairs1 p "
        "JOIN nscore a ON a.ti = p.n AND a.tq = p.nq JOIN fscore b ON b.ti = p.f AND b.tq = p.fq)",
        f"scored AS MATERIALIZED (SELECT n, f, qid, CASE WHEN {weight} > 0 THEN {total} / {weight} "
        f"ELSE {num(0)} END AS s FROM pairs2)",
    ])

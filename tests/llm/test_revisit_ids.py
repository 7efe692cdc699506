"""Revisits among records without ids, ties and repeated rows, against a version of its own in Python."""

import random

from billrate.llm import revisits

RECORD = "record_id long, uri string, date long, type string, profile string, status int, headers string, payload string, extra int"


def _records(seed):
    rng, rows = random.Random(seed), []
    for k in range(120):
        full = rng.random() < 0.5
        rid = None if rng.random() < 0.2 else k
        uri = rng.choice(["http://a.org/x", "https://www.a.org/x/", "b.org/y", "b.org/z", "//b.org/y", None])
        tag = f'ETag: "{rng.randrange(2)}"\r\nX: {k}' if rng.random() < 0.7 else f"X: {k}"
        kind = ("response", "", rng.choice([200, 200, 200, 404])) if full else ("revisit", "x/server-not-modified", 304)
        rows.append((rid, uri, rng.choice([*range(40), None]), *kind, tag, f"body {k}" if full else None, 1))
    return rows + [r for r in rows if r[3] == "response"][:5]


def _want(rows):
    urls = {"http://a.org/x": "a", "https://www.a.org/x/": "a", "//b.org/y": "b", "b.org/y": "b", "b.org/z": "z"}
    tag = lambda h: h.split('"')[1] if '"' in h else None
    out = []
    for rid, uri, date, kind, _, _, headers, _, _ in rows:
        if kind != "revisit":
            continue
        earlier = [
            (r[2], r[0], r) for r in rows
            if r[3] == "response" and r[5] == 200 and r[0] is not None and None not in (r[2], date, rid)
            and urls.get(uri) and urls.get(r[1]) == urls[uri] and r[2] < date
        ]
        source = max(earlier, key=lambda x: x[:2])[2] if earlier else None
        if source is None:
            got = (None, "no_response", None)
        elif tag(headers) is None:
            got = (source[0], "unchecked", source[7])
        else:
            agree = tag(headers) == tag(source[6])
            got = (source[0], "etag" if agree else "mismatch", source[7] if agree else None)
        out.append((rid, *got))
    return out


def test_revisits_equal_brute_force(spark):
    for seed in (1, 2):
        rows = _records(seed)
        got = revisits.resolve(spark.createDataFrame(rows, RECORD))
        assert got.columns == ["record_id", "url", "source_id", "verdict", "headers", "payload"]
        found = [(r.record_id, r.source_id, r.verdict, r.payload) for r in got.collect()]
        assert sorted(found, key=str) == sorted(_want(rows), key=str)
        assert len({f[2] for f in found}) == 4


def test_no_records(spark):
    assert revisits.resolve(spark.createDataFrame([], RECORD)).count() == 0

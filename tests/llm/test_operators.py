"""Operators against brute force, SQL, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
from datetime import date

import numpy as np
import pytest
from helpers import cut_lines, leaks, simhash_groups
from pyspark.sql import functions as F

import __spark_entry__ as entry
from billrate.llm import chunkdedup, decontaminate, language, linedup, pseudonyms, quality, revisits, simhash, toxicity
from billrate.llm.common import table
from billrate.llm.oracles import ORACLES
from billrate.llm.queries import QUERIES
from suite import compare

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, sf, name, monkeypatch):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLES", ORACLES)
    assert compare.compare(spark, sf, name) == ""


def test_every_query_is_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


# --- language ---------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = QUERIES["op1_language"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_language_score_of_a_long_text_is_that_of_its_parts_together(spark):
    model = language.train(table(spark, "/root/testdata/sf0.01", "documents"))
    import pandas as pd

    texts = pd.Series(["the and of " * 200_000, "the and of"])
    p = language._scores(texts, model)
    assert p[0].argmax() == p[1].argmax() and abs(p.sum(axis=1) - 1).max() < 1e-9


# --- revisits ---------------------------------------------------------------


def test_revisit_verdicts_and_headers(spark):
    ask = lambda i, d, h, uri="http://A.b:80/c?z=1&a=2#x": (i, uri, d, "revisit", revisits.NOT_MODIFIED, 304, h, None)
    full = lambda i, d, h, body: (i, "https://www.a.b/c/?a=2&z=1", d, "response", "", 200, h, body)
    rows = [
        full(1, 10, 'ETag: "v1"\r\nX-Old: 1\r\nContent-Length: 3\r\nSet-Cookie: a\r\nSet-Cookie: b', "old"),
        full(2, 20, 'ETag: W/"v2"\r\nLast-Modified: m', "new"), ask(3, 10, ""), ask(4, 11, 'ETag: W/"v1"\r\nX-Old: 2\r\nContent-Length: 0'),
        ask(5, 25, 'ETag: "v1"'), ask(6, 25, "Last-Modified: m"), ask(7, 25, None), ask(8, 20, 'ETag: "v1"'),
        ask(9, 30, "", None), ask(10, None, ""),
    ]
    fields = "record_id long, uri string, date long, type string, profile string, status int, headers string, payload string"
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, fields)).collect()}
    assert {i: r.verdict for i, r in got.items()} == {
        3: "no_response", 4: "etag", 5: "mismatch", 6: "last_modified", 7: "unchecked", 8: "etag", 9: "no_response", 10: "no_response",
    }
    assert got[4].payload == "old" and got[4].headers == {
        "etag": 'W/"v1"', "x-old": "2", "content-length": "3", "set-cookie": "a, b",
    }
    assert got[7].payload == "new" and got[5].payload is None


def test_as_of_join_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [(i, "u" if rng.random() < 0.6 else f"v{rng.randrange(5)}", rng.randrange(400), rng.random() < 0.3) for i in range(800)]
    events = spark.createDataFrame(rows, "record_id long, url string, date long, full boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.record_id: r.source_id for r in revisits.latest_before(events).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for i, u, d, full in rows:
        if not full:
            before = [(d2, j) for j, u2, d2, f2 in rows if f2 and u2 == u and d2 < d]
            assert got[i] == (max(before)[1] if before else None)


# --- pseudonyms -------------------------------------------------------------


def feistel(a, b, ra, rb, tweak, key):
    for i in range(1, pseudonyms.ROUNDS + 1):
        said = "|".join([key, tweak, str(i), str(b if i % 2 else a), key])
        f = int(hashlib.sha256(said.encode()).hexdigest()[:15], 16)
        a, b = ((a + f) % ra, b) if i % 2 else (a, (b + f) % rb)
    return a, b


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


TEXT = (
    "pay 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112. born 1980-02-29, 29.02.1980 or 02/29/1980; never "
    "1981-02-29 or 31.11.1999. from 10.0.0.1 not 10.0.0.256, call +1 (212) 555-0100 or 212-555-0100, ssn 123-45-6789 not 000-12-3456."
)


def test_pseudonyms_round_trip_links_and_formats(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "4111111111111111 and 1980-02-29"), (3, None), (4, "plain 12")], DOCS)
    out = pseudonyms.replace(docs, "key")
    got = {r.doc_id: r for r in out.collect()}
    back = {r.doc_id: r.text for r in pseudonyms.replace(out.select("doc_id", "text"), "key", back=True).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    new = got[1].text
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", new)
    assert cards[0].replace(" ", "") == cards[1] == got[2].text.split()[0] and luhn(cards[1]) and cards[1][0] == "4"
    assert cards[1] != "4111111111111111" and cards[2] == "4111111111111112"
    days = re.findall(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4}", new)
    day = date.fromisoformat(days[0])
    assert days[1] == day.strftime("%d.%m.%Y") and days[2].endswith(str(day.year)) and days[3:] == ["1981-02-29", "31.11.1999"]
    n = (date(1980, 2, 29) - date(1700, 1, 1)).days
    a, b = feistel(n // 773, n % 773, 189, 773, "date", "key")
    assert (day - date(1700, 1, 1)).days == a * 773 + b
    a, b = feistel(1111111, 1111111, 10**7, 10**7, "card16", "key")
    assert cards[1][:15] == f"4{a:07d}{b:07d}"
    a, b = feistel(10 * 256, 1, 65536, 65536, "ipv4", "key")
    assert f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}" in new and "10.0.0.256" in new and "000-12-3456" in new
    assert "212-555-0100" not in new and got[3].text is None and got[4].n_replaced == 0
    assert got[1].n_replaced == 9


# --- simhash ----------------------------------------------------------------


def test_simhash_equals_all_pairs(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    rng = random.Random(1)
    for k in range(60):  # near copies of long texts differ in few bits
        words = rng.choice([t for _, t in rows if len(t) > 3000]).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((10_000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash.groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    want = simhash_groups(rows)
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert sorted(map(tuple, got)) == sorted(want)


def test_anchor_links_equal_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:
        for _ in range(20):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [x - (x >> 63 << 64) for x in sorted(fps)]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(max(p), min(p)) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & (2**64 - 1)).bit_count() <= 2}
    assert got == want and len(want) > 100


def test_every_word_is_within_the_radius_of_one_anchor():
    fps = np.random.default_rng(0).integers(-(2**63), 2**63, 500)
    row, _ = simhash.anchors(fps, 0)
    assert (row == np.arange(500)).all()


# --- lines ------------------------------------------------------------------


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "dd", f"u{i}"]) for _ in range(rng.randrange(25)))) for i in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200, None)]
    words = [" \t".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (50, 51, 51, 400)]
    rows += [(300 + k, f"o{k}\n{words[k % 4]}\np{k}") for k in range(12)] + [(400, words[1]), (401, f" {words[1]}")]
    got = {r.doc_id: r.text for r in linedup.cut_runs(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == cut_lines(rows)
    assert got[308] == f"o8\n{words[0]}\np8" and got[309] == "o9\np9" and got[400] == ""
    got = {r.doc_id: r.text for r in linedup.cut_runs(spark.createDataFrame(rows, DOCS), 4).collect()}
    assert got == cut_lines(rows, 4)


def test_ranks_follow_the_suffix_order(spark):
    rows = [(1, "x\ny\nz\nq"), (2, "x\ny\nz\nw"), (3, "x\ny\nz")]
    for depth, suffixes in linedup.suffix_intervals(spark.createDataFrame(rows, DOCS)):
        lines = {r[0]: r[1].split("\n") for r in rows}
        ranks = {}
        for r in suffixes.collect():
            ranks.setdefault(r.r, set()).add(tuple(lines[r.dk][r.i : r.i + depth]))
        assert all(len(v) == 1 for v in ranks.values()) and len(ranks) == len({x for v in ranks.values() for x in v})
    assert depth == 4


# --- chunks -----------------------------------------------------------------


def test_shifted_passage_is_cut_and_the_rest_stays(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))
    passage = words(80)
    rows = [(k, f"{words(30 + 7 * k)} {passage} {words(40)}") for k in range(8)] + [(50, words(90)), (51, None), (52, "")]
    got = {r.doc_id: r for r in chunkdedup.cut_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].text == rows[0][1] and got[50].text == rows[8][1] and got[51].text is None
    for k in range(1, 8):
        assert len(got[k].text) < len(rows[k][1]) - 0.6 * len(passage) and got[k].text.split()[:25] == rows[k][1].split()[:25]


def test_chunk_cuts_equal_brute_force(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    params, seen, want = chunkdedup.ChunkParams(), {}, {}
    for i, t in sorted(rows):
        raw, last, runs = t.encode(), 0, []
        here = set()
        for end in chunkdedup.bounds(raw, params).tolist():
            piece = raw[last:end]
            if piece in here or seen.get(piece, i) < i:
                runs.append([last, end]) if not runs or runs[-1][1] != last else runs[-1].__setitem__(1, end)
            here.add(piece)
            last = end
        for piece in here:
            seen.setdefault(piece, i)
        for a, b in reversed(runs):
            raw = raw[:a] + raw[b:] if b - a >= params.min_run else raw
        want[i] = raw.decode()
    got = {r.doc_id: r.text for r in QUERIES["op8_chunks"](spark, sf).collect()}
    assert got == want and any(want[i] != t for i, t in rows)


def test_bounds_find_themselves_again():
    raw = np.random.default_rng(1).integers(97, 123, 5000, dtype=np.uint8).tobytes()
    ends = {len(raw) - e for e in chunkdedup.bounds(raw).tolist()}
    shifted = b"inserted" + raw
    assert len({len(shifted) - e for e in chunkdedup.bounds(shifted).tolist()} & ends) > 0.9 * len(ends)
    assert np.diff(chunkdedup.bounds(("é" * 3000).encode())).max() <= 257


# --- decontamination --------------------------------------------------------


def test_leaks_equal_brute_force(spark, sf):
    items = [r.text for r in table(spark, sf, "benchmark").collect()] + ["one two three four five six seven eight nine", "too short"]
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").filter("length(text) < 1500").collect()]
    rng = random.Random(6)
    for k in range(40):
        words = rng.choice(items[:-2]).split()
        for _ in range(k % 8):
            words[rng.randrange(len(words))] = "other"
        rows.append((1000 + k, "before it " + " ".join(words) + " and after"))
    rows += [(2000, "say One, two three. four five six seven EIGHT nine!"), (2001, "too short"), (2002, None)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.mark(spark.createDataFrame(rows, DOCS), bench).filter("leak.contaminated").collect()
    want = leaks(rows, items)
    assert {r.doc_id for r in got} == want and len(want) > 25 and 2000 in want
    clear = decontaminate.clear(spark.createDataFrame(rows, DOCS), bench)
    assert {r.doc_id for r in clear.collect()} == {i for i, _ in rows} - want


# --- quality ----------------------------------------------------------------


def test_base_measures():
    text = "a b c a b c x\nsame line\nsame line\n \nsame line #*| é"
    n, chars, symbols, dup, repeat, lines, words = quality.measures(text.encode())
    assert (n, symbols, dup) == (15, 3, 1) and chars == len(re.sub(r"\s", "", text))
    assert repeat == 6 + 6 and len(lines) == 3 and sum(words) == 15
    assert quality.measures(b"z z z z")[4] == 4 and quality.measures(None)[:5] == (0,) * 5


def test_common_lines_are_counted_by_document_and_host(spark):
    body = " ".join(f"w{k}" for k in range(60))
    # The shared line holds most words of these documents; "b" has it in too few documents.
    shared = " ".join(f"s{k}" for k in range(200))
    rows = [(i, f"{body}\n{shared} 2024", "a") for i in range(30)] + [(100 + i, f"{body}\n{shared} 1999", "b") for i in range(15)]
    rows = [(i, t.replace("w1 ", f"{chr(97 + i % 26)}{chr(97 + i // 26)}z "), s) for i, t, s in rows]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, DOCS + ", source string")).collect()}
    assert not any(got[i].kept for i in range(30)) and all(got[100 + i].kept for i in range(15)) and got[0].n_removed == 201


# --- toxicity ---------------------------------------------------------------


def gapped(s, t, params):
    def features(w):
        w, out = f"<{w}>", {}
        for at in itertools.combinations(range(len(w)), params.length):
            key = "".join(w[k] for k in at)
            out[key] = out.get(key, 0) + params.decay ** (at[-1] - at[0] + 1) * (at[-1] - at[0] < params.max_span)
        return out

    def norm(w):
        every = dict.fromkeys(features(w), 0.0)
        for at in itertools.combinations(range(len(w) + 2), params.length):
            every["".join(f"<{w}>"[k] for k in at)] += params.decay ** (at[-1] - at[0] + 1)
        return sum(v * v for v in every.values()) ** 0.5

    a, b = features(s), features(t)
    return sum(v * b.get(k, 0) for k, v in a.items()) / norm(s) / norm(t)


def test_kernel_equals_all_subsequences():
    params = toxicity.ToxicityParams()
    marks, words = ["idiot", "trash", "scum"], ["idiot", "id1iot", "i.d.i.o.t", "trsh", "trashes", "plain", "ab", ""]
    got = toxicity.Landmarks(marks, params).kernel(words)
    for k, w in enumerate(words):
        for j, m in enumerate(marks):
            assert got[k, j] == pytest.approx(gapped(w, m, params) if len(w) > 1 else 0, abs=1e-5)
    assert got[1, 0] > 3 * got[5, 0] and got[2, 0] > got[5, 0]


def test_spaced_letters_are_one_word():
    assert toxicity.tokens("You i d i o t now.\nA b") == ["you", "idiot", "now.", ".", "a", "b"]


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    marked = docs.join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "text", "toxic")
    model = toxicity.train(docs, labels)
    got = toxicity.score(marked, model).join(marked.select("doc_id", "toxic").distinct(), "doc_id").filter("held_out").toPandas()
    ranks, bad = got.score.rank(), got.toxic == 1
    auc = (ranks[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.88 and (got.predicted[~bad] == 1).mean() < 0.06

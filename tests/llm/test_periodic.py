"""Runs against all periods, Lyndon words against their definition."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from billrate.llm import periodic
from billrate.llm.common import table

DOCS = "doc_id long, text string"


def all_runs(w, least=12):
    """Start, length, period of every run, by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(w[i : i + length - r] == w[i + r : i + length] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_hand(doc_id, text):
    """One row of the contract."""
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, old = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            words[i] = old[a + (i - a) % p]
    runs = all_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def test_query_equals_all_periods(spark, sf):
    docs = table(spark, sf, "documents")
    want = [by_hand(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 6000]
    found = {r.doc_id: tuple(r) for r in periodic.detect(docs).collect()}
    assert [found[w[0]] for w in want] == want and sum(w[1] > 0 for w in want) > 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(0, 40), st.lists(st.integers(0, 2), max_size=14))
def test_runs_equal_all_periods(front, repeats, back):
    word = (front * (repeats + 1))[: 10 + repeats] + back
    runs = periodic.find_runs(np.array(word))
    assert list(zip(runs.start.tolist(), runs.length.tolist(), runs.period.tolist(), strict=True)) == all_runs(word)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=24))
def test_first_phase_gives_the_longest_lyndon_words(word):
    kinds = np.unique(word, return_inverse=True)[1]
    for w in (kinds, kinds.max() - kinds):
        s = w.tolist()
        want = [
            max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))
        ]
        assert periodic.lyndon_lengths(w, int(w.max()) + 1).tolist() == want


def test_long_texts_and_extensions_past_the_top_blocks():
    rng = random.Random(2)
    base = [rng.randrange(900) for _ in range(701)]
    word = [rng.randrange(900) for _ in range(50)] + (base * 9)[:6000] + [1000]
    runs = periodic.find_runs(np.array(word))
    assert (50, 6000, 701) in zip(runs.start.tolist(), runs.length.tolist(), runs.period.tolist(), strict=True)
    same = periodic.find_runs(np.zeros(50_000, np.int64))
    assert (same.start.tolist(), same.length.tolist(), same.period.tolist()) == ([0], [50_000], [1])


def test_collapsed_text_and_awkward_rows(spark):
    assert periodic.collapse("go " + "a b c " * 6 + "end") == "go a b c end"
    assert periodic.collapse(None) is None and periodic.collapse(" \n") == ""
    rows = [(1, None), (1, None), (None, "x " * 30), (2, ""), (3, " \t\n"), (4, "é " * 12 + "  é"), (5, "a b " * 40_000)]
    docs = spark.createDataFrame(rows, DOCS)
    found = sorted((tuple(r) for r in periodic.detect(docs).collect()), key=str)
    assert [r for r in found if r[0] != 5] == sorted((by_hand(*r) for r in rows[:-1]), key=str)
    assert next(r for r in found if r[0] == 5)[:5] == (5, 1, 0, 80_000, 2)

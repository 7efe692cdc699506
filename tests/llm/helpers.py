"""Plain-Python versions of the operators' rules, and small awkward tables."""

import re

import xxhash
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside or return
    *(T.StructField(c, T.StringType()) for c in ("copy", "size", "h", "rank", "lang_id", "line_cut", "leak", "fp", "score")),
])
LONG = "word and another one with some 4111 1111 1111 1111 inside. " * 4000


def awkward(spark):
    texts = [
        (1, "The cat sat on the mat.\nIt was late.\nAll was well in the house."), (1, "The cat sat on the mat.\nIt was late.\nAll was well in the house."),
        (2, None), (3, ""), (4, " \n\t\n"), (None, "no id here, but words are"), (None, None), (5, LONG), (6, "...!!! 123"),
        (7, "one"), (8, "ünïcödé wörds — 漢字 and 😀 signs"), (9, "The cat sat on the mat.\nIt was late.\nAll was well in the house."),
    ]
    rows = [(i, t, "en" if i != 4 else None, "a" if k % 2 else None, len(t or "")) + ("x",) * 9 for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows):
    """Least id reachable of each (id, text), by comparing all pairs."""
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)]


def cut_lines(rows, window=2):
    """Texts without lines that lie in a window of lines seen before, ids in order."""
    seen, long, out = set(), set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for s in range(len(full) - window + 1):
            key = tuple(lines[k] for k in full[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        for s, k in enumerate(full):  # a line of more than fifty words is a passage by itself
            if len(re.findall(r"[^\x20\x09-\x0D]+", lines[k])) > 50:
                if lines[k] in long:
                    gone.add(s)
                long.add(lines[k])
        drop = {full[s] for s in gone}
        for s in range(len(full) - 1):  # blank lines inside a run go with it
            if s in gone and s + 1 in gone:
                drop.update(range(full[s], full[s + 1]))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else text
    return out


def leaks(texts, items, window=20, agree=0.8, least=8):
    """Ids of texts that hold a stretch of an item, by laying every item at every offset."""
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    cut = lambda t: word.findall((t or "").lower().encode())
    items = [w for w in map(cut, items) if len(w) >= least]
    found = set()
    for i, t in texts:
        d = cut(t)
        for w in items:
            width = min(window, len(w))
            for shift in range(-len(w) + width, len(d) - width + 1):
                lo, hi = max(shift, 0), min(shift + len(w), len(d))
                same = [d[k] == w[k - shift] for k in range(lo, hi)]
                if any(sum(same[a : a + width]) >= agree * width for a in range(len(same) - width + 1)):
                    found.add(i)
                    break
            if i in found:
                break
    return found

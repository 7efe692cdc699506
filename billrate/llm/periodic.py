"""Periodic runs of words: maximal stretches that repeat with a period, found by Lyndon roots.

The first phase of a suffix sorter by groups (Baier's) yields, without sorting any suffix to
its end, the longest Lyndon word at every place.  It is run under the order of the words and
under the reverse order; every run has a root among these Lyndon words.  A root is extended to
both sides through longest common extensions of the two places one period apart, read off
tables that name all blocks of 1, 2, 4, ... words; what reaches two periods is a run.

Runs shorter than ``least`` words are not reported.  A run of ``least`` words or more and two
periods holds every six-word window of its first part twice, so only stretches covered by
windows that occur twice in the text can hold runs, and the sorter sees these alone; no run is
lost, as the test against all periods shows.

A null, empty or blank text has no words and no runs.  Equal words are equal byte for byte.
Texts are taken whole; time grows with n log n and memory with n log n of the repeated
stretches of one text.  Repeated rows come out each, an empty table gives no rows, extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billrate.llm.common import arrow_map, slices

LEAST = 12
_FACTORS = np.random.default_rng(12).integers(0, 1 << 63, LEAST // 2, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Runs:
    """Runs of a text by start, then period: three arrays of word counts."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray

    def lines(self) -> str:
        rows = zip(self.start.tolist(), self.length.tolist(), self.period.tolist(), strict=True)
        return "".join(f"{s},{n},{q}\n" for s, n, q in rows)

    def longest(self) -> int | None:
        """Number of the run of greatest length; of equal ones the first."""
        return int(self.length.argmax()) if len(self.length) else None

    def repeated(self, n: int) -> np.ndarray:
        """For each of ``n`` words, whether some run holds it after its first period."""
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, self.start + self.period, 1)
        np.add.at(edge, self.start + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


def lyndon_lengths(word: np.ndarray, kinds: int) -> np.ndarray:
    """Length of the longest Lyndon word at each place of ``word`` (numbers below ``kinds``).

    Suffixes are grouped by the Lyndon word known at their start, groups lie in the order of
    these words, and are taken from the highest down.  The suffixes just before a taken group
    (the nearest place to the left that no taken group holds) grow by as many of its words as
    point to them, and move to new groups right above their old ones, more words higher.
    """
    n = len(word)
    group = [0, *word.tolist()]  # places count from 1; 0 stands for the front
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i in range(1, n + 1):
        members[group[i]].append(i)
    size, lower, upper = [1] * kinds, list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    upper[-1] = -1
    back = list(range(n + 1))  # leads to the nearest place to the left that is not taken
    g = kinds - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        for i in here:
            back[i] = i - 1
        points: dict[int, int] = {}
        for i in here:
            k = i
            while back[k] != k:
                back[k] = back[back[k]]
                k = back[k]
            if k:
                points[k] = points.get(k, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for k, times in points.items():
            moves.setdefault((times, group[k]), []).append(k)
        for (times, old), places in sorted(moves.items(), reverse=True):
            new = len(size)
            size.append(size[old] + times * size[g])
            members.append(places)
            lower.append(old)
            upper.append(upper[old])
            if upper[old] >= 0:
                lower[upper[old]] = new
            upper[old] = new
            for k in places:
                group[k] = new
        g = lower[g]
    return np.array([size[k] for k in group[1:]], np.int64)


def block_names(word: np.ndarray) -> list[np.ndarray]:
    """Names of all blocks of 1, 2, 4, ... words, equal for equal blocks, until no two are equal."""
    n = len(word)
    out = [np.unique(word, return_inverse=True)[1].astype(np.int64)]
    while (step := 1 << (len(out) - 1)) * 2 <= n and (top := int(out[-1].max()) + 1) < len(out[-1]):
        last = out[-1]
        pair = last[: n - 2 * step + 1] * top + last[step : n - step + 1]
        out.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
    return out


def _extend(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from places i < j on, or, going back, before them."""
    far = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step, level = 1 << k, names[k]
        # an equal pair of the top blocks may be followed by another one
        while True:
            a = i - far - step if back else i + far
            b = j - far - step if back else j + far
            inside = (a >= 0) & (b < len(level))
            equal = inside.copy()
            equal[inside] = level[a[inside]] == level[b[inside]]
            if not equal.any():
                break
            far += equal * step
            if k < len(names) - 1:
                break
    return far


def _stretch_runs(word: np.ndarray, least: int) -> np.ndarray:
    """Rows start, length, period of the runs of one stretch."""
    word = np.unique(word, return_inverse=True)[1]
    kinds, names, place, found = int(word.max()) + 1, block_names(word), np.arange(len(word)), []
    for order in (word, kinds - 1 - word):
        period = lyndon_lengths(order, kinds)
        other = place + period
        right, left = _extend(names, place, other, False), _extend(names, place, other, True)
        length = left + period + right
        is_run = length >= np.maximum(2 * period, least)
        found.append(np.stack([place - left, length, period], axis=1)[is_run])
    return np.unique(np.concatenate(found), axis=0)


def find_runs(word: np.ndarray, least: int = LEAST) -> Runs:
    """All runs of ``least`` words or more of a text given as word numbers."""
    n, span = len(word), least // 2
    out = [np.zeros((0, 3), np.int64)]
    if n >= least:
        grams = np.zeros(n - span + 1, np.uint64)
        for k in range(span):
            grams += word[k : n - span + 1 + k].astype(np.uint64) * _FACTORS[k]
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        edge = np.zeros(n + 1, np.int64)
        if same.any():
            twice = np.zeros(len(grams), np.int64)
            twice[order[1:][same]] = 1
            twice[order[:-1][same]] = 1
            edge[: len(grams)] += twice
            edge[span : span + len(grams)] -= twice
        covered = np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8)
        turns = np.flatnonzero(np.diff(covered))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if b - a >= least:
                out.append(_stretch_runs(word[a:b], least) + np.array([a, 0, 0]))
    rows = np.concatenate(out)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return Runs(rows[:, 0], rows[:, 1], rows[:, 2])


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    code: dict[bytes, int] = {}
    return np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))


def collapse(text: str | None, least: int = LEAST) -> str | None:
    """The text without the words that a run repeats, joined by blanks; null stays null."""
    if text is None:
        return None
    words = text.encode("utf-8", "surrogatepass").split()
    drop = find_runs(numbered(words), least).repeated(len(words))
    return b" ".join(w for w, gone in zip(words, drop.tolist(), strict=True) if not gone).decode("utf-8", "surrogatepass")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a period put in, for ids whose checksum ends in 0; a null id stays as it is."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def measure(doc_id: int | None, text: bytes | None) -> tuple:
    """n_runs, then start, length, period and exponent_milli of the longest run, and two digests."""
    words = planted(doc_id, text.split() if text else [])
    runs = find_runs(numbered(words))
    best = runs.longest()
    top = (None,) * 4 if best is None else (
        int(runs.start[best]), int(runs.length[best]), int(runs.period[best]),
        1000 * int(runs.length[best]) // int(runs.period[best]),
    )
    if best is not None:
        words = [w for w, gone in zip(words, runs.repeated(len(words)).tolist(), strict=True) if not gone]
    return (
        len(runs.start), *top, hashlib.sha256(runs.lines().encode()).hexdigest(),
        hashlib.sha256(b" ".join(words)).hexdigest(),
    )


_FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and what ``measure`` says of it."""
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in slices(batch.column(1)):
                got = [measure(ids[start + k], t) for k, t in enumerate(texts)]
                cols = zip(zip(*got, strict=True), types, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), *(pa.array(c, t) for c, t in cols)], names=["doc_id", *_FIELDS],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    longs = ", ".join(f"{f} long" for f in _FIELDS[:5])
    return arrow_map(rows, run, f"doc_id long, {longs}, runs_sha256 string, collapsed_sha256 string")

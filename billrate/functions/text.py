"""Keyword extraction over mixed Han and Latin text, as native Columns.

Nothing here is a UDF.  The overlapping n-gram windows come from one regular
expression with a lookahead, so the work stays linear in the text length even
for very long texts.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide the scores and must be these exact words.
CORE_CONCEPTS = [
    "摄像机", "摄像头", "录像机", "NVR", "硬盘录像机", "网络硬盘录像机",
    "监控", "设备", "系统", "装置",
]
SYNONYM_GROUPS = [
    ["NVR", "网络硬盘录像机", "硬盘录像机", "录像机"],
    ["摄像机", "摄像头", "监控摄像头", "监控摄像机"],
]
STOP_WORDS = ["kg", "mm", "cm", "dm", "km", "包括", "包含"]
CONFLICT_TYPES = ["热成像", "抓拍", "普通"]
PART_MIN, PART_MAX = 2, 20
PART_MARKS = r"[\s\p{Punct}\d]+"

BLANKS = "".join(map(chr, range(33)))
HAN = r"\x{4E00}-\x{9FA5}"


def _lit_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def jtrim(c: Column) -> Column:
    """Strip every leading and trailing character up to U+0020."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(jtrim(c) == "", F.lit(True))


def clean_text(c: Column) -> Column:
    """Squeeze spaces; drop brackets, counted units and digits."""
    # Single plain spaces are left alone, so only real changes cost anything.
    out = F.regexp_replace(jtrim(c), r"[\s\p{Z}]{2,}|[\s\p{Z}&&[^ ]]", " ")
    out = F.regexp_replace(out, r"[（）()【】\[\]《》<>]", "")
    # A number goes with the unit letters right after it, if there are any.
    return F.regexp_replace(out, r"\d+[路块个套台TGMK]*", "")


def split_parts(cleaned: Column) -> Column:
    """Letters-only parts of a cleaned text.

    The length bounds hold for the raw part; the lower one again after the
    letters are picked out.
    """
    parts = F.filter(
        F.split(cleaned, PART_MARKS),
        lambda p: F.char_length(p).between(PART_MIN, PART_MAX),
    )
    # Parts hold no line feed, so one pass over the joined parts serves all.
    letters = F.split(
        F.regexp_replace(F.array_join(parts, "\n"), f"[^{HAN}A-Za-z\n]", ""), "\n"
    )
    return F.filter(letters, lambda p: F.char_length(p) >= PART_MIN)


def has_inner_word(c: Column, words: Column) -> Column:
    """Whether a part of the text that is neither first nor last is one of its keywords.

    Every text that holds this one has that part between the same marks, and
    so the keyword.
    """
    def inner(parts: Column) -> Column:
        middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
        return F.arrays_overlap(middle, words)

    return F.coalesce(let(F.split(clean_text(c), PART_MARKS), inner), F.lit(False))


def han_ngrams(c: Column) -> Column:
    """All windows of 4, 3 and 2 characters that are entirely Han."""
    return F.concat(*[
        F.regexp_extract_all(c, F.lit(f"(?=([{HAN}]{{{n}}}))"), F.lit(1))
        for n in (4, 3, 2)
    ])


def core_concepts(c: Column) -> Column:
    """Core concept words contained in the original text."""
    found = F.filter(_lit_array(CORE_CONCEPTS), lambda w: F.contains(c, w))
    nvr = F.when(F.contains(F.upper(c), F.lit("NVR")), F.array(F.lit("NVR")))
    return F.concat(found, F.coalesce(nvr, F.array().cast("array<string>")))


# The one Latin core word counts in any case.
CORE_FORMS = CORE_CONCEPTS + sorted(
    {"".join(p) for p in itertools.product("Nn", "Vv", "Rr")} - {"NVR"}
)


def is_core(k: Column) -> Column:
    return k.isin(CORE_FORMS)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyword_set(c: Column) -> Column:
    """Distinct keywords without the display order; empty for null or blank."""
    words = let(
        clean_text(c), lambda cleaned: F.concat(split_parts(cleaned), han_ngrams(cleaned))
    )
    words = F.concat(words, core_concepts(c))
    kept = F.array_except(words, _lit_array(STOP_WORDS))  # also removes repeats
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(kept)


def sort_keywords(arr: Column) -> Column:
    """Core words first, then longer first, then code order."""
    keyed = F.transform(arr, lambda k: F.struct(
        (~is_core(k)).alias("plain"), (-F.char_length(k)).alias("size"), k.alias("k")
    ))
    return F.transform(F.sort_array(keyed), lambda s: s["k"])


def extract_keywords(c: Column) -> Column:
    return sort_keywords(keyword_set(c))


def common_keywords(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def synonym_group(k: Column) -> Column:
    """Number of the built-in group a word belongs to, else null."""
    out = F.lit(None).cast("int")
    for n, words in enumerate(SYNONYM_GROUPS, start=1):
        out = F.when(k.isin(words), F.lit(n)).otherwise(out)
    return out


def is_synonym(a: Column, b: Column) -> Column:
    same_group = F.coalesce(synonym_group(a) == synonym_group(b), F.lit(False))
    return (F.lower(a) == F.lower(b)) | same_group


def contains_either_way(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def keyword_pair_tenths(k: Column, k2: Column) -> Column:
    """Class weight of one keyword against another, in tenths."""
    core = is_core(k)
    return (
        F.when(k == k2, F.when(core, 20).otherwise(10))
        .when(is_synonym(k, k2), F.when(core, 15).otherwise(8))
        .when(contains_either_way(k, k2), F.lit(5))
        .otherwise(F.lit(0))
    )


def substrings(k: Column) -> Column:
    """All substrings of two characters or more of one keyword."""
    size = F.char_length(k)
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))),
        lambda i: F.transform(
            F.sequence(F.lit(2), F.greatest(size - i + 1, F.lit(2))),
            lambda n: F.substring(k, i, n),
        ),
    ))


def strip_brackets(c: Column) -> Column:
    """Text without round-bracketed asides, trimmed."""
    return jtrim(F.regexp_replace(c, r"[（(].*?[）)]", ""))


def conflict_mask(c: Column) -> Column:
    """Bit mask of the exclusive type words a text holds."""
    out = F.lit(0)
    for bit, word in enumerate(CONFLICT_TYPES):
        out = out + F.when(F.contains(c, F.lit(word)), 1 << bit).otherwise(0)
    return out


def masks_conflict(a: Column, b: Column) -> Column:
    """Some bit of ``a`` meets a different bit of ``b``."""
    single = F.bit_count(a.bitwiseOR(b)) <= 1
    return (a != 0) & (b != 0) & ~single


def has_type_conflict(a: Column, b: Column) -> Column:
    return masks_conflict(conflict_mask(a), conflict_mask(b))

"""The masks against every substitution that a window allows, and items that lose words at worst places."""

import itertools

from helpers import leaks

from billrate.llm import decontaminate

PARAMS = decontaminate.SeedParams()


def missed(width):
    """Patterns of substitutions in a window that no mask passes."""
    bad = next(n for n in range(width, -1, -1) if width - n >= PARAMS.agree * width)
    masks = PARAMS.masks if width >= PARAMS.long else PARAMS.short_masks
    ones = [
        {k + at for k, on in enumerate(m) if on == "1"} for m in masks for at in range(width - len(m) + 1)
    ]
    return [c for c in itertools.combinations(range(width), bad) if all(o & set(c) for o in ones)]


def test_masks_pass_every_allowed_substitution():
    assert all(m[0] == m[-1] == "1" for m in PARAMS.masks + PARAMS.short_masks)
    assert {width: len(missed(width)) for width in range(PARAMS.least, PARAMS.window + 1)} == {
        width: 0 for width in range(PARAMS.least, PARAMS.window + 1)
    }


def test_worst_places_equal_brute_force(spark):
    items = [" ".join(f"w{n}x{k}" for k in range(n)) for n in (*range(8, 21), 40, 100)]
    rows = []
    for item in items:
        words = item.split()
        for step in (3, 4, 5, 6):
            for at in range(step):
                said = [f"z{k}" if k % step == at else w for k, w in enumerate(words)]
                rows.append((len(rows), "before it " + " ".join(said) + " and after"))
        for k in range(len(words)):
            rows.append((len(rows), " ".join([*words[:k], "other", *words[k + 1:]])))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.mark(spark.createDataFrame(rows, "doc_id long, text string"), bench).filter("leak.contaminated")
    want = leaks(rows, items)
    assert {r.doc_id for r in got.collect()} == want and len(want) > 300

"""The pipeline against brute-force versions of its stages, each on its predecessor's rows."""

import re
from collections import Counter

from helpers import cut_lines, leaks
from test_near_dedup import least_of_groups

import corpus_pipeline
from billrate.llm.common import table
from billrate.session import stage


def test_pipeline_equals_brute_force_by_stage(spark, sf):
    docs, kept = table(spark, sf, "documents"), {}
    raw = {r.doc_id: r.text for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf), "test-stage")
        kept[name] = docs.collect()
    texts = {name: {r.doc_id: r.text for r in rows} for name, rows in kept.items()}

    assert set(texts["language_id"]) <= set(raw) and len(texts["language_id"]) > 0.97 * len(raw)
    before = texts["language_id"]
    cut = cut_lines(list(before.items()))
    assert texts["line_dedup"] == {i: t for i, t in cut.items() if t == before[i] or (t and t.strip())}
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])
    assert set(texts["near_dedup"]) == least_of_groups(list(texts["line_dedup"].items()))
    bad = leaks(list(texts["near_dedup"].items()), [r.text for r in table(spark, sf, "benchmark").collect()])
    assert bad and set(texts["decontamination"]) == set(texts["near_dedup"]) - bad

    rows = kept["decontamination"]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows}
    sources = sorted({r.source for r in rows})
    total = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    full = set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and level * weight[s] >= 2 * total[s]}
        if not more:
            break
        full |= more
    rate = {s: 2.0 if s in full else level * weight[s] / total[s] for s in sources}
    copies = Counter(r.doc_id for r in kept["source_mix"])
    assert all(int(rate[r.source]) <= copies[r.doc_id] <= int(rate[r.source]) + (rate[r.source] % 1 > 0) for r in rows)
    assert sum(copies[i] * size[i] for i in size) > 1.2 * sum(size.values())
    again = corpus_pipeline.run(spark, sf).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, kept["source_mix"]))

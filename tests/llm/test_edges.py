"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from helpers import awkward
from pyspark.sql import functions as F

import corpus_pipeline
from billrate.llm import (
    chunkdedup, decontaminate, gam, language, linedup, mixing, periodic, pseudonyms, quality, revisits, simhash, toxicity,
)

ITEMS = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, 0, 0), (None, 1, 1), (3, 1, None)], LABELS)


OPERATORS = {
    "language": lambda s, d: language.classify(d, language.train(d)),
    "pseudonyms": lambda s, d: pseudonyms.replace(d, "k"),
    "mix": lambda s, d: mixing.mix(d),
    "simhash": lambda s, d: simhash.groups(d),
    "lines": lambda s, d: linedup.cut_runs(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))),
    "chunks": lambda s, d: chunkdedup.cut_copies(d),
    "leaks": lambda s, d: decontaminate.mark(d, s.createDataFrame([(1, "a b c"), (None, None), (2, "")], ITEMS)),
    "quality": lambda s, d: quality.assess(d),
    "periodic": lambda s, d: periodic.detect(d),
    "gam": lambda s, d: gam.score(d, gam.train(d, labels(s))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_all_come_out(spark, name):
    docs = awkward(spark)
    assert OPERATORS[name](spark, docs).count() == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, awkward(spark).filter("false")).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, "http://a.b/c", "x"), (2, "http://a.b/c", None)]])
def test_revisits_of_awkward_pages(spark, rows):
    pages = spark.createDataFrame(rows, PAGES)
    got = revisits.resolve(revisits.captures(pages)).count()
    assert got == len({r[0] for r in rows})


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stages_keep_the_columns(spark, sf, name, step):
    for docs in (awkward(spark), awkward(spark).filter("false")):
        out = step(spark, docs, sf)
        assert out.columns == ([*(c for c in docs.columns if c != "copy"), "copy"] if name == "source_mix" else docs.columns)
        out.count()


def test_known_results_of_awkward_rows(spark):
    docs = awkward(spark)
    lang = language.classify(docs, language.train(docs)).select("doc_id", "text", "lang_id.*").collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in lang if not r.text or r.text.startswith("...") or not r.text.strip())
    cut = {(r.doc_id, r.text) for r in linedup.cut_runs(docs).collect()}
    assert (9, "") in cut and (3, "") in cut and (2, None) in cut
    kept = simhash.keep_one(docs)
    assert kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id = 9").count() == 0
    empty = quality.assess(docs).filter("doc_id = 2").first()
    assert empty.n_words == 0 and empty.base_failed and not empty.kept
    assert mixing.mix(docs).filter(F.col("taken") > 2 * F.col("size")).count() == 0

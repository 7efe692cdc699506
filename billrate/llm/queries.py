"""One query per operator: thin callers that fix parameters and pick the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billrate.llm import (
    chunkdedup, codebooks, decontaminate, gam, language, linedup, mixing, periodic, pseudonyms, quality, revisits, simhash,
    toxicity,
)
from billrate.llm.common import held_out, table

QUERIES = {}
# Stands for a secret that a real run takes from its key store.
PSEUDONYM_KEY = "registered-query"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.train(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return language.classify(rows, model).select(
        "doc_id", "held_out", "lang_id.lang_pred", "lang_id.score", "lang_id.rejected"
    )


@query
def op2_revisits(spark, sf):
    got = revisits.resolve(revisits.captures(table(spark, sf, "pages")))
    header = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return got.select(
        "record_id", "url", "source_id", "verdict", F.array_join(header, "\n").alias("headers"),
        F.md5("payload").alias("payload_md5"), F.length("payload").cast("long").alias("payload_chars"),
    )


@query
def op3_pseudonyms(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pseudonyms.replace(docs, PSEUDONYM_KEY)


@query
def op4_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_simhash(spark, sf):
    return simhash.groups(table(spark, sf, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op6_line_runs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return linedup.cut_runs(docs).select("doc_id", "text", "line_cut.n_lines", "line_cut.n_removed")


@query
def op7_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))


@query
def op8_chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunkdedup.cut_copies(docs).select("doc_id", "text", "chunk_cut.n_runs", "chunk_cut.n_bytes")


@query
def op9_decontaminate(spark, sf):
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    return decontaminate.mark(docs, items).select("doc_id", "leak.*")


@query
def op10_quality(spark, sf):
    return quality.assess(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed"
    )


@query
def op11_codebooks(spark, sf):
    return codebooks.compress(table(spark, sf, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


@query
def op12_periodic_runs(spark, sf):
    return periodic.detect(table(spark, sf, "documents"))


@query
def op13_quality_model(spark, sf):
    docs = table(spark, sf, "documents")
    return gam.score(docs, gam.train(docs, table(spark, sf, "labels")))

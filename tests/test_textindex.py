"""Searches by postings against searches of the whole table."""

import random

from billrate.operators import filters as FL
from billrate.sources import textindex
from billrate.sources.textindex import TextIndex, grams, literal_runs

ROW = "id long, quota_name string, feature_value string, _note string"


def test_runs_and_grams_of_a_pattern():
    assert literal_runs("ab%c_de") == ["ab", "c", "de"]
    assert literal_runs(r"a\%b\\c\d") == [r"a%b\c\d"]
    assert literal_runs("%_") == [] and grams(["a"]) == [] and grams(["Ab"]) == ["ab"]
    assert grams(["Steel"]) == ["eel", "ste", "tee"] and grams(["İst", "ΑΣ"]) == []


def test_every_search_equals_a_full_scan(spark, tmp_path):
    rng = random.Random(3)
    said = ["steel", "Steel", "bar", "混凝土", "浇筑", "C30", "100%", "a_b", "back\\slash", "ΟΔΟΣ", "İzmir", "𠀀土", " "]
    data = [(k % 90, " ".join(rng.choices(said, k=rng.randrange(5))), rng.choice([None, "", *said]), "n") for k in range(150)]
    data += [(None, "steel bar", None, None), (None, None, None, None), (7, "x" * 5000 + "needle", "long", "n")]
    df = spark.createDataFrame(data, ROW)
    index = TextIndex(str(tmp_path / "index"), parts=8)
    index.write(df)
    terms = ["ste%ar", "混凝", "土", "c30", "100\\%", "a\\_b", "back\\slash", "ΟΔΟΣ", "İZMIR", "𠀀土", "", "zzz", "needle"]
    found = 0
    for kw in terms:
        for fold in (False, True):
            want = sorted(map(str, FL.search_quotas(df, kw, ignore_case=fold).collect()))
            assert sorted(map(str, index.like(spark, kw, fold).collect())) == want, (kw, fold)
            found += bool(want)
    assert found > 18


def test_a_search_reads_few_folders(spark, tmp_path):
    df = spark.range(400).selectExpr("id", "concat('item ', hex(id * 7919), ' end') text")
    index = TextIndex(str(tmp_path / "index"), "id", ("text",), parts=32)
    index.write(df)
    word = df.filter("id = 123").first().text
    hits = index.contains(spark, "text", word)
    assert [r.id for r in hits.collect()] == [123]
    plan = hits._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_p" in plan.split("PartitionFilters: [")[1].split("]")[0]
    near = index.candidates(spark, [word])
    assert near.select("_p").distinct().count() < 4
    assert index.candidates(spark, []).count() == 400


def test_empty_table(spark, tmp_path):
    index = TextIndex(str(tmp_path / "index"))
    index.write(spark.createDataFrame([], ROW))
    assert index.like(spark, "steel").count() == 0 == index.like(spark, "%").count()


def test_repeated_keys_in_several_slices_and_tasks_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "SLICE_BYTES", 40)
    monkeypatch.setattr(textindex, "FILE_BYTES", 50)
    rows = [(k % 5 if k % 7 else None, f"word{k % 3} Steel {'😀' if k % 4 else 'É'}ring{k}") for k in range(60)] + [(1, None), (2, "")]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    index = TextIndex(str(tmp_path / "index"), "id", ("text",), parts=2)
    index.write(docs)
    for kw in ("steel", "ÉRING", "😀r", "ring59", "none of them"):
        want = sorted(map(str, FL.contains_filter(docs, "text", kw, True).collect()))
        assert sorted(map(str, index.contains(spark, "text", kw, True).collect())) == want, kw
    # More texts mean more tasks, so that what one task holds does not grow with the table.
    assert max(len(list(d.glob("*.parquet"))) for d in (tmp_path / "index" / "grams").glob("_b=*")) > 2


def test_grams_and_their_rows():
    rng = random.Random(5)
    letters = ["ab混𠀀 \n", "".join(chr(rng.randrange(0x10000, 0x110000)) for _ in range(9000))]
    for some in letters:
        texts = [rng.choice([None, "", "".join(rng.choices(some, k=rng.randrange(12)))]) for _ in range(300)]
        want = {}
        for row, x in enumerate(texts):
            for gram in {x[k : k + size] for size in (2, 3) for k in range(len(x) - size + 1)} if x else ():
                want.setdefault(gram, []).append(row)
        found, ends, rows = textindex.gram_rows(texts)
        assert {g: rows[ends[k] : ends[k + 1]].tolist() for k, g in enumerate(found)} == want
    assert textindex.gram_rows([None, ""])[0] == [] == textindex.gram_rows([])[0]

from billrate.llm import language


def test_bound_of_the_sample_spares_rare_languages(spark):
    sizes, rows = {"a": 3000, "b": 1500, "c": 800, "d": 300, "e": 60, "f": 12}, []
    for lang, n in sizes.items():
        rows += [(len(rows) + k, f"text {lang} {k}", lang) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    all_of_f = docs.filter("lang = 'f'").filter(language.may_learn(docs.doc_id)).count()
    got = {}
    for r in language.training_rows(docs, language.LanguageParams(rows_per_lang=40, max_rows=100)).collect():
        got[r.lang] = got.get(r.lang, 0) + 1
    assert sum(got.values()) == 100 and got["f"] == all_of_f > 0
    assert all(got[lang] >= 16 for lang in "abcde")

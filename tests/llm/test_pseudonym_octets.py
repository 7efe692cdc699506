from billrate.llm import pseudonyms


def test_addresses_of_one_digit_octets(spark):
    rows = [(1, "ask 8.8.8.8 now"), (2, "ask 8.8.8.8 now, in 2024"), (3, "or 1.2.3.4"), (4, "version 1.2 of 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pseudonyms.replace(docs, "key")
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].n_replaced for i in (1, 2, 3, 4)] == [1, 1, 1, 0] and "8.8.8.8" not in got[1].text
    assert got[2].text == f"{got[1].text}, in 2024"
    back = pseudonyms.replace(out.select("doc_id", "text"), "key", back=True).collect()
    assert {(r.doc_id, r.text) for r in back} == set(rows)

"""Ids that removals name in vain."""

from billrate.operators.rejects import undeletable_items, unknown_ids


def test_each_vain_id_comes_once_with_its_reason(spark):
    items = spark.createDataFrame([(1, 7), (2, 8), (3, None), (4, 7)], "id bigint, user_id bigint")
    ids = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "x"), (9, "x"), (9, "x"), (None, "x")], "id bigint, _own string")
    got = sorted((tuple(r) for r in undeletable_items(items, ids, 7).collect()), key=str)
    assert got == [(2, "foreign"), (3, "foreign"), (9, "unknown"), (None, "unknown")]
    assert sorted((tuple(r) for r in unknown_ids(items, ids).collect()), key=str) == [(9, "unknown"), (None, "unknown")]
    assert unknown_ids(items, ids.filter("false")).count() == 0
    assert unknown_ids(items.filter("false"), ids).count() == 5

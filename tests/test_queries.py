"""Registered queries against their SQL, on the smallest data."""

import pytest

from suite.compare import compare
from suite.oracles import ORACLES
from suite.queries import QUERIES

SAMPLE = [
    "match_items_zh", "top_candidates", "extract_keywords", "pair_score", "manual_match",
    "add_item_quotas", "export_items", "discover_synonyms", "upsert_versions", "load_quotas_csv",
    "render_batch",
]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, name) == ""

from pathlib import Path

import pytest

from billrate import session


@pytest.fixture
def own_list(monkeypatch):
    monkeypatch.setattr(session, "_staged", [])


def test_staged_tables_go_on_request(spark, own_list):
    kept = session.stage(spark.range(3), "kept")
    path = Path(session._staged[0])
    assert kept.count() == 3 and path.is_dir()
    session.stage(spark.range(0), "none")
    assert session.drop_staged(spark) == 2 and not path.exists()
    assert session.drop_staged(spark) == 0


def test_spread_keeps_rows_and_gives_each_task_some(spark):
    df = session.spread(spark.range(1000), "id")
    assert df.count() == 1000
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_temporary_tables_go_with_their_block(spark, own_list):
    before = session.stage(spark.range(2), "before")
    with session.temporary(spark) as keep:
        inner = session.stage_together(a=spark.range(3), b=spark.range(4))
        with session.temporary(spark) as hold:
            session.stage(spark.range(1), "inmost")
            held = hold(inner[0].union(inner[1]), "held")
        result = keep(held, "result")
        folders = {Path(f.removeprefix("file:")).parent for t in (*inner, held) for f in t.inputFiles()}
        assert all(f.is_dir() for f in folders)
    assert not any(f.exists() for f in folders)
    assert before.count() == 2 and result.count() == 7
    assert session.drop_staged(spark) == 2

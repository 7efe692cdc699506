"""One bad cell or row never stops a job."""

from decimal import Decimal

from pyspark.sql import functions as F

from billrate.functions import money as M
from billrate.functions import templates as TP
from billrate.operators import filters as FL
from billrate.sources.imports import load_quotas
from suite.queries import QUERIES


def test_numbers_out_of_range(spark):
    row = spark.sql("select 1e20D x, double('NaN') y, 12D z, 99999999999999.99BD q").select(
        M.number_as_text(F.col("x")), M.number_as_text(F.col("y")), M.number_as_text(F.col("z")),
        M.line_total(F.col("q"), F.col("q")), M.line_total(F.lit(Decimal("2.00")), F.lit(Decimal("3.50"))),
    ).first()
    assert tuple(row) == ("1.0E20", "NaN", "12", None, Decimal("7.00"))


def test_templates_with_null_values_and_equal_names(spark):
    row = spark.createDataFrame(
        [('{"a":"1"," a":"2"}', "x ${a} ${b}", {"${a}": "1", "${b}": None})], "j string, t string, m map<string,string>"
    )
    got = row.select(TP.replacements_from_json(F.col("j")), TP.render_template(F.col("t"), F.col("m"))).first()
    assert tuple(got) == ({"${a}": "2"}, "x 1 ${b}")


def test_backslash_in_a_search_word(spark):
    quotas = spark.createDataFrame([(r"pa\b", ""), ("p%b", "")], "quota_name string, feature_value string")
    assert [FL.search_quotas(quotas, k).count() for k in (r"a\b", r"p\%b", "p%b", r"a\\b")] == [1, 1, 2, 1]


def test_validation_query_meets_all_outcomes(spark):
    got = {r.reject_reason for r in QUERIES["validate_items"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {None, "name missing", "quantity not a number", "price not valid"}


def test_large_csv_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "quotas.csv"
    path.write_text("h,n\n" + "Q001,concrete\n" * 200_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        assert load_quotas(spark, str(path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

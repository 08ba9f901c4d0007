"""A third of all rows on one key / one value: results stay whole and the
hot group is collapsed before any shuffle."""

from pyspark.sql import functions as F

from tessera.model import ForeignKey
from tessera.operators import keys as K
from tessera.operators import profile as PR
from tessera.operators import validate as V
from tessera.operators.common import first_n

N = 30000


def _skewed(spark):
    # key 7 holds a third of the rows; the rest are spread
    return spark.range(N).select(
        F.col("id").alias("line_number"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 100).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("v"), (F.col("id") % 50).cast("string")))
        .alias("code"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_duplicates_are_partially_aggregated(spark):
    df = _skewed(spark)
    dup = K.pk_duplicates(df, ["k"])
    rows = dup.collect()
    assert [(r["k"], r["n"]) for r in rows] == [(7, N // 3)]
    assert "HashAggregate" in _plan(dup) and "partial_count" in _plan(dup)


def test_hot_orphan_key_keeps_every_row(spark):
    child = _skewed(spark)
    parent = spark.range(100, 100 + N).select(F.col("id").alias("pk"))     # 7 has no parent
    fk = ForeignKey(("k",), "p", ("pk",))
    orph, valid = K.split_orphans(child, parent, fk)
    assert orph.count() == N // 3 and valid.count() == N - N // 3
    assert "BroadcastHashJoin" in _plan(orph)       # orphan keys proven small: no shuffle of child rows


def test_hot_bad_value_in_large_catalog(spark):
    df = _skewed(spark)
    codes = spark.range(50).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("code"))
    check = V.CatalogCheck("code", "string", codes)          # size unknown: values-first path
    stream = V.violation_stream(df, "line_number", (), [check])
    rep = V.check_report(stream).first()
    assert rep["total_wrong_lines"] == N // 3
    assert rep["wrong_values"] == ["HOT"] and rep["n_wrong_values"] == 1
    assert rep["wrong_lines"][:3] == ["0", "3", "6"] and rep["wrong_lines"][-1] == f"+{N // 3 - 10} lines"


def test_first_n_limits_before_shuffle(spark):
    df = _skewed(spark)
    firsts = first_n(df, ["k"], "line_number", "line_number", 10, "lines")
    hot = firsts.where(F.col("k") == 7).first()["lines"]
    assert hot == list(range(0, 30, 3))
    text = _plan(firsts)
    assert "WindowGroupLimit" in text


def test_value_counts_collapse_hot_value(spark):
    df = _skewed(spark)
    prof = {r["variable"]: r for r in PR.numeric_profile(df, ["k"]).collect()}
    assert prof["k"]["n_distinct"] == 1 + (N - N // 3)
    assert prof["k"]["count"] == N

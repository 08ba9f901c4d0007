"""Property tests (hypothesis) on the invariants of the checks."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.model import ForeignKey
from tessera.operators import audit as AU
from tessera.operators import keys as K
from tessera.operators import publish as P
from tessera.operators import validate as V
from tessera.operators.common import number_rows

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
cells = st.one_of(st.none(), st.sampled_from(["", "NA", "1", "01", "1.0", "2.5", "x", "-3", "1e3", "TRUE"]))


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.integers(-5, 5))),
                min_size=1, max_size=30))
def test_passed_plus_wrong_is_total(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int")
    s = V.rule_summary(df, ["a > b", "a is null or b > 0"]).collect()
    for r in s:
        assert r["passed_rule"] + r["total_wrong_lines"] == r["total_registries"] == len(rows)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(0, 8)), min_size=1, max_size=40),
       st.lists(st.integers(0, 8), max_size=10))
def test_orphans_valid_nulls_partition_rows(spark, child_keys, parent_keys):
    child = spark.createDataFrame([(i, k) for i, k in enumerate(child_keys)], "id int, k int")
    parent = spark.createDataFrame([(k,) for k in parent_keys], "pk int")
    fk = ForeignKey(("k",), "p", ("pk",))
    orph, valid = K.split_orphans(child, parent, fk)
    nulls = child.where(F.col("k").isNull()).count()
    assert orph.count() + valid.count() + nulls == len(child_keys)
    assert orph.count() == K.orphans(child, parent, fk).count()
    assert valid.count() == K.valid_rows(child, parent, fk).count()


@SETTINGS
@given(st.dictionaries(st.integers(0, 20), st.integers(0, 9), max_size=15),
       st.dictionaries(st.integers(0, 20), st.one_of(st.none(), st.integers(0, 9)), max_size=15))
def test_upsert_is_idempotent(spark, target, source):
    t = spark.createDataFrame(list(target.items()) or [(0, 0)], "k int, v int")
    s = spark.createDataFrame(list(source.items()) or [(0, 0)], "k int, v int")
    once = sorted(P.upsert(t, s, ["k"]).collect())
    twice = sorted(P.upsert(P.upsert(t, s, ["k"]), s, ["k"]).collect())
    assert once == twice


@SETTINGS
@given(st.lists(cells, min_size=1, max_size=30), st.sampled_from(["integer", "double", "date", "boolean"]))
def test_strict_audit_within_roundtrip(spark, values, fmt):
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "line_number long, v string")
    strict = {r["line_number"] for r in AU.cast_audit(df, {"v": fmt}, mode="strict").collect()}
    rt = {r["line_number"] for r in AU.cast_audit(df, {"v": fmt}, mode="roundtrip").collect()}
    assert strict <= rt


@SETTINGS
@given(st.integers(1, 300), st.integers(1, 9))
def test_line_numbers_have_no_gaps(spark, n, parts):
    df = spark.range(n).repartition(parts).withColumn("key", (F.col("id") * 7919) % 100003)
    out = number_rows(df, ["key", "id"]).select("line_number", "key", "id").collect()
    assert sorted(r["line_number"] for r in out) == list(range(1, n + 1))
    ordered = [(r["key"], r["id"]) for r in sorted(out, key=lambda r: r["line_number"])]
    assert ordered == sorted(ordered)


@SETTINGS
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60), st.lists(st.integers(0, 5), min_size=1, max_size=30))
def test_weighted_quantiles_match_numpy(spark, xs, ys):
    import numpy as np
    from tessera.operators.profile import numeric_value_counts, weighted_quantiles
    rows = [(float(x), None) for x in xs] + [(None, float(y)) for y in ys]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    probs = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {r["variable"]: r["q"] for r in weighted_quantiles(numeric_value_counts(df, ["a", "b"]), probs).collect()}
    for name, vals in (("a", xs), ("b", ys)):
        want = np.percentile(np.array(vals, dtype=float), [p * 100 for p in probs])
        assert np.allclose(got[name], want)


def test_large_integers_stay_distinct(spark):
    from tessera.operators import profile as PR
    big = 2**53
    df = spark.createDataFrame([(str(big + i),) for i in range(10)], "s string").selectExpr("cast(s as decimal(38,0)) as k")
    row = PR.numeric_profile(df, ["k"]).first()
    assert (row["n_distinct"], row["n_unique"]) == (10, 10)


def test_histogram_leaves_infinities_out(spark):
    from tessera.operators import profile as PR
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(float("inf"),), (float("-inf"),), (float("nan"),)], "x double")
    rows = PR.histogram(df, ["x"]).collect()
    assert sum(r["n"] for r in rows) == 100 and len(rows) == 10 and all(abs(r["upper"]) < 1e3 for r in rows)


def test_missing_file_is_not_a_failing_rule(spark, workdir):
    import os
    import pytest
    from tessera.model import Entity, Rule, Variable
    from tessera.operators.validate import validate_entity
    path = os.path.join(workdir, "t")
    spark.range(10).selectExpr("cast(id as decimal(38,0)) as x", "id + 1 as line_number").repartition(3).write.parquet(path)
    ent = Entity("t", [Variable("x", "integer")], [Rule("x >= 0"), Rule("1 / (x - x) > 0")])
    rec = validate_entity(spark.read.parquet(path), ent).first()
    assert [r["total_wrong_lines"] for r in rec["rules"]] == [0, 10]
    df = spark.read.parquet(path)
    for f in os.listdir(path):
        if f.endswith(".parquet"):
            os.unlink(os.path.join(path, f))
    with pytest.raises(Exception, match="FILE_NOT_EXIST"):
        validate_entity(df, ent).first()

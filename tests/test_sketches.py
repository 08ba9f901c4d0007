"""Profiles merged from segments against the whole."""

import datetime as dt
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import sketches as S


def test_merge_equals_the_whole(spark, workdir):
    rng = random.Random(1)
    rows = [(float(round(rng.gauss(100, 30), 2)) if rng.random() < 0.9 else None, rng.choice([0, -1, 5, None]),
             dt.datetime(2020, 1, 1) + dt.timedelta(minutes=rng.randrange(100_000))) for _ in range(30_000)]
    rows += [(float("inf"), 1, None), (float("nan"), 1, None)]
    df = spark.createDataFrame(rows, "x double, k int, t timestamp_ntz")
    root = os.path.join(workdir, "s")
    cut = [df.limit(0), spark.createDataFrame(rows[:7], df.schema), spark.createDataFrame(rows[7:20_000], df.schema),
           spark.createDataFrame(rows[20_000:], df.schema)]
    for i, part in enumerate(cut):
        S.append_segment(part, root, f"p{i}", ["x", "k"], ["t"])
    S.append_segment(cut[2], root, "p2", ["x", "k"], ["t"])      # again: replaces its own
    assert S.segments(spark, root) == ["p0", "p1", "p2", "p3"]
    got = {r["variable"]: r for r in S.merged_profile(spark, root).collect()}
    xs = sorted(r[0] for r in rows if r[0] is not None and math.isfinite(r[0]))
    g = got["x"]
    assert (g["segments"], g["rows"], g["n"], g["missing"], g["infinite"]) == (4, len(rows), len(xs) + 2, len(rows) - len(xs) - 2, 2)
    assert g["min"] == xs[0] and g["max"] == xs[-1] and g["negatives"] == sum(x < 0 for x in xs)
    assert g["mean"] == pytest.approx(statistics.fmean(xs)) and g["std"] == pytest.approx(statistics.stdev(xs))
    for p, q in zip(S.QUANTILES, g["quantiles"]):
        assert sum(x < q for x in xs) / len(xs) <= p + S.RANK_ERROR and sum(x <= q for x in xs) / len(xs) >= p - S.RANK_ERROR
    exact = len({r[0] for r in rows if r[0] is not None})
    assert abs(g["n_distinct"] - exact) <= S.DISTINCT_ERROR * exact
    assert got["k"]["zeros"] == sum(r[1] == 0 for r in rows) and got["k"]["n_distinct"] == 4
    ts = [r[2] for r in rows if r[2]]
    times = S.merged_profile(spark, root).where("is_time").select(S.as_time(F.col("min"))).first()[0]
    assert times == min(ts) and got["t"]["missing"] == 2


def test_an_empty_entity_and_wrong_names(spark, workdir):
    root = os.path.join(workdir, "s")
    with pytest.raises(FileNotFoundError):
        S.merged_profile(spark, root)
    S.append_segment(spark.createDataFrame([], "x double"), root, "none", ["x"])
    r = S.merged_profile(spark, root).first()
    assert (r["rows"], r["n"], r["min"], r["mean"], r["quantiles"]) == (0, 0, None, None, None) and r["n_distinct"] in (0, None)
    for bad in ("", "a/b", "a=b"):
        with pytest.raises(ValueError):
            S.append_segment(spark.createDataFrame([], "x double"), root, bad, ["x"])


def test_appending_reads_the_new_segment_only(spark, workdir):
    root = os.path.join(workdir, "s")
    S.append_segment(spark.createDataFrame([(1.0,)], "x double"), root, "a", ["x"])
    before = {f: os.path.getmtime(os.path.join(root, "segment=a", f)) for f in os.listdir(os.path.join(root, "segment=a"))}
    S.append_segment(spark.createDataFrame([(3.0,)], "x double"), root, "b", ["x"])
    assert {f: os.path.getmtime(os.path.join(root, "segment=a", f)) for f in os.listdir(os.path.join(root, "segment=a"))} == before
    assert S.merged_profile(spark, root).first()["mean"] == 2.0

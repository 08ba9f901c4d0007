"""Exact quantiles by bins against a sort."""

import math
import random

import pytest

from tessera.operators import profile as PR


def exact(values, p):
    values = sorted(values)
    pos = p * (len(values) - 1)
    lo, hi = values[math.floor(pos)], values[math.ceil(pos)]
    return lo + (pos - math.floor(pos)) * (hi - lo)


@pytest.mark.parametrize("driver_rows", [50_000, 10])
def test_quantiles_of_all_kinds_of_columns(spark, monkeypatch, driver_rows):
    monkeypatch.setattr(PR, "DRIVER_ROWS", driver_rows)     # 10: searched where the rows are
    rng = random.Random(4)
    columns = {"even": [rng.random() for _ in range(4000)], "crowded": [math.exp(rng.gauss(0, 6)) for _ in range(3000)],
               "one": [7.0] * 50, "two": [1.0, 2.0], "single": [3.5], "hot": [5.0] * 2000 + [rng.random() * 10 for _ in range(900)],
               "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0], "ints": [float(rng.randrange(40)) for _ in range(999)], "a\u0001b": [1.0, 5.0, 9.0]}
    rows = [(c, x, 1) for c, xs in columns.items() for x in xs]
    rng.shuffle(rows)
    vc = spark.createDataFrame(rows, "variable string, x double, n long").repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r["variable"]: r["q"] for r in PR.weighted_quantiles(vc, probs).collect()}
    assert set(got) == set(columns)
    for c, xs in columns.items():
        assert got[c] == [exact(xs, p) for p in probs], c
    grouped = vc.groupBy("variable", "x").count().withColumnRenamed("count", "n")
    assert {r["variable"]: r["q"] for r in PR.weighted_quantiles(grouped, probs).collect()} == got
    assert PR.weighted_quantiles(vc.limit(0), probs).collect() == []

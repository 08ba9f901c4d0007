"""Rules that raise at run time are found by halving."""

import math

import pytest

from tessera.model import Rule
from tessera.operators import validate as V


@pytest.mark.parametrize("n, bad", [(64, ()), (64, (63,)), (64, (5, 40)), (9, (3, 4)), (7, tuple(range(7)))])
def test_few_scans_find_the_rules_that_raise(spark, monkeypatch, n, bad):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "a int, z int")
    rules = [Rule(f"a / z > {i}" if i in bad else f"a + z > {i}") for i in range(n)] + [Rule("a / 1 = b")]
    checks = V.analyse_rules(df, rules)
    scans = []
    probe = V._raises
    monkeypatch.setattr(V, "_raises", lambda d, r: scans.append(len(r)) or probe(d, r))
    found = V.runtime_safe_rules(df, checks)
    assert [r.index for r in found if r.column is None] == [*bad, n]
    assert all("DIVIDE_BY_ZERO" in r.error for r in found if r.index in bad)
    if not bad:
        assert not scans
    elif len(bad) <= 2:
        assert len(scans) <= 2 * len(bad) * math.ceil(math.log2(n))
    counts = V.fused_counts(df, [], found).first()
    assert all(counts[f"pass_{i}"] == sum(a + a % 3 > i for a in range(30)) for i in range(n) if i not in bad)


def test_other_errors_are_no_rules_fault(spark, workdir):
    df = spark.read.schema("a int").parquet(_written(spark, workdir))
    checks = V.analyse_rules(df, [Rule("a > 0"), Rule("a < 9")])
    import shutil
    shutil.rmtree(workdir + "/t")
    with pytest.raises(Exception):
        V.runtime_safe_rules(df, checks)


def _written(spark, workdir):
    spark.range(5).selectExpr("cast(id as int) AS a").write.parquet(workdir + "/t")
    return workdir + "/t"

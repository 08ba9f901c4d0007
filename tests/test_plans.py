"""Plan shape: fused scans, broadcast anti joins, bounded first-n."""

from tessera.operators import validate as V
from tessera.plans import driver_model as M


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_rules_and_nulls_share_one_scan(spark):
    df = M.lineitem_view(spark, "/root/testdata/sf0.001")
    checks = V.analyse_rules(df, M.LINEITEM_RULES)
    plan = V.fused_counts(df, M.LINEITEM.labels, checks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_large_catalog_goes_by_stored_wrong_values(spark):
    df = M.orders_lines(spark, "/root/testdata/sf0.001")
    checks = V.catalog_checks_for(M.ORDERS, M.catalogs_for(spark, "/root/testdata/sf0.001", "orders"),
                                  inline=False)
    stream = V.violation_stream(df, "line_number", (), checks)
    stream.collect()
    plan = _plan(stream)
    # the anti join against the codes ran once, while the wrong values were stored
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "LeftAnti" not in plan


def test_small_catalog_is_an_in_set_predicate(spark):
    df = M.orders_lines(spark, "/root/testdata/sf0.001")
    checks = V.catalog_checks_for(M.ORDERS, M.catalogs_for(spark, "/root/testdata/sf0.001", "orders"))
    stream = V.violation_stream(df, "line_number", (), checks)
    plan = stream._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    counts = V.fused_counts(df, M.ORDERS.labels, [], checks)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_first_lines_use_window_group_limit(spark):
    df = M.lineitem_lines(spark, "/root/testdata/sf0.001")
    stream = V.violation_stream(df, "line_number", V.analyse_rules(df, M.LINEITEM_RULES))
    lines = V.check_lines(stream)
    text = lines._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def test_catalog_paths_agree(spark):
    d = "/root/testdata/sf0.001"
    df = M.orders_lines(spark, d)
    small = V.catalog_checks_for(M.ORDERS, M.catalogs_for(spark, d, "orders"))
    large = V.catalog_checks_for(M.ORDERS, M.catalogs_for(spark, d, "orders"), inline=False)
    a = sorted(V.violation_stream(df, "line_number", (), small).collect())
    b = sorted(V.violation_stream(df, "line_number", (), large).collect())
    assert a == b and len(a) > 0

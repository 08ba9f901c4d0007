"""Steps whose cost must not grow faster than their input: what their plans and stored tables show."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import casting as C
from tessera.model import CatalogRef, Entity, ForeignKey, Rule, Variable
from tessera.operators import common as OC
from tessera.operators import keys as K
from tessera.operators import validate as V
from tessera.plans import driver_model as M
from tessera.plans import ingest as IG
from tessera.plans import intake as IN
from tessera.plans import queries as Q
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_load_types_each_cell_once(spark, monkeypatch):
    """The typed value also tells whether the cell is bad; it used to be parsed again for that."""
    seen = []
    keep = IG.store_splits
    monkeypatch.setattr(IG, "store_splits", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    IG.load_entity(spark, Q._intake_headers(spark, SF_SMALL), M.ORDERS)
    groups = len(IN.SEGMENT_ORDERS)
    assert seen[0].count("[0-9]{4}[-/][0-9]{1,2}") == groups      # the one date column of each header order


def test_plain_doubles_are_not_formatted(spark):
    """Short texts come from the engine; they are those of the slow search for the shortest."""
    random.seed(7)
    values = [round(random.uniform(-2e6, 2e6), random.randint(0, 12)) for _ in range(3000)]
    values += [random.uniform(-1e8, 1e8) for _ in range(500)] + [0.0, 1e-3, 2e-3, 9.5e6, 1e7, 0.1 + 0.2, 123456789012345.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(C.canonical_text(F.col("x"), "double")).collect()] == [repr(v) for v in values]


@pytest.mark.parametrize("text,fmt,want", [
    ("12", "integer", "12"), ("007", "integer", "7"), ("1e3", "integer", "1000"), ("99999999999999999999", "integer", "99999999999999999999"),
    ("1.5d", "double", None), ("1.5", "double", "1.5"), ("2020-01-02", "datetime", "2020-01-02 00:00:00"),
    ("2020-02-30", "datetime", None), ("2020/1/2 10:11", "datetime", "2020-01-02 10:11:00")])
def test_quick_and_slow_parses_agree(spark, text, fmt, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.typed_cell(F.col("t"), fmt).cast("string")).first()[0] == want


def test_intake_sorts_only_what_needs_an_order(spark, monkeypatch):
    """Rows without a reported line number are not sorted; cells are rendered after the sort, not shuffled."""
    seen = {}
    monkeypatch.setattr(IN, "_write", lambda df, path, encoding="UTF-8": seen.update({path.rsplit("/", 1)[1]: _plan(df)}))
    monkeypatch.setattr(IN, "_CACHE", {})
    IN.intake(spark, SF_SMALL)
    assert "Sort" not in seen["lineitem_all"] and "Sort" not in seen["orders_partial"]
    for status in IN.SEGMENT_ORDERS:
        above, _, below = seen[f"orders_{status}"].partition("Exchange")
        assert "Sort" in above and "format_string" in above and "format_string" not in below


def test_numbered_tables_are_stored_once(spark, monkeypatch):
    """The sorted rows are the stored table; numbering them writes no second copy."""
    monkeypatch.setattr(M, "_STAGED", {})
    stored = []
    keep = OC.write_read
    monkeypatch.setattr(OC, "write_read", lambda df, name, *more: stored.append(name) or keep(df, name, *more))
    df = M.orders_lines(spark, SF_SMALL)
    assert stored == ["numbered"] and all("/numbered-" in f for f in df.inputFiles())
    rows = df.orderBy("o_orderkey").select("line_number").collect()
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))


def test_numbering_of_no_rows_and_one(spark):
    df = spark.createDataFrame([(5,)], "k int")
    assert OC.number_rows(df.where("k < 0"), ["k"]).collect() == []
    assert [tuple(r) for r in OC.number_rows(df, ["k"]).collect()] == [(5, 1)]


def test_orphans_are_marked_once(spark, monkeypatch):
    """Both halves of a split read one stored table: too many orphan keys for a broadcast shuffle the child once."""
    monkeypatch.setattr(K, "store_side", lambda df: OC.store_side(df, max_rows=0))
    child = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    parent = spark.createDataFrame([(1,)], "p int")
    orphans, valid = K.split_orphans(child, parent, ForeignKey(("k",), "parent", ("p",)))
    assert "Join" not in _plan(orphans) and set(orphans.inputFiles()) == set(valid.inputFiles())
    assert sorted(map(tuple, orphans.collect())) == [(2, "b"), (2, "c")] and valid.collect() == [(1, "a")]


def test_validation_sorts_no_table(spark, monkeypatch):
    """The records number the lines they name; the whole table used to be sorted and stored for that."""
    monkeypatch.setattr(M, "_STAGED", {})
    stored = []
    keep = OC.write_read
    monkeypatch.setattr(OC, "write_read", lambda df, name, *more: stored.append(name) or keep(df, name, *more))
    records = {r["entity"]: r for r in Q.validation_records(spark, SF_SMALL).collect()}
    assert "numbered" not in stored
    numbered = V.validate_entity(M.lineitem_lines(spark, SF_SMALL), M.LINEITEM, M.catalogs_for(spark, SF_SMALL, "lineitem")).first()
    assert "numbered" in stored and records["lineitem"] == numbered


@pytest.mark.parametrize("inline", [True, False])
@pytest.mark.parametrize("leads", [40, 2, 0])
def test_ordered_report_is_that_of_the_numbered_table(spark, inline, leads):
    """With equal rows, tied, NULL and NaN leading fields, and without rows."""
    random.seed(leads)
    rows = [(random.choice([None, float("nan"), *map(float, range(leads))]), random.choice([None, "p", "q"]),
             random.choice([None, *"abcdefghijklmnopqrs"]), random.randint(0, 3)) for _ in range(400 * (leads > 0))]
    rows += rows[:60]
    order = ["k", "s", "v", "n"]
    df = spark.createDataFrame(rows, "k double, s string, v string, n int").repartition(5)
    ent = Entity("t", [Variable("v", "string", "Categorical", True, CatalogRef("c", "code")), Variable("n", "integer")],
                 [Rule("n > 0"), Rule("n < 9"), Rule("no_such > 1")], (), [], 0)
    checks = V.analyse_rules(df, ent.rules)
    cats = V.catalog_checks_for(ent, {"v": spark.createDataFrame([("a",), ("b",)], "code string")}, inline=inline)
    want = V.check_report(V.violation_stream(OC.number_rows(df, order), "line_number", checks, cats))
    got = V.ordered_report(df.withColumn("place", F.struct(*order)), "place", checks, cats)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_numbering_of_reported_lines_shuffles_counts_only(spark):
    """Neither the wrong rows nor the table are sorted or shuffled to number the first of them."""
    df = M.ordered_view(spark, SF_SMALL, "lineitem")
    first = V.first_rows(df, "line_order", V.analyse_rules(df, M.LINEITEM_RULES), [])
    assert first.count() == V.REPORT_LINES * len(M.LINEITEM_RULES)
    plan = V.line_numbers_of(df, "line_order", first)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [id"):]
    assert "Sort" not in below and "Window" not in below and "count(1)" in below

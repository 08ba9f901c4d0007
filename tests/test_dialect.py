"""Dialect search over files on disk."""

import os

import pytest

from tessera.sources import dialect as DI
from tests.test_load_and_publish import write


def sniffed(spark, workdir, files):
    paths = [write(workdir, name, data) for name, data in files.items()]
    return {os.path.basename(r["file"]): r.asDict() for r in DI.sniff_dialect(spark, paths).collect()}


def test_dialects(spark, workdir):
    got = sniffed(spark, workdir, {
        "plain.csv": "a,b,c\n1,2,3\n4,5,6\n",
        "double.csv": 'a;b\n1;"x ""y""; z"\n2;"p;q;r"\n3;plain\n',
        "back.csv": 'a|b\r\n1|"x \\"y\\"| z"\r\n2|"p|q|r"\r\n',
        "single.csv": "a,b\n'x, y',2\n'z',3\n",
        "pre.csv": "Title of the file, with a comma\n\nsecond line\na\tb\tc\n1\t2\t3\n4\t5\t6\n7\t8\t9\n",
        "apostrophe.csv": "a,b\nit's,1\nthat's,2\n",
        "one.csv": "name\nx\ny\n",
        "data.csv": "1,2020-01-02\n3,2021-05-06\n",
        "bom.csv": "﻿a,b\n1,2\n",
        "ragged.csv": "a,b,c\n1,2,3\n1,2\n4,5,6\n7,8,9\n",
        "stamps.csv": "t;u\n2020-01-02T10:11;31/12/2019\n2020-01-03T10:12;30/12/2019\n"})
    keys = ("delimiter", "quote", "escape", "skipped_rows", "n_columns", "has_header")
    assert {n: tuple(r[k] for k in keys) for n, r in got.items()} == {
        "plain.csv": (",", "", "", 0, 3, True), "double.csv": (";", '"', '"', 0, 2, True), "back.csv": ("|", '"', "\\", 0, 2, True),
        "single.csv": (",", "'", "", 0, 2, True), "pre.csv": ("\t", "", "", 3, 3, True), "apostrophe.csv": (",", "", "", 0, 2, True),
        "one.csv": (",", "", "", 0, 1, True), "data.csv": (",", "", "", 0, 2, False), "bom.csv": (",", "", "", 0, 2, True),
        "ragged.csv": (",", "", "", 0, 3, True), "stamps.csv": (";", "", "", 0, 2, True)}
    assert got["back.csv"]["newline"] == "\\r\\n" and got["plain.csv"]["newline"] == "\\n"
    assert got["ragged.csv"]["lines"] == 5 and got["ragged.csv"]["consistent_lines"] == 4
    assert got["stamps.csv"]["timestamp_format"] == "%Y-%m-%dT%H:%M" and got["data.csv"]["date_format"] == "%Y-%m-%d"
    assert got["data.csv"]["header"] is None and got["pre.csv"]["header"] == ["a", "b", "c"] and got["bom.csv"]["header"] == ["a", "b"]


@pytest.mark.parametrize("split", [2_000, 1 << 27])
def test_file_of_many_splits_is_read_whole(spark, workdir, split):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        body = "".join(f'{i};"v {i}; more"\n' for i in range(3000))
        r = sniffed(spark, workdir, {"long.csv": "made by hand\nk;v\n" + body})["long.csv"]
        assert (r["delimiter"], r["quote"], r["skipped_rows"], r["n_columns"]) == (";", '"', 1, 2)
        assert (r["lines"], r["consistent_lines"]) == (3002, 3001)
    finally:
        spark.conf.set(key, before)


def test_load_takes_the_dialect_that_was_found(spark, workdir):
    from tessera.plans.ingest import load_entity
    from tessera.sources import delimited as D
    from tests.test_load_and_publish import MODEL

    paths = [write(workdir, "a.csv", "Made on a day\n\ns;town\n1;plain\n\n2;'x; y'\n"),
             write(workdir, "b.csv", 's,town\n3,"he said \\"hi\\", twice"\n'),
             write(workdir, "c.csv", "town|s\nlast|4\n"), write(workdir, "d.csv", "note\ns\ttown\nfive\tno number\n6\tb\n")]
    heads = D.dialect_headers(DI.sniff_dialect(spark, paths))
    res = load_entity(spark, heads, MODEL.entity("site"))
    files = {os.path.basename(r["file"]): (r["status"], r["rows"]) for r in res.files.collect()}
    assert files == {"a.csv": ("loaded", 2), "b.csv": ("loaded", 1), "c.csv": ("loaded", 1), "d.csv": ("refused", 2)}
    rows = res.table.orderBy("line_number").collect()
    assert [(r["line_number"], r["file_line"], int(r["s"]), r["town"]) for r in rows] == [
        (1, 1, 1, "plain"), (2, 2, 2, "x; y"), (3, 1, 3, 'he said "hi", twice'), (4, 1, 4, "last")]
    assert [(r["line_number"], r["value"]) for r in res.audit.collect()] == [(1, "five")]


def test_files_with_odd_names_load(spark, workdir):
    from tessera.plans.ingest import load_model
    from tests.test_load_and_publish import MODEL

    folder, staging = os.path.join(workdir, "in put"), os.path.join(workdir, "st")
    write(folder, "site one+two 100%.csv", "s|town\n1|x\n")
    write(folder, "é lab.csv", "l\n7\n")
    got = {r["entity"]: r["rows_read"] for r in load_model(spark, folder, MODEL, staging).collect()}
    assert got["site"] == 1 and got["lab"] == 1
    got = {r["entity"]: r["rows_read"] for r in load_model(spark, folder, MODEL, staging, dialects=True).collect()}
    assert got["site"] == 1 and got["lab"] == 1


def test_counts_are_a_hash_aggregate_of_one_row_a_line(spark):
    """Neither a row for each line and candidate nor a text in the aggregate's buffer, which would make it sort."""
    lines = spark.createDataFrame([("f", 0, "a,b"), ("f", 0, '1,"x"'), ("f", 0, "")], "file string, block long, value string")
    counts = DI.line_counts(lines)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Generate" not in plan
    assert sorted(r["lines"] for r in counts.collect()) == [1, 1, 1]


def test_repeated_first_line_and_carriage_returns(spark, workdir):
    got = sniffed(spark, workdir, {"same.csv": "a;b\r\na;b\r\na;b\r\n", "quotes.csv": 'a,b\n"x" y,1\n2,"p" q\n'})
    assert got["same.csv"]["header"] == ["a", "b"] and got["same.csv"]["lines"] == 3 and got["same.csv"]["newline"] == "\\r\\n"
    assert (got["quotes.csv"]["quote"], got["quotes.csv"]["n_columns"]) == ("", 2)

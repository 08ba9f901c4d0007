"""Overlapping publishes and the parts that a publish rewrites."""

import os
import threading

import pytest

from tessera.operators import publish as P
from tessera.session import create_once, file_names, read_small_file
from tests.test_load_and_publish import MODEL, frames


def rows(spark, target, entity):
    return sorted(tuple(int(x) if x is not None and not isinstance(x, str) else x for x in r)
                  for r in P.read_target(spark, target, MODEL.entity(entity)).collect())


def only(f, *names):
    return {n: f[n] for n in names}


def test_a_record_is_created_once(spark, workdir):
    path = os.path.join(workdir, "c", "1.json")
    assert create_once(spark, path, "first é") and not create_once(spark, path, "second")
    assert read_small_file(spark, path) == "first é" and file_names(spark, os.path.dirname(path)) == ["1.json"]
    assert file_names(spark, os.path.join(workdir, "nowhere")) == []


def test_overlapping_publishes_keep_both(spark, workdir):
    target = os.path.join(workdir, "t")
    attempts = []

    def other(attempt):
        attempts.append(attempt)
        if attempt == 0:      # a second run reads, merges and commits while the first is about to
            P.publish(spark, MODEL, only(frames(spark, [], sites=((1, "from two"), (5, "e"))), "site"), target)

    rep = P.publish(spark, MODEL, only(frames(spark, []), "site", "lab"), target, before_commit=other)
    assert attempts == [0, 1] and rep["site"]["rows"] == 3
    assert rows(spark, target, "site") == [(1, "a"), (2, "b"), (5, "e")]     # the later record has the last word
    assert rows(spark, target, "lab") == [(7,)] and P.last_commit(spark, target).version == 2


def test_a_loser_checks_children_of_changed_parents_again(spark, workdir):
    target, q = os.path.join(workdir, "t"), os.path.join(workdir, "q")
    P.publish(spark, MODEL, only(frames(spark, []), "site", "lab"), target)

    def other(attempt):
        if attempt == 0:
            P.publish(spark, MODEL, only(frames(spark, [], sites=((9, "late"),)), "site"), target)

    rep = P.publish(spark, MODEL, only(frames(spark, [(1, 9, 7, 0), (2, 8, 7, 0)]), "visit"), target, q, before_commit=other)
    assert rep["visit"]["orphans"] == 1 and rep["visit"]["rows"] == 1
    assert rows(spark, target, "visit") == [(1, 9, 7, 0)]
    assert [r["v"] for r in spark.read.option("header", True).csv(f"{q}/errors_fk_visit_s").collect()] == ["2"]


def test_many_publishes_at_once_lose_nothing(spark, workdir):
    target, errors = os.path.join(workdir, "t"), []

    def run(k):
        try:
            P.publish(spark, MODEL, only(frames(spark, [], sites=((100 + k, f"s{k}"), (1, f"by {k}"))), "site"), target)
        except Exception as e:  # noqa: BLE001 - shown below
            errors.append(e)
    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    got = rows(spark, target, "site")
    assert [r[0] for r in got] == [1, 100, 101, 102, 103] and P.last_commit(spark, target).version == 4


def test_only_parts_that_the_rows_meet_are_rewritten(spark, workdir):
    target = os.path.join(workdir, "t")
    site = MODEL.entity("site")
    many = tuple((i, f"t{i}") for i in range(400))
    P.publish(spark, MODEL, only(frames(spark, [], sites=many), "site"), target, parts=16)
    before = P.last_commit(spark, target).tables["site"]
    assert before.deal == 16 and len(before.parts) == 16 and before.rows == 400
    rep = P.publish(spark, MODEL, only(frames(spark, [], sites=((3, "new"), (1000, "more"))), "site"), target)
    after = P.last_commit(spark, target).tables["site"]
    changed = {k for k in after.parts if after.parts[k] != before.parts.get(k)}
    numbers = spark.createDataFrame([(3,), (1000,)], "s int").select(P.part_number(["s"], 16).alias("p")).collect()
    assert changed == {str(r["p"]) for r in numbers} and rep["site"]["rewritten"] == len(changed)
    want = {**dict(many), 3: "new", 1000: "more"}
    assert rows(spark, target, "site") == sorted(want.items()) and after.rows == 401
    # another run that meets other parts does not make the first compute again
    free = next(i for i in range(2000, 2100) if spark.createDataFrame([(i,)], "s int").select(
        P.part_number(["s"], 16).alias("p")).first()["p"] not in {r["p"] for r in numbers})
    written = []

    def other(attempt):
        written.append(sorted(os.listdir(target)))
        if attempt == 0:
            P.publish(spark, MODEL, only(frames(spark, [], sites=((free, "free"),)), "site"), target)
    P.publish(spark, MODEL, only(frames(spark, [], sites=((3, "again"),)), "site"), target, before_commit=other)
    assert len(written) == 2 and dict(rows(spark, target, "site"))[free] == "free" and dict(rows(spark, target, "site"))[3] == "again"
    assert P.read_target(spark, target, site).columns == site.labels


def test_a_table_that_outgrows_its_parts_is_dealt_anew(spark, workdir, monkeypatch):
    target = os.path.join(workdir, "t")
    monkeypatch.setattr(P, "PART_ROWS", 10)
    P.publish(spark, MODEL, only(frames(spark, [], sites=tuple((i, "x") for i in range(8))), "site"), target)
    assert P.last_commit(spark, target).tables["site"].deal == 1
    P.publish(spark, MODEL, only(frames(spark, [], sites=tuple((i, "y") for i in range(5, 90))), "site"), target)
    table = P.last_commit(spark, target).tables["site"]
    assert table.deal == 16 and table.rows == 90
    assert rows(spark, target, "site") == [(i, "x" if i < 5 else "y") for i in range(90)]


def test_a_failed_run_removes_what_it_wrote(spark, workdir):
    target = os.path.join(workdir, "t")
    P.publish(spark, MODEL, only(frames(spark, []), "site"), target)
    before = sorted(os.listdir(target))
    with pytest.raises(P.PublishError):
        P.publish(spark, MODEL, frames(spark, [(1, 1, 7, 0)]), target, fail_after="site")
    assert sorted(os.listdir(target)) == before and rows(spark, target, "site") == [(1, "a"), (2, "b")]

"""What a run leaves behind: its result and nothing else."""

import os

import pytest

from tessera.operators import publish as P
from tessera.plans import ingest as IG
from tessera.session import ensure_checkpoint_dir, intermediate_tables, remove_scratch, scratch_path, scratch_root, write_read
from tests.test_load_and_publish import MODEL, frames, write


def tables(spark):
    root = scratch_root(spark).removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_load_and_a_publish_leave_only_their_results(spark, workdir):
    folder, staging, target = (os.path.join(workdir, x) for x in ("in", "st", "t"))
    write(folder, "s.csv", "s|town\n1|x\n2|y\n")
    write(folder, "l.csv", "l\n7\n")
    write(folder, "v.csv", "v;s;l;n\n1;1;7;3\n2;9;7;3\n")
    before = tables(spark)
    IG.load_model(spark, folder, MODEL, staging).collect()
    assert tables(spark) == before and sorted(os.listdir(staging)) == ["lab", "site", "visit"]
    staged = {n: spark.read.parquet(f"{staging}/{n}") for n in ("site", "lab", "visit")}
    P.publish(spark, MODEL, staged, target, os.path.join(workdir, "q"))
    assert tables(spark) == before
    with pytest.raises(P.PublishError):
        P.publish(spark, MODEL, frames(spark, [(1, 1, 7, 0)]), target, fail_after="lab")
    assert tables(spark) == before


def test_a_failed_load_leaves_the_earlier_tables(spark, workdir, monkeypatch):
    folder, staging = os.path.join(workdir, "in"), os.path.join(workdir, "st")
    write(folder, "s.csv", "s|town\n1|x\n")
    IG.load_model(spark, folder, MODEL, staging)
    write(folder, "l.csv", "l\n7\n")
    os.unlink(os.path.join(folder, "s.csv"))
    before = tables(spark)
    whole = IG.load_entity

    def broken(spark, headers, entity, encoding="UTF-8"):
        if entity.name == "visit":
            raise RuntimeError("lost")
        return whole(spark, headers, entity, encoding)
    monkeypatch.setattr(IG, "load_entity", broken)
    with pytest.raises(RuntimeError):
        IG.load_model(spark, folder, MODEL, staging)
    assert os.listdir(staging) == ["site"] and spark.read.parquet(f"{staging}/site").count() == 1
    assert tables(spark) == before
    monkeypatch.setattr(IG, "load_entity", whole)
    IG.load_model(spark, folder, MODEL, staging)
    assert os.listdir(staging) == ["lab"]


def test_a_load_by_the_dialects_found(spark, workdir):
    folder, staging = os.path.join(workdir, "in"), os.path.join(workdir, "st")
    write(folder, "s.csv", "made by hand\n\ns;town\n1;'x; y'\n")
    assert IG.load_model(spark, folder, MODEL, staging).where("status = 'success'").count() == 0
    got = {r["entity"]: r["rows_read"] for r in IG.load_model(spark, folder, MODEL, staging, dialects=True).collect()}
    assert got["site"] == 1 and spark.read.parquet(f"{staging}/site").first()["town"] == "x; y"


def test_inner_runs_end_on_their_own(spark):
    with intermediate_tables(spark):
        outer = scratch_path(spark, "outer")
        spark.range(2).write.parquet(outer)
        with pytest.raises(ValueError), intermediate_tables(spark):
            inner = scratch_path(spark, "inner")
            spark.range(3).write.parquet(inner)
            raise ValueError
        assert os.path.isdir(outer.removeprefix("file:")) and not os.path.isdir(inner.removeprefix("file:"))
    assert not os.path.isdir(outer.removeprefix("file:"))
    kept = write_read(spark.range(4), "kept")      # outside a run nothing is removed
    assert kept.count() == 4 and ensure_checkpoint_dir(spark) in scratch_root(spark)
    assert callable(remove_scratch)

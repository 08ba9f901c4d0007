"""Nothing is lost or let in unseen at the two ends: the load and the publish."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.model import DataModel
from tessera.operators import publish as P
from tessera.plans.ingest import load_entity, load_model
from tessera.plans.validation import validate_staged
from tessera.sources import delimited as D
from tessera.sources import files as FS

MODEL = DataModel.from_dict({"metadata": {"use_case": "t"}, "entities": [
    {"name": "site", "variables": [{"label": "s", "format": "integer"}, {"label": "town", "format": "string"}], "primary_key": ["s"]},
    {"name": "lab", "variables": [{"label": "l", "format": "integer"}], "primary_key": ["l"]},
    {"name": "visit", "variables": [{"label": "v", "format": "integer"}, {"label": "s", "format": "integer"},
                                    {"label": "l", "format": "integer"}, {"label": "n", "format": "integer"}],
     "primary_key": ["v"],
     "foreign_keys": [{"columns": ["s"], "parent": "site"}, {"columns": ["l"], "parent": "lab"}]}]})


def write(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return path


def frames(spark, visits, sites=((1, "a"), (2, "b")), labs=((7,),)):
    typed = lambda rows, ent: spark.createDataFrame(rows, MODEL.entity(ent).schema)
    dec = lambda rows: [tuple(__import__("decimal").Decimal(x) if isinstance(x, int) else x for x in r) for r in rows]
    return {"site": typed(dec(sites), "site"), "lab": typed(dec(labs), "lab"), "visit": typed(dec(visits), "visit")}


def test_publish_accounts_for_every_row(spark, workdir):
    target, q = os.path.join(workdir, "t"), os.path.join(workdir, "q")
    rep = P.publish(spark, MODEL, frames(spark, [(1, 1, 7, 0), (2, 9, 7, 0), (3, 1, 8, 0), (4, None, 7, 0), (5, 2, None, 0),
                                                 (6, 8, 7, 5_000_000_000)]), target, q)
    v = rep["visit"]
    assert v == {"rows": 3, "staged": 6, "published": 3, "orphans": 3, "null_keys": 2, "rewritten": 1}
    read = lambda n: sorted(r["v"] for r in spark.read.option("header", True).csv(f"{q}/errors_fk_visit_{n}").collect())
    assert read("s") == ["2", "6"] and read("l") == ["3"]      # one folder per key; the orphan's bad number refused nothing
    assert sorted(r["v"] for r in P.read_target(spark, target, MODEL.entity("visit")).collect()) == [1, 4, 5]
    # a run without orphans clears what the last one put aside
    P.publish(spark, MODEL, frames(spark, [(1, 1, 7, 0)]), target, q)
    assert not os.path.exists(f"{q}/errors_fk_visit_s")


def test_unreadable_commit_record_is_no_empty_target(spark, workdir):
    target = os.path.join(workdir, "t")
    P.publish(spark, MODEL, frames(spark, [(1, 1, 7, 0), (2, 1, 7, 0)]), target)
    files = [f for f in os.listdir(f"{target}/_commits") if f.endswith(".json")]
    assert len(files) == 1
    good = open(f"{target}/_commits/{files[0]}").read()
    for f in os.listdir(f"{target}/_commits"):
        if f.endswith(".crc"):
            os.unlink(f"{target}/_commits/{f}")
    with open(f"{target}/_commits/{files[0]}", "w") as f:
        f.write(good[:20])
    with pytest.raises(Exception):
        P.publish(spark, MODEL, frames(spark, [(3, 1, 7, 0)]), target)
    with open(f"{target}/_commits/{files[0]}", "w") as f:
        f.write(good)
    assert P.read_target(spark, target, MODEL.entity("visit")).count() == 2


def test_untouched_tables_are_not_copied(spark, workdir):
    target = os.path.join(workdir, "t")
    P.publish(spark, MODEL, frames(spark, [(1, 1, 7, 0)]), target)
    first = P.last_commit(spark, target).tables
    P.publish(spark, MODEL, {"visit": frames(spark, [(2, 2, 7, 0)])["visit"]}, target)
    second = P.last_commit(spark, target).tables
    assert second["site"] == first["site"] and second["visit"] != first["visit"]
    assert P.read_target(spark, target, MODEL.entity("visit")).count() == 2
    assert P.read_target(spark, target, MODEL.entity("site")).count() == 2


def test_entity_without_key_is_refused_or_appended(spark, workdir):
    model = DataModel.from_dict({"metadata": {"use_case": "t"}, "entities": [
        {"name": "note", "variables": [{"label": "x", "format": "string"}]}]})
    df = {"note": spark.createDataFrame([("a",)], "x string")}
    with pytest.raises(P.PublishError):
        P.publish(spark, model, df, os.path.join(workdir, "t"))
    P.publish(spark, model, df, os.path.join(workdir, "t"), append=["note"])
    assert P.publish(spark, model, df, os.path.join(workdir, "t"), append=["note"])["note"]["rows"] == 2


def test_load_refuses_per_file_and_says_why(spark, workdir):
    folder, staging = os.path.join(workdir, "in"), os.path.join(workdir, "st")
    write(folder, "a.csv", "s;town\n1;x\n2;\"two\nlines; and more\"\n")
    write(folder, "b.csv", "town,s\nragged,3,9\n")
    write(folder, "c.csv", "s\ttown\n4\tz\n")
    write(folder, "d.csv", "s|town\n5|café\n".encode("latin-1"))
    write(folder, "e.csv", "s|town\nfive|no\n")
    write(folder, "f.csv", "\n\ns|town\n6|empty lines before\n")
    write(folder, "l1.csv", "l\n7\n7\n")
    ent = MODEL.entity("site")
    res = load_entity(spark, D.file_headers(spark, D.list_files(spark, folder)), ent)
    files = {os.path.basename(r["file"]): (r["status"], r["reason"]) for r in res.files.collect()}
    assert files == {"a.csv": ("loaded", None), "b.csv": ("refused", "ragged row"), "c.csv": ("loaded", None),
                     "d.csv": ("refused", "invalid bytes"), "e.csv": ("refused", "cell not castable"), "f.csv": ("loaded", None)}
    rows = res.table.orderBy("line_number").collect()
    assert [(r["line_number"], int(r["s"]), r["town"]) for r in rows] == [
        (1, 1, "x"), (2, 2, "two\nlines; and more"), (3, 4, "z"), (4, 6, "empty lines before")]
    status = {r["entity"]: (r["status"], r["rows_read"], r["reason"]) for r in load_model(spark, folder, MODEL, staging).collect()}
    assert status["site"][:2] == ("success", 4) and status["visit"][0] == "missing"
    assert status["lab"] == ("fatal", 0, "duplicate key") and not os.path.exists(f"{staging}/lab")
    write(folder, "l1.csv", "l\n7\nNA\n")
    assert {r["entity"]: r["reason"] for r in load_model(spark, folder, MODEL, staging).collect()}["lab"] == "NULL key"


def test_withdrawn_file_leaves_no_table(spark, workdir):
    folder, staging = os.path.join(workdir, "in"), os.path.join(workdir, "st")
    write(folder, "l.csv", "l\n7\n")
    path = write(folder, "s.csv", "s|town\n1|x\n")
    load_model(spark, folder, MODEL, staging)
    assert os.path.exists(f"{staging}/site")
    os.unlink(path)
    load_model(spark, folder, MODEL, staging)
    assert not os.path.exists(f"{staging}/site") and os.path.exists(f"{staging}/lab")


def test_staged_tables_by_uri(spark, workdir):
    folder, staging = os.path.join(workdir, "in"), f"file://{workdir}/st"
    write(folder, "l.csv", "l\n7\n")
    load_model(spark, folder, MODEL, staging)
    rec = validate_staged(spark, MODEL, staging, workdir)
    assert [r["entity"] for r in rec.collect()] == ["lab"]
    with pytest.raises(FileNotFoundError):
        validate_staged(spark, MODEL, f"{workdir}/nowhere", workdir)


def test_header_of_a_file_of_many_splits(spark, workdir):
    path = write(workdir, "big.csv", "s|town\n" + "".join(f"{i}|t{i}\n" for i in range(200_000)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, 20_000)
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 50
        row = D.file_headers(spark, [path]).first()
    finally:
        spark.conf.set(key, before)
    assert (row["header"], row["separator"]) == ("s|town", "|")


def test_line_numbers_skip_refused_files(spark, workdir):
    write(workdir, "1.csv", "s|town\nbad|x\n9|y\n")
    write(workdir, "2.csv", "s|town\n1|x\n2|y\n")
    res = load_entity(spark, D.file_headers(spark, D.list_files(spark, workdir)), MODEL.entity("site"))
    assert sorted((r["line_number"], r["file_line"]) for r in res.table.collect()) == [(1, 1), (2, 2)]
    assert [(r["variable"], r["line_number"], r["value"]) for r in res.audit.collect()] == [("s", 1, "bad")]


@pytest.mark.parametrize("text,day", [("25/12/2020", "2020-12-25"), ("2020-01-02 00:00:00", "2020-01-02"),
                                      ("2020-01-02T10:11:12Z", "2020-01-02"), ("2020/1/2", "2020-01-02")])
def test_date_layouts_of_the_load(spark, workdir, text, day):
    model = DataModel.from_dict({"metadata": {"use_case": "t"}, "entities": [
        {"name": "d", "variables": [{"label": "d", "format": "date"}]}]})
    write(workdir, "d.csv", f"d\n{text}\n")
    load_model(spark, workdir, model, os.path.join(workdir, "st"))
    assert [str(r["d"]) for r in spark.read.parquet(f"{workdir}/st/d").select("d").collect()] == [day]


def test_catalog_rows_need_the_declared_code(spark, workdir):
    path = write(workdir, "cat.csv", "description|code\n|1\nb|\nc|3\n")
    assert sorted(r["code"] for r in D.read_catalog(spark, path, column_name="code").collect()) == ["1", "3"]


def test_manifest_paths_of_odd_roots(spark, workdir):
    root = os.path.join(workdir, "logs", "x", "logs")
    write(os.path.join(root, "logs", "a"), "f.txt", "x")
    write(root, "g.txt", "y")
    assert sorted(r["path"] for r in FS.manifest(spark, root).collect()) == ["g.txt", "logs/a/f.txt"]
    assert sorted(r["rel_path"] for r in FS.listing(spark, root).collect()) == ["g.txt", "logs/a/f.txt"]


def test_modified_after(spark, workdir):
    old = write(workdir, "old.csv", "l\n1\n")
    write(workdir, "new.csv", "l\n2\n")
    os.utime(old, (1_000_000_000, 1_000_000_000))
    assert [os.path.basename(p) for p in D.list_files(spark, workdir, modified_after="2015-01-01T00:00:00")] == ["new.csv"]


def test_cascade_reaches_grandchildren(spark):
    model = DataModel.from_dict({"metadata": {"use_case": "t"}, "entities": [
        {"name": "p", "variables": [{"label": "p"}], "primary_key": ["p"]},
        {"name": "c", "variables": [{"label": "c"}, {"label": "p"}], "primary_key": ["c"],
         "foreign_keys": [{"columns": ["p"], "parent": "p"}]},
        {"name": "g", "variables": [{"label": "g"}, {"label": "c"}], "primary_key": ["g"],
         "foreign_keys": [{"columns": ["c"], "parent": "c"}]}]})
    tables = {"c": spark.createDataFrame([("c1", "p1"), ("c2", "p2"), ("c3", None)], "c string, p string"),
              "g": spark.createDataFrame([("g1", "c1"), ("g2", "c2"), ("g3", None)], "g string, c string")}
    out = P.cascade_all(model, tables, "p", spark.createDataFrame([("p1",)], "p string"))
    assert sorted(r["c"] for r in out["c"].collect()) == ["c2", "c3"]
    assert sorted(r["g"] for r in out["g"].collect()) == ["g2", "g3"]


def test_model_file_needs_use_case_and_formats(workdir):
    import json
    path = os.path.join(workdir, "m.json")
    for cfg in ({"entities": []}, {"metadata": {"use_case": "u"}, "entities": [{"name": "e", "variables": [{"label": "x"}]}]}):
        with open(path, "w") as f:
            json.dump(cfg, f)
        with pytest.raises(ValueError):
            DataModel.from_json(path)

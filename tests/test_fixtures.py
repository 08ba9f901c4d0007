"""Defect cases on the six-entity model (FIXTURES.md section 4)."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit as AU
from tessera.operators import keys as K
from tessera.operators import publish as P
from tessera.operators import status as ST
from tessera.operators.validate import validate_entity
from tessera.plans.ingest import load_entity, load_model
from tessera.plans.validation import catalog_frames
from tessera.sources import delimited as D
from tests.cdm_data import rows_for, write_catalogs, write_csv


def _load(spark, cdm, folder, entity_name):
    ent = cdm.entity(entity_name)
    headers = D.file_headers(spark, D.list_files(spark, folder))
    return load_entity(spark, headers, ent)


def test_clean_mixed_order_segments(spark, cdm, workdir):
    ent = cdm.entity("surgical_treatment_ent")
    cols = ent.labels
    write_csv(workdir, "a.csv", cols, rows_for(ent, 5))
    write_csv(workdir, "b.csv", list(reversed(cols)), rows_for(ent, 7, start=6))
    res = _load(spark, cdm, workdir, ent.name)
    t = res.table
    assert t.count() == 12
    assert t.columns[3:] == cols                      # declared order
    row = t.where(F.col("woman_id") == "W9").first()  # from the reversed file
    assert row["initial_treatment_code_st"] == "initia9"
    lines = sorted(r["line_number"] for r in t.select("line_number").collect())
    assert lines == list(range(1, 13))


def test_null_tokens(spark, cdm, workdir):
    ent = cdm.entity("surgical_treatment_ent")
    cols = ent.labels
    path = os.path.join(workdir, "n.csv")
    with open(path, "w") as f:
        f.write("|".join(cols) + "\n")
        for i, tok in enumerate(["NA", "", '"NA"', '""']):
            vals = [f"W{i}", tok, "c", "2020-01-01", "1", "1", "true", "1", "1"]
            f.write("|".join(vals) + "\n")
    res = _load(spark, cdm, workdir, ent.name)
    vals = [r["initial_treatment_cd"] for r in res.table.collect()]
    assert vals == [None, None, None, None]


def test_header_mismatch_is_missing(spark, cdm, workdir):
    ent = cdm.entity("followup_ent")
    write_csv(workdir, "f.csv", ent.labels[:-1], rows_for(ent, 3))
    res = _load(spark, cdm, workdir, ent.name)
    assert res.table is None
    status = load_model(spark, workdir, cdm, os.path.join(workdir, "stage"))
    row = status.where(F.col("entity") == "followup_ent").first()
    assert row["status"] == "missing"


def test_bad_integer_refuses_file_and_audits(spark, cdm, workdir):
    ent = cdm.entity("surgical_treatment_ent")
    write_csv(workdir, "good.csv", ent.labels, rows_for(ent, 4))
    write_csv(workdir, "bad.csv", ent.labels, rows_for(ent, 4, start=10,
                                                       initial_treatment_cd=lambda i: "x" if i == 12 else "1"))
    res = _load(spark, cdm, workdir, ent.name)
    files = {os.path.basename(r["file"]): r["status"] for r in res.files.collect()}
    assert files == {"good.csv": "loaded", "bad.csv": "refused"}
    assert res.table.count() == 4
    found = res.audit.collect()
    assert [(r["variable"], r["line_number"], r["value"]) for r in found] == [("initial_treatment_cd", 3, "x")]


def test_non_canonical_strict_vs_roundtrip(spark):
    df = spark.createDataFrame([(1, "01"), (2, "1.0"), (3, "7"), (4, "TRUE"), (5, "x"), (6, None)],
                               "line_number long, v string")
    strict = {r["line_number"] for r in AU.cast_audit(df, {"v": "integer"}, mode="strict").collect()}
    rt = {r["line_number"] for r in AU.cast_audit(df, {"v": "integer"}, mode="roundtrip").collect()}
    assert strict == {4, 5}
    assert rt == {1, 2, 4, 5, 6}
    b = spark.createDataFrame([(1, "TRUE"), (2, "true")], "line_number long, v string")
    assert [r["line_number"] for r in AU.cast_audit(b, {"v": "boolean"}, mode="roundtrip").collect()] == [1]
    assert AU.cast_audit(b, {"v": "boolean"}, mode="strict").count() == 0


def test_sixteen_bad_cells_summary(spark):
    df = spark.createDataFrame([(i, f"bad{i}") for i in range(1, 17)], "line_number long, v string")
    s = AU.audit_summary(AU.cast_audit(df, {"v": "integer"})).first()
    assert s["n_lines"] == 16 and s["n_values"] == 16
    assert s["line_list"] == ", ".join(f"'{i}'" for i in range(1, 16)) + ", ..."
    assert s["value_list"].endswith("'bad15', ...")


def test_duplicate_and_null_keys(spark, cdm):
    ent = cdm.entity("followup_ent")
    df = spark.createDataFrame([(1, "W1", "2020-01-01"), (2, "W1", "2020-01-01"), (3, None, "2020-01-02"),
                                (4, "W2", None)], "line_number long, woman_id string, last_followup_contact_dt string")
    assert K.pk_duplicates(df, list(ent.primary_key)).count() == 1
    assert sorted(r["line_number"] for r in K.pk_nulls(df, list(ent.primary_key)).collect()) == [3, 4]


def _women_df(spark, cdm, rows):
    ent = cdm.entity("women_ent")
    data = [tuple([i + 1] + [r[c] for c in ent.labels]) for i, r in enumerate(rows)]
    raw = spark.createDataFrame(data, "line_number long, " + ", ".join(f"{c} string" for c in ent.labels))
    return D.typed(raw, ent)


def _record(spark, cdm, rows, catalog_dir):
    ent = cdm.entity("women_ent")
    df = _women_df(spark, cdm, rows)
    return validate_entity(df, ent, catalog_frames(spark, ent, catalog_dir)).first()


def test_catalog_ten_and_twelve(spark, cdm, workdir):
    cats = write_catalogs(os.path.join(workdir, "cat"))
    ent = cdm.entity("women_ent")
    rows = rows_for(ent, 20, menopause_cd=lambda i: "9" if i <= 10 else "1")
    rec = _record(spark, cdm, rows, cats)
    c = [x for x in rec["catalog_checking"] if x["variable"] == "menopause_cd"][0]
    assert c["total_wrong_lines"] == 10 and c["wrong_lines"] == [str(i) for i in range(1, 11)]
    assert c["wrong_values"] == ["9"]
    rows = rows_for(ent, 20, menopause_cd=lambda i: str(100 + min(i, 11)) if i <= 12 else "2")
    rec = _record(spark, cdm, rows, cats)
    c = [x for x in rec["catalog_checking"] if x["variable"] == "menopause_cd"][0]
    assert c["total_wrong_lines"] == 12
    assert c["wrong_lines"] == [str(i) for i in range(1, 11)] + ["+2 lines"]
    assert c["wrong_values"] == [str(100 + i) for i in range(1, 11)] + ["+1 values"]


def test_catalog_null_and_rules(spark, cdm, workdir):
    cats = write_catalogs(os.path.join(workdir, "cat"))
    ent = cdm.entity("women_ent")
    rows = rows_for(ent, 10, menopause_cd=lambda i: "NA" if i <= 3 else "1",
                    menopause_age_nm=lambda i: "10" if i == 4 else "50",
                    menarque_age_nm=lambda i: "NA" if i == 5 else "12")
    rec = _record(spark, cdm, rows, cats)
    c = [x for x in rec["catalog_checking"] if x["variable"] == "menopause_cd"][0]
    assert c["total_wrong_lines"] == 0
    na = {x["label"]: x["na_count"] for x in rec["na_count_list"]}
    assert na["menopause_cd"] == 3
    r0, r1, r2 = rec["rules"]
    assert r0["total_wrong_lines"] == 2 and r0["wrong_lines"] == ["4", "5"]   # NULL result counts as wrong
    assert r0["passed_rule"] + r0["total_wrong_lines"] == 10
    for bad in (r1, r2):   # division by zero at run time; unknown column
        assert bad["passed_rule"] == 0 and bad["total_wrong_lines"] == 10 and bad["wrong_lines"] == ["10 lines"]


def test_blank_catalog_row_matches_nothing(spark, cdm, workdir):
    cats = write_catalogs(os.path.join(workdir, "cat"))
    ent = cdm.entity("dicom_series_ent")
    codes = catalog_frames(spark, ent, cats)["lesion_mass_shape_cd"]
    assert sorted(r["code"] for r in codes.collect()) == ["0", "1", "2", "3", "4"]


def test_threshold_flags(spark):
    checks = spark.createDataFrame([("e", 10, "rule", "r1", 2), ("e", 10, "rule", "r2", 3),
                                    ("e", 10, "null", "c", 1)],
                                   "entity string, total_registries long, kind string, check string, "
                                   "total_wrong_lines long")
    flags = {r["check"]: r["flagged"] for r in ST.threshold_flags(checks).collect()}
    assert flags == {"r1": False, "r2": True, "c": True}


def test_upsert_semantics(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, s string, x double")
    source = spark.createDataFrame([(1, None, 5.0), (3, "c", 3.0)], "k long, s string, x double")
    out = {r["k"]: (r["s"], r["x"]) for r in P.upsert(target, source, ["k"]).collect()}
    assert out == {1: (None, 5.0), 2: ("b", 2.0), 3: ("c", 3.0)}
    twice = P.upsert(P.upsert(target, source, ["k"]), source, ["k"])
    assert sorted(twice.collect()) == sorted(P.upsert(target, source, ["k"]).collect())


def _stage(spark, cdm, folder, women_rows, child_rows=None):
    ents = {"women_ent": cdm.entity("women_ent"), "followup_ent": cdm.entity("followup_ent")}
    out = {"women_ent": D.typed(spark.createDataFrame(
        [tuple(r[c] for c in ents["women_ent"].labels) for r in women_rows],
        ", ".join(f"{c} string" for c in ents["women_ent"].labels)), ents["women_ent"], keep=())}
    if child_rows is not None:
        out["followup_ent"] = D.typed(spark.createDataFrame(
            [tuple(r[c] for c in ents["followup_ent"].labels) for r in child_rows],
            ", ".join(f"{c} string" for c in ents["followup_ent"].labels)), ents["followup_ent"], keep=())
    return out


def test_publish_orphans_range_and_atomicity(spark, cdm, workdir):
    target = os.path.join(workdir, "target")
    women = rows_for(cdm.entity("women_ent"), 3)
    follow = rows_for(cdm.entity("followup_ent"), 4, woman_id=lambda i: f"W{i}")   # W4 has no parent
    rep = P.publish(spark, cdm, _stage(spark, cdm, workdir, women, follow), target,
                    quarantine_dir=os.path.join(workdir, "q"))
    assert rep["women_ent"]["rows"] == 3 and rep["followup_ent"] == {
        "rows": 3, "staged": 4, "published": 3, "orphans": 1, "null_keys": 0, "rewritten": 1}
    q = spark.read.option("header", True).csv(os.path.join(workdir, "q", "errors_fk_followup_ent"))
    assert [r["woman_id"] for r in q.collect()] == ["W4"]
    v1 = P.current_version(spark, target)
    # out of range integer: refused, target unchanged
    big = rows_for(cdm.entity("women_ent"), 1, start=7, height_nm=lambda i: "2147483648")
    with pytest.raises(P.PublishError):
        P.publish(spark, cdm, _stage(spark, cdm, workdir, big), target)
    assert P.current_version(spark, target) == v1
    # failure after the first table: nothing of the run becomes visible
    more = rows_for(cdm.entity("women_ent"), 2, start=20)
    with pytest.raises(P.PublishError):
        P.publish(spark, cdm, _stage(spark, cdm, workdir, more, follow), target, fail_after="women_ent")
    assert P.current_version(spark, target) == v1
    assert P.read_target(spark, target, cdm.entity("women_ent")).count() == 3


def test_empty_entity_is_fatal(spark, cdm, workdir):
    ent = cdm.entity("neoadjuvant_treatment_ent")
    write_csv(workdir, "empty.csv", ent.labels, [])
    status = load_model(spark, workdir, cdm, os.path.join(workdir, "stage"))
    row = status.where(F.col("entity") == ent.name).first()
    assert row["status"] == "fatal" and row["rows_read"] == 0

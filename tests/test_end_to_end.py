"""End to end on the six-entity model: load -> validate -> profile -> publish."""

import json
import os

from pyspark.sql import functions as F

from tessera.operators import publish as P
from tessera.plans.ingest import load_model
from tessera.plans.report import artifact_catalog, write_profiles, write_validation
from tessera.plans.validation import validate_staged
from tests.cdm_data import rows_for, write_catalogs, write_csv


def test_run_end_to_end(spark, cdm, workdir):
    intake = os.path.join(workdir, "inputs")
    women = cdm.entity("women_ent")
    follow = cdm.entity("followup_ent")
    surg = cdm.entity("surgical_treatment_ent")
    write_csv(intake, "women_a.csv", women.labels, rows_for(women, 6, menopause_cd=lambda i: "7" if i == 2 else "1"))
    write_csv(intake, "women_b.csv", list(reversed(women.labels)), rows_for(women, 4, start=7))
    write_csv(intake, "follow.csv", follow.labels, rows_for(follow, 5, woman_id=lambda i: f"W{i * 3}"))
    write_csv(intake, "surgical_bad.csv", surg.labels, rows_for(surg, 3, initial_treatment_cd=lambda i: "x"))
    staging = os.path.join(workdir, "staging")
    res = {r["entity"]: r.asDict() for r in load_model(spark, intake, cdm, staging).collect()}
    assert res["women_ent"]["rows_read"] == 10 and res["women_ent"]["status"] == "success"
    assert res["followup_ent"]["rows_read"] == 5
    assert res["surgical_treatment_ent"]["status"] == "fatal" and res["surgical_treatment_ent"]["refused_files"] == 1
    assert res["dicom_series_ent"]["status"] == "missing"

    cats = write_catalogs(os.path.join(workdir, "catalogs"))
    rec = validate_staged(spark, cdm, staging, cats)
    out = os.path.join(workdir, "outputs")
    path = write_validation(rec, os.path.join(out, "dqa"))
    doc = json.loads(open([os.path.join(path, f) for f in os.listdir(path) if f.endswith(".json")][0]).read())
    women_rec = [e for e in doc["info"] if e["entity"] == "women_ent"][0]
    assert women_rec["total_registries"] == 10
    meno = [c for c in women_rec["catalog_checking"] if c["variable"] == "menopause_cd"][0]
    assert meno["wrong_values"] == ["7"] and meno["wrong_lines"] == ["2"]

    frames = {n: spark.read.parquet(os.path.join(staging, n)) for n in ("women_ent", "followup_ent")}
    names = write_profiles(spark, cdm, frames, os.path.join(out, "dqa"))
    assert names == ["dqa_demo_case_women_ent", "dqa_demo_case_followup_ent"]

    target = os.path.join(workdir, "target")
    rep = P.publish(spark, cdm, frames, target, quarantine_dir=out)
    assert rep["women_ent"]["rows"] == 10
    assert (rep["followup_ent"]["rows"], rep["followup_ent"]["orphans"]) == (3, 2)      # W12 and W15 have no parent
    cat = artifact_catalog(spark, out).collect()
    kinds = {r["category"] for r in cat}
    assert kinds == {"dqa", "analysis"}
    assert P.read_target(spark, target, follow).where(F.col("woman_id") == "W9").count() == 1


def test_cli_steps(spark, cdm, workdir, capsys):
    from tessera.cli import main
    intake = os.path.join(workdir, "in")
    women = cdm.entity("women_ent")
    write_csv(intake, "w.csv", women.labels, rows_for(women, 3))
    cfg = os.path.join(os.path.dirname(__file__), "fixtures", "cdm_model.json")
    staging = os.path.join(workdir, "st")
    assert main(["load", "--config", cfg, "--intake", intake, "--staging", staging]) == 0
    loaded = {r["entity"]: r["rows_read"] for r in json.loads(capsys.readouterr().out.strip().splitlines()[-1])}
    assert loaded["women_ent"] == 3
    cats = write_catalogs(os.path.join(workdir, "cat"))
    assert main(["validate", "--config", cfg, "--staging", staging, "--catalogs", cats,
                 "--out", os.path.join(workdir, "out")]) == 0
    assert main(["publish", "--config", cfg, "--staging", staging, "--target", os.path.join(workdir, "tgt"),
                 "--out", os.path.join(workdir, "out")]) == 0

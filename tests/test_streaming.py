"""Segments arriving over time go through the same load checks."""

import os

from pyspark.sql import functions as F

from tessera.streaming.intake import start_intake
from tests.cdm_data import rows_for, write_csv


def test_stream_loads_and_refuses_per_file(spark, cdm, workdir):
    ent = cdm.entity("surgical_treatment_ent")
    inbox = os.path.join(workdir, "inbox")
    write_csv(inbox, "a.csv", ent.labels, rows_for(ent, 5))
    write_csv(inbox, "b.csv", ent.labels, rows_for(ent, 3, start=10, adyuvant_treatment_cd=lambda i: "zz"))
    staging, results = os.path.join(workdir, "staged"), os.path.join(workdir, "results")
    q = start_intake(spark, inbox, ent.labels, ent, staging, results, os.path.join(workdir, "ckpt"),
                     available_now=True)
    q.awaitTermination(120)
    files = {os.path.basename(r["file"]): r["status"] for r in spark.read.parquet(results).collect()}
    assert files == {"a.csv": "loaded", "b.csv": "refused"}
    staged = spark.read.parquet(staging)
    assert staged.count() == 5
    assert sorted(r["file_line"] for r in staged.collect()) == [1, 2, 3, 4, 5]
    assert staged.where(F.col("initial_treatment_cd").isNull()).count() == 0

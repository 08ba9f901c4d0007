"""Scalar helpers, status logic, log parsing and file helpers."""

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.functions.casting import canonical_text, try_parse, typed_cell
from tessera.model import DataModel
from tessera.operators import logs as LG
from tessera.operators import status as ST
from tessera.operators.common import file_line_numbers
from tessera.plans import report as RP
from tessera.sources import delimited as D
from tessera.sources import files as FS


def _one(spark, col, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(col.alias("r")).first()["r"]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=40))
def test_double_text_matches_shortest_repr(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = [r["t"] for r in df.select(canonical_text(F.col("v"), "double").alias("t")).collect()]
    assert got == [repr(x) for x in xs]


def test_double_text_specials(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1e16,), (1e-5,), (0.0001,),
                                (10000000.0,), (-0.0,), (123.456,)], "v double")
    got = [r["t"] for r in df.select(canonical_text(F.col("v"), "double").alias("t")).collect()]
    assert got == ["nan", "inf", "-inf", "1e+16", "1e-05", "0.0001", "10000000.0", "-0.0", "123.456"]


def test_type_dialect(spark):
    assert str(_one(spark, try_parse(F.col("v"), "date"), "2020/01/02")) == "2020-01-02"
    assert _one(spark, try_parse(F.col("v"), "date"), "2020-01") is None
    assert _one(spark, try_parse(F.col("v"), "double"), "5d") is None
    assert int(_one(spark, try_parse(F.col("v"), "integer"), "1e3")) == 1000
    assert int(_one(spark, try_parse(F.col("v"), "integer"), "2.5")) == 3
    assert _one(spark, typed_cell(F.col("v"), "integer"), "NA") is None
    assert _one(spark, typed_cell(F.col("v"), "boolean"), "yes") is True


def test_text_helpers(spark):
    assert _one(spark, TX.strip_ansi(F.col("v")), "\x1b[1;31mERROR\x1b[0m x\x1b[K") == "ERROR x"
    assert _one(spark, TX.infer_separator(F.col("v")), '"a";"b";"c"') == ";"
    assert _one(spark, TX.infer_separator(F.col("v")), "only_one_name") == "|"
    assert _one(spark, TX.infer_separator(F.col("v")), "añño,ÿes") == ","
    assert _one(spark, TX.sha256_hex(F.col("v")), "abc") == \
        "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    cat = spark.createDataFrame([("logs/a.html", "a.html"), ("dqa/x.json", "x.json"), ("r/validator.html", "validator.html"),
                                 ("run.txt", "run.txt"), ("plot.png", "plot.png")], "p string, n string")
    assert [r["c"] for r in cat.select(TX.artifact_category(F.col("p"), F.col("n")).alias("c")).collect()] == \
        ["logs", "dqa", "dqa", "logs", "analysis"]
    ext = spark.createDataFrame([("a.py",), ("b.R",), ("c.tar.py",), ("d.qmd",), ("e.sh",)], "n string")
    assert [r["s"] for r in ext.select(TX.is_script(F.col("n")).alias("s")).collect()] == [True, True, False, True, False]


def test_status_rules(spark):
    load = spark.createDataFrame([("a", 0, None), ("b", 1, 0), ("c", 2, 10), ("d", 1, None)],
                                 "entity string, matched_files long, rows_read long")
    st_ = {r["entity"]: (r["status"], r["total_records"]) for r in ST.entity_status(load).collect()}
    assert st_ == {"a": ("missing", 0), "b": ("fatal", 0), "c": ("success", 10), "d": ("success", 0)}
    counts = spark.createDataFrame([("b", 5), ("d", 0)], "entity string, n long")
    fixed = {r["entity"]: (r["status"], r["total_records"])
             for r in ST.correct_status(ST.entity_status(load), counts).collect()}
    assert fixed["b"] == ("success", 5) and fixed["d"] == ("fatal", 0) and fixed["a"] == ("missing", 0)
    none = spark.createDataFrame([("a", "missing", 0)], "entity string, status string, total_records long")
    assert ST.load_summary(none).first()["message"].startswith("None of the uploaded files")
    badge = spark.createDataFrame([("fatal", 1), ("missing", 0), ("success", 2), ("success", 0)], "s string, f long")
    got = [r["b"] for r in badge.select(ST.quality_badge(F.col("s"), F.col("f"), F.lit(0), F.lit(0)).alias("b")).collect()]
    assert got == ["fatal", "missing", "warning", "ok"]


def test_log_parsers(spark, workdir):
    text = "\n".join([
        'INFO:: Trying to load records in the table "women_ent"', "INFO:: 12 records read.",
        'WARNING:: No file of the uploaded files has been found that matches the header with the configuration '
        'of the "followup_ent" entity.!',
        'INFO:: Trying to load records in the table "dicom_series_ent"', "ERROR:: 0 records read",
        "ERROR:: ---------", "ERROR:: Checking variable: birads_cd", "ERROR:: Filename: dicom.csv",
        "ERROR:: Found casting errors in 3 line(s)", "ERROR:: Example of erroneous values found: 'x', 'y'",
        "ERROR:: ---------"])
    path = os.path.join(workdir, "run.log")
    with open(path, "w") as f:
        f.write(text + "\n")
    raw = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file"),
                                       F.col("_metadata.file_block_start").alias("_block"))
    lines = file_line_numbers(raw).select(F.col("_file").alias("file"), F.col("file_line").alias("line"), "text")
    res = {r["entity"]: (r["status"], r["total_records"]) for r in LG.load_results(lines).collect()}
    assert res == {"women_ent": ("success", 12), "followup_ent": ("missing", 0), "dicom_series_ent": ("fatal", 0)}
    errs = LG.cast_errors(lines).collect()
    assert [(r["variable"], r["filename"], r["affected_rows"], r["examples"]) for r in errs] == \
        [("birads_cd", "dicom.csv", 3, "'x', 'y'")]


def test_header_match_and_sniff(spark, workdir):
    model = DataModel.from_dict({"entities": [
        {"name": "a", "variables": [{"label": "x", "format": "integer"}, {"label": "y", "format": "string"}]},
        {"name": "b", "variables": [{"label": "y", "format": "string"}, {"label": "x", "format": "double"}]},
        {"name": "c", "variables": [{"label": "x", "format": "integer"}]}]})
    p1 = os.path.join(workdir, "f1.csv")
    with open(p1, "w") as f:
        f.write('"y";"x"\nabc;1\nNA;2\n')
    p2 = os.path.join(workdir, "f2.csv")
    with open(p2, "w", encoding="utf-8-sig") as f:
        f.write("x|y|z\n1|2|3\n")
    h = D.file_headers(spark, [p1, p2])
    m = sorted((os.path.basename(r["file"]), r["entity"]) for r in D.header_matches(h, model).collect())
    assert m == [("f1.csv", "a"), ("f1.csv", "b"), ("f2.csv", None)]
    groups = D.header_groups(h, model.entity("a"))
    raw = D.csv_rows(spark, groups, ["y", "x"])
    kinds = {r["name"]: r["type"] for r in D.sniff(raw, ["y", "x"]).collect()}
    assert kinds == {"y": "string", "x": "integer"}
    enc = {os.path.basename(r["file"]): r["encoding"] for r in FS.encoding_check(spark, [p1, p2]).collect()}
    assert enc == {"f1.csv": "UTF-8", "f2.csv": "UTF-8"}   # the BOM is skipped by the reader
    p3 = os.path.join(workdir, "f3.csv")
    with open(p3, "wb") as f:
        f.write("x|y\n1|café\n".encode("latin-1"))
    assert FS.encoding_check(spark, [p3]).first()["encoding"] == "ISO-8859-1"


def test_purge_and_stamp(spark):
    spark.range(3).createOrReplaceTempView("women_ent")
    spark.range(3).write.mode("overwrite").saveAsTable("followup_ent")
    spark.sql("CREATE OR REPLACE VIEW surgical_ent AS SELECT 1 AS x")
    RP.purge(spark, ["women_ent", "followup_ent", "surgical_ent", "never_made"])
    assert not [t.name for t in spark.catalog.listTables() if t.name.endswith("_ent")]
    model = DataModel.from_dict({"cdmb_version": "7", "entities": []})
    row = RP.version_stamp(spark.range(1), model, "p1").first()
    assert (row["model_version"], row["pipeline_version"]) == ("7", "p1")


def test_create_table_and_scripts(spark, cdm, workdir):
    from tessera.operators.publish import create_entity_table
    ent = cdm.entity("followup_ent")
    path = os.path.join(workdir, "t")
    create_entity_table(spark, ent, path)
    create_entity_table(spark, ent, path)        # already there: kept
    df = spark.read.parquet(path)
    assert df.count() == 0 and df.columns == ent.labels
    assert dict(df.dtypes)["ypt_cd"] == "decimal(38,0)"
    for name in ("b.py", "a.qmd", "c.txt", "x.tar.py"):
        with open(os.path.join(workdir, name), "w") as f:
            f.write("x")
    names = [r["name"] for r in RP.script_catalog(spark, workdir).collect()]
    assert names == ["a.qmd", "b.py"]


def test_type_map_falls_back_to_text():
    from pyspark.sql import types as T
    m = DataModel.from_dict({"entities": [{"name": "e", "variables": [
        {"label": "a", "format": "Integer"}, {"label": "b", "format": "weird"}, {"label": "c", "format": "datetime"}],
        "rules": []}]})
    sch = m.entity("e").schema
    assert sch["a"].dataType == T.DecimalType(38, 0)
    assert sch["b"].dataType == T.StringType()
    assert sch["c"].dataType == T.TimestampNTZType()
    assert m.entity("e").publish_schema["a"].dataType == T.IntegerType()


def test_sniff_files_properties(spark, workdir):
    a = os.path.join(workdir, "crlf.csv")
    with open(a, "wb") as f:
        f.write(b'id;day;name\r\n1;2020/01/02;"x"\r\n2;2020/01/03;y\r\n')
    b = os.path.join(workdir, "nohead.csv")
    with open(b, "w") as f:
        f.write("1|2020-01-02|x\n2|2020-01-03|y\n")
    got = {os.path.basename(r["file"]): r for r in D.sniff_files(spark, [a, b]).collect()}
    assert (got["crlf.csv"]["delimiter"], got["crlf.csv"]["quote"], got["crlf.csv"]["newline"]) == (";", '"', "\\r\\n")
    assert got["crlf.csv"]["has_header"] is True and got["crlf.csv"]["date_format"] == "%Y/%m/%d"
    assert got["nohead.csv"]["has_header"] is False and got["nohead.csv"]["newline"] == "\\n"
    assert got["nohead.csv"]["date_format"] == "%Y-%m-%d" and got["nohead.csv"]["n_columns"] == 3

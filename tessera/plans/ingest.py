"""Load plan: intake folder -> staged, typed, line-numbered entity tables.

Per entity (parents first): match files by header, read each header group with
its own separator, store the parsed rows once, refuse the files that hold
a cell the load cannot parse, a ragged row or invalid bytes, number the lines of
the accepted files 1..n, and write them as one staged table.  A table with
duplicate or NULL keys is not staged.  Other entities still load when one
fails (the reference stops at the first failure; see README).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.casting import iso_date, typed_cell
from tessera.model import DataModel, Entity
from tessera.operators import audit as AU
from tessera.operators import keys as K
from tessera.operators.common import STORED_CODEC, number_splits, split_counts, store_splits
from tessera.session import delete_path, intermediate_tables, move_path, write_read
from tessera.sources import delimited as D
from tessera.sources.dialect import sniff_dialect


@dataclass
class LoadResult:
    entity: str
    table: DataFrame | None      # typed rows of accepted files, with line numbers
    files: DataFrame | None      # file, rows, bad_rows, ragged_rows, invalid_lines, status, reason
    audit: DataFrame | None      # strict cast audit findings


def load_entity(spark: SparkSession, headers: DataFrame, entity: Entity, encoding: str = "UTF-8") -> LoadResult:
    """Read, parse and number the files of ``entity``.

    The text is read once: each line is parsed with the marks of its file's health beside
    it, and every cell is typed then; next to the typed values only the raw text of
    unparsable cells is kept (a sparse array).  Only files with a cell that spans lines
    are read again, whole.  File status, accepted rows and the cast audit are all read from
    that stored table, each pruned to the columns it needs."""
    groups = D.header_groups(headers, entity)
    if not groups:
        return LoadResult(entity.name, None, None, None)
    cells = {v.label: iso_date(F.col(v.label), v.fmt) for v in entity.variables}
    # a cell that is there and no null token but has no typed value; a string always has one
    bad = [F.when(F.col(v.label).isNull() & AU.given_cell(F.col(f"_raw.`{v.label}`")),
                  F.struct(F.lit(v.label).alias("variable"), F.col(f"_raw.`{v.label}`").alias("value")))
           for v in entity.variables if v.fmt != "string"]
    none = F.array().cast("array<struct<variable:string,value:string>>")
    any_bad = F.when(F.coalesce(*bad).isNull(), none).otherwise(F.array_compact(F.array(*bad))) if bad else none
    marks = ["_ragged", "_file", "_block", "_skip", "_blank", "_invalid", "_open"]

    def parsed(raw: DataFrame) -> DataFrame:
        typed = raw.select(*[typed_cell(cells[v.label], v.fmt).alias(v.label) for v in entity.variables],
                           F.struct(*entity.labels).alias("_raw"), *marks)
        return store_splits(typed.select(*entity.labels, any_bad.alias("_bad_cells"), *marks))

    stored = parsed(D.scan_text(spark, groups, entity.labels, encoding))
    # one row a split from one scan: what its file's health and its header line need
    lead = write_read(stored.groupBy("_split", "_file", "_block").agg(
        F.min("_mid").alias("_head"), F.count_if("_invalid").alias("i"), F.count_if("_open").alias("o")), "splits-lead")
    facts = [(r["_file"], r["i"], r["o"]) for r in lead.groupBy("_file").agg(      # one row per file
        F.sum("i").alias("i"), F.sum("o").alias("o")).collect()]
    before = {f for g in groups if g.skip for f in g.files}
    spanning = [f for f, _, o in facts if o and f not in before]
    plain = stored
    if spanning:
        plain = stored.where(~F.col("_file").isin(spanning))
    rows = D.data_rows(plain.where("_skip IS NULL"), lead.where("_block = 0").select("_split", "_head"))
    if before:
        rows = rows.unionByName(D.after_preamble(plain.where("_skip IS NOT NULL")))
    if spanning:
        rows = rows.unionByName(parsed(D.csv_rows(spark, groups, entity.labels, encoding, spanning)))
    # the same of the data rows, for the line numbers and the files' status
    blocks = write_read(split_counts(rows, F.count_if(F.size("_bad_cells") > 0).alias("bad_rows"),
                                     F.count_if("_ragged").alias("ragged_rows")), "splits-rows")
    seen = (blocks.groupBy(F.col("_file").alias("file"))
            .agg(F.sum("_n").alias("rows"), F.sum("bad_rows").alias("bad_rows"), F.sum("ragged_rows").alias("ragged_rows")))
    # files without a data row have facts only
    files = (spark.createDataFrame([f[:2] for f in facts], "file string, invalid_lines long")
             .join(seen, "file", "left").fillna(0, ["rows", "bad_rows", "ragged_rows"]))
    reason = (F.when(F.col("invalid_lines") > 0, F.lit("invalid bytes")).when(F.col("ragged_rows") > 0, F.lit("ragged row"))
              .when(F.col("bad_rows") > 0, F.lit("cell not castable")))
    files = files.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNotNull(), F.lit("refused")).otherwise(F.lit("loaded")))
    accepted = files.where("status = 'loaded'").select(F.col("file").alias("_file"))
    numbered = number_splits(rows, accepted=accepted, blocks=blocks)
    table = (numbered.where(F.col("line_number").isNotNull())
             .select("line_number", "file_line", "_file", *entity.labels))
    audit = (numbered.where(F.size("_bad_cells") > 0)
             .select(F.col("file_line").alias("line_number"), F.inline("_bad_cells"))
             .select("variable", "line_number", "value"))
    return LoadResult(entity.name, table, files, audit)


def key_fault(table: DataFrame, entity: Entity) -> str | None:
    """Why the rows cannot be a table with the entity's primary key, or None."""
    pk = list(entity.primary_key)
    if not pk:
        return None
    if K.pk_nulls(table, pk, None).limit(1).count():
        return "NULL key"
    if K.pk_duplicates(table, pk).limit(1).count():
        return "duplicate key"
    return None


def load_model(spark: SparkSession, intake: str, model: DataModel, staging: str, encoding: str = "UTF-8",
               dialects: bool = False) -> DataFrame:
    """Load every entity of ``model`` from the CSV files below ``intake``
    into parquet tables ``<staging>/<entity>``.  Returns the load results: ``(entity, priority,
    matched_files, rows_read, refused_files, status, reason)``.

    New tables are written aside and take the place of an earlier load's when every
    entity has been read; entities without rows have no table then.  A load that fails
    leaves the earlier tables as they were, and no intermediate table either way.
    With ``dialects`` each file is read in the dialect that its lines show (quote, escape,
    preamble), else with the separator of its header and double quotes.
    """
    new = f"{staging}/_new-{uuid.uuid4().hex[:12]}"
    rows, written = [], []
    try:
        with intermediate_tables(spark):
            paths = D.list_files(spark, intake)
            headers = None
            if paths:   # one row per file, read once for all entities
                h = D.dialect_headers(sniff_dialect(spark, paths, encoding)) if dialects else D.file_headers(spark, paths, encoding)
                headers = spark.createDataFrame(h.collect(), h.schema)
            for i, ent in enumerate(model.load_order()):
                res = load_entity(spark, headers, ent, encoding) if headers is not None else None
                if res is None or res.table is None:
                    rows.append((ent.name, i, 0, 0, 0, "missing", None))
                    continue
                path = f"{new}/{ent.name}"
                res.table.write.parquet(path, compression=STORED_CODEC)
                stats = res.files.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "refused").alias("r"),
                                      F.min("reason").alias("reason")).first()
                table = spark.read.schema(res.table.schema).parquet(path)
                n_rows, reason = table.count(), stats["reason"]
                fault = key_fault(table, ent)
                if fault:
                    n_rows, reason = 0, fault
                else:
                    written.append(ent.name)
                status = "success" if n_rows > 0 else "fatal"
                rows.append((ent.name, i, stats["n"], n_rows, stats["r"], status, reason))
        for ent in model.entities:
            if ent.name in written:
                move_path(spark, f"{new}/{ent.name}", f"{staging}/{ent.name}")
            else:
                delete_path(spark, f"{staging}/{ent.name}")
    finally:
        delete_path(spark, new)
    return spark.createDataFrame(rows, "entity string, priority int, matched_files long, rows_read long, "
                                       "refused_files long, status string, reason string")

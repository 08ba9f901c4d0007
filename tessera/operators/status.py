"""Entity status, quality roll-up, badges, thresholds and counts.

All inputs are small per-entity tables (load results, validation records),
so these are plain DataFrame expressions; the heavy work behind them is the
load and validation plans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Share of wrong rows above which a check is highlighted, and
# the priority given to entities without one.
FLAG_SHARE = 0.2
UNKNOWN_PRIORITY = 99


def entity_status(load: DataFrame) -> DataFrame:
    """``(entity, status, total_records)`` from load results
    ``(entity, matched_files, rows_read)``: no file -> missing (0); file but
    0 rows -> fatal; rows -> success; rows unknown -> success with 0."""
    status = (F.when(F.col("matched_files") == 0, F.lit("missing"))
              .when(F.col("rows_read").isNull(), F.lit("success"))
              .when(F.col("rows_read") == 0, F.lit("fatal"))
              .otherwise(F.lit("success")))
    total = F.when(F.col("matched_files") == 0, F.lit(0)).otherwise(F.coalesce("rows_read", F.lit(0)))
    return load.select("entity", status.alias("status"), total.cast("long").alias("total_records"))


def correct_status(status: DataFrame, counts: DataFrame) -> DataFrame:
    """An entity with 0 records that is not missing is looked up in the
    tables (``counts``: entity, n): rows there -> success with that count,
    otherwise fatal."""
    j = status.join(counts.withColumnRenamed("n", "_n"), "entity", "left")
    zero = (F.col("total_records") == 0) & (F.col("status") != "missing")
    return j.select(
        "entity",
        F.when(zero & (F.coalesce("_n", F.lit(0)) > 0), F.lit("success"))
         .when(zero, F.lit("fatal")).otherwise(F.col("status")).alias("status"),
        F.when(zero, F.coalesce("_n", F.lit(0))).otherwise(F.col("total_records")).cast("long").alias("total_records"),
        *[c for c in status.columns if c not in ("entity", "status", "total_records")])


def rollup(records: DataFrame) -> DataFrame:
    """Validation records -> ``(entity, total_registries, rule_fails,
    catalog_fails, na_count)``; sums over the (bounded) arrays of a record."""
    def total(arr, field):
        return F.aggregate(F.transform(arr, lambda x: x[field]), F.lit(0).cast("long"), lambda a, b: a + b)
    return records.select(
        "entity", "total_registries",
        total(F.col("rules"), "total_wrong_lines").alias("rule_fails"),
        total(F.col("catalog_checking"), "total_wrong_lines").alias("catalog_fails"),
        total(F.col("na_count_list"), "na_count").alias("na_count"))


def quality_badge(status: F.Column, rule_fails: F.Column, catalog_fails: F.Column, na_count: F.Column) -> F.Column:
    """fatal > missing > warning (any rule, catalog or NULL failure) > ok."""
    issues = (F.coalesce(rule_fails, F.lit(0)) > 0) | (F.coalesce(catalog_fails, F.lit(0)) > 0) \
        | (F.coalesce(na_count, F.lit(0)) > 0)
    return (F.when(status == "fatal", F.lit("fatal")).when(status == "missing", F.lit("missing"))
            .when(issues, F.lit("warning")).otherwise(F.lit("ok")))


def quality_table(load_status: DataFrame, records: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Load status joined with validation metrics per entity (full outer):
    validation values win; an entity known only to validation is a success;
    then the zero-count correction and the badge."""
    r = rollup(records)
    j = load_status.join(r, "entity", "full")
    merged = j.select(
        "entity",
        F.coalesce("status", F.lit("success")).alias("status"),
        F.coalesce("total_registries", "total_records", F.lit(0)).cast("long").alias("total_records"),
        F.coalesce("rule_fails", F.lit(0)).cast("long").alias("rule_fails"),
        F.coalesce("catalog_fails", F.lit(0)).cast("long").alias("catalog_fails"),
        F.coalesce("na_count", F.lit(0)).cast("long").alias("na_count"))
    if counts is not None:
        merged = correct_status(merged, counts)
    return merged.withColumn("badge", quality_badge(F.col("status"), F.col("rule_fails"), F.col("catalog_fails"),
                                                    F.col("na_count")))


def check_rows(records: DataFrame) -> DataFrame:
    """Flatten validation records to one row per check:
    ``(entity, total_registries, kind, check, total_wrong_lines)``."""
    nulls = records.select("entity", "total_registries", F.inline("na_count_list")).select(
        "entity", "total_registries", F.lit("null").alias("kind"), F.col("label").alias("check"),
        F.col("na_count").alias("total_wrong_lines"))
    cats = records.select("entity", "total_registries", F.inline("catalog_checking")).select(
        "entity", "total_registries", F.lit("catalog").alias("kind"), F.col("variable").alias("check"),
        "total_wrong_lines")
    rules = records.select("entity", "total_registries", F.inline("rules")).select(
        "entity", "total_registries", F.lit("rule").alias("kind"), F.col("expression").alias("check"),
        "total_wrong_lines")
    return nulls.unionByName(cats).unionByName(rules)


def threshold_flags(checks: DataFrame, share: float = FLAG_SHARE) -> DataFrame:
    """Highlight: catalog or rule check with more than ``share`` of rows
    wrong; NULL count above 0."""
    flagged = F.when(F.col("kind") == "null", F.col("total_wrong_lines") > 0).otherwise(
        F.col("total_wrong_lines") > F.lit(share) * F.col("total_registries"))
    return checks.withColumn("flagged", flagged)


def failing_checks(checks: DataFrame) -> DataFrame:
    return checks.where(F.col("total_wrong_lines") > 0)


def load_summary(load_status: DataFrame) -> DataFrame:
    """Entities loaded, and the error text when none was."""
    n = F.count_if(F.col("status") == "success")
    return load_status.agg(n.alias("entities_loaded")).withColumn(
        "message", F.when(F.col("entities_loaded") == 0,
                          F.lit("None of the uploaded files have been matched with an entity!"))
        .otherwise(F.concat(F.lit("Total number of entities that have been matched to an uploaded file: "),
                            F.col("entities_loaded").cast("string"))))


def entity_counts(spark: SparkSession, tables: Mapping[str, DataFrame | None],
                  priority: Sequence[str] = (), compat_all_zero: bool = False) -> DataFrame:
    """``(entity, priority, n_registries)``: one count per entity table,
    unioned; a missing table counts 0 for itself only.  With ``compat_all_zero``
    any missing table makes every count 0 (and no table is counted), as the
    reference has it."""
    out = None
    if compat_all_zero and any(df is None for df in tables.values()):
        tables = dict.fromkeys(tables)
    for name, df in tables.items():
        prio = priority.index(name) if name in priority else UNKNOWN_PRIORITY
        part = (df.agg(F.count(F.lit(1)).alias("n_registries")) if df is not None
                else spark.range(1).select(F.lit(0).cast("long").alias("n_registries")))
        part = part.select(F.lit(name).alias("entity"), F.lit(prio).alias("priority"), "n_registries")
        out = part if out is None else out.unionByName(part)
    return out

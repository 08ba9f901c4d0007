"""Outputs of a run: validation JSON, profile JSON, artifact catalog, purge
and version stamps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import artifact_category, is_script, minute_stamp
from tessera.model import DataModel
from tessera.operators import profile as PR
from tessera.sources.files import listing

ENGINE_VERSION = "0.1.0"


def version_stamp(df: DataFrame, model: DataModel, pipeline_version: str = "Non-versioned") -> DataFrame:
    """Attach the model, engine and pipeline versions to a result table."""
    return df.select("*", F.lit(model.version).alias("model_version"), F.lit(ENGINE_VERSION).alias("engine_version"),
                     F.lit(pipeline_version).alias("pipeline_version"))


def write_validation(records: DataFrame, out_dir: str) -> str:
    """``{"info": [record, ...]}`` as one JSON document (one record per
    entity, so the single output row is bounded by the model size)."""
    path = f"{out_dir}/validator_output"
    (records.agg(F.collect_list(F.struct(*records.columns)).alias("info")).coalesce(1)
     .write.mode("overwrite").json(path))
    return path


def profile_entity(df: DataFrame, entity, exact: bool = False) -> dict[str, DataFrame]:
    """All profile sections of an entity.  ``exact=False`` (the default for
    written profiles) uses bounded sketches, which hold on any table size."""
    roles = PR.column_roles(entity)
    out = {"overview": PR.overview(df, entity)}
    if roles["numeric"]:
        out["numeric"] = PR.numeric_profile(df, roles["numeric"], exact)
    if roles["categorical"]:
        out["categorical"] = PR.categorical_summary(df, roles["categorical"])
        out["value_counts"] = PR.categorical_profile(df, roles["categorical"])
    if roles["datetime"]:
        out["datetime"] = PR.datetime_profile(df, roles["datetime"], exact)
    if roles["boolean"]:
        out["boolean"] = PR.boolean_profile(df, roles["boolean"])
    if roles["text"]:
        out["text"] = PR.text_profile(df, roles["text"])
    if roles["numeric"]:
        out["histogram"] = PR.histogram(df, roles["numeric"])
        if "line_number" in df.columns:
            out["monotonic"] = PR.monotonic(df, roles["numeric"])
    return out


def write_profiles(spark: SparkSession, model: DataModel, frames: Mapping[str, DataFrame], out_dir: str,
                   exact: bool = False) -> list[str]:
    """One JSON folder per non-empty entity, ``dqa_<use_case>_<entity>``,
    holding each profile section as records tagged by ``section``."""
    written = []
    for ent in model.entities:
        df = frames.get(ent.name)
        if df is None or df.limit(1).count() == 0:   # an empty table gets no profile
            continue
        name = f"dqa_{model.use_case}_{ent.name.replace(' ', '_')}"
        for section, part in profile_entity(df, ent, exact).items():
            (part.select(F.lit(section).alias("section"), F.to_json(F.struct(*part.columns)).alias("stats"))
             .write.mode("append").json(f"{out_dir}/{name}"))
        written.append(name)
    return written


def artifact_catalog(spark: SparkSession, outputs: str) -> DataFrame:
    """Files below ``outputs``: name, category, size, mtime, date, path;
    HTML first, then newest first.  File contents are not read."""
    return artifact_rows(listing(spark, outputs)).orderBy(*artifact_order())


def artifact_order() -> list:
    """HTML first, then newest first."""
    return [~F.lower("name").endswith(".html"), F.desc("mtime")]


def artifact_rows(files: DataFrame) -> DataFrame:
    """``name, category, size, mtime, date, path`` of listed files (name, rel_path, size, mtime), hidden ones left out."""
    files = files.where(~F.col("name").startswith(".") & ~F.col("name").startswith("_"))
    return (files.select("name", artifact_category(F.col("rel_path"), F.col("name")).alias("category"), "size",
                         "mtime", minute_stamp(F.col("mtime")).alias("date"), F.col("rel_path").alias("path")))


def script_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Analysis scripts (extension after the first dot in py, r, qmd) by name."""
    return listing(spark, root).where(is_script(F.col("name"))).select(F.col("rel_path").alias("name")).orderBy("name")


def purge(spark: SparkSession, names: list[str]) -> None:
    """Drop the views, then the tables, of a project's entities."""
    kinds = {t.name: t.tableType for t in spark.catalog.listTables() if t.name in {n.lower() for n in names}}
    temporary = {n for n, k in kinds.items() if k == "TEMPORARY"}
    for n in names:
        if n.lower() in temporary:
            spark.catalog.dropTempView(n)
    kinds = {t.name: t.tableType for t in spark.catalog.listTables() if t.name in {n.lower() for n in names}}
    for n in names:
        if kinds.get(n.lower()) == "VIEW":
            spark.sql(f"DROP VIEW `{n}`")
        elif n.lower() in kinds:
            spark.sql(f"DROP TABLE `{n}`")

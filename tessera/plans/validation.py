"""Validation plan: staged entities -> nested validation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.model import DataModel, Entity
from tessera.operators.validate import validate_entity
from tessera.session import path_exists
from tessera.sources.delimited import read_catalog


def catalog_frames(spark: SparkSession, entity: Entity, catalog_dir: str) -> dict[str, DataFrame]:
    """Code lists of an entity's catalog variables, read from
    ``<catalog_dir>/<filename>`` (or ``<catalog_dir>/<entity>/catalogs/...``)."""
    out = {}
    for v in entity.variables:
        if not v.checks_catalog:
            continue
        nested = f"{catalog_dir}/{entity.name}/catalogs/{v.catalog.filename}"
        flat = f"{catalog_dir}/{v.catalog.filename}"
        out[v.label] = read_catalog(spark, nested if path_exists(spark, nested) else flat,
                                    column_name=v.catalog.column_name)
    return out


def validate_staged(spark: SparkSession, model: DataModel, staging: str, catalog_dir: str) -> DataFrame | None:
    """One validation record per staged entity (``line_number`` stored at
    load), in load order."""
    if not path_exists(spark, staging):
        raise FileNotFoundError(f"no staged tables at {staging}")
    out = None
    for ent in model.load_order():
        path = f"{staging}/{ent.name}"
        if not path_exists(spark, path):
            continue
        df = spark.read.parquet(path)
        rec = validate_entity(df, ent, catalog_frames(spark, ent, catalog_dir))
        out = rec if out is None else out.unionByName(rec)
    return out

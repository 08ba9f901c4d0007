"""Helpers shared by the training-data operators.

Everything here is a Spark job over written tables: lineage is cut by writing
Parquet to the shared folder of ``spark.checkpoint.dir`` and reading it back,
so a lost executor costs recomputed tasks and never a different answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

# monotonically_increasing_id keeps the partition above 33 bits of position
_POSITION_BITS = 33


TEXT_ROWS = 250    # rows of whole texts that travel to Python together
CHUNK_LINKS = 1_000_000   # links that a task contracts together


def text_batches(spark: SparkSession) -> None:
    """Keep the session's batches to Python small: rows hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_read(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Send at most ``rows`` rows to Python at a time while the block runs its jobs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col="doc_id"):
    """True for rows kept apart from learning: crc32 of the id as text, mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def range_numbered(df: DataFrame, order: list, parts: int, name: str) -> DataFrame:
    """Rows range-sorted by ``order`` and stored, with ``_part`` and ``_at``.

    ``_part`` rises with the order and ``_at`` counts rows inside it, so a
    global position is a sum over at most ``parts`` partition counts; no
    window ever sees all rows.
    """
    ranged = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    stored = write_read(ranged, name)
    return stored.select("*", F.shiftright("_mid", _POSITION_BITS).alias("_part"),
                         F.col("_mid").bitwiseAND((1 << _POSITION_BITS) - 1).alias("_at")).drop("_mid")


def partition_starts(counts: DataFrame) -> DataFrame:
    """``(_part, n)`` -> ``(_part, _start)``; one row per range partition."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_part", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("_start"))


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row reachable, for n rows with links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contracted(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links with each run of ``CHUNK_LINKS`` of a task replaced by stars around the least node, u > v."""
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def contract():
            ends = np.concatenate(held, axis=1)
            nodes, at = np.unique(ends, return_inverse=True)
            at = at.reshape(2, -1)
            root = nodes[local_components(len(nodes), at[0], at[1])]
            away = root != nodes
            return pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(root[away])], names=["u", "v"])

        for b in batches:
            held.append(np.stack([b.column(c).to_numpy() for c in ("u", "v")]))
            size += b.num_rows
            if size >= CHUNK_LINKS:
                yield contract()
                held, size = [], 0
        if size:
            yield contract()

    return edges.select("u", "v").mapInArrow(stars, "u long, v long")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(a, b)`` links -> ``(node, component)`` with the least node reachable.

    Tasks first contract the links they hold to stars, which settles links that fit one
    task.  While some node is still both a centre and a leaf, or a leaf of two centres,
    large-star / small-star steps follow: every step maps edges to at most as many
    edges (a min per node and a join, no neighbour lists), so a node with a third of
    all links is one aggregated row, and tasks contract again what they hold.  Each step
    is written to the shared folder.  Nodes without a link are not returned.  Null ends are ignored.
    """
    e = write_read(_contracted(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                               .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
                               .distinct()), name)
    while True:
        # a star forest: no node is both a leaf and a centre, and each leaf has one centre
        ends = (e.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
                .unionAll(e.select("v", F.lit(0), F.lit(1))))
        open_ends = (ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
                     .where("leaf + centre > 1 AND leaf > 0").limit(1))
        if not open_ends.count():
            break
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour moves to the least neighbour
        large = (both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: the smaller neighbours and the node itself move to the least of them
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(m2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(m2.select("u", F.col("m").alias("v"))).distinct())
        e = write_read(_contracted(small), name)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionAll(centres)

"""Building blocks shared by the check operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import path_bytes, scratch_path, write_read

# Largest side that is broadcast on purpose, by rows and by bytes of its stored
# columnar form (a row may hold a long text).  Anything above goes through a
# shuffle join, where AQE may still pick a broadcast from runtime sizes.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 32_000_000
# Codec of stored tables as large as their input: fewer bytes written for a little more time.
STORED_CODEC = "zstd"


def store_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """``df`` stored once, and whether the stored table is proven small enough to broadcast."""
    spark = df.sparkSession
    path = scratch_path(spark, "side")
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return stored, path_bytes(spark, path) <= max_bytes and stored.count() <= max_rows


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``df`` stored once, and broadcast only if the stored table is proven small.

    The stored copy serves the size check and the join, so the work behind
    ``df`` runs once however it turns out."""
    stored, small = store_side(df, max_rows, max_bytes)
    return F.broadcast(stored) if small else stored


def first_n(df: DataFrame, group_cols: Sequence[str], order_col: str, value: Column | str,
            n: int, name: str = "firsts") -> DataFrame:
    """Per group, the ``value`` of the ``n`` rows with the smallest ``order_col``.

    ``row_number() <= n`` lets Spark insert a partial window-group limit
    before the shuffle, so each map task ships at most ``n`` rows per group:
    a group holding a third of all rows never lands whole in one task.
    """
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*group_cols).orderBy(F.col("_o").asc())
    limited = (df.select(*group_cols, F.col(order_col).alias("_o"), value.alias("_v"))
               .withColumn("_rn", F.row_number().over(w))
               .where(F.col("_rn") <= n))
    return (limited.groupBy(*group_cols)
            .agg(F.array_sort(F.collect_list(F.struct("_o", "_v"))).alias("_s"))
            .select(*group_cols, F.transform("_s", lambda s: s["_v"]).alias(name)))


def with_tail(items: Column, total: Column, n: int, unit: str) -> Column:
    """``items`` plus ``"+k <unit>"`` when ``total`` exceeds ``n``."""
    extra = F.concat(F.lit("+"), (total - F.lit(n)).cast("string"), F.lit(f" {unit}"))
    return F.when(total > n, F.concat(items, F.array(extra))).otherwise(items)


def number_rows(df: DataFrame, order_cols: Sequence[Column | str], name: str = "line_number") -> DataFrame:
    """Attach 1..n in the given total order, without a single-task window.

    The rows are range-sorted, tagged with ``monotonically_increasing_id`` and
    stored once, so the ids cannot change between the two uses below.  Per
    sort partition the row count is taken; a prefix sum over those counts
    (one row per partition, on the driver) gives each partition its offset, which
    the numbering holds as a constant array.  ``order_cols``
    must be a total order (unique rows): ties would make the numbering
    arbitrary, and one hot key value would land in a single range partition.
    """
    tagged = write_read(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()), "numbered", STORED_CODEC)
    part = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_min")).collect()
    shifts, before = {}, 1
    for r in sorted(counts, key=lambda r: r["_part"]):      # one row a sort partition
        shifts[r["_part"]] = before - r["_min"]
        before += r["_n"]
    shift = F.expr("CAST(array(" + ", ".join(f"{shifts.get(i, 0)}L" for i in range(max(shifts, default=-1) + 1)) + ") AS array<bigint>)")
    return tagged.withColumn(name, F.col("_mid") + F.get(shift, part.cast("int"))).drop("_mid")


def store_splits(df: DataFrame) -> DataFrame:
    """Rows of a file scan (with ``_file`` and ``_block`` from ``_metadata``)
    stored with the id that fixes their order and a 64-bit number of their split."""
    return write_read(df.withColumn("_mid", F.monotonically_increasing_id())
                      .withColumn("_split", F.xxhash64("_file", "_block")), "splits", STORED_CODEC)


def split_counts(stored: DataFrame, *more: Column, file_order: Sequence[str] = ("_file",)) -> DataFrame:
    """Per split of stored rows: their number, their first id and what ``more`` aggregates."""
    return stored.groupBy("_split", *file_order, "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_min"), *more)


def number_splits(stored: DataFrame, file_order: Sequence[str] = ("_file",), table_name: str = "line_number",
                  file_name: str = "file_line", accepted: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Line numbers for stored rows, in file order.

    Each split is read contiguously by one task, so ``monotonically_increasing_id``
    is consecutive inside a split; counts per split, prefix-summed in
    (file, split) order, give the offsets.  ``file_line`` numbers rows within each
    file; ``line_number`` numbers 1..n over the files of ``accepted`` (column
    ``_file``; all files without it) and is NULL for the others.  ``blocks`` are the
    :func:`split_counts` of ``stored``, if already known.
    """
    keys = [*file_order, "_block"]
    blocks = split_counts(stored, file_order=file_order) if blocks is None else blocks
    taken = F.lit(True)
    if accepted is not None:
        blocks = blocks.join(accepted.select("_file").distinct().withColumn("_taken", F.lit(True)), "_file", "left")
        taken = F.coalesce(F.col("_taken"), F.lit(False))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy(*file_order).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "_split", "_min", taken.alias("_ok"),
        F.coalesce(F.sum(F.when(taken, F.col("_n")).otherwise(0)).over(before), F.lit(0)).alias("_toff"),
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_foff"))
    pos = F.col("_mid") - F.col("_min") + 1
    return (stored.join(broadcast_checked(blocks), "_split")
            .withColumn(table_name, F.when(F.col("_ok"), F.col("_toff") + pos))
            .withColumn(file_name, F.col("_foff") + pos)
            .drop("_toff", "_foff", "_min", "_mid", "_split", "_ok"))


def file_line_numbers(df: DataFrame, file_order: Sequence[str] = ("_file",),
                      table_name: str = "line_number", file_name: str = "file_line") -> DataFrame:
    """:func:`number_splits` of a scan that is stored here, all files taken."""
    return number_splits(store_splits(df), file_order, table_name, file_name)

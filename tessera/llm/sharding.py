"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows of each source are put in a seeded shuffled order and ranked; row r of n
gets the fractional rank (2r - 1) / 2n.  Sorted by fractional rank the sources
interleave in proportion, so every contiguous cut holds the mixture of the
whole.  The cut makes shards whose row counts differ by at most one.

No window holds a source: ranks come from a range sort by (source, shuffled
key) whose partitions split a hot source, plus prefix sums over one row per
(partition, source).

Defined results: a null source is a stratum of its own; a null text has no
bytes; equal rows are interchangeable and each gets a slot of its own; an empty
table gives no rows; further columns are passed through unseen, except that input
columns called shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import partition_starts, partitions, range_numbered


def shuffle_key(id_col: str, seed: int):
    """60 bits of md5(seed:id): the seeded order inside a source."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("~")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def interleave(df: DataFrame, n_shards: int = 16, stratum: str = "source", id_col: str = "doc_id",
               seed: int = 17, tie_cols: tuple = ()) -> DataFrame:
    """``df`` with ``shard`` (0 .. n_shards-1) and ``slot`` (gapless from 0 in it).

    ``tie_cols`` order rows that share an id.  All columns travel through two
    range sorts, so pass narrow rows and join the payload by id when writing.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    parts = partitions(df.sparkSession)
    kept = [F.col(c) for c in df.columns if c not in ("shard", "slot")]
    keyed = df.select(F.struct(*kept).alias("_row"), F.col(stratum).alias("_s"), shuffle_key(id_col, seed).alias("_k"),
                      F.col(id_col).alias("_id"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie_cols)])
    order = ["_s", "_k", "_id", *[f"_t{i}" for i in range(len(tie_cols))]]
    first = range_numbered(keyed, order, parts, "interleave-rank")

    runs = first.groupBy("_part", "_s").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_from"))
    of_source = Window.partitionBy("_s")
    before = of_source.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_part").alias("_p"), F.col("_s").alias("_q"), "_from",
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
                       F.sum("n").over(of_source).alias("_total"))
    ranked = (first.join(runs, (F.col("_part") == F.col("_p")) & F.col("_s").eqNullSafe(F.col("_q")))
              .withColumn("_f", (2 * (F.col("_before") + F.col("_at") - F.col("_from")) + 1).cast("double")
                          / (2 * F.col("_total")).cast("double"))
              .select("_row", "_f", *order))

    second = range_numbered(ranked, ["_f", *order], parts, "interleave-cut")
    counts = second.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    total = second.count()
    q, r = divmod(total, n_shards)
    # one row per range partition: at most `parts` rows are broadcast
    placed = (second.join(F.broadcast(partition_starts(counts)), "_part")
              .withColumn("_pos", F.col("_start") + F.col("_at")))
    large = r * (q + 1)   # rows in the first r shards, which hold one row more
    pos, rest = F.col("_pos"), F.col("_pos") - large
    shard = F.when(pos < large, F.floor(pos / (q + 1))).otherwise(r + F.floor(rest / max(q, 1)))
    slot = F.when(pos < large, pos % (q + 1)).otherwise(rest % max(q, 1))
    return placed.select("_row.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int) -> None:
    """One folder per shard, rows in slot order inside each file."""
    (df.repartitionByRange(max(n_shards, partitions(df.sparkSession)), "shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


def shard_digest(docs: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """The contract's columns for ``documents``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                         (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = interleave(narrow, n_shards, "source", "doc_id", seed, ("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


SHARD_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 15))::BIGINT AS k
  FROM documents),
bytes AS (
  SELECT doc_id, source, k, octet_length(encode(t)) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda p: ('0x' || p)::BIGINT) AS bl FROM d),
crc AS (
  SELECT doc_id, source, k, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(bl, lambda v:
               [v & 1, (v >> 1) & 1, (v >> 2) & 1, (v >> 3) & 1, (v >> 4) & 1, (v >> 5) & 1, (v >> 6) & 1, (v >> 7) & 1]))),
             lambda c, x: xor(c >> 1, 3988292384::BIGINT * (xor(c, x) & 1))), 4294967295::BIGINT) AS text_crc32
  FROM bytes),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size, text_crc32) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS f FROM crc),
placed AS (
  SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, k, doc_id, size, text_crc32) - 1 AS pos,
         count(*) OVER () // 16 AS q, count(*) OVER () % 16 AS r FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
       CAST(CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) ELSE r + (pos - r * (q + 1)) // greatest(q, 1) END AS INTEGER) AS shard,
       CAST(CASE WHEN pos < r * (q + 1) THEN pos % (q + 1) ELSE (pos - r * (q + 1)) % greatest(q, 1) END AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

"""Segments that arrive over time: the load checks as a file stream.

A streaming CSV source watches one entity's intake folder (one header order
per folder).  Each micro-batch goes through the same steps as a batch load
(stored line numbers, per-file refusal of unparsable cells, typed
projection, ragged rows refuse their file) and writes the accepted rows and one
result row per file below a ``batch_id=`` folder of its own.  A batch that is run again after a
failure (foreachBatch runs at least once) overwrites its folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.model import Entity
from tessera.operators.common import file_line_numbers
from tessera.sources import delimited as D


def segment_stream(spark: SparkSession, folder: str, columns: Sequence[str], labels: Sequence[str],
                   sep: str = "|", files_per_batch: int = 100) -> DataFrame:
    """All-text rows of new files below ``folder`` (header order ``columns``),
    projected to the declared ``labels`` with file metadata."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_corrupt"]])
    return (spark.readStream.schema(schema).option("header", True).option("sep", sep)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
            .option("quote", '"').option("escape", '"')
            .option("maxFilesPerTrigger", files_per_batch).csv(folder)
            .select(*labels, F.col("_corrupt").isNotNull().alias("_ragged"), F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block")))


def _load_batch(entity: Entity, staging: str, results: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        numbered = file_line_numbers(batch)
        raw = numbered.withColumn("_bad", D.bad_cells(numbered, entity) + F.col("_ragged").cast("int"))
        files = (raw.groupBy(F.col("_file").alias("file"))
                 .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_bad") > 0).alias("bad_rows"))
                 .withColumn("status", F.when(F.col("bad_rows") > 0, F.lit("refused")).otherwise(F.lit("loaded")))
                 )
        # one folder per batch, overwritten when a batch is run again
        files.write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")
        refused = files.where(F.col("bad_rows") > 0).select(F.col("file").alias("_file"))
        accepted = raw.join(F.broadcast(refused), "_file", "left_anti")
        (D.typed(accepted, entity, keep=("file_line", "_file"))
         .write.mode("overwrite").parquet(f"{staging}/batch_id={batch_id}"))
    return run


def start_intake(spark: SparkSession, folder: str, columns: Sequence[str], entity: Entity, staging: str,
                 results: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    stream = segment_stream(spark, folder, columns, entity.labels)
    writer = stream.writeStream.foreachBatch(_load_batch(entity, staging, results)).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()

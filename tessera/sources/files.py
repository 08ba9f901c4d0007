"""Raw file scans: encoding check, content hashes, listings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import scanned_path, sha256_hex
from tessera.session import file_system, qualified, write_read

# Encoding names reported, and the fallback for text that is
# not valid UTF-8.  (A UTF-8 byte-order mark is skipped by the line reader
# itself, so such files read as plain UTF-8.)
UTF8 = "UTF-8"
FALLBACK_ENCODING = "ISO-8859-1"


def encoding_check(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Per file: lines that are not valid UTF-8, and the encoding to read it
    with.  A splittable text scan (no whole-file load), one aggregate; a
    statistical detector is not rebuilt."""
    lines = spark.read.text(paths).select(scanned_path().alias("file"), "value")
    per_file = lines.groupBy("file").agg(F.count_if(~F.is_valid_utf8("value")).alias("invalid_lines"))
    return per_file.withColumn(
        "encoding", F.when(F.col("invalid_lines") > 0, F.lit(FALLBACK_ENCODING)).otherwise(F.lit(UTF8)))


def _relative(spark: SparkSession, root: str):
    """The listed path without the root, cut by the root's length."""
    prefix = qualified(spark, root).rstrip("/") + "/"
    return F.col("path").substr(F.lit(len(prefix) + 1), F.length("path"))


# Extensions that the text source would decompress; such files are hashed as whole contents (2 GB each at most).
PACKED = (".gz", ".bz2", ".zst", ".zstd", ".snappy", ".lz4", ".deflate", ".xz")
_BOM = b"\xef\xbb\xbf"
_UNSPLIT = str(1 << 60)


@contextmanager
def _one_task_a_file(spark: SparkSession):
    """Scans planned in the block give each file to a task of its own, whole and in order."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, _UNSPLIT)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file from its lines in order; what the line reader takes away (the last line
    break, a byte-order mark) is told by the file's size."""
    path, size, with_mark, plain, seen, lines = None, 0, None, None, 0, 0

    def end():
        short = size - seen - (lines - 1)          # bytes that no line holds
        digest = with_mark if short >= len(_BOM) else plain
        if short % len(_BOM) == 1:
            digest.update(b"\n")
        return pa.RecordBatch.from_pydict({"path": [path], "sha256": [digest.hexdigest()]})

    for b in batches:
        paths, sizes = b.column("path").to_pylist(), b.column("size").to_pylist()
        values, at = b.column("line").to_pylist(), 0
        while at < len(paths):      # the run of one file's lines, a whole batch but where files meet
            p = paths[at]
            to = len(paths) if paths[-1] == p else next(i for i in range(at, len(paths)) if paths[i] != p)
            if p != path:
                if path is not None:
                    yield end()
                path, size, seen, lines = p, sizes[at], 0, 0
                with_mark, plain = hashlib.sha256(_BOM), hashlib.sha256()
            text = b"\n".join(values[at:to])
            for digest in (with_mark, plain):
                if lines:
                    digest.update(b"\n")
                digest.update(text)
            seen, lines, at = seen + len(text) - (to - at - 1), lines + to - at, to
    if path is not None:
        yield end()


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, sha256)`` of files of any size, stored.  A task reads its file line by line through
    Spark's text source and feeds the digest as it goes; it holds a batch of lines, never the file.
    Empty files have no row."""
    packed = [p for p in paths if p.lower().endswith(PACKED)]
    plain = [p for p in paths if not p.lower().endswith(PACKED)]
    out = spark.createDataFrame([], "path string, sha256 string")
    with _one_task_a_file(spark):
        if plain:
            lines = spark.read.option("lineSep", "\n").text(plain).select(
                scanned_path().alias("path"), F.col("_metadata.file_size").alias("size"),
                F.col("value").cast("binary").alias("line"))
            out = write_read(lines.mapInArrow(_digests, "path string, sha256 string"), "digests")
    if packed:
        out = out.unionByName(write_read(spark.read.format("binaryFile").load(packed).select(
            "path", sha256_hex(F.col("content")).alias("sha256")), "digests"))
    return out


def _empty_files(spark: SparkSession, root: str) -> list[tuple]:
    """(path, modification time in seconds) of the files without a byte, which a file scan leaves out; a listing."""
    where, fs = file_system(spark, root)
    found, files = [], fs.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        path = str(f.getPath().toString())
        if f.getLen() == 0 and not any(part[:1] in ("_", ".") and "=" not in part for part in path[len(qualified(spark, root)):].split("/")):
            found.append((path, f.getModificationTime() / 1000))
    return found


def manifest(spark: SparkSession, root: str, modified_after: str | None = None, previous: DataFrame | None = None) -> DataFrame:
    """``(path, sha256, size, mtime, status)`` of every file below ``root`` (changed since
    ``modified_after``, if given); ``path`` is relative to ``root``.

    With a ``previous`` manifest only files that it does not have, or has with another size or an
    earlier time, are read; the digests of the others are taken over.  ``status`` is ``new``,
    ``changed``, ``same`` or ``gone`` (files of the earlier manifest that are there no more; their
    digest stays)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    empty = spark.createDataFrame(_empty_files(spark, root), "path string, at double").select(
        "path", F.lit(0).cast("long").alias("length"), F.col("at").cast("timestamp").alias("modificationTime"))
    if modified_after:
        empty = empty.where(F.col("modificationTime") > F.lit(modified_after).cast("timestamp"))
    found = reader.load(root).select("path", "length", "modificationTime").unionByName(empty)
    now = write_read(found.select(F.col("path").alias("_full"), _relative(spark, root).alias("path"),
                                  F.col("length").alias("size"), F.col("modificationTime").alias("mtime")), "listing")
    if previous is None:
        previous = spark.createDataFrame([], "path string, sha256 string, size long, mtime timestamp, status string")
    old = previous.where("status <> 'gone'").select("path", F.col("sha256").alias("_sha"), F.col("size").alias("_size"),
                                                    F.col("mtime").alias("_mtime"))
    same = F.col("_size").eqNullSafe(F.col("size")) & (F.col("mtime") <= F.col("_mtime"))
    status = (F.when(F.col("_full").isNull(), "gone").when(F.col("_sha").isNull(), "new").when(same, "same").otherwise("changed"))
    joined = write_read(now.join(old, "path", "full").withColumn("status", status), "manifest")
    paths = [r["_full"] for r in joined.where("status IN ('new', 'changed') AND size > 0").select("_full").collect()]   # one a file
    fresh = file_digests(spark, paths)
    digest = F.when(F.col("status").isin("same", "gone"), F.col("_sha")).when(F.col("size") == 0, F.sha2(F.lit(b""), 256)).otherwise(
        F.col("_new"))
    return (joined.join(fresh.select(F.col("path").alias("_full"), F.col("sha256").alias("_new")), "_full", "left")
            .select("path", digest.alias("sha256"), F.coalesce("size", "_size").alias("size"),
                    F.coalesce("mtime", "_mtime").alias("mtime"), "status"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, name, rel_path, size, mtime)`` without reading content (the
    ``content`` column is pruned from the binary-file scan)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select("path", F.element_at(F.split(F.col("path"), "/"), -1).alias("name"),
                     _relative(spark, root).alias("rel_path"),
                     F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))

"""Session helpers: one place for the configuration every job relies on.

Nothing here replaces Spark machinery; it only sets the knobs that matter for
checks over large entities (AQE, skew handling, UTC) and resolves the shared
folder used to cut lineage (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Settings that shape the physical plans of this library.  They are only
# defaults for sessions created here; a cluster session keeps its own values.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Adds its folder to the workers' import path; on a cluster whose nodes hold
    the package elsewhere (or get it with the job) the entry does nothing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The folder comes from the running context or from ``spark.checkpoint.dir``.
    Only a local session without either gets a fresh folder of its own (tests);
    a cluster session without the setting is an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    share_package(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # not set at all
            configured = None
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


# Intermediate tables of the runs of this thread that have not ended, innermost last.
_RUNS = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables; inside
    :func:`intermediate_tables` it is removed when the block ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    runs = getattr(_RUNS, "open", [])
    if runs:
        runs[-1].append(path)
    return path


@contextmanager
def intermediate_tables(spark: SparkSession):
    """A run whose result is written when the block ends: the intermediate tables that were
    made in it by this thread are removed then, also when it fails.  Nothing lazy that reads
    them may leave the block."""
    if not hasattr(_RUNS, "open"):
        _RUNS.open = []
    made: list[str] = []
    _RUNS.open.append(made)
    try:
        yield made
    finally:
        _RUNS.open.remove(made)
        for path in made:
            delete_path(spark, path)


def remove_scratch(spark: SparkSession) -> None:
    """Remove every intermediate table of this application, at its end: lazy results that read
    one can no longer be computed."""
    delete_path(spark, scratch_root(spark))


def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the store that Spark itself reads.
    Only a missing path is False; any other error rises."""
    where, fs = file_system(spark, path)
    return bool(fs.exists(where))


def path_bytes(spark: SparkSession, path: str) -> int:
    where, fs = file_system(spark, path)
    return int(fs.getContentSummary(where).getLength())


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly below a path; none when it is not there."""
    where, fs = file_system(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isFile())


def read_small_file(spark: SparkSession, path: str) -> str:
    """The text of a small file that the driver keeps."""
    where, fs = file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole and only if it is not there; False when another was first.

    The text goes to a file of its own, which then takes the name in one step: by a
    rename that refuses an existing name in the store's file system, by a hard link on
    a local one, whose rename would replace."""
    jvm = spark.sparkContext._jvm
    where, fs = file_system(spark, path)
    fs.mkdirs(where.getParent())
    own = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(own, False)
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(own.toUri().getPath(), where.toUri().getPath())
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(own, where, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(own, False)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as file listings print it."""
    where, fs = file_system(spark, path)
    return str(fs.makeQualified(where).toString())


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Put the folder ``source`` in the place of ``target``."""
    there, fs = file_system(spark, target)
    here, _ = file_system(spark, source)
    fs.delete(there, True)
    fs.mkdirs(there.getParent())
    if not fs.rename(here, there):
        raise OSError(f"{source} could not be moved to {target}")


def delete_path(spark: SparkSession, path: str) -> None:
    where, fs = file_system(spark, path)
    fs.delete(where, True)


def write_read(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write to a fresh table of the shared folder and read it back: cuts the
    lineage, survives lost executors, and stays columnar."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


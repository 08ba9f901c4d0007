"""Embedding whitening with Spark MLlib's BlockMatrix.

Entries become whole numbers x = floor(64 c) + 1000000.  The fit list holds every
distinct x-vector once; its count n and sums S are exact, and rows are centred as
(n x - S) / n before anything is multiplied.  Centred rows are packed into blocks of
``BLOCK_ROWS`` rows inside the tasks that read them (the last block of a task is filled
up with zero rows, which change no product), so making blocks shuffles nothing.
``transpose().multiply()`` gives the scatter matrix, numpy's ``eigh`` its unit
eigenvectors, and one more BlockMatrix product with the whitening matrix projects
rows.  The covariance of the projected fit list, made the same way, is held
against the identity.

Scale: a matrix of the driver's knowing has at most ``SLAB_BLOCKS`` blocks, because
MLlib plans a product on the driver; further blocks are further slabs, whose scatter
matrices add up.  The middle dimension of the scatter product is split, and the
whitening matrix is dealt over enough partitions, that a task meets about
``TASK_BLOCKS`` blocks at a time.  No task sees a group: equal vectors meet only in the
distinct, which collapses them before the shuffle, and repeated rows are projected
where they stand.

Defined results: a row whose vector is null, empty, or holds a null or non-finite
entry is dropped; entries beyond 2^46 in size count as that bound; vectors of
different lengths are whitened apart, each length with its own fit list;
components whose eigenvalue is zero to double precision have no whitened value and
are left out (a single distinct vector has none); a deviation that no long can
hold is null; repeated rows and rows without vec_id stay, each with its rows of the
result; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import partition_starts, rows_per_batch, write_read
from tessera.operators.common import broadcast_checked
from tessera.session import scratch_path

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BLOCK_ROWS = 1024
TASK_BLOCKS = 64          # blocks that meet in one task of a product
SLAB_BLOCKS = 8192        # blocks of one BlockMatrix
_LIMIT = 1 << 52          # of a scaled entry
_BATCH = 4                # blocks sent to Python at a time
_UDT = MatrixUDT()
_STRUCT = MatrixUDT.sqlType()
_STORED = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("rows", T.IntegerType()),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("deviations", T.ArrayType(T.LongType())),
    T.StructField("matrix", _STRUCT)])
_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x of every row whose vector is whole and finite."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform("e", lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(_LIMIT))), F.lit(-float(_LIMIT)))) + SHIFT)
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
            .where(F.coalesce(F.col("e").isNotNull() & (F.size("e") > 0) & fine, F.lit(False)))
            .select("vec_id", scaled.alias("x"), F.size("e").alias("dim")))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows of the fit list and exact sums by dimension."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                high, low, n = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0), n + len(x)
        yield pa.RecordBatch.from_pydict({"j": np.arange(dim, dtype=np.int32), "high": high, "low": low,
                                          "n": np.full(dim, n, np.int64)})

    rows = (fit.select("x").mapInArrow(sums, "j int, high long, low long, n long").groupBy("j")
            .agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect())
    by = {r["j"]: r for r in rows}     # one row for each dimension
    return by[0]["n"], [(by[j]["high"] << 32) + by[j]["low"] for j in range(dim)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: int64 where it fits, else Python integers."""
    if len(x) and n * int(np.abs(x).max()) + max(abs(s) for s in sums) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(d: np.ndarray) -> list:
    """Sum of squares of each row, exact; None beyond a long."""
    top = int(np.abs(d).max()) if d.size else 0
    if d.dtype != object and top * top * d.shape[1] < 1 << 62:
        return (d * d).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (d.astype(object) ** 2).sum(1).tolist()]


def _store(df: DataFrame, chunk, width: int, name: str) -> DataFrame:
    """Blocks of the rows that ``chunk`` makes of each record batch: (matrix, ids or None, deviations or None).

    Returns part, seq, rows, ids, deviations and the matrix as a column of MLlib."""
    def one(part, seq, m, ids, dev):
        full = np.zeros((BLOCK_ROWS, width))
        full[:len(m)] = m
        lists = [pa.array([v], pa.list_(pa.int64())) for v in (ids, dev)]
        values = pa.ListArray.from_arrays(pa.array([0, full.size], pa.int32()), pa.array(full.ravel()))
        none = pa.array([None], pa.list_(pa.int32()))
        struct = pa.StructArray.from_arrays(
            [pa.array([1], pa.int8()), pa.array([BLOCK_ROWS], pa.int32()), pa.array([width], pa.int32()), none, none, values,
             pa.array([True])], names=_STRUCT.names)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                                           pa.array([len(m)], pa.int32()), *lists, struct], names=_STORED.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        m, ids, dev = np.zeros((0, width)), [], []
        for piece in chain(batches, [None]):
            last = piece is None
            if not last and piece.num_rows:
                got, i, d = chunk(piece)
                m, ids, dev = np.concatenate([m, got]), ids + (i or []), dev + (d or [])
            while len(m) >= BLOCK_ROWS or (last and len(m)):
                yield one(part, seq, m[:BLOCK_ROWS], ids[:BLOCK_ROWS], dev[:BLOCK_ROWS])
                m, ids, dev, seq = m[BLOCK_ROWS:], ids[BLOCK_ROWS:], dev[BLOCK_ROWS:], seq + 1

    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.mapInArrow(build, _STORED).write.parquet(path)
    as_matrix = T.StructType([*_STORED.fields[:-1], T.StructField("matrix", _UDT)])
    stored = spark.read.schema(as_matrix).parquet(path)
    starts = partition_starts(stored.groupBy(F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("n")))
    return (stored.join(broadcast_checked(starts), F.col("part") == F.col("_part"))
            .withColumn("block", F.col("_start") + F.col("seq")).drop("part", "seq", "_part", "_start"))


class Blocks:
    """Numbered blocks of one table, read as BlockMatrix slab by slab."""

    def __init__(self, df: DataFrame, width: int):
        self.df, self.width = df, width
        self.n = df.select(F.max("block")).first()[0]
        self.n = 0 if self.n is None else self.n + 1

    def slabs(self) -> Iterator[tuple[int, int, BlockMatrix]]:
        for low in range(0, self.n, SLAB_BLOCKS):
            count = min(SLAB_BLOCKS, self.n - low)
            part = self.df.where((F.col("block") >= low) & (F.col("block") < low + count)).select(
                F.struct((F.col("block") - low).alias("_1"), F.lit(0).cast("long").alias("_2")).alias("at"), "matrix")
            java = callMLlibFunc("createBlockMatrix", part, BLOCK_ROWS, self.width, count * BLOCK_ROWS, self.width)
            yield low, count, BlockMatrix(java, BLOCK_ROWS, self.width)

    def scatter(self) -> np.ndarray:
        """The sum of outer products of all rows."""
        total = np.zeros((self.width, self.width))
        for _, count, m in self.slabs():
            splits = -(-count // TASK_BLOCKS)
            product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
            total += BlockMatrix(product, self.width, self.width).toLocalMatrix().toArray()
        return total

    def project(self, matrix: np.ndarray, name: str) -> DataFrame:
        """block, rows, ids, deviations and ``z`` (the projected rows as a struct) of every block."""
        spark = self.df.sparkSession
        schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("z", _STRUCT)])
        out = None
        for low, count, m in self.slabs():
            # MLlib deals a tall result over the square root of the partitions it sees
            slices = (-(-count // TASK_BLOCKS)) ** 2
            one = spark.createDataFrame([((0, 0), DenseMatrix(*matrix.shape, matrix.ravel(order="F")))],
                                        T.StructType([T.StructField("at", T.StructType([
                                            T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])),
                                            T.StructField("matrix", _UDT)])).repartition(slices)
            right = BlockMatrix(callMLlibFunc("createBlockMatrix", one, matrix.shape[0], matrix.shape[1], *matrix.shape),
                                *matrix.shape)
            blocks = callMLlibFunc("getMatrixBlocks", m.multiply(right)._java_matrix_wrapper._java_model)
            path = scratch_path(spark, name)
            blocks.toDF("at", "z").select((F.col("at._1").cast("long") + low).alias("block"), "z").write.parquet(path)
            read = spark.read.schema(schema).parquet(path)
            out = read if out is None else out.unionAll(read)
        return self.df.drop("matrix").join(out, "block")


def _struct_rows(z, row: int, rows: int) -> np.ndarray:
    """The first rows of a stored matrix."""
    m = z[row].as_py()
    v = np.array(m["values"])
    shape = (m["numRows"], m["numCols"])
    return (v.reshape(shape) if m["isTransposed"] else v.reshape(shape[::-1]).T)[:rows]


def principal_axes(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as columns, those above zero, k at most."""
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    real = values > max(values[0], 0.0) * len(values) * 8 * np.finfo(float).eps if len(values) else np.zeros(0, bool)
    k = min(k, int(real.sum()))
    axes = axes[:, :k]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(k)]) if k else np.ones(0)
    return values[:k].copy(), axes * signs


def _identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Largest entry of the projected fit list's covariance less the identity; centred before multiplying."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for b in batches:
            for i, rows in enumerate(b.column("rows").to_pylist()):
                total += _struct_rows(b.column("z"), i, rows).sum(0)
        yield pa.RecordBatch.from_pydict({"j": np.arange(k, dtype=np.int32), "s": total})

    read = projected.select("rows", "z")
    mean = np.zeros(k)
    for r in read.mapInArrow(sums, "j int, s double").groupBy("j").agg(F.sum("s").alias("s")).collect():
        mean[r["j"]] = r["s"] / n

    def centred(b):
        z = [_struct_rows(b.column("z"), i, rows) for i, rows in enumerate(b.column("rows").to_pylist())]
        return np.concatenate(z) - mean, None, None

    scatter = Blocks(_store(read, centred, k, "whiten-identity"), k).scatter()
    return float(np.abs(scatter / n - np.eye(k)).max())


def _whiten_length(stored: DataFrame, dim: int, components: int) -> DataFrame | None:
    spark = stored.sparkSession
    rows = stored.where(F.col("dim") == dim).select("vec_id", "x")
    fit = write_read(rows.select("x").distinct(), "whiten-fit")
    n, sums = fit_sums(fit, dim)

    def centre(x):
        d = deviations(x, n, sums)
        return d, (d / n).astype(float)

    def fit_chunk(b):
        return centre(_matrix(b.column("x")))[1], None, None

    def row_chunk(b):
        d, c = centre(_matrix(b.column("x")))
        return c, b.column("vec_id").to_pylist(), square_sums(d)

    listed = Blocks(_store(fit, fit_chunk, dim, "whiten-fit-blocks"), dim)
    covariance = listed.scatter() / n
    values, axes = principal_axes(covariance, components)
    k = len(values)
    if not k:
        return None
    whitening = axes / np.sqrt(values)
    explained = values / np.trace(covariance)
    with rows_per_batch(spark, _BATCH):
        error = _identity_error(listed.project(whitening, "whiten-fit-projected"), n, k)
    projected = Blocks(_store(rows, row_chunk, dim, "whiten-blocks"), dim).project(whitening, "whiten-projected")

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, count in enumerate(b.column("rows").to_pylist()):
                z = _struct_rows(b.column("z"), i, count)
                ids, dev = b.column("ids")[i].as_py(), b.column("deviations")[i].as_py()
                at = np.repeat(np.arange(count), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(ids, pa.int64()).take(pa.array(at)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    "n": pa.array(np.full(count * k, n, np.int64)),
                    "deviation": pa.array(dev, pa.int64()).take(pa.array(at)),
                    "whitened": pa.array(z.ravel()), "explained": pa.array(np.tile(explained, count)),
                    "identity_error": pa.array(np.full(count * k, error))})

    with rows_per_batch(spark, _BATCH):
        return write_read(projected.select("rows", "ids", "deviations", "z").mapInArrow(result, _RESULT), "whitened")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    stored = write_read(whole_vectors(vectors), "whiten-rows")
    out = None
    for r in stored.groupBy("dim").count().orderBy("dim").collect():    # one row for each length
        part = _whiten_length(stored, r["dim"], components)
        if part is not None:
            out = part if out is None else out.unionAll(part)
    return stored.sparkSession.createDataFrame([], _RESULT) if out is None else out

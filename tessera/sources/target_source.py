"""The committed target as a Spark data source of its own, for readers that know it by name only.

``read_target_source`` opens one committed version of one entity.  Each part of the
table is one input partition.  Filters that Spark pushes down are used twice: an
equality (or a list) on every key column leaves the parts that such keys are dealt
to, and comparisons skip row groups of the Parquet files by their statistics.  Spark evaluates
all filters again, so pushing them only saves reading.  Batches travel as Arrow.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, LessThan, LessThanOrEqual)

from tessera.model import Entity
from tessera.operators.publish import PublishError, last_commit
from tessera.session import qualified, share_package

NAME = "tessera_target"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
# lists of keys that are looked up one by one; longer products of lists read every part
_KEYS = 10_000
_TESTS = {EqualTo: pads.Expression.__eq__, GreaterThan: pads.Expression.__gt__, GreaterThanOrEqual: pads.Expression.__ge__,
          LessThan: pads.Expression.__lt__, LessThanOrEqual: pads.Expression.__le__}


def key_text(value) -> str:
    """A key value as Spark prints it; the types that keys are published in."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | str):
        return str(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value.isoformat()
    raise TypeError(type(value).__name__)


def part_of(key: tuple, deal: int) -> int:
    """The part that :func:`tessera.operators.publish.part_number` gives a key."""
    text = "\u0001".join(map(key_text, key))
    return int(hashlib.md5(text.encode("utf-8"), usedforsecurity=False).hexdigest()[:8], 16) % deal


class PartOfTarget(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TargetReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.columns = schema.names
        self.key, self.deal = json.loads(options["key"]), int(options["deal"])
        self.parts = json.loads(options["parts"])
        self.tests: list[tuple[str, str, object]] = []
        self.numbers: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        allowed: dict[str, list] = {}
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in self.columns and type(f) in _TESTS and not isinstance(f.value, decimal.Decimal):
                self.tests.append((type(f).__name__, column, f.value))
            if column in self.key and isinstance(f, EqualTo | In):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                allowed[column] = [v for v in allowed.get(column, values) if v in values]
            yield f      # Spark looks again
        if self.key and self.deal and all(c in allowed for c in self.key):
            size = 1
            for c in self.key:
                size *= len(allowed[c])
            if size <= _KEYS:
                try:
                    self.numbers = {part_of(k, self.deal) for k in itertools.product(*(allowed[c] for c in self.key))}
                except TypeError:      # a key of another type: read every part
                    self.numbers = None

    def partitions(self) -> list[InputPartition]:
        chosen = [PartOfTarget(path) for number, path in self.parts
                  if self.numbers is None or not number.isdigit() or int(number) in self.numbers]
        return chosen or [PartOfTarget("")]

    def read(self, partition: PartOfTarget) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        by_name = {t.__name__: test for t, test in _TESTS.items()}
        where = None
        for kind, column, value in self.tests:
            test = by_name[kind](pads.field(column), pa.scalar(value))
            where = test if where is None else where & test
        data = pads.dataset(partition.path, format="parquet")
        for batch in data.scanner(columns=self.columns, filter=where, batch_size=10_000).to_batches():
            if batch.num_rows:
                yield batch


class TargetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema) -> TargetReader:
        return TargetReader(schema, self.options)


def read_target_source(spark: SparkSession, root: str, entity: Entity, version: int | None = None) -> DataFrame:
    """The newest (or, if named, exactly this) committed version of ``entity`` through the data source.

    The store must be one that pyarrow opens on the executors; :func:`tessera.operators.publish.read_target`
    reads through Spark's own Parquet scan instead."""
    share_package(spark)
    commit = last_commit(spark, root)
    if version is not None and commit.version != version:
        raise PublishError(f"version {version} is not the newest ({commit.version})")
    table = commit.tables.get(entity.name)
    where = qualified(spark, root).rstrip("/")
    parts = [[k, f"{where}/{p.path}"] for k, p in sorted(table.parts.items())] if table else []
    spark.dataSource.register(TargetSource)
    spark.conf.set(PUSHDOWN, "true")
    return (spark.read.format(NAME).schema(entity.publish_schema)
            .option("key", json.dumps(list(entity.primary_key))).option("deal", str(table.deal if table else 0))
            .option("parts", json.dumps(parts)).load())

"""Publishing clean entities into a target: upsert, cascade, narrowing checks
and an all-or-nothing commit.

The target is a folder of parquet tables written by Spark.  A table is dealt into
parts by a hash of its key; a publish merges only the parts that its rows meet, writes
them under a fresh version folder and only then writes one commit record, which names
the files of every part of every table.  Parts and tables that a run does not touch are
carried by reference, and readers take the newest record, so a failure anywhere
leaves the previous version in force (no partial publish).

Runs may overlap.  A record is numbered one above the record that the run was
computed from and is created only if no other run has created it; the loser looks at what
changed meanwhile, computes those parts (and the children of changed parents) again and
tries the next number.  The result is that of the runs one after another, in
the order of their records.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import PUBLISH_TYPES, STRING_LIMIT, UNLIMITED_TEXT_LABELS, DataModel, Entity
from tessera.operators import keys as K
from tessera.operators.common import STORED_CODEC, broadcast_checked
from tessera.session import create_once, delete_path, file_names, intermediate_tables, path_exists, read_small_file, write_read

PART_ROWS = 2_000_000      # rows of a part that a new table is dealt for
OUTGROWN = 4               # a table is dealt anew when its parts hold this many times more
ATTEMPTS = 50              # records that other runs may create first


class PublishError(RuntimeError):
    """A publish was refused; the target keeps its last committed version."""


def upsert(target: DataFrame, source: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Matched key: every non-key column from ``source`` (NULLs included);
    new key: inserted; target-only key: kept.  Columns are matched by name.

    ``source`` must be unique on ``pk`` (check :func:`keys.pk_duplicates`).
    One anti join on the key, then a union: no row is rewritten twice.
    """
    kept = target.join(source.select(*pk), list(pk), "left_anti")
    return source.select(*target.columns).unionByName(kept)


def cascade_delete(child: DataFrame, deleted_parent_keys: DataFrame, fk_cols: Sequence[str],
                   parent_cols: Sequence[str]) -> DataFrame:
    """Child rows left after deleting parents (``ON DELETE CASCADE``)."""
    gone = deleted_parent_keys.select([F.col(p).alias(c) for p, c in zip(parent_cols, fk_cols)]).distinct()
    # the deleted key set is broadcast when proven small, so a child key that
    # holds a large share of rows is never shuffled into one task
    return child.join(broadcast_checked(gone), list(fk_cols), "left_anti")


def cascade_all(model: DataModel, tables: Mapping[str, DataFrame], entity: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables left after deleting the keys ``deleted`` of ``entity``: its
    children lose their rows, those rows' children theirs, and so on."""
    out, queue = dict(tables), [(entity, deleted)]
    while queue:
        name, gone = queue.pop(0)
        for child, fk in model.children_of(name):
            if child.name not in out:
                continue
            keys = gone.select([F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns)]).distinct()
            lost = out[child.name].join(broadcast_checked(keys), list(fk.columns), "left_semi")
            out[child.name] = cascade_delete(out[child.name], gone, fk.columns, fk.parent_columns)
            queue.append((child.name, lost))
    return out


def range_violations(df: DataFrame, entity: Entity, key_nulls: bool = False) -> DataFrame:
    """Per variable, rows that do not fit the target type: integers outside
    32 bits, strings over the length limit; with ``key_nulls`` also rows with
    a NULL key column (variable ``<primary key>``).  One fused aggregate."""
    checks = []
    if key_nulls and entity.primary_key:
        any_null = F.lit(False)
        for c in entity.primary_key:
            any_null = any_null | F.col(c).isNull()
        checks.append(("<primary key>", F.count_if(any_null).alias("<primary key>")))
    for v in entity.variables:
        c = F.col(v.label)
        if v.fmt == "integer":
            bad = c.isNotNull() & c.try_cast("int").isNull()
        elif v.fmt == "string" and v.label not in UNLIMITED_TEXT_LABELS:
            bad = F.length(c) > STRING_LIMIT
        else:
            continue
        checks.append((v.label, F.count_if(bad).alias(v.label)))
    if not checks:
        return df.sparkSession.createDataFrame([], "entity string, variable string, n_out_of_range long")
    counts = df.agg(*[a for _, a in checks])
    rows = F.array(*[F.struct(F.lit(entity.name).alias("entity"), F.lit(lbl).alias("variable"),
                              F.col(f"`{lbl}`").alias("n_out_of_range")) for lbl, _ in checks])
    return counts.select(F.inline(rows))


def narrow(df: DataFrame, entity: Entity) -> DataFrame:
    """Cast staged columns to the target types (after :func:`range_violations`)."""
    return df.select([F.col(v.label).cast(PUBLISH_TYPES[v.fmt]).alias(v.label) for v in entity.variables])


# ----------------------------------------------------------- versioning
@dataclass(frozen=True)
class Part:
    path: str      # below the target's folder
    rows: int


@dataclass
class Table:
    """The committed files of one entity: parts by their number among ``deal``; without a key, appended pieces."""
    deal: int = 0
    parts: dict[str, Part] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts.values())

    def paths(self, root: str, numbers=None) -> list[str]:
        return [f"{root}/{p.path}" for k, p in sorted(self.parts.items()) if numbers is None or k in numbers]


@dataclass
class Commit:
    version: int
    run_id: str
    tables: dict[str, Table]


def _record(spark: SparkSession, root: str, name: str) -> Commit:
    try:
        r = json.loads(read_small_file(spark, f"{root}/_commits/{name}"))
        tables = {e: Table(t["deal"], {k: Part(*p) for k, p in t["parts"].items()}) for e, t in r["tables"].items()}
        return Commit(int(r["version"]), r["run_id"], tables)
    except (ValueError, KeyError, TypeError) as e:
        raise PublishError(f"commit record {name} cannot be read") from e


def last_commit(spark: SparkSession, root: str) -> Commit:
    """The newest commit; version 0 without tables when nothing was ever committed.
    A record that cannot be read is an error, never an empty target."""
    names = [n for n in file_names(spark, f"{root}/_commits") if n.endswith(".json") and not n.startswith(".")]
    return _record(spark, root, names[-1]) if names else Commit(0, "", {})


def _commit(spark: SparkSession, root: str, commit: Commit) -> bool:
    """Write the record of ``commit.version`` unless another run has."""
    record = {"version": commit.version, "run_id": commit.run_id, "at": dt.datetime.now(dt.timezone.utc).isoformat(),
              "tables": {e: {"deal": t.deal, "parts": {k: [p.path, p.rows] for k, p in sorted(t.parts.items())}}
                         for e, t in sorted(commit.tables.items())}}
    return create_once(spark, f"{root}/_commits/{commit.version:020d}.json", json.dumps(record))


def current_version(spark: SparkSession, root: str) -> str | None:
    return last_commit(spark, root).run_id or None


def _read(spark: SparkSession, root: str, entity: Entity, table: Table | None, numbers=None) -> DataFrame:
    paths = table.paths(root, numbers) if table else []
    if not paths:
        return spark.createDataFrame([], entity.publish_schema)
    return spark.read.schema(entity.publish_schema).parquet(*paths)


def read_target(spark: SparkSession, root: str, entity: Entity) -> DataFrame:
    """The committed table of ``entity``; empty with the publish schema if
    the target has no committed version or no such table yet."""
    return _read(spark, root, entity, last_commit(spark, root).tables.get(entity.name))


def part_number(pk: Sequence[str], deal: int) -> Column:
    """The part of a key: the first 32 bits of the MD5 of its text, modulo the number of parts."""
    text = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in pk])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(deal)).cast("int")


def parts_for(rows: int) -> int:
    """Parts of a new table of that many rows, a power of two."""
    return 1 << max(0, (max(rows, 1) - 1) // PART_ROWS).bit_length()


def _quarantine_name(entity: Entity, fk) -> str:
    """One folder per foreign key; an entity with one key has the plain name."""
    name = f"errors_fk_{entity.name}"
    return name if len(entity.foreign_keys) == 1 else f"{name}_{'_'.join(fk.columns)}"


@dataclass
class _Done:
    """What a run has computed for an entity, and from what."""
    parents: dict        # the tables its orphans were checked against
    source: DataFrame    # valid rows, narrowed, stored with their part
    counts: dict
    deal: int = 0
    base: dict = field(default_factory=dict)      # part -> what it was merged with
    made: dict = field(default_factory=dict)      # part -> what came out
    met: set = field(default_factory=set)         # parts that the source has rows for


class _Run:
    def __init__(self, spark, model, staged, root, quarantine_dir, append, parts):
        self.spark, self.model, self.root, self.quarantine_dir, self.parts = spark, model, root, quarantine_dir, parts
        self.run_id = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d%H%M%S%f") + "-" + uuid.uuid4().hex[:8]
        self.done: dict[str, _Done] = {}
        self.written = 0
        self.entities = [e for e in model.load_order() if e.name in staged]
        self.given, self.append, self.staged = staged, append, {}

    def take(self) -> None:
        """Store the staged rows and refuse what cannot be upserted."""
        for ent in self.entities:
            if not ent.primary_key and ent.name not in self.append:
                raise PublishError(f"{ent.name}: no primary key to upsert by")
            # stored once: the checks below and the merge read it, not the chain behind it
            rows = write_read(self.given[ent.name].select(*ent.labels), "staged", STORED_CODEC)
            if ent.primary_key and K.pk_duplicates(rows, list(ent.primary_key)).limit(1).count():
                raise PublishError(f"{ent.name}: duplicate primary key")
            self.staged[ent.name] = rows

    def check(self, ent: Entity, parents: dict) -> _Done:
        """Put orphans aside, count, refuse what does not fit; the valid rows stored, narrowed."""
        src = self.staged[ent.name]
        counts = {"staged": src.count(), "orphans": 0, "null_keys": 0}
        for fk in ent.foreign_keys:
            parent = self.model.entity(fk.parent)
            orph, valid = K.split_orphans(src, _read(self.spark, self.root, parent, parents.get(fk.parent)), fk)
            n = orph.count()
            counts["orphans"] += n
            if self.quarantine_dir:
                path = f"{self.quarantine_dir}/{_quarantine_name(ent, fk)}"
                if n:
                    orph.write.mode("overwrite").option("header", True).csv(path)
                else:
                    delete_path(self.spark, path)    # what an earlier run put aside
            unnamed = K.null_keys(src, fk)
            counts["null_keys"] += unnamed.count()
            src = valid.unionByName(unnamed)
        # the valid rows only: an orphan with a bad value does not refuse the run
        bad = range_violations(src, ent, key_nulls=True).where(F.col("n_out_of_range") > 0).collect()
        if bad:
            raise PublishError(f"{ent.name}: NULL key or values out of target range in " + ", ".join(r["variable"] for r in bad))
        counts["published"] = counts["staged"] - counts["orphans"]
        return _Done(parents, write_read(narrow(src, ent), "valid", STORED_CODEC), counts)

    def write(self, rows: DataFrame, ent: Entity, by_part: bool) -> dict[str, Part]:
        """Rows as files of this run, one folder a part; (part, rows) of what was written."""
        self.written += 1
        path = f"v={self.run_id}/{ent.name}-{self.written}"
        if not by_part:
            rows.write.mode("error").parquet(f"{self.root}/{path}")
            n = self.spark.read.parquet(f"{self.root}/{path}").count()
            return {f"{self.run_id}-{self.written}": Part(path, n)}
        rows.repartition("_part").write.mode("error").partitionBy("_part").parquet(f"{self.root}/{path}")
        counts = self.spark.read.parquet(f"{self.root}/{path}").groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()
        return {str(r["_part"]): Part(f"{path}/_part={r['_part']}", r["n"]) for r in counts}

    def merge(self, ent: Entity, base: Table | None) -> Table:
        """``base`` with the valid rows of this run; parts merged in an earlier attempt stand if their base does."""
        done, pk = self.done[ent.name], list(ent.primary_key)
        if not pk:
            done.made = done.made or self.write(done.source, ent, False)
            return Table(0, {**(base.parts if base else {}), **done.made})
        old = base or Table()
        deal, have, coming = old.deal, old.rows, done.counts["published"]
        if not deal or have + coming > OUTGROWN * PART_ROWS * deal:
            deal = max(deal, self.parts or parts_for(have + coming))      # dealt (anew): every part is written
        anew = bool(old.parts) and deal != old.deal
        source = done.source.withColumn("_part", part_number(pk, deal))
        if deal != done.deal:
            done.deal, done.base, done.made = deal, {}, {}
            done.met = {str(r["_part"]) for r in source.select("_part").distinct().collect()}     # one row a part
        if anew:
            merged = upsert(_read(self.spark, self.root, ent, old), done.source, pk)
            made = self.write(merged.withColumn("_part", part_number(pk, deal)), ent, True)
            done.deal = 0
            return Table(deal, made)
        again = {k for k in done.met if k not in done.made or done.base.get(k) != old.parts.get(k)}
        if again:
            target = _read(self.spark, self.root, ent, old, again)
            fresh = source if again == done.met else source.where(F.col("_part").isin([int(k) for k in again]))
            merged = upsert(target, fresh.drop("_part"), pk).withColumn("_part", part_number(pk, deal))
            done.made.update(self.write(merged, ent, True))
            done.base.update({k: old.parts.get(k) for k in again})
        return Table(deal, {**old.parts, **{k: done.made[k] for k in done.met}})

    def tables(self, base: Commit, fail_after: str | None) -> dict[str, Table]:
        """The tables of ``base`` with every staged entity merged, parents first."""
        tables = dict(base.tables)
        for ent in self.entities:
            parents = {fk.parent: tables.get(fk.parent) for fk in ent.foreign_keys}
            if ent.name not in self.done or self.done[ent.name].parents != parents:
                self.done[ent.name] = self.check(ent, parents)
            tables[ent.name] = self.merge(ent, base.tables.get(ent.name))
            if fail_after == ent.name:
                raise PublishError(f"injected failure after {ent.name}")
        return tables


def publish(spark: SparkSession, model: DataModel, staged: Mapping[str, DataFrame], root: str,
            quarantine_dir: str | None = None, fail_after: str | None = None, append: Sequence[str] = (),
            parts: int | None = None, before_commit: Callable[[int], None] | None = None) -> dict:
    """Upsert every staged entity into the target, parents first, as one unit.

    Per entity: refuse duplicate or NULL primary keys; put orphans aside, one
    CSV folder with header per foreign key (when ``quarantine_dir`` is given);
    refuse valid rows that do not fit the target types; upsert the rest.  Rows
    whose foreign key is NULL name no parent: they are published and
    counted.  Parents are merged first, so new parents count in the orphan
    check of children.  An entity without a primary key cannot be upserted; it is
    refused unless named in ``append``.  ``parts`` fixes the number of parts of new
    tables (else :func:`parts_for` their rows).  ``fail_after`` injects a failure and
    ``before_commit`` is called before each attempt to commit (tests).  A run that fails
    removes what it wrote.  Returns ``{entity: {"rows", "staged", "published",
    "orphans", "null_keys", "rewritten"}}``; staged = published + orphans, and
    ``rewritten`` counts the parts that the run wrote.
    """
    run, committed = _Run(spark, model, staged, root, quarantine_dir, append, parts), False
    try:
        with intermediate_tables(spark):
            run.take()
            for attempt in range(ATTEMPTS):
                base = last_commit(spark, root)
                tables = run.tables(base, fail_after)
                if before_commit:
                    before_commit(attempt)
                if _commit(spark, root, Commit(base.version + 1, run.run_id, tables)):
                    committed = True
                    mine = f"v={run.run_id}/"
                    return {e.name: {"rows": tables[e.name].rows, **run.done[e.name].counts,
                                     "rewritten": sum(p.path.startswith(mine) for p in tables[e.name].parts.values())}
                            for e in run.entities}
        raise PublishError(f"other runs committed first {ATTEMPTS} times")
    finally:
        if not committed:
            delete_path(spark, f"{root}/v={run.run_id}")


def create_entity_table(spark: SparkSession, entity: Entity, path: str, staging: bool = True) -> str:
    """Create the (empty, typed) table of ``entity`` at ``path`` if absent.

    Keys are not enforced by the storage; they are checked (C3) before any
    publish instead."""
    schema = entity.schema if staging else entity.publish_schema
    if not path_exists(spark, path):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return path


def read_jdbc_target(spark: SparkSession, url: str, entity: Entity, properties: dict | None = None,
                     partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A relational target behind the same interface as :func:`read_target`
    (untested here: no JDBC driver is installed).  ``partition`` is (column,
    lower bound, upper bound, tasks); without it one task reads the table."""
    split = {}
    if partition:
        column, low, high, tasks = partition
        split = {"column": column, "lowerBound": low, "upperBound": high, "numPartitions": tasks}
    return spark.read.jdbc(url, entity.name, properties=properties or {}, **split).select(*entity.labels)

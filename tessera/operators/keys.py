"""Primary and foreign key checks.

Orphan detection works on keys first: the child's distinct keys (a partial
aggregate on a pruned key column) are anti-joined to the parent's keys, and
only the resulting orphan key set goes back to the full child rows, broadcast
when its size is proven small.  The wide child rows are never shuffled to
find out which of them are orphans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import ForeignKey
from tessera.operators.common import STORED_CODEC, broadcast_checked, store_side
from tessera.session import write_read


def _all_not_null(cols: Sequence[str]):
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def _any_null(cols: Sequence[str]):
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return cond


def pk_duplicates(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Key values held by more than one row: ``(*pk, n)``.  A hot key is
    collapsed by the map-side partial count before the shuffle."""
    return (df.where(_all_not_null(pk)).groupBy(*pk).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def pk_nulls(df: DataFrame, pk: Sequence[str], line_col: str | None = "line_number") -> DataFrame:
    """Rows with a NULL in any key column."""
    cols = ([line_col] if line_col else []) + list(pk)
    return df.where(_any_null(pk)).select(*cols)


def orphan_keys(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Distinct non-NULL child keys with no parent row (null-aware NOT IN on a
    never-NULL parent key equals this anti join)."""
    keys = child.where(_all_not_null(fk.columns)).select(*fk.columns).distinct()
    pkeys = parent.select([F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns)])
    return keys.join(pkeys, list(fk.columns), "left_anti")


def split_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> tuple[DataFrame, DataFrame]:
    """``(orphans, valid)`` rows of ``child``.

    Rows whose key is NULL are in neither: they are not orphans (``NOT IN``
    ignores them) and not valid (``IN`` drops them); :func:`null_keys` has them.
    The orphan keys are found once and stored; both results read them.  When they are too
    many for a broadcast, the rows are marked once and stored, so that the child is shuffled
    once however often the results are read.
    """
    bad, small = store_side(orphan_keys(child, parent, fk))
    keyed = child.where(_all_not_null(fk.columns))
    cols = child.columns
    if small:
        bad = F.broadcast(bad)
        return (keyed.join(bad, list(fk.columns), "left_semi").select(*cols),
                keyed.join(bad, list(fk.columns), "left_anti").select(*cols))
    marked = write_read(keyed.join(bad.withColumn("_orphan", F.lit(True)), list(fk.columns), "left"), "marked", STORED_CODEC)
    return (marked.where("_orphan IS NOT NULL").select(*cols), marked.where("_orphan IS NULL").select(*cols))


def null_keys(child: DataFrame, fk: ForeignKey) -> DataFrame:
    """Rows that name no parent because a key column is NULL."""
    return child.where(_any_null(fk.columns))


def orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    bad = broadcast_checked(orphan_keys(child, parent, fk))
    return child.where(_all_not_null(fk.columns)).join(bad, list(fk.columns), "left_semi")


def valid_rows(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    bad = broadcast_checked(orphan_keys(child, parent, fk))
    return child.where(_all_not_null(fk.columns)).join(bad, list(fk.columns), "left_anti")

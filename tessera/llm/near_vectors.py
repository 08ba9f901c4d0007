"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are turned into a basis ordered by variance (PCA of a bounded sample; the
basis changes the speed, never the result).  Two unit vectors with cosine t or
more lie within d = sqrt(2 - 2t) of each other, so their leading coordinates do
too.  Vectors of a label are dealt into cells of width d over up to three
leading coordinates (as many as its count calls for), cells into tiles of about ``TILE``
vectors, and only tiles of neighbouring cells whose bounding boxes come within d are
compared.  Inside a pair of tiles the leading dimensions are multiplied first; a pair
goes on only while its partial product plus the product of its suffix norms
can still reach the threshold.  What comes within 1e-9 of the threshold is decided by the
cosine of the original vectors in double precision.

Equal vectors are one class with a count.  A pair of tiles returns a count and
one component per vector, never its pairs, so a group of n near copies costs O(n)
rows.

Defined results: a vector that is null, zero, or holds a null or non-finite
component, or whose label is null, links with nothing; vectors of different
lengths never link; every row is a vector, so repeated rows link with each
other; a row without vec_id has no links and no component; rows that share a
vec_id share a component; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, local_components, rows_per_batch, write_read

THRESHOLD = 0.98
TILE = 1024
SAMPLE = 20_000        # vectors the basis is fitted on, about
_LEAD = 8              # dimensions of the first product and of the boxes
_SECOND = 24
_GRID = 3
_SPREAD = 5            # cells that a coordinate is taken to spread over
_SLACK = 1e-9
_ROWS_PER_BATCH = 16   # pairs of tiles sent to Python at a time


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid():
    """Whether a row can link: an id, a label and a finite vector that is not zero."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists(x, lambda v: v != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite & nonzero, F.lit(False))


def fit_basis(classes: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each vector length, columns by falling variance."""
    n = classes.count()
    part = classes.select("embedding")
    if n > sample:
        part = part.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, g in pdf["embedding"].groupby(pdf["embedding"].map(len)):
                u = unit(np.array(g.tolist(), np.float64))
                total[dim] = total.get(dim, 0) + u.T @ u
        yield pd.DataFrame([(d, m.tobytes()) for d, m in total.items()], columns=["dim", "m"])

    total: dict[int, np.ndarray] = {}
    # a bounded sample on eight tasks: eight small matrices for each length come back
    for r in part.repartition(8).mapInPandas(moments, "dim int, m binary").collect():
        m = np.frombuffer(r["m"]).reshape(r["dim"], r["dim"])
        total[r["dim"]] = total.get(r["dim"], 0) + m
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in total.items()}


def rotated(x: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    u = unit(x)
    return u @ basis[x.shape[1]] if x.shape[1] in basis else u


def _suffix(p: np.ndarray, k: int) -> np.ndarray:
    return np.sqrt((p[:, k:] ** 2).sum(axis=1))


def links(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float, same: bool):
    """(i, j) of linked rows of two tiles; x, y original and p, q rotated unit vectors."""
    dim = p.shape[1]
    lead, second = min(_LEAD, dim), min(_SECOND, dim)
    reach = threshold - _SLACK
    part = p[:, :lead] @ q[:, :lead].T
    alive = part + np.outer(_suffix(p, lead), _suffix(q, lead)) >= reach
    if same:
        alive &= np.arange(len(p))[:, None] < np.arange(len(q))
    i, j = np.nonzero(alive)
    if len(i) * 50 > alive.size:      # many near copies: finish as one product
        value = (part + p[:, lead:] @ q[:, lead:].T)[i, j]
    else:
        value = part[i, j]
        for a, z in ((lead, second), (second, dim)):
            out = np.empty(len(i))
            for s in range(0, len(i), 100_000):
                out[s:s + 100_000] = np.einsum("ij,ij->i", p[i[s:s + 100_000], a:z], q[j[s:s + 100_000], a:z])
            value = value + out
            keep = value + _suffix(p, z)[i] * _suffix(q, z)[j] >= reach
            i, j, value = i[keep], j[keep], value[keep]
    sure = value >= threshold + _SLACK
    doubt = np.flatnonzero(~sure & (value >= reach))
    for s in range(0, len(doubt), 100_000):
        d = doubt[s:s + 100_000]
        a, b = x[i[d]], y[j[d]]
        cosine = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        sure[d] = cosine >= threshold
    return i[sure], j[sure]


_TILES = ("tile string, chunk long, cells array<int>, base string, low array<double>, high array<double>,"
          " reps binary, ids binary, counts binary, x binary, dim int")


def _tiles(classes: DataFrame, basis: dict[int, np.ndarray], width: float, size: int) -> DataFrame:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, g in pdf.groupby(pdf["embedding"].map(len)):
                x = np.array(g["embedding"].tolist(), np.float64)
                p = rotated(x, basis)[:, :_GRID]
                cells = np.floor(p / width).astype(np.int32)
                cells = np.pad(cells, ((0, 0), (0, _GRID - cells.shape[1])))
                yield pd.DataFrame({"base": g["label"].astype(str) + f"|{dim}", "rep": g["rep"], "id": g["id"],
                                    "count": g["count"], "dim": dim, "x": [r.tobytes() for r in x], "cells": list(cells)})

    placed = classes.mapInPandas(place, "base string, rep long, id long, count long, dim int, x binary, cells array<int>")
    # equal first cells are counted once for each label; a label with few vectors is one cell
    n = F.col("_n") / size
    grid = F.least(F.lit(_GRID), F.greatest(F.lit(0), F.floor(F.log(n) / F.log(F.lit(float(_SPREAD)))))).cast("int")
    stored = write_read(placed, "vectors-placed")
    labels = stored.groupBy("base").agg(F.count(F.lit(1)).alias("_n"))
    celled = (stored.join(labels, "base").withColumn("cells", F.slice("cells", F.lit(1), grid))
              .withColumn("tile", F.concat_ws("|", "base", F.concat_ws(",", F.col("cells").cast("array<string>")))))
    counts = celled.groupBy("tile").agg(F.count(F.lit(1)).alias("_m"))
    dealt = (celled.join(counts, "tile")
             .withColumn("chunk", F.pmod(F.xxhash64("id", "rep"), F.ceil(F.col("_m") / size))).drop("_n", "_m"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(b) for b in pdf["x"]])
        lead = rotated(x, basis)[:, :_LEAD]
        return pd.DataFrame([(pdf["tile"].iloc[0], pdf["chunk"].iloc[0], pdf["cells"].iloc[0], pdf["base"].iloc[0],
                              lead.min(0), lead.max(0), pdf["rep"].to_numpy("<i8").tobytes(), pdf["id"].to_numpy("<i8").tobytes(),
                              pdf["count"].to_numpy("<i8").tobytes(), x.tobytes(), x.shape[1])],
                            columns=["tile", "chunk", "cells", "base", "low", "high", "reps", "ids", "counts", "x", "dim"])

    return write_read(dealt.groupBy("tile", "chunk").applyInPandas(pack, _TILES), "vectors-tiles")


def _pairs(tiles: DataFrame, distance: float) -> DataFrame:
    """Pairs of tiles of neighbouring cells whose boxes come within the distance; tables without vectors."""
    meta = tiles.select("tile", "chunk", "cells", "base", "low", "high")
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = meta.withColumn("near", F.array(F.array().cast("array<int>")))
    for k in range(_GRID):    # all cells one step away at most, coordinate by coordinate
        grown = F.flatten(F.transform("near", lambda c: F.transform(step, lambda s: F.array_append(
            c, F.get("cells", F.lit(k)) + s))))
        near = near.withColumn("near", F.when(F.size("cells") > k, grown).otherwise(F.col("near")))
    a = (near.withColumn("cell", F.explode("near"))
         .select(F.concat_ws("|", "base", F.concat_ws(",", F.col("cell").cast("array<string>"))).alias("tile_b"),
                 F.col("tile").alias("tile_a"), F.col("chunk").alias("chunk_a"),
                 F.col("low").alias("la"), F.col("high").alias("ha")))
    b = meta.select(F.col("tile").alias("tile_b"), F.col("chunk").alias("chunk_b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    gap = F.zip_with(F.zip_with("lb", "ha", lambda u, v: u - v), F.zip_with("la", "hb", lambda u, v: u - v),
                     lambda u, v: F.greatest(u, v, F.lit(0.0)))
    square = F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v)
    ordered = (F.col("tile_a") < F.col("tile_b")) | ((F.col("tile_a") == F.col("tile_b")) & (F.col("chunk_a") <= F.col("chunk_b")))
    return (a.join(b, "tile_b").where(ordered & (square <= (distance + _SLACK) ** 2))
            .select("tile_a", "chunk_a", "tile_b", "chunk_b"))


def _compare(tiles: DataFrame, pairs: DataFrame, basis: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(rep, id, links, root): for each vector of a pair of tiles its links there, and the least rep it reaches there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                same = (r.tile_a, r.chunk_a) == (r.tile_b, r.chunk_b)
                x, y = (np.frombuffer(b).reshape(-1, r.dim) for b in (r.xa, r.xb))
                i, j = links(x, y, rotated(x, basis), rotated(y, basis), threshold, same)
                if not len(i):
                    continue
                rep, ids, count = (np.concatenate([np.frombuffer(a, "<i8")] + ([] if same else [np.frombuffer(b, "<i8")]))
                                   for a, b in ((r.ra, r.rb), (r.ia, r.ib), (r.na, r.nb)))
                j = j if same else j + len(x)
                n = np.bincount(i, count[j], len(rep)) + np.bincount(j, count[i], len(rep))
                order = np.argsort(rep, kind="stable")     # so that the least row of a component has the least rep
                place = np.empty(len(rep), np.int64)
                place[order] = np.arange(len(rep))
                root = rep[order][local_components(len(rep), place[i], place[j])[place]]
                at = np.flatnonzero(n)
                yield pd.DataFrame({"rep": rep[at], "id": ids[at], "links": n[at].astype(np.int64), "root": root[at]})

    def side(s):
        return tiles.select(F.col("tile").alias(f"tile_{s}"), F.col("chunk").alias(f"chunk_{s}"), F.col("x").alias(f"x{s}"),
                            F.col("reps").alias(f"r{s}"), F.col("ids").alias(f"i{s}"), F.col("counts").alias(f"n{s}"),
                            *([F.col("dim")] if s == "a" else []))
    work = pairs.join(side("a"), ["tile_a", "chunk_a"]).join(side("b"), ["tile_b", "chunk_b"])
    found = work.mapInPandas(run, "rep long, id long, links long, root long")
    with rows_per_batch(tiles.sparkSession, _ROWS_PER_BATCH):     # a row holds two tiles
        return write_read(found, "vectors-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    valid = rows.where(_valid())
    grouped = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("count"))
    classes = write_read(grouped.withColumn("id", F.xxhash64("label", "embedding")), "vectors-classes")
    basis = fit_basis(classes)
    distance = float(np.sqrt(max(2 - 2 * threshold, 0)))
    tiles = _tiles(classes, basis, distance * (1 + 1e-6) + _SLACK, tile)
    found = _compare(tiles, _pairs(tiles, distance), basis, threshold)

    members = write_read(valid.join(classes, ["label", "embedding"]).select("vec_id", "rep", "id", "count"), "vectors-members")
    # rows of one vec_id that hold different vectors tie their classes together
    several = members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").drop("z")
    same = members.join(several, "vec_id").select("a", F.col("rep").alias("b"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionAll(same))
    counts = found.groupBy("rep", "id").agg(F.sum("links").alias("links"))
    linked = (members.join(counts, ["rep", "id"], "left")
              .join(component.withColumnRenamed("node", "rep"), "rep", "left")
              .select("vec_id", (F.col("count") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    alone = rows.where(~_valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL),
ok AS (SELECT * FROM n WHERE norm > 0 AND isfinite(norm) AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.r AS ra, b.r AS rb, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r
         AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
k AS (SELECT ra, count(*) AS n FROM p GROUP BY ra)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, CAST(c.component_id AS BIGINT) AS component_id,
       v.vec_id = c.component_id AS kept
FROM v LEFT JOIN k ON k.ra = v.r JOIN c ON c.node = v.vec_id
"""

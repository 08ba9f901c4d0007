"""N-gram Jaccard join with prefix filters under several global orders.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches ``percent``.  Equal sets are one class from the start, so copies are
never compared.  For sets x, y that link, at most a quarter (1 - threshold) of
either lies outside the other, so under *any* common token order the prefixes
hold the first common tokens.  Three orders are used, and a candidate must pass
all of them:

1. hash order: every class shows the first (1 - t)|x| + l tokens.  Any partner
   shows l of them too, so a class that shows fewer than l tokens that another
   class shows has no partner.
2. rarity order, over the full sets of the classes left: only tokens that two
   of them hold count.  A class keeps t|x| such tokens at least, or is done;
   sorted by document frequency, rarest first, partners share a token among the
   first |S| - t|x| + 1.
3. a second hash order, checked pair by pair on the full sets' prefixes
   before the intersection is counted.

Candidates are not expanded into all pairs of a token's classes.  Each token
first links its classes to its least class (a star); the verified links give
components.  Where classes that share a token are still apart, they and all
that hang together with them by such tokens form a group; the classes outside the
group's largest component are compared with the whole group in tiles of full
sets.  A pair of tiles returns components, never its pairs.  So no link is lost, and
a large group of near copies costs a linear number of rows.

Token statistics travel as packed arrays: a task sends each token once per
flush of its documents, with a count, so a token of a third of all documents
is one record per flush.  Results between steps are tables in the shared folder.

Defined results: a document without words (or a null text) has an empty set and
is linked with nothing; rows that share a doc_id are one document (they get one
component); a row without doc_id has no component; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, discard, local_components, partitions, rows_per_batch, write_read
from tessera.llm.shingles import mix, set_keys, shingle_sets
from tessera.llm.tokenizing import forget
from tessera.operators.common import broadcast_checked
from tessera.session import scratch_path

WIDTH = 5
PERCENT = 75
_FLUSH_TOKENS = 1_500_000
_FLUSH_CLASSES = 30_000
_SMALL = 24                 # common tokens that small sets must show
_TEXTS_PER_BATCH = 250
_TILE_TOKENS = 200_000      # tokens of a tile of full sets, about
_TILE_SETS = 1024
_TILES_PER_BATCH = 16
_COLUMNS = 4096
_SEVERAL = 65535     # in place of a class number: several classes of the flush show this token

_SHOWN = ("kind string, doc_id long, n long, h1 long, h2 long, flush long, bucket int, classes binary,"
          " tokens binary, owners binary, counts binary")


def spare(n: int, percent: int) -> int:
    """Tokens of a set of n that may lie outside a partner."""
    return n - -(-percent * n // 100)


def margin(n: int, percent: int) -> int:
    """Common tokens that the shown prefix of a set of n certainly holds (l of the module's text).

    Small sets are shown nearly whole: for them a few tokens of a common line
    would else be enough to go on."""
    return max(1, n // 16, min(-(-percent * n // 100), _SMALL))


def least_margin(n: int, percent: int) -> int:
    """The same for the smallest possible partner."""
    return min(margin(n, percent), margin(-(-percent * n // 100), percent))


def _packed(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, 6 bytes each.  Equal upper bits only add candidates."""
    return (tokens >> np.uint64(32)).astype("<u4").tobytes() + (tokens >> np.uint64(16)).astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return (np.frombuffer(data, "<u4", n).astype(np.uint64) << np.uint64(32)
            | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(16))


class _Flush:
    """Classes of one task with the tokens they show, sent off together."""

    def __init__(self, buckets: int):
        self.buckets, self.made, self.part = buckets, 0, TaskContext.get().partitionId()
        self.known: dict[tuple, int] = {}
        self.shown: list[np.ndarray] = []
        self.held = 0

    def add(self, key: tuple, tokens: np.ndarray) -> bool:
        """Whether the flush is full; ``key`` is (h1, h2, n) and new."""
        self.known[key] = len(self.known)
        self.shown.append(tokens)
        self.held += len(tokens)
        return self.held >= _FLUSH_TOKENS or len(self.known) >= _FLUSH_CLASSES

    def rows(self) -> list[tuple]:
        number = (self.part << 24) | self.made
        tokens = np.concatenate(self.shown) & ~np.uint64(0xFFFF)
        owner = np.repeat(np.arange(len(self.shown), dtype=np.uint16), [len(x) for x in self.shown])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.concatenate([first, [len(tokens)]]))
        several = np.repeat(count > 1, count)
        out = [("flush", None, None, None, None, number, None, np.array(list(self.known), "<i8").reshape(-1, 3).tobytes(),
                _packed(tokens[several]), owner[several].tobytes(), None)]
        one, who = tokens[first], np.where(count > 1, _SEVERAL, owner[first]).astype("<u2")
        # buckets are equal ranges of the hash, so a sorted array is cut, not scattered
        limits = (np.arange(1, self.buckets, dtype=object) * 2**64 // self.buckets).astype(np.uint64)
        at = [0, *np.searchsorted(one, limits).tolist(), len(one)]
        for k in range(self.buckets):
            a, z = at[k], at[k + 1]
            if z > a:
                c = count[a:z]
                out.append(("tokens", None, None, None, None, number, k, None, _packed(one[a:z]), who[a:z].tobytes(),
                            c[c > 1].astype("<u4").tobytes()))
        self.known.clear()
        self.shown.clear()
        self.made, self.held = self.made + 1, 0
        return out


def _shown_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _SHOWN.split(",")], dtype=object)
    return out.astype({c: "Int64" for c in ("doc_id", "n", "h1", "h2", "flush")} | {"bucket": "Int32"})


def _show(docs: DataFrame, buckets: int, width: int, percent: int) -> DataFrame:
    """Keys of all documents, classes of each flush, and shown tokens by bucket of the token hash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        flush = _Flush(buckets)
        for pdf in batches:
            rows = []
            for doc, tokens in zip(pdf["doc_id"], shingle_sets(pdf["text"], width)):
                n = len(tokens)
                key = (*set_keys(tokens), n)
                rows.append(("key", None if pd.isna(doc) else int(doc), n, key[0], key[1], None, None, None, None, None, None))
                if n and key not in flush.known and flush.add(key, tokens[:spare(n, percent) + margin(n, percent)]):
                    rows += flush.rows()
            yield _shown_frame(rows)
        if flush.shown:
            yield _shown_frame(flush.rows())

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInPandas(run, _SHOWN)


def _show_sets(sets: DataFrame, buckets: int) -> DataFrame:
    """The same for full sets, all tokens shown."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flush = _Flush(buckets)
        for pdf in batches:
            for h1, h2, n, tokens in zip(pdf["h1"], pdf["h2"], pdf["n"], pdf["tokens"]):
                key = (int(h1), int(h2), int(n))
                if key not in flush.known and flush.add(key, np.asarray(tokens).view(np.uint64)):
                    yield _shown_frame(flush.rows())
        if flush.shown:
            yield _shown_frame(flush.rows())

    return sets.select("h1", "h2", "n", "tokens").mapInPandas(run, _SHOWN)


def _shared(shown: DataFrame) -> DataFrame:
    """Tokens that two classes or more show, with their frequency, sent back to their flush."""
    schema = "flush long, tokens binary, owners binary, counts binary"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = [_unpacked(x) for x in pdf["tokens"]]
        owners = [np.frombuffer(x, "<u2") for x in pdf["owners"]]
        sizes = [len(t) for t in tokens]
        tok, who = np.concatenate(tokens), np.concatenate(owners)
        count = np.ones(len(tok), np.int64)
        count[who == _SEVERAL] = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]])
        _, place = np.unique(tok, return_inverse=True)
        frequency = np.bincount(place, count).astype(np.int64)[place]
        keep = frequency > 1
        ends = np.cumsum(sizes)
        rows = []
        for flush, a, z in zip(pdf["flush"], ends - sizes, ends):
            k = keep[a:z]
            if k.any():
                rows.append((flush, _packed(tok[a:z][k]), who[a:z][k].tobytes(),
                             np.minimum(frequency[a:z][k], 2**32 - 1).astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["flush", "tokens", "owners", "counts"])

    return (shown.where("kind = 'tokens'").select("bucket", "flush", "tokens", "owners", "counts")
            .groupBy("bucket").applyInPandas(run, schema))


def _survivors(shown: DataFrame, shared: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Classes that may have a partner; with ``whole`` sets shown, their rarity-order prefix too."""
    schema = "h1 long, h2 long, n long" + (", tokens array<long>" if whole else "")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        told, back = pdf[pdf["kind"] == "flush"], pdf[pdf["kind"] == "shared"]
        rows = []
        if len(back):
            classes = np.frombuffer(told["classes"].iloc[0], "<i8").reshape(-1, 3)
            many, many_owner = _unpacked(told["tokens"].iloc[0]), np.frombuffer(told["owners"].iloc[0], "<u2")
            tok = np.concatenate([_unpacked(x) for x in back["tokens"]])
            who = np.concatenate([np.frombuffer(x, "<u2") for x in back["owners"]])
            df = np.concatenate([np.frombuffer(x, "<u4") for x in back["counts"]])
            one = who != _SEVERAL
            lead = np.argsort(tok[~one])
            several, several_df = tok[~one][lead], df[~one][lead]
            at = np.searchsorted(several, many)     # every token that several local classes show came back
            tok = np.concatenate([tok[one], many])
            df = np.concatenate([df[one], several_df[at] if len(many) else df[:0]])
            owner = np.concatenate([who[one], many_owner]).astype(np.int64)
            order = np.lexsort((mix(tok, 3), df, owner)) if whole else np.argsort(owner, kind="stable")
            tok, owner = tok[order], owner[order]
            cuts = np.searchsorted(owner, np.arange(len(classes) + 1))
            for i, (h1, h2, n) in enumerate(classes.tolist()):
                s, need = int(cuts[i + 1] - cuts[i]), n - spare(n, percent) if whole else least_margin(n, percent)
                if s >= need:
                    row = (h1, h2, n)
                    rows.append((*row, tok[cuts[i]:cuts[i] + s - need + 1].astype(np.int64)) if whole else row)
        return pd.DataFrame(rows, columns=["h1", "h2", "n"] + ["tokens"] * whole)

    both = (shown.where("kind = 'flush'").select("kind", "flush", "classes", "tokens", "owners", "counts")
            .unionByName(shared.withColumn("kind", F.lit("shared")), allowMissingColumns=True))
    return both.groupBy("flush").applyInPandas(run, schema)


def _filtered(spark, shown: DataFrame, percent: int, whole: bool, name: str) -> tuple[DataFrame, str, DataFrame]:
    """The shown table stored, and its classes that may have a partner; the path is for discarding."""
    path = scratch_path(spark, name)
    with rows_per_batch(spark, _TEXTS_PER_BATCH):
        shown.write.parquet(path)
    stored = spark.read.schema(_SHOWN).parquet(path)
    return stored, path, _survivors(stored, _shared(stored), percent, whole)


def _full_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """``rep, h1, h2, n, tokens`` of the documents in ``reps``, tokens in the third order; stored."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part, rows = pdf.iloc[at:at + 1024], []
                for rep, tokens in zip(part["rep"], shingle_sets(part["text"], width)):
                    if len(tokens):
                        key = set_keys(tokens)
                        tokens = tokens[np.argsort(mix(tokens, 5), kind="stable")]
                        rows.append((rep, *key, len(tokens), tokens.astype(np.int64)))
                yield pd.DataFrame(rows, columns=["rep", "h1", "h2", "n", "tokens"])

    # ids of the classes left: broadcast when proven small, else the texts are shuffled to them
    texts = docs.select(docs["doc_id"].cast("long").alias("rep"), "text").join(
        broadcast_checked(reps.select("rep").distinct()), "rep", "left_semi")
    with rows_per_batch(docs.sparkSession, _TEXTS_PER_BATCH):
        sets = write_read(texts.mapInPandas(run, "rep long, h1 long, h2 long, n long, tokens array<long>"), "jaccard-sets")
    # repeated rows give a class several times; sets are only moved again if there are any
    if sets.groupBy("rep", "h1", "h2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
        sets = write_read(sets.dropDuplicates(["rep", "h1", "h2"]), "jaccard-sets")
    return sets


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that reach the threshold: third-order prefixes first, then the whole sets."""
    x = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def prefix(tokens, n):   # spare(n) + 1 tokens
        return F.slice(tokens, F.lit(1), (F.col(n) - F.ceil(F.col(n) * percent / 100) + 1).cast("int"))

    met = pairs.join(x, "a").join(y, "b").where(F.arrays_overlap(prefix("ta", "na"), prefix("tb", "nb")))
    common = F.size(F.array_intersect("ta", "tb"))
    return (met.withColumn("_c", common)
            .where(100 * F.col("_c") >= percent * (F.col("na") + F.col("nb") - F.col("_c"))).select("a", "b"))


def _tile_links(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the sets of x and y that reach the threshold."""
    nx, ny = np.array([len(t) for t in x]), np.array([len(t) for t in y])
    tx, ty = np.concatenate(x), np.concatenate(y)
    ox, oy = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    both = np.intersect1d(tx, ty)
    kx, ky = np.searchsorted(both, tx), np.searchsorted(both, ty)
    hit = (kx < len(both)) & (both[np.minimum(kx, len(both) - 1)] == tx) if len(both) else np.zeros(len(tx), bool)
    kx, ox = kx[hit], ox[hit]
    hit = (ky < len(both)) & (both[np.minimum(ky, len(both) - 1)] == ty) if len(both) else np.zeros(len(ty), bool)
    ky, oy = ky[hit], oy[hit]
    sx, sy = np.argsort(kx, kind="stable"), np.argsort(ky, kind="stable")
    kx, ox, ky, oy = kx[sx], ox[sx], ky[sy], oy[sy]
    common = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, len(both), _COLUMNS):     # exact: counts stay far below 2^24
        z = min(a + _COLUMNS, len(both))
        left, right = np.zeros((len(x), z - a), np.float32), np.zeros((len(y), z - a), np.float32)
        i, j = slice(*np.searchsorted(kx, [a, z])), slice(*np.searchsorted(ky, [a, z]))
        left[ox[i], kx[i] - a] = 1
        right[oy[j], ky[j] - a] = 1
        common += left @ right.T
    c = common.astype(np.int64)
    return np.nonzero(100 * c >= percent * (nx[:, None] + ny[None, :] - c))


def _tiles(sets: DataFrame) -> DataFrame:
    """Full sets of each (grp, minor, chunk) packed into one row: reps, sizes, tokens."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["grp"].iloc[0], pdf["minor"].iloc[0], pdf["chunk"].iloc[0], pdf["rep"].to_numpy("<i8").tobytes(),
                              pdf["tokens"].map(len).to_numpy("<i8").tobytes(),
                              np.concatenate(pdf["tokens"].tolist()).astype("<i8").tobytes())],
                            columns=["grp", "minor", "chunk", "reps", "sizes", "tokens"])
    return write_read(sets.groupBy("grp", "minor", "chunk").applyInPandas(
        pack, "grp long, minor boolean, chunk long, reps binary, sizes binary, tokens binary"), "jaccard-tiles")


def _apart(rows: DataFrame, named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among classes that share a prefix token and are still in different components.

    ``rows`` are (token, rep), ``named`` (rep, component).  Returned as (a, b):
    each class of a pair of tiles with the least one it reaches there."""
    placed = rows.join(named, "rep", "left").select("token", "rep", F.coalesce("component", "rep").alias("component"))
    still = (placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                         F.min("rep").alias("centre")).where("lo <> hi").select("token", "centre"))
    apart = write_read(placed.join(still, "token").select("centre", "rep", "component").distinct(), "jaccard-apart")
    # classes that hang together by such tokens are one group
    groups = connected_components(apart.select(F.col("centre").alias("a"), F.col("rep").alias("b")), "jaccard-groups")
    members = write_read(apart.select("rep", F.col("component").alias("part")).distinct()
                         .join(groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "rep")
                         .join(sets.select("rep", "n"), "rep"), "jaccard-members")

    def tiles_for(n, rows):
        return F.greatest(F.ceil(n / _TILE_TOKENS), F.ceil(rows / _TILE_SETS), F.lit(1))
    # within a group only its largest component need not be compared with itself
    parts = members.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    top = F.max(F.struct("k", "part", "n"))
    sizes = parts.groupBy("grp").agg(top.alias("top"), F.sum("n").alias("n"), F.sum("k").alias("k")).select(
        "grp", F.col("top.part").alias("largest"), tiles_for(F.col("n"), F.col("k")).alias("m"),
        tiles_for(F.col("n") - F.col("top.n"), F.col("k") - F.col("top.k")).alias("r"))
    # one row per group joins the members from a checked broadcast, so that no group meets in one task
    dealt = members.join(broadcast_checked(sizes), "grp").select(
        "rep", "grp", F.when(F.col("part") != F.col("largest"), F.pmod(F.xxhash64("rep"), "r")).alias("minor"),
        F.pmod(F.xxhash64("rep"), "m").alias("whole"))
    sides = F.array(F.struct(F.lit(True).alias("minor"), F.col("minor").alias("chunk")),
                    F.struct(F.lit(False).alias("minor"), F.col("whole").alias("chunk")))
    tiles = _tiles(dealt.select("rep", "grp", F.explode(sides).alias("_s")).select("rep", "grp", "_s.*")
                   .where("chunk IS NOT NULL").join(sets.select("rep", "tokens"), "rep"))
    minor, whole = tiles.where("minor").drop("minor"), tiles.where("NOT minor").drop("minor")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sets_of(sizes, tokens):
            ends = np.cumsum(np.frombuffer(sizes, "<i8"))
            return np.split(np.frombuffer(tokens, "<i8"), ends[:-1])
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ra, rb = np.frombuffer(r.reps, "<i8"), np.frombuffer(r.reps_b, "<i8")
                i, j = _tile_links(sets_of(r.sizes, r.tokens), sets_of(r.sizes_b, r.tokens_b), percent)
                away = ra[i] != rb[j]
                if away.any():
                    nodes, at = np.unique(np.concatenate([ra[i[away]], rb[j[away]]]), return_inverse=True)
                    k = int(away.sum())
                    yield pd.DataFrame({"a": nodes[local_components(len(nodes), at[:k], at[k:])], "b": nodes})

    other = whole.select("grp", F.col("chunk").alias("chunk_b"), F.col("reps").alias("reps_b"),
                         F.col("sizes").alias("sizes_b"), F.col("tokens").alias("tokens_b"))
    # numbers of tiles meet by group; the tiles follow by their own numbers, so a large group is dealt out
    pairs = minor.select("grp", "chunk").join(other.select("grp", "chunk_b"), "grp")
    work = pairs.join(minor, ["grp", "chunk"]).join(other, ["grp", "chunk_b"])
    with rows_per_batch(rows.sparkSession, _TILES_PER_BATCH):
        return write_read(work.mapInPandas(run, "a long, b long"), "jaccard-tile-links")


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    spark = docs.sparkSession
    docs_count = docs.count()
    buckets = max(partitions(spark), docs_count // 4000)
    shown, path, left = _filtered(spark, _show(docs, buckets, width, percent), percent, False, "jaccard-shown")
    keys = shown.where("kind = 'key'").select("doc_id", "n", "h1", "h2")
    key = ["h1", "h2", "n"]
    classes = write_read(keys.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")), "jaccard-classes")
    # classes with more than a fair share of the rows: a bounded number, broadcast, so that no task meets one of them whole
    rows = docs_count // (4 * partitions(spark)) + 1
    hot = classes.where(F.col("k") > rows).select(*key, F.col("rep").alias("hot"))
    placed = keys.join(broadcast_checked(hot), key, "left")
    members = write_read(
        placed.where("hot IS NULL").drop("hot").join(classes.where(F.col("k") <= rows).drop("k"), key, "left")
        .select("doc_id", "n", "rep")
        .unionAll(placed.where("hot IS NOT NULL").select("doc_id", "n", F.col("hot").alias("rep"))), "jaccard-members")
    reps = write_read(left.distinct().join(classes, key).select("rep"), "jaccard-reps")
    discard(spark, path)

    sets = _full_sets(docs, reps, width)
    _, path, left = _filtered(spark, _show_sets(sets, buckets), percent, True, "jaccard-whole")
    left = write_read(left.join(sets.select("rep", "h1", "h2", "n"), ["h1", "h2", "n"])
                      .dropDuplicates(["rep", "h1", "h2"]), "jaccard-left")
    discard(spark, path)
    sets = write_read(sets.join(left.select("rep", "h1", "h2"), ["rep", "h1", "h2"], "left_semi"), "jaccard-candidates")

    rows = left.select("rep", F.explode("tokens").alias("token"))
    centres = (rows.groupBy("token").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("k"))
               .where("k > 1").select("token", "a"))
    stars = write_read(rows.join(centres, "token").select("a", F.col("rep").alias("b")).where("a <> b").distinct(),
                       "jaccard-stars")
    links = write_read(_linked(stars, sets, percent), "jaccard-links")
    first = connected_components(links, "jaccard-components").select(F.col("node").alias("rep"), "component")
    more = _apart(rows, first, sets, percent)

    # rows of one doc_id that hold different texts tie their classes together
    own = members.where("rep IS NOT NULL").select("doc_id", "rep")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").drop("z")
    same = own.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    found = connected_components(links.unionAll(more).unionAll(same), "jaccard-components")
    named = found.select(F.col("node").alias("rep"), "component")
    # a row without words takes the component of its doc_id's other rows, if there are any
    of_id = own.join(named, "rep").groupBy("doc_id").agg(F.min("component").alias("component"))
    return (members.join(of_id, "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component", "rep", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: its least doc_id; rows without an id stay.

    Rows that share a doc_id are one document; the least of them stays, by its columns
    in their order, nulls last.
    """
    gone = (components(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct())
    # ids only: broadcast when proven small, so that texts are neither moved nor sorted
    kept = docs.join(broadcast_checked(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if not repeated.limit(1).count():
        return kept      # texts are not moved to look for repeated rows
    first = F.min_by(F.struct(*docs.columns), F.struct(*(F.struct(F.col(c).isNull(), F.col(c)) for c in docs.columns)))
    return (kept.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(first.alias("_row")).select("_row.*")
            .unionAll(kept.where("doc_id IS NULL")))


COMPONENT_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                      WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 3),
                             lambda i: array_to_string(words[i:i + 4], ' '))) END AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM t p JOIN t q ON p.x = q.x AND p.doc_id < q.doc_id
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, CAST(component_id AS BIGINT) AS component_id
FROM s JOIN c ON c.node = s.doc_id
"""

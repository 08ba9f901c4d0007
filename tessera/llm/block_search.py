"""Ranked lexical search with per-term geometric blocking.

Every task holds its documents as index shards of a bounded number of cells
(documents x terms of the items).  Inside a shard the posting list of a term is
clustered by document similarity (seed documents spread over the list, each document
joins the seed whose sketch of random projections is nearest); each cluster is a block
and stores the coordinatewise maximum of its documents' impacts.  Only coordinates of
items that hold the term are stored, since no other coordinate meets such an item.  An
item goes through its terms from the largest possible contribution down; the inner
product of its weights with a block's summary bounds every score in the block, and a
block is skipped only when this bound is below the item's current k-th score.  The
terms that are left when their contributions together stay below that score cannot hold
a result.  All numbers are integers, so bounds and scores are exact.

Scale: two passes over the corpus and no shuffle of documents or postings.  The
first stores each document's length and its counts of the items' terms, from which
the corpus statistics are summed; the second searches it.  A task returns at most k
rows an item, and these are cut to k for each (item, salt) before the last cut.
Items are served in blocks of about ``ITEM_BYTES`` of text, each with its own two passes.

Defined results: an item is an item_id; its terms are those of all its different
texts (equal rows count once); items without a term, null or empty ones, return no
rows; a null document text has no terms; a row without doc_id can be found and
comes after others of its score, its doc_id null; repeated rows are rows of their own;
only scores above 0 are returned; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import write_read
from tessera.llm.words import words

TOP = 20
ITEM_BYTES = 1 << 20      # text of the items that are searched together, about
CELLS = 8_000_000         # of one shard of the index
SHARD_DOCS = 4096
BLOCK = 24                # documents of a block, on average
_SKETCH = 32
_SALTS = 64
_FIRST = 64               # documents scored before the threshold is looked at again
_EXACT = 1 << 53          # whole numbers below it are exact as doubles
_VECTORS = "doc_id long, n long, terms binary, counts binary"
_FOUND = "item int, doc_id long, score long, salt int"


def count_terms(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, words of the whole text, and the terms of the items that it holds with their counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, times = [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                found = words(text)
                n.append(len(found))
                held = Counter(found)
                got = sorted((terms[t], held[t]) for t in held.keys() & terms.keys())
                ids.append(np.array([g[0] for g in got], "<i4").tobytes())
                times.append(np.array([g[1] for g in got], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                                              pa.array(times, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        count, _VECTORS)


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """For each term the documents that hold it; one row a term comes to the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for ids in b.column("terms").to_pylist():
                total[np.frombuffer(ids, "<i4")] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": at.astype(np.int32), "df": total[at]})

    df = np.zeros(size, np.int64)
    for r in vectors.select("terms").mapInArrow(add, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return df


class Items:
    """Items of one block: terms, weights and the columns that a term's summaries keep."""

    def __init__(self, counts: list[Counter], terms: dict[bytes, int], df: np.ndarray, n_docs: int):
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
        self.columns, self.weights, self.holders = [], [], {}
        top = 0
        for q, c in enumerate(counts):
            at = np.array(sorted(terms[t] for t in c), np.int64)
            repeat = {terms[t]: k for t, k in c.items()}
            w = np.array([weight[t] * repeat[t] for t in at], np.int64)
            at, w = at[w > 0], w[w > 0]
            self.columns.append(at)
            self.weights.append(w)
            top = max(top, int(w.sum()) * 1_000_000)
            for t in at.tolist():
                self.holders.setdefault(t, []).append(q)
        self.kind = np.float64 if top < _EXACT else np.int64
        self.weights = [w.astype(self.kind) for w in self.weights]


class Best:
    """The k best documents of an item so far: higher scores first, then smaller ids, rows without id last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """A document below it is not among the best; 1 while there is room."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, ids, missing) -> None:
        keep = score >= self.threshold
        if not keep.any():
            return
        score = np.concatenate([self.score, score[keep].astype(np.int64)])
        ids = np.concatenate([self.id, ids[keep]])
        missing = np.concatenate([self.missing, missing[keep]])
        order = np.lexsort((ids, missing, -score))[:self.k]
        self.score, self.id, self.missing = score[order], ids[order], missing[order]


class Shard:
    """Documents of a task as a matrix of impacts, with blocked posting lists made when an item asks for them."""

    def __init__(self, rows: list[tuple], items: Items, size: int, corpus: tuple[int, int], projection: np.ndarray):
        self.items = items
        self.id = np.array([0 if r[0] is None else r[0] for r in rows], np.int64)
        self.missing = np.array([r[0] is None for r in rows])
        n_docs, total = corpus
        length = np.array([100 - 25 + (25 * r[1] * n_docs) // total for r in rows], np.int64)
        self.impact = np.zeros((len(rows), size), np.int32)
        for i, r in enumerate(rows):
            tf = np.frombuffer(r[3], "<i4").astype(np.int64)
            self.impact[i, np.frombuffer(r[2], "<i4")] = (1_000_000_000 * tf) // (1000 * tf + 12 * length[i])
        self.top = self.impact.max(0).astype(items.kind)
        sketch = self.impact.astype(np.float32) @ projection
        self.sketch = sketch / np.maximum(np.sqrt((sketch * sketch).sum(1, keepdims=True)), 1e-12)
        self.lists: dict[int, tuple] = {}
        self.blocks = self.skipped = 0

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents by block, starts of the blocks, the columns kept and the blocks' maxima there."""
        if term not in self.lists:
            docs = np.flatnonzero(self.impact[:, term])
            seeds = docs[::BLOCK]
            near = (self.sketch[docs] @ self.sketch[seeds].T).argmax(1)
            order = np.argsort(near, kind="stable")
            docs = docs[order]
            starts = np.flatnonzero(np.diff(near[order], prepend=-1))
            columns = np.unique(np.concatenate([self.items.columns[q] for q in self.items.holders[term]]))
            summary = np.maximum.reduceat(self.impact[np.ix_(docs, columns)], starts, axis=0)
            self.lists[term] = docs, np.append(starts, len(docs)), columns, summary.astype(self.items.kind)
        return self.lists[term]

    def search(self, q: int, best: Best) -> None:
        columns, weights = self.items.columns[q], self.items.weights[q]
        most = weights * self.top[columns]
        held = most > 0
        columns, weights, most = columns[held], weights[held], most[held]
        order = np.argsort(most, kind="stable")
        reach = np.cumsum(most[order])            # what the terms up to each one can give together
        seen = np.zeros(len(self.id), bool)
        for at in range(len(order) - 1, -1, -1):
            if reach[at] < best.threshold:
                return
            docs, ends, kept, summary = self.blocked(int(columns[order[at]]))
            bound = summary[:, np.searchsorted(kept, columns)] @ weights
            self.blocks += len(bound)
            rank = np.argsort(-bound, kind="stable")
            low, step = 0, _FIRST
            while low < len(rank) and bound[rank[low]] >= best.threshold:
                high, size = low, 0
                while high < len(rank) and bound[rank[high]] >= best.threshold and size < step:
                    size += ends[rank[high] + 1] - ends[rank[high]]
                    high += 1
                these = np.concatenate([docs[ends[b]:ends[b + 1]] for b in rank[low:high]])
                these = these[~seen[these]]
                seen[these] = True
                best.add(self.impact[np.ix_(these, columns)].astype(self.items.kind) @ weights, self.id[these], self.missing[these])
                low, step = high, step * 4
            self.skipped += len(rank) - low


def search_block(docs: DataFrame, items: list[tuple], top: int) -> DataFrame | None:
    """item (its place in the list), doc_id, score and salt of the documents that a task holds best."""
    counts = [Counter(w for text in texts for w in words(text)) for _, texts in items]
    terms = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    if not terms:
        return None
    size = len(terms)
    vectors = write_read(count_terms(docs, terms), "search-vectors")
    corpus = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = document_frequencies(vectors, size)
    queries = Items(counts, terms, df, corpus["docs"])
    shard_docs = max(64, min(SHARD_DOCS, CELLS // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries.columns]
        projection = np.random.default_rng(12).normal(size=(size, _SKETCH)).astype(np.float32)
        rows: list[tuple] = []

        def serve():
            shard = Shard(rows, queries, size, (corpus["docs"], corpus["terms"]), projection)
            for q, b in enumerate(best):
                shard.search(q, b)

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts"))):
                if r[2]:
                    rows.append(r)
                if len(rows) == shard_docs:
                    serve()
                    rows = []
        if rows:
            serve()
        for q, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.score), q, np.int32)), pa.array(b.id, mask=b.missing), pa.array(b.score),
                     pa.array(np.full(len(b.score), hash(b.id[0].item()) % _SALTS, np.int32))],
                    names=["item", "doc_id", "score", "salt"])

    return vectors.mapInArrow(run, _FOUND)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of every item."""
    spark = docs.sparkSession
    item = items.select(F.col("item_id").cast("long").alias("item_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("text"))
    item = write_read(item.where("text IS NOT NULL").distinct(), "search-items")
    volume = item.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-volume // ITEM_BYTES)
    out = None
    for k in range(blocks):
        texts: dict[int | None, list[bytes]] = {}
        for r in item.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect():     # a bounded block of items
            texts.setdefault(r["item_id"], []).append(bytes(r["text"]))
        block = list(texts.items())
        found = search_block(docs, block, top) if block else None
        if found is None:
            continue
        ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "item int, item_id long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salted = found.withColumn("_r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(
            F.col("_r") <= top)
        ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(
            F.col("rank") <= top)
        part = write_read(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "search-ranked")
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


# the upper and lower case letters A-Z that alone are folded
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) AS k FROM i GROUP BY ALL),
len AS (SELECT r, doc_id, count(*) AS n FROM d GROUP BY ALL),
c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM len),
tf AS (SELECT r, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * c.big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, c GROUP BY term, c.big_n),
s AS (SELECT q.item_id, len.r, len.doc_id, CAST(sum(q.k * w.w * ((1000000000 * tf.tf) //
             (1000 * tf.tf + 12 * (100 - 25 + (25 * len.n * c.big_n) // c.big_l)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (r), c GROUP BY q.item_id, len.r, len.doc_id),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20
"""

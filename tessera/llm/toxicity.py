"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples stand against unlabelled text.  With class prior p,
f the linear score and l the logistic loss, the risk is

    p * mean_P l(f)  +  max(0, mean_U l(-f) - p * mean_P l(-f))

and the gradient turns against the second term while it is below zero, so the
model cannot fit the unlabelled toxic rows as negatives.  No label 0 is used
as a negative example; labels give the positives and the prior (the share of
toxic rows among labelled rows that may be learned from).

Features are byte n-grams (4 to 10, word edges included) of the lower-cased
text, hashed to 2^20 bins, each at two levels: present, and dense (at least
``DENSE`` times the number of words).  Document frequencies of all features in
the sample are one Spark aggregate; the ``FEATURES`` ones whose frequency differs
most between positives and unlabelled text are kept.  Equal texts of the sample
count once, so a toxic text that was copied does not become a feature.

Bounds (parameters): at most about ``MAX_POSITIVE`` toxic and
``MAX_UNLABELLED`` unlabelled documents are sampled, by a hash of the id.
Scoring covers every whole text.

Defined results: a null or empty text has no features and gets the base score; a
document labelled toxic in any of its label rows counts once as positive;
without positives every score is 0; repeated rows are scored alike; null ids
are never learned from; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, write_read
from tessera.llm.tokenizing import forget

BIN_BITS = 20
GRAMS = (4, 5, 6, 8, 10)
FEATURES = 1024
DENSE = 0.006
LEAST_SHARE = 0.01   # of the positives hold a feature, three at least
LEAST_Z = 5.0
MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000
_CHUNK = 400_000     # bytes of text hashed at a time; a longer text is a chunk of its own
_SPACE = 32


def _byte_map() -> np.ndarray:
    """Lower case; letters, digits and non-ASCII bytes stay, all else is a word edge."""
    out = np.full(256, _SPACE, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or (c.isascii() and c.isalnum()):
            out[b] = ord(c.lower()) if b < 128 else b
    return out


_MAP = _byte_map()


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number, bin) of every n-gram inside a word, with repeats."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    b = _MAP[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)] if texts else np.empty(0, np.uint8)
    doc = np.repeat(np.arange(len(texts)), sizes)
    edges = np.concatenate([[0], np.cumsum(b == _SPACE)])
    wide, h = b.astype(np.uint64), None
    for n in range(1, max(GRAMS) + 1):
        if len(b) < n:
            return
        h = wide.copy() if h is None else h[:-1] * np.uint64(1_000_003) + wide[n - 1:]
        if n in GRAMS:
            i = np.arange(len(h))
            inside = edges[i + n - 1] - edges[i + 1] == 0   # only the first and last byte may be an edge
            at = np.flatnonzero(inside)
            mixed = (h[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            yield doc[at], (mixed >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _chunks(texts) -> Iterator[tuple[int, list[bytes]]]:
    held, size, start = [], 0, 0
    for i, t in enumerate(texts):
        held.append((t or "").encode("utf-8"))
        size += len(held[-1])
        if size > _CHUNK:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def _word_counts(part: list[bytes]) -> np.ndarray:
    b = _MAP[np.frombuffer(b"".join(t + b" " for t in part), np.uint8)] == _SPACE
    ends = np.cumsum([len(t) + 1 for t in part]) - 1
    starts = np.concatenate([[0], np.cumsum(~b & np.concatenate([[True], b[:-1]]))])
    return np.diff(np.concatenate([[0], starts[ends + 1]]))


def presence(texts, lut: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, text numbers, features) without repeats, by chunk of texts.

    A feature is 2 * bin + level.  With ``lut`` (feature -> number, or -1) only
    known features come, as their numbers.
    """
    known = None if lut is None else (lut[0::2] >= 0) | (lut[1::2] >= 0)
    for start, part in _chunks(texts):
        found = [np.empty(0, np.int64)]
        for doc, bin_ in grams(part):
            key = doc << BIN_BITS | bin_
            found.append(key if known is None else key[known[bin_]])
        key, count = np.unique(np.concatenate(found), return_counts=True)
        dense = count >= DENSE * _word_counts(part)[key >> BIN_BITS]
        both = np.sort(np.concatenate([2 * key, 2 * key[dense] + 1]))
        doc, feature = both >> (BIN_BITS + 1), both & ((2 << BIN_BITS) - 1)
        if lut is not None:
            at = np.flatnonzero(lut[feature] >= 0)
            doc, feature = doc[at], lut[feature[at]]
        yield start, len(part), doc, feature


def lookup(features: np.ndarray) -> np.ndarray:
    lut = np.full(2 << BIN_BITS, -1, np.int16)
    lut[features] = np.arange(len(features))
    return lut


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts, lut: np.ndarray | None = None) -> np.ndarray:
        """``lut``: :func:`lookup` of the features, for callers with many batches."""
        out = np.zeros(len(texts))
        if self.prior <= 0:
            return out
        for start, n, doc, f in presence(texts, lookup(self.features) if lut is None else lut):
            out[start:start + n] = np.bincount(doc, self.weights[f], minlength=n)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -50, 50)))


def nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05,
         decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear weights and bias by the non-negative risk; rows of ``x`` are positive or unlabelled."""
    p, u = x[positive], x[~positive]
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        single = w[:-1].astype(np.float32)      # as the rows are; else every step would copy them
        fp, fu = (p @ single).astype(np.float64) + w[-1], (u @ single).astype(np.float64) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -50, 50))), 1 / (1 + np.exp(-np.clip(fu, -50, 50)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # gradients of l(f) on P, of l(-f) on U and on P
        gp, gu, gn = (sp - 1) * prior / len(p), su / len(u), -sp * prior / len(p)
        if negative < 0:
            gp, gu, gn = 0 * gp, -gu, -gn
        slope = p.T @ (gp + gn).astype(np.float32) + u.T @ gu.astype(np.float32)
        g = np.append(slope.astype(np.float64), (gp + gn).sum() + gu.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _share(rows: int, bound: int, id_col: str) -> Column:
    """Keep about ``bound`` of ``rows`` rows, by a hash of the id."""
    if rows <= bound:
        return F.lit(True)
    key = F.conv(F.substring(F.md5(F.concat(F.lit("nnpu:"), F.col(id_col).cast("string")).cast("binary")), 1, 12), 16, 10)
    return key.cast("long") < int((1 << 48) * bound / rows)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
        features: int = FEATURES) -> Model:
    """Learn from rows whose id is not held out; see the module's bounds."""
    told = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n, n_toxic = told.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    nothing = Model(np.empty(0, np.int64), np.empty(0), 0.0, 0.0)
    if not n_toxic:
        return nothing
    usable = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).where(~held_out())
    n_docs = usable.count()
    # at most about max_positive ids: a bounded broadcast
    chosen = told.where("toxic = 1").where(_share(n_toxic, max_positive, "doc_id")).select("doc_id")
    sample = write_read(
        usable.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")
        .unionAll(usable.where(_share(n_docs, max_unlabelled, "doc_id")).select(F.lit(False).alias("positive"), "text")),
        "nnpu-sample").distinct()
    sample = write_read(sample, "nnpu-texts")
    n_pos, n_all = sample.agg(F.count_if("positive"), F.count(F.lit(1))).first()
    if not n_pos or n_pos == n_all:
        return nothing

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 2 << BIN_BITS), np.int32)
        for pdf in batches:
            kind = pdf["positive"].to_numpy(bool)
            for start, k, doc, f in presence(pdf["text"]):
                mine = kind[start:start + k][doc]
                for side in (0, 1):
                    np.add.at(total[side], f[mine == bool(side)], 1)
        seen = np.flatnonzero(total.any(axis=0))
        for at in np.split(seen, range(100_000, len(seen), 100_000)):
            yield pd.DataFrame({"feature": at, "in_u": total[0][at], "in_p": total[1][at]})

    n_unl = n_all - n_pos
    seen = (sample.mapInPandas(frequencies, "feature long, in_u long, in_p long")
            .groupBy("feature").agg(F.sum("in_u").alias("in_u"), F.sum("in_p").alias("in_p")))
    p1, p0 = (F.col("in_p") + 0.5) / (n_pos + 1), (F.col("in_u") + 0.5) / (n_unl + 1)
    scored = seen.where(F.col("in_p") >= max(3.0, LEAST_SHARE * n_pos)).withColumn("z", (p1 - p0) / F.sqrt(p0 * (1 - p0) * (1 / n_pos + 1 / n_unl)))
    top = scored.where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "feature").limit(features).collect()
    chosen_features = np.array([r["feature"] for r in top], np.int64)
    prior = min(max(n_toxic / n, 1e-4), 1 - 1e-4)
    if not len(chosen_features):
        return Model(chosen_features, np.empty(0), float(np.log(prior / (1 - prior))), prior)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [b""] * len(pdf)
            for start, k, doc, f in presence(pdf["text"], lookup(chosen_features)):
                cuts = np.searchsorted(doc, np.arange(k + 1))
                for i in range(k):
                    found[start + i] = f[cuts[i]:cuts[i + 1]].astype("<i2").tobytes()
            yield pd.DataFrame({"positive": pdf["positive"], "f": found})

    got = sample.mapInPandas(rows, "positive boolean, f binary").collect()   # the bounded sample, features only
    x = np.zeros((len(got), len(chosen_features)), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["f"], "<i2")] = 1
    weights, bias = nnpu(x, np.array([r["positive"] for r in got]), prior)
    return Model(chosen_features, weights, bias, prior)


def score_column(model: Model, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        lut = lookup(model.features)
        for s in parts:
            yield pd.Series(model.scores(list(s), lut))
    return score(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    return (docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the model does not call toxic; all columns stay."""
    model = fit(docs, labels)
    return docs.where(score_column(model) < 0.5)

"""Language identification by a byte convolutional network.

Bytes of a fixed-length window are embedded, filters of widths 2 to 5 slide over
them, each filter keeps its largest response (max pooling) and a softmax gives
the languages.  Trained in numpy with Adam; max pooling sends a gradient to
one place per filter and window, so the backward pass is small.

A text is cut into windows of ``WINDOW`` bytes that cover it whole; the
document's language has the greatest byte-weighted mean log-probability.

Bounds (parameters): training takes windows of about ``PER_LANG`` documents a
language, chosen by a hash of the id, ``WINDOWS`` windows each.

Defined results: null text, or text without a letter, is ``und`` with score 0; texts
shorter than a window are padded with zero bytes; rows without a language are
never learned from; without any labelled row every result is ``und``; other
columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 16          # of each width
PER_LANG = 500
WINDOWS = 4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_REACH = max(WIDTHS)


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray     # 256 x EMBED
    filters: np.ndarray   # _REACH * EMBED x filters, rows beyond a filter's width are zero
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW) bytes -> (n, WINDOW, _REACH * EMBED): each place with the places after it."""
        x = self.embed[np.pad(windows, ((0, 0), (0, _REACH - 1)))]
        return np.concatenate([x[:, j:j + windows.shape[1]] for j in range(_REACH)], axis=2)

    def pooled(self, windows: np.ndarray, where: bool = False):
        x = self.columns(windows)
        r = x.reshape(-1, x.shape[2]) @ self.filters
        r = r.reshape(len(windows), windows.shape[1], -1)
        if not where:
            return np.maximum(r.max(axis=1) + self.shift, 0)
        at = r.argmax(axis=1)
        top = np.take_along_axis(r, at[:, None], 1)[:, 0] + self.shift
        return np.maximum(top, 0), at, x

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(windows), 64):
            z = self.pooled(windows[i:i + 64]) @ self.dense + self.bias
            out.append(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        return np.concatenate(out)


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and the bytes each holds."""
    n = max(1, -(-len(data) // WINDOW))
    flat = np.zeros(n * WINDOW, np.uint8)
    flat[:len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return flat.reshape(n, WINDOW), sizes


def train(windows: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.004,
          seed: int = 5) -> Net:
    rng = np.random.default_rng(seed)
    widths = np.repeat(WIDTHS, FILTERS)
    mask = (np.arange(_REACH * EMBED)[:, None] < widths * EMBED).astype(np.float32)
    net = Net(langs, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
              (rng.normal(0, 1, mask.shape) / np.sqrt(widths * EMBED)).astype(np.float32) * mask,
              np.zeros(len(widths), np.float32), rng.normal(0, 0.1, (len(widths), len(langs))).astype(np.float32),
              np.zeros(len(langs), np.float32))
    names = ("embed", "filters", "shift", "dense", "bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    # languages weigh alike, however many windows each has
    share = np.bincount(y, minlength=len(langs)).astype(float)
    weight = (1 / np.maximum(share, 1))[y]
    weight = weight / weight.mean()
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            at = order[i:i + batch]
            w, t = windows[at].copy(), y[at]
            short = rng.random(len(at)) < 0.3     # short texts are seen too
            for j in np.flatnonzero(short):
                w[j, rng.integers(12, WINDOW):] = 0
            top, place, x = net.pooled(w, where=True)
            z = top @ net.dense + net.bias
            p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
            p[np.arange(len(at)), t] -= 1
            dz = (p * weight[at, None] / len(at)).astype(np.float32)
            dtop = (dz @ net.dense.T) * (top > 0)
            best = np.take_along_axis(x, place[:, :, None], 1)       # n x filters x reach*embed
            dx = dtop[:, :, None] * net.filters.T[None]
            grads = {"dense": top.T @ dz, "bias": dz.sum(0), "shift": dtop.sum(0),
                     "filters": np.einsum("nfk,nf->kf", best, dtop) * mask, "embed": np.zeros_like(net.embed)}
            cell = np.pad(w, ((0, 0), (0, _REACH - 1)))
            for j in range(_REACH):
                np.add.at(grads["embed"], np.take_along_axis(cell, place + j, 1), dx[:, :, j * EMBED:(j + 1) * EMBED])
            step += 1
            for k in names:
                g = grads[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    return net


def fit(docs: DataFrame, per_lang: int = PER_LANG, windows: int = WINDOWS) -> Net | None:
    """Train on about ``per_lang`` documents of each language that are not held out."""
    usable = (docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
              .where(~held_out()))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    key = F.conv(F.substring(F.md5(F.concat(F.lit("lang:"), F.col("doc_id").cast("string")).cast("binary")), 1, 12), 16, 10)
    share = F.lit(0.0)
    for lang in langs:   # a threshold on the hash: no shuffle, and no group meets in one task
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / counts[lang]))).otherwise(share)
    sample = usable.where(key.cast("double") < share * float(1 << 48)).select("doc_id", "lang", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
                if not _LETTER.search(text):
                    continue
                data = text.encode("utf-8")
                rng = np.random.default_rng(int(doc) & 0xFFFFFFFF)
                for at in rng.integers(0, max(1, len(data) - WINDOW + 1), windows if len(data) > WINDOW else 1):
                    rows.append((lang, data[at:at + WINDOW]))
            yield pd.DataFrame(rows, columns=["lang", "window"])

    got = sample.mapInPandas(cut, "lang string, window binary").collect()   # per_lang * windows * WINDOW bytes a language
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["window"])))
    x = np.stack([windows_of(bytes(r["window"]))[0][0] for r in got])
    y = np.array([langs.index(r["lang"]) for r in got])
    return train(x, y, langs)


def predict(net: Net | None, texts) -> tuple[list[str], np.ndarray]:
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if net is None:
        return langs, scores
    held, owners, size = [], [], 0

    def flush():
        flat = np.concatenate([h[0] for h in held])
        lp = net.log_probabilities(flat)
        at = 0
        for i, (w, sizes) in zip(owners, held):
            mean = (lp[at:at + len(w)] * sizes[:, None]).sum(0) / max(sizes.sum(), 1)
            at += len(w)
            k = int(mean.argmax())
            langs[i] = net.langs[k]
            scores[i] = float(np.exp(mean[k] - np.logaddexp.reduce(mean)))

    for i, t in enumerate(texts):
        if t is None or not _LETTER.search(t):
            continue
        held.append(windows_of(t.encode("utf-8")))
        owners.append(i)
        size += len(held[-1][0])
        if size >= 4096:
            flush()
            held, owners, size = [], [], 0
    if held:
        flush()
    return langs, np.clip(scores, 0, 1)


def language_column(net: Net | None, text: str = "text") -> Column:
    """Struct of lang_pred and score."""
    @F.pandas_udf("lang_pred string, score double")
    def lang(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            names, scores = predict(net, list(s))
            yield pd.DataFrame({"lang_pred": names, "score": scores})
    return lang(F.col(text))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    net = fit(docs)
    return (docs.select("doc_id", held_out().alias("held_out"), language_column(net).alias("_l"))
            .select("doc_id", "held_out", "_l.lang_pred", "_l.score"))

"""Personal data by weak supervision over an exact base.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  Other
spans are learned without labels: every white-space token with four digits or
more is a candidate; labelers (patterns, gazetteers, context words) vote on it
or abstain; expectation-maximisation estimates each labeler's reliability from
the counts of all vote patterns of the whole corpus; the resulting
probabilities train a logistic span classifier.  A candidate that the votes and
the classifier both support is added as ``secret`` or ``number`` where no base
span lies.

The base patterns are matched from anchors (the @, the + and the start of a
digit run), which gives the leftmost non-overlapping matches in time linear in
the text, whatever it holds.

Bound (parameter): the classifier is trained on about ``SAMPLE`` different candidates
(a token with what the labelers and features see around it), those with the least hash,
each weighted with its occurrences in the whole corpus.  Ids play no part, and copies
are one candidate, so what comes to the driver stays bounded whatever the rows hold.

Defined results: a null or empty text has no spans; without candidates nothing
is added; repeated rows give equal results; a null id gets its own row; other
columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import write_read

KINDS = ("email", "ip", "card", "phone")
ADDED = ("number", "secret")
SAMPLE = 10_000
_HASHES = 1 << 62
_DIM = 1 << 12

# fixed values: the patterns of the base kinds, possessive where it changes nothing
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            end = at + 1      # no match can hold this sign
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- candidates ----
_DIGIT = re.compile(r"[0-9]")
_FIRST = re.compile(r"[0-9]\S*+")
_EDGE = "\"'`.,;:!?()[]{}<>|*_"
_PURE = re.compile(r"[0-9().+/\-]+")


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens holding four digits or more, trimmed; bare digit groups one space apart are one candidate."""
    out: list[tuple[int, int, bool]] = []
    end = 0
    for m in _FIRST.finditer(text):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = end = m.end()
        eq = max(text.rfind("=", start, stop), text.rfind(":", start, stop - 1))
        if eq >= 0 and stop - eq > 6 and text[start:eq].isascii() and "@" not in text[start:stop]:
            start = eq + 1
        while start < stop and text[start] in _EDGE and text[start] != "(":
            start += 1
        while stop > start and text[stop - 1] in _EDGE:
            stop -= 1
        if stop <= start:
            continue
        pure = _PURE.fullmatch(text, start, stop) is not None
        if pure and out and out[-1][2] and out[-1][1] + 1 == start and text[start - 1] == " ":
            out[-1] = (out[-1][0], stop, True)
        else:
            out.append((start, stop, pure))
    return [(a, b) for a, b, _ in out if b - a >= 4 and sum(c.isdigit() for c in text[a:b]) >= 4]


# ---- labelers: 1 personal, 0 not, -1 abstains ----
# fixed values: gazetteers and cue words
_TOP_DOMAINS = frozenset("com org net edu gov info biz io de fr es uk it eu us ch at nl".split())
_PLAIN_WORDS = frozenset("version versions license licence copyright page pages chapter section vol volume figure fig table"
                         " article isbn issn doi part paragraph line year years public apache gnu since until edition".split())
_CUES = frozenset("tel telephone phone call fax mobile cell email mail contact ssn social card visa mastercard iban account"
                  " passport password passwd pwd token secret key apikey credential login ip telefon correo telefono".split())
_KNOWN = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bap]-|AIza|eyJ)[A-Za-z0-9_\-]{8,}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
                    r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,8}|(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}")
_PLAIN = re.compile(r"(?:1[0-9]{3}|20[0-9]{2})(?:[-–/][0-9]{2,4})?|[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"
                    r"|[0-9]{1,3}(?:[,.][0-9]{3})*(?:[.,][0-9]+)?%?|[0-9]{1,6}|v?[0-9]+(?:\.[0-9]+){1,2}")
_WORD = re.compile(r"[^\W\d_]+")

LABELERS = ("base_pattern", "known_pattern", "plain_pattern", "mixed_string", "digit_count", "domain_gazetteer",
            "plain_gazetteer", "context_cue")


def around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    return (_WORD.findall(text[max(0, a - 40):a].lower())[-3:], _WORD.findall(text[b:b + 25].lower())[:1])


def votes(text: str, a: int, b: int, base: bool) -> str:
    s = text[a:b]
    d = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    before, after = around(text, a, b)
    out = [1 if base else -1,
           1 if _KNOWN.fullmatch(s) else -1,
           0 if _PLAIN.fullmatch(s) else -1,
           1 if len(s) >= 16 and letters >= 2 and s.isalnum() and len(set(s)) >= 8 else -1]
    if letters:
        out.append(-1)
    else:
        digits = _digits(s)
        out.append(0 if d < 7 or d > 19 else int(luhn(digits)) if d >= 16 else 1)
    out.append(1 if "@" in s and s.rsplit(".", 1)[-1].lower() in _TOP_DOMAINS else -1)
    out.append(0 if _PLAIN_WORDS.intersection(before + after) else -1)
    out.append(1 if _CUES.intersection(before) else -1)
    return "".join("-" if v < 0 else str(v) for v in out)


def span_features(text: str, a: int, b: int) -> list[int]:
    """Hashed features of a span: shape, sizes, letters, neighbours."""
    s = text[a:b]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", s[:200]))))
    mixed = re.sub(r"(?:[aA9]){4,}", "m", shape)
    d = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    before, after = around(text, a, b)
    names = ["1", f"m{mixed[:24]}", f"d{min(d, 24)}", f"l{min(len(s), 48) // 2}", f"a{min(letters, 32) // 2}",
             f"u{min(len(set(s)), 20) // 2}", f"k{luhn(_digits(s)) if 16 <= d <= 19 and not letters else '-'}",
             f"b{before[-1] if before and before[-1] in _CUES | _PLAIN_WORDS else '-'}",
             f"n{after[0] if after and after[0] in _PLAIN_WORDS else '-'}",
             f"s{''.join(sorted(set(c for c in s if not c.isalnum())))[:8]}"]
    return [zlib.crc32(x.encode("utf-8", "replace")) % _DIM for x in names]


# ---- reliabilities and the classifier ----
_PSEUDO = 50.0          # candidates of each class assumed before any is seen,
_RIGHT, _WRONG = 0.5, 0.02   # how often a labeler votes there for the right and the wrong class


@dataclass
class Reliability:
    prior: float
    vote: np.ndarray    # labeler x class x vote: how often it is cast

    def odds(self, pattern: str) -> float:
        """Log-odds of the votes alone, both classes alike beforehand; abstentions carry no evidence."""
        return float(sum(np.log(self.vote[j, 1, int(v)] / self.vote[j, 0, int(v)])
                         for j, v in enumerate(pattern) if v != "-"))

    def posterior(self, pattern: str) -> float:
        return float(1 / (1 + np.exp(-(self.odds(pattern) + np.log(self.prior / (1 - self.prior))))))

    def supports(self, pattern: str) -> bool:
        """Some labeler votes for it, and the votes together do."""
        return "1" in pattern and self.odds(pattern) > 0


def estimate(patterns: dict[str, int], rounds: int = 60) -> Reliability:
    """EM over vote-pattern counts: the class prior, and how often each labeler casts each vote in each class."""
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([[-1 if c == "-" else int(c) for c in k] for k in keys]).reshape(len(keys), len(LABELERS))
    ones, zeros = (v == 1).sum(1), (v == 0).sum(1)
    q = np.clip((ones + 0.5) / (ones + zeros + 1.0), 0.05, 0.95)    # majority vote to begin with
    sure = np.array([k[0] == "1" for k in keys], bool)              # base spans are personal data by definition
    q[sure] = 1.0
    rel = Reliability(0.5, np.full((len(LABELERS), 2, 2), 0.5))
    for _ in range(rounds):
        # without candidates of a class seen, the pseudo candidates speak for it
        prior = ((n * q).sum() + _PSEUDO) / (n.sum() + 2 * _PSEUDO)
        table = np.empty((len(LABELERS), 2, 2))
        for c, mass in ((0, n * (1 - q)), (1, n * q)):
            for k in (0, 1):
                assumed = _PSEUDO * (_RIGHT if k == c else _WRONG)
                table[:, c, k] = ((mass[:, None] * (v == k)).sum(0) + assumed) / (mass.sum() + _PSEUDO)
        rel = Reliability(float(prior), table)
        q = np.where(sure, 1.0, [rel.posterior(k) for k in keys])
    return rel


def train(features: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic weights over hashed features (row sums), soft targets, Adam."""
    w, m, v = np.zeros(_DIM), np.zeros(_DIM), np.zeros(_DIM)
    share = weight / weight.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(w[features].sum(1), -30, 30)))
        g = np.bincount(features.ravel(), np.repeat((p - target) * share, features.shape[1]), minlength=_DIM) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Taken:
    """Places that base spans hold; a question costs the logarithm of their number."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(accumulate((b for _, b in ordered), max))

    def meets(self, a: int, b: int) -> bool:
        before = bisect_left(self.starts, b)      # spans that begin before b
        return before > 0 and self.reach[before - 1] > a


class Least:
    """The different candidates of a task with the least hashes, and how often each occurs there."""

    def __init__(self, size: int):
        self.size, self.seen, self.heap, self.full = size, {}, [], False

    def add(self, text: str, a: int, b: int, pattern: str) -> None:
        around_it = f"{pattern}|{a - max(0, a - 40)}|{b - a}|{text[max(0, a - 40):b + 25]}".encode("utf-8", "surrogatepass")
        h = int.from_bytes(hashlib.blake2b(around_it, digest_size=8).digest(), "little") >> 2
        if h in self.seen:
            self.seen[h][0] += 1
        elif len(self.heap) < self.size or h < -self.heap[0]:
            self.seen[h] = [1, pattern, span_features(text, a, b)]
            if len(self.heap) < self.size:
                heapq.heappush(self.heap, -h)
            else:
                self.full = True
                del self.seen[-heapq.heapreplace(self.heap, -h)]
        else:
            self.full = True

    def complete(self) -> int:
        """Every candidate of the task with a hash up to this one is held."""
        return -self.heap[0] if self.full else _HASHES - 1


@dataclass
class Model:
    weights: np.ndarray
    reliability: Reliability

    def accepts(self, text: str, a: int, b: int, base: bool = False) -> bool:
        return (self.reliability.supports(votes(text, a, b, base))
                and self.weights[span_features(text, a, b)].sum() > 0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Labeler reliabilities and classifier; vote patterns are counted over all documents."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        least = Least(sample)
        for pdf in batches:
            for text in pdf["text"]:
                if not text:
                    continue
                taken = Taken(base_spans(text) if _DIGIT.search(text) else [])
                for a, b in candidates(text):
                    pattern = votes(text, a, b, taken.meets(a, b))
                    counts[pattern] += 1
                    least.add(text, a, b, pattern)
        rows = [(k, n, None, None) for k, n in counts.items()] + [(k, n, h, f) for h, (n, k, f) in least.seen.items()]
        rows.append((None, 0, least.complete(), None))
        out = pd.DataFrame(rows, columns=["pattern", "n", "hash", "features"], dtype=object)
        yield out.astype({"n": "int64", "hash": "Int64"})

    seen = write_read(docs.select("text").mapInPandas(scan, "pattern string, n long, hash long, features array<int>"), "pii-votes")
    patterns = {r["pattern"]: r["n"] for r in seen.where("hash IS NULL").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    if not patterns:
        return Model(np.zeros(_DIM), estimate({}))
    # up to the least hash to which some task is complete all candidates are known; their number there
    # gives the hash that about ``sample`` of them stay below
    limit = seen.where("pattern IS NULL").agg(F.min("hash")).first()[0]
    known = (seen.where((F.col("hash") <= limit) & F.col("pattern").isNotNull()).groupBy("hash", "pattern")
             .agg(F.sum("n").alias("n"), F.any_value("features").alias("features")))
    different = known.count()
    if different > sample:
        known = known.where(F.col("hash") <= limit * sample // different)
    rows = known.orderBy("hash", "pattern").collect()
    rel = estimate(patterns)
    belief = {k: 1.0 if k[0] == "1" else rel.posterior(k) for k in patterns}
    return Model(train(np.array([r["features"] for r in rows]), np.array([belief[r["pattern"]] for r in rows]),
                       np.array([r["n"] for r in rows], float)), rel)


def spans_of(text: str | None, model: Model) -> list[tuple[str, int, int]]:
    """Base spans, then added ones, each by kind and start."""
    if not text:
        return []
    base = base_spans(text)
    taken = Taken(base)
    added = []
    for a, b in candidates(text):
        if not taken.meets(a, b) and model.accepts(text, a, b):
            added.append(("secret" if any(c.isalpha() for c in text[a:b]) else "number", a, b))
    order = {k: i for i, k in enumerate(KINDS + ADDED)}
    return base + sorted(added, key=lambda s: (order[s[0]], s[1]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base and all spans of every document."""
    model = fit(docs)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            rows = []
            for text in s:
                found = spans_of(text, model)
                base = [x for x in found if x[0] in KINDS]
                n = Counter(x[0] for x in base)
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", spans(F.col("text")).alias("_s")).select("doc_id", "_s.*")


def redacted(text: str | None, model: Model) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    found = sorted((a, b, k) for k, a, b in spans_of(text, model))
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        a, b, k = found[i]
        i += 1
        while i < len(found) and found[i][0] < b:
            b = max(b, found[i][1])
            i += 1
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact_column(model: Model, text: str = "text") -> Column:
    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([redacted(t, model) for t in s], dtype=object)
    return clean(F.col(text))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all other columns stay."""
    return docs.withColumn("text", redact_column(fit(docs)))

"""License scans by template-markup matching.

A template (``license_templates``) is compiled into a token automaton: one state
before each of its words, regions that may be left out as jumps over their states,
replaceable regions as states that take any word or as branches of phrases.  The
states of a text are the bits of one integer, so a text is read once, one shift and one
mask a word, however many of its words begin a match.  A text is accepted where all
mandatory wording stands in order and word for word; a match ends at the first
word that completes it and begins at the farthest word from which it does.  Matches of
one template do not overlap.  An automaton runs only on texts that hold every
mandatory run of words of its template and a phrase of every mandatory choice.

Base: places where the words of a fixed phrase stand consecutively.  The score is the
share of the text's words that lie inside a match or a base phrase.

Every text is scanned whole by the task that reads it; nothing is shuffled, and a very
long text costs time and memory in proportion to its length.

Defined results: a null or empty text has no words, no places, empty labels and score
0; repeated rows and rows without doc_id each keep their row; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.license_templates import TEMPLATES
from tessera.llm.words import folded, words

# fixed values: phrases and their labels
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

_MARK = re.compile(r"<<(.*?)>>", re.S)
_RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, matches string")


def parse(markup: str) -> list:
    """A template as nodes: a word (bytes), ("any", least, most), ("one", phrases) or ("optional", nodes)."""
    stack: list[list] = [[]]
    for i, piece in enumerate(_MARK.split(markup)):
        if i % 2 == 0:
            stack[-1] += words(piece.encode())
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            nodes = stack.pop()
            stack[-1].append(("optional", nodes))
        else:
            kind, *fields = piece.split(";")
            value = dict(f.split("=", 1) for f in fields)
            if kind != "var" or not {"words", "match"} & value.keys():
                raise ValueError(f"unknown markup {piece!r}")
            if "words" in value:
                least, most = map(int, value["words"].split(","))
                stack[-1].append(("any", least, most))
            else:
                stack[-1].append(("one", [words(p.encode()) for p in value["match"].split("|")]))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def _backwards(nodes: list) -> list:
    out = []
    for node in reversed(nodes):
        if isinstance(node, tuple) and node[0] == "optional":
            node = ("optional", _backwards(node[1]))
        elif isinstance(node, tuple) and node[0] == "one":
            node = ("one", [p[::-1] for p in node[1]])
        out.append(node)
    return out


class Automaton:
    """States as bits: bit i is the state before element i, the last one accepts."""

    def __init__(self, nodes: list):
        self.size = 0
        self.any = 0                          # states that take every word
        self.takes: dict[bytes, int] = {}     # word -> further states that take it
        self.jumps: list[tuple[int, int]] = []    # (states, the state they reach without a word), in order of the states
        self._add(nodes)
        self.jumps.sort(key=lambda j: (j[0] & -j[0], j[1]))
        self.takes = {w: m | self.any for w, m in self.takes.items()}
        self.accept = 1 << self.size
        self.start = self._jump(1)

    def _word(self, word: bytes | None) -> None:
        if word is None:
            self.any |= 1 << self.size
        else:
            self.takes[word] = self.takes.get(word, 0) | 1 << self.size
        self.size += 1

    def _add(self, nodes: list) -> None:
        for node in nodes:
            if isinstance(node, bytes):
                self._word(node)
            elif node[0] == "any":
                for _ in range(node[1]):
                    self._word(None)
                first = self.size
                for _ in range(node[2] - node[1]):
                    self._word(None)
                if self.size > first:
                    self.jumps.append(((1 << self.size) - (1 << first), 1 << self.size))
            elif node[0] == "optional":
                first = self.size
                self._add(node[1])
                self.jumps.append((1 << first, 1 << self.size))
            else:       # a state that takes no word leads to each phrase, and one behind each phrase to the end
                enter, ends = 1 << self.size, 0
                self.size += 1
                for phrase in node[1]:
                    self.jumps.append((enter, 1 << self.size))
                    for w in phrase:
                        self._word(w)
                    ends |= 1 << self.size
                    self.size += 1
                while ends:
                    self.jumps.append((ends & -ends, 1 << self.size))
                    ends &= ends - 1

    def _jump(self, states: int) -> int:
        for source, target in self.jumps:
            if states & source:
                states |= target
        return states

    def step(self, states: int, word: bytes) -> int:
        return self._jump((states & self.takes.get(word, self.any)) << 1)


class Template:
    def __init__(self, label: str, markup: str):
        nodes = parse(markup)
        self.label = label
        self.forward, self.reverse = Automaton(nodes), Automaton(_backwards(nodes))
        runs, run = [], []
        for node in [*nodes, ()]:
            if isinstance(node, bytes):
                run.append(node)
            else:
                runs.append(run)
                run = []
        longest = max(runs, key=lambda r: sum(map(len, r)))
        if not longest:
            raise ValueError("a template needs mandatory words")
        self.rare = max(longest, key=len)
        # what a matching text must hold: every mandatory run and one phrase of every mandatory choice
        held = [[r] for r in runs if r] + [n[1] for n in nodes if isinstance(n, tuple) and n[0] == "one" and all(n[1])]
        self.needs = [[b" " + b" ".join(p) + b" " for p in phrases] for phrases in held]
        self.needs.sort(key=lambda phrases: -min(map(len, phrases)))

    def matches(self, text: list[bytes]) -> list[tuple[int, int]]:
        """Word spans, end exclusive."""
        found, states, past = [], 0, 0
        a, b = self.forward, self.reverse
        for i, w in enumerate(text):
            states = a.step(states | a.start, w)
            if states & a.accept:
                back, first, j = b.start, i, i
                while back and j >= past:
                    back = b.step(back, text[j])
                    if back & b.accept:
                        first = j
                    j -= 1
                found.append((first, i + 1))
                states, past = 0, i + 1
        return found


class Scanner:
    def __init__(self, templates=None, base=None):
        self.templates = [Template(*t) for t in (TEMPLATES if templates is None else templates)]
        self.base = [(words(p.encode()), label) for p, label in (BASE if base is None else base)]

    def scan(self, raw: bytes | None) -> tuple:
        """n_words, base places (start, length, label) in order, matches (start, end, label) in order, score."""
        fold = folded(raw)
        text = fold.split()
        places = []
        for phrase, label in self.base:
            if phrase[-1] in fold:
                at = -1
                for _ in range(text.count(phrase[-1])):
                    at = text.index(phrase[-1], at + 1)
                    first = at - len(phrase) + 1
                    if first >= 0 and text[first:at + 1] == phrase:
                        places.append((first, len(phrase), label))
        found = []
        likely = [t for t in self.templates if t.rare in fold]
        if likely:
            joined = b" " + b" ".join(text) + b" "
            for t in likely:
                if all(any(p in joined for p in phrases) for phrases in t.needs):
                    found += [(s, e, t.label) for s, e in t.matches(text)]
        covered, reach = 0, 0
        for s, e in sorted([(s, s + n) for s, n, _ in places] + [(s, e) for s, e, _ in found]):
            covered += max(0, e - max(s, reach))
            reach = max(reach, e)
        return len(text), sorted(places), sorted(found), covered / len(text) if text else 0.0


def scan(docs: DataFrame, templates=None, base=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches
    (label:start:end in words, by start, comma-joined) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                                                    "score", "matches")}
            for raw in b.column("text").cast(pa.binary()).to_pylist():
                n, places, found, score = scanner.scan(raw)
                named = {p[2] for p in places}
                row = (n, len(places), places[0][0] if places else None, places[-1][0] if places else None,
                       ",".join(sorted(named)), ",".join(sorted(named | {f[2] for f in found})), score,
                       ",".join(f"{label}:{s}:{e}" for s, e, label in found))
                for c, v in zip(out, row):
                    out[c].append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))],
                                             names=["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _RESULT)

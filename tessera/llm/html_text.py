"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score by the context they stand in
(kind of block, inside a link, inside page furniture, inside or outside an
article element), tags score below zero; one linear scan finds the contiguous
region with the greatest sum.  The region is widened to whole blocks and page
furniture inside it is left out.

The scores are log-odds counted over labelled pages: pages that mark their
content with an ``article`` or ``main`` element (about ``MAX_LABELLED``
of them, chosen by a hash of the page).  Pages without such an element are scored
by the contexts alone.

Class and id names are evidence, not proof.  An element that only its names mark is furniture
unless it holds more than ``_MOST`` of the page's words outside links: then it is a wrapper of the
page, whatever it is called, and its text scores like any other.  Names that classify a post
(``category-...``, ``tag-...``) mark nothing.  Reader comments are left out in any element that is
named after them, articles too, and everything inside.  The title of an article (``h1``) belongs
to it also where it stands in the article's own header.

Defined results: null html gives an empty text; a page with no word in a
positive context gives an empty text; character references are decoded as
HTML 5 does (an unknown one stays); a tag or comment that never closes runs to the
page's end; ``br`` is white space inside its block; repeated pages are
treated alike; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 4000
_SMOOTH = 4.0
_TAG_CEILING = -0.3
_LIMIT = 4.0
_FURNITURE_LIMIT = 0.5   # furniture is left out anyway; its score only says how much of it a region may span

# fixed values: names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section"
    " select summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav header footer aside form button select option noscript template svg canvas object dialog"
                      " menu head map audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar"
                  " toolbar".split())
# words of class and id names that mark furniture
MARKS = frozenset("ad ads adv nav navbar menu menus header masthead topbar footer sidebar banner notice notices alert alerts"
                  " popup modal overlay consent gdpr widget widgets social share sharing related toolbar pager login"
                  " signup search discussion teaser trending skip".split())
STEMS = ("advert", "sponsor", "cookie", "breadcrumb", "navig", "sidebar", "newsletter", "subscri", "promo", "recommend",
         "paginat", "disqus", "comment")
# marks that also rule out an article element, where they lead a name
_ASIDE_ARTICLE = ("ad", "ads", "advert", "sponsor", "promo", "related", "teaser", "recommend")
# words of names of reader comments, and first words of names that classify a post
REPLIES = frozenset("reply replies respond response responses".split())
TAXONOMY = frozenset("category cat tag type format status term".split())
_NEGATED = frozenset("has with no is without".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>")
_ATTR = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KINDS = frozenset("p li td div dd pre blockquote".split())
_LIMITS = ("ul", "ol", "dl", "table", "tbody", "select", "article", "div")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th"), "option": ("option",)}


_MOST = 0.5     # of a page's words; an element that holds more is no furniture by its names


def _marked(names: str, article: bool) -> str:
    """'replies' for reader comments, 'furniture' for other marks, '' for none."""
    found = ""
    for name in names.lower().split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if not words or words[0] in _NEGATED or words[0] in TAXONOMY:
            continue
        if any(w in REPLIES or w.startswith("comment") for w in words):
            return "replies"
        if article:
            if any(words[0] == m or (len(m) > 4 and words[0].startswith(m)) for m in _ASIDE_ARTICLE):
                found = "furniture"
        elif any(w in MARKS or w.startswith(STEMS) for w in words):
            found = "furniture"
    return found


def _furniture(name: str, attrs: str) -> str:
    """'' for content, 'named' for furniture by its names alone, 'soft' where an article inside still counts, 'hard' otherwise."""
    if name in FURNITURE:
        return "soft" if name in ("form", "header", "head") else "hard"
    if attrs and ("=" in attrs or "hidden" in attrs):
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id") and name not in ("html", "body"):
                mark = _marked(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value), name in ("article", "main"))
                if mark:
                    return "hard" if mark == "replies" or name in ("article", "main") else "named"
            if key == "role" and value.lower() in ROLES:
                return "soft"
            if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return "hard"
    return ""


class _Open:
    """The open elements, each with the context of the text directly inside it."""

    def __init__(self):
        self.names: list[str] = []
        self.contexts = [("plain", False, "other")]   # one more than names
        self._hard = [False]
        self._header = [False]                         # in an article's own header and no other furniture of it
        self._at: dict[str, list[int]] = {}            # places of each open name
        self._blocks: list[int] = []                   # places of open blocks
        self.words = 0                                 # words outside links so far
        self._named: list[tuple] = []                  # open elements marked by name: place, number, words before
        self.spans: list[tuple] = []                   # closed ones: number, words inside
        self.named = 0

    def push(self, name: str, mark: str) -> None:
        zone, link, kind = self.contexts[-1]
        hard = self._hard[-1] or mark == "hard"
        header = self._header[-1]
        if name in ("article", "main"):
            zone, header = "furniture" if hard else "article", False   # soft furniture around an article does not count
        elif mark:
            header = mark != "hard" and (zone == "article" or header) and (name == "header" or mark == "named")
            zone = "inset" if zone in ("article", "inset") else "furniture"
        elif name == "h1" and header:
            zone = "article"
        if name in BLOCKS:
            kind = "h" if name in _HEADINGS else name if name in _KINDS else "other"
            self._blocks.append(len(self.names))
        self._at.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.contexts.append((zone, link or name == "a", kind))
        self._hard.append(hard)
        self._header.append(header)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.names) > place:
            name = self.names.pop()
            self._at[name].pop()
            if name in BLOCKS:
                self._blocks.pop()
            self.contexts.pop()
            self._hard.pop()
            self._header.pop()
            if self._named and self._named[-1][0] == len(self.names):
                _, element, words = self._named.pop()
                self.spans.append((element, self.words - words))

    def hidden(self) -> bool:
        return self._hard[-1]

    def last(self, name: str) -> int:
        places = self._at.get(name)
        return places[-1] if places else -1

    def block(self) -> int:
        return self._blocks[-1] if self._blocks else -1

    def close(self, name: str) -> None:
        place = self.last(name)
        # an inline end tag does not reach through a block that is still open
        if place >= 0 and (name in BLOCKS or name == "a" or place > self.block()):
            self.cut(place)

    def finish(self) -> list[tuple]:
        self.cut(0)
        return self.spans

    def open(self, name: str, mark: str, wrappers: frozenset) -> None:
        if name == "body":
            self.cut(self.last("html") + 1)
        if name in BLOCKS and self.block() >= 0 and self.names[self.block()] == "p":
            self.cut(self.block())     # a block ends a paragraph
        if name in _SAME:
            same, limit = max(map(self.last, _SAME[name])), max(map(self.last, _LIMITS))
            if same > limit:
                self.cut(same)
        if mark == "named":
            self._named.append((len(self.names), self.named, self.words))
            mark = "" if self.named in wrappers else mark
            self.named += 1
        self.push(name, mark)


def parse(page: str) -> list[tuple]:
    """Page items in order: ("text", raw, context) and ("tag", name, breaks a block, furniture zone it touches or "").

    context: (zone, in link, kind of block); the zone is article, plain, furniture, or
    inset for furniture inside an article.
    """
    stack = _Open()
    items = list(_parse(page, stack, frozenset()))
    wrappers = frozenset(k for k, words in stack.finish() if words > _MOST * stack.words)
    return list(_parse(page, _Open(), wrappers)) if wrappers else items


def _parse(page: str, stack: _Open, wrappers: frozenset) -> Iterator[tuple]:
    at, n = 0, len(page)
    while at < n:
        before = stack.contexts[-1][0]
        lt = page.find("<", at)
        if lt != at:
            lt = n if lt < 0 else lt
            yield "text", page[at:lt], stack.contexts[-1]
            if not stack.contexts[-1][1] and not stack.hidden():
                stack.words += len(page[at:lt].split())
            at = lt
            continue
        m = _TAG.match(page, at)
        if m is None:
            nxt = page[at + 1:at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = n if end < 0 else end + 3
            elif nxt and nxt in "!?/":
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            elif nxt.isascii() and nxt.isalpha():
                at = n          # a tag that never closes
            else:
                yield "text", "<", stack.contexts[-1]
                at += 1
            continue
        name, attrs = m[2].lower(), m[3]
        at = m.end()
        if m[1]:
            stack.close(name)
        elif name in RAW:
            found = _RAW_END[name].search(page, at)
            end = page.find(">", found.end()) if found else -1
            at = n if end < 0 else end + 1
        elif name not in VOID and (not attrs.endswith("/") or name in BLOCKS):
            stack.open(name, _furniture(name, attrs), wrappers)
        yield "tag", ("/" if m[1] else "") + name, name in BLOCKS, next((z for z in ("furniture", "inset") if z in (before, stack.contexts[-1][0])), "")


def features(items: list[tuple], has_article: bool) -> Iterator[tuple[int, str, int]]:
    """(item number, feature, weight count); words of a text count once each."""
    for i, item in enumerate(items):
        if item[0] == "text":
            words = len(item[1].split())
            if words:
                zone, link, kind = item[2]
                if zone in ("article", "plain") and not has_article:
                    zone = "any"
                yield i, f"w|{zone}|{int(link)}|{kind}", words
        else:
            yield i, f"t|{item[3] or item[1]}", 1


def label_counts(page: str) -> Counter | None:
    """Counts (feature, inside content) of a page that marks its content; None for others."""
    items = parse(page)
    if not any(x[0] == "text" and x[2][0] == "article" and x[1].strip() for x in items):
        return None
    out, inside = Counter(), False
    zones = [x[2][0] if x[0] == "text" else None for x in items]
    last = "plain"
    for i, f, k in features(items, True):
        if "inset" in f:
            continue     # left out of the text whatever it scores; it teaches nothing about the article's limits
        if zones[i] is not None:
            last = zones[i]
        elif items[i][1] in ("article", "/article", "main", "/main"):
            last = "plain"
        inside = last == "article"
        out[f, inside] += k
        if f.startswith(("w|article", "w|plain")):
            _, _, link, kind = f.split("|")
            out[f"w|any|{link}|{kind}", inside] += k   # for pages that mark nothing
    return out


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds by feature from (inside, outside) counts; tags stay below zero."""
    out = {}
    for f, (inside, outside) in counts.items():
        w = math.log((inside + _SMOOTH * prior(f)) / (outside + _SMOOTH * (1 - prior(f))))
        limit = _FURNITURE_LIMIT if "furniture" in f else _LIMIT
        out[f] = max(-limit, min(w, _TAG_CEILING if f.startswith("t|") else limit))
    return out


def prior(feature: str) -> float:
    """Share of content assumed before any page is seen."""
    if feature.startswith("t|"):
        return 0.4
    _, zone, link, _ = feature.split("|")
    if zone == "furniture":
        return 0.02
    if zone == "inset":
        return 0.45
    if zone == "plain":
        return 0.1      # the page marks its content, and this is not it
    return 0.5 if link == "1" and zone == "any" else 0.9


def weight_of(feature: str, learned: dict[str, float]) -> float:
    if feature in learned:
        return learned[feature]
    p = prior(feature)
    limit = _FURNITURE_LIMIT if "furniture" in feature else _LIMIT
    return max(-limit, min(math.log(p / (1 - p)), _TAG_CEILING if feature.startswith("t|") else limit))


def best_region(scored: list[tuple[int, float]]) -> tuple[float, int, int]:
    """(sum, first, last) of the contiguous run of (item, score) with the greatest sum, the
    first of equal ones; (0, 0, -1) when no score is above zero.  One scan."""
    best = (0.0, 0, -1)
    run, start = 0.0, 0
    for i, score in scored:
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best[0]:
            best = (run, start, i)
    return best


def extract(page: str | None, learned: dict[str, float]) -> str:
    if not page:
        return ""
    items = parse(page)
    has_article = any(x[0] == "text" and x[2][0] == "article" for x in items)
    _, first, last = best_region([(i, k * weight_of(f, learned)) for i, f, k in features(items, has_article)])
    # whole blocks: widen to the block limits around the region
    while first > 0 and not (items[first - 1][0] == "tag" and items[first - 1][2]):
        first -= 1
    while 0 <= last < len(items) - 1 and not (items[last + 1][0] == "tag" and items[last + 1][2]):
        last += 1
    blocks, now = [], []
    for item in items[first:last + 1]:
        if item[0] == "text":
            if item[2][0] in ("article", "plain"):
                now.append(html.unescape(item[1]))
        elif item[2]:
            blocks.append("".join(now))
            now = []
        elif item[1] == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def fit(pages: DataFrame, html_col: str = "html", max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Feature weights from labelled pages: one row per feature comes back."""
    # pages that mark their content; their number gives the share that is learned from
    usable = pages.select(F.col(html_col).alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    n = usable.count()
    if n > max_labelled:
        usable = usable.where(F.pmod(F.xxhash64("html"), F.lit(1 << 40)) < int((1 << 40) * max_labelled / n))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for page in pdf["html"]:
                total.update(label_counts(page) or {})
        yield pd.DataFrame([(f, k if inside else 0, 0 if inside else k) for (f, inside), k in total.items()],
                           columns=["feature", "inside", "outside"])

    seen = (usable.select("html").mapInPandas(count, "feature string, inside long, outside long")
            .groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
            .where("i + o >= 20"))   # rarer names (invented tags) keep the prior, so the model stays small
    return weights({r["feature"]: (r["i"], r["o"]) for r in seen.collect()})


def text_column(learned: dict[str, float], html_col: str = "html") -> Column:
    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda p: extract(p, learned))
    return text(F.col(html_col))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    learned = fit(pages)
    return (pages.select("page_id", "url", text_column(learned).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))

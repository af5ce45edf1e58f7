"""Main text of web pages: the best-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import slices, text_or_empty

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# A slash that closes the tag, not one that ends a value without quotes.
_CLOSED = re.compile(r"(?:\A|[\s\"'])/\Z")
_UNFINISHED = re.compile(r"<[/!?a-zA-Z][^>]*\Z")
_NAME = re.compile(r"[a-z]+|\d+")

# Fixed names: elements whose content is no text, elements and names that set apart what is not the article.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
APART = {"head", "nav", "aside", "form", "footer", "header", "menu", "dialog", "button", "select", "svg",
         "object", "canvas", "audio", "video", "map", "datalist", "option", "fieldset"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
         "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
         "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
         "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "sidebar", "menu", "nav",
         "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "toolbar", "comment",
         "comments", "commentlist", "disqus", "respond", "reply", "replies", "related", "recommended", "share", "sharing",
         "social", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "widget",
         "pagination", "pager", "search", "complementary", "contentinfo"}
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion"}
MAIN = {"article", "main"}


@dataclass
class Part:
    """A tag, or the text between two tags with its number of words."""

    tag: str
    text: str
    words: int
    apart: bool
    main: int


def parts_of(page: str) -> list[Part]:
    """Tags and words of a page in order. ``apart`` marks what lies in menus, adverts and the like; ``main`` numbers the
    outermost article or main element (-1 outside)."""
    out: list[Part] = []
    stack: list[tuple[str, bool]] = []
    apart, main, mains, at, end = False, -1, 0, 0, len(page)

    def words(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            out.append(Part("", text, len(text.split()), apart, main))

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            words(_UNFINISHED.sub("", page[at:]))
            break
        words(page[at : m.start()])
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not closing:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if closing:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                apart = any(a for _, a in stack)
                if not any(n in MAIN for n, _ in stack):
                    main = -1
        elif name not in VOID and not _CLOSED.search(rest):
            own = _set_apart(name, rest, main >= 0, any(n in ("p", "li", "td", "dd") for n, _ in stack))
            if name in MAIN and not own and apart:
                # What was to end before the article was never closed.
                stack = [(n, False) for n, _ in stack]
            if name in BLOCK or name in APART or own:
                stack.append((name, own))
            apart = any(a for _, a in stack)
            if name in MAIN and main < 0 and not apart:
                main, mains = mains, mains + 1
        out.append(Part(name, " " if name == "br" else "", 0, apart, main))
    return out


def _set_apart(name: str, attributes: str, in_main: bool, in_text: bool) -> bool:
    """Whether an element is no part of the article by its name or its class, id and role.

    Inside an article only a whole class name, id or role counts, or a class that begins like an advert's, since parts of
    it have names of their own; and a button in a sentence is a word.
    """
    if name in APART:
        return not (in_main and (name == "header" or (name == "button" and in_text)))
    if name in ("html", "body") or "=" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind not in ("class", "id", "role"):
            continue
        words = value.split() if in_main else _NAME.findall(value)
        if in_main and kind == "class":
            words += [w for w in (x.split("-")[0].split("_")[0] for x in words) if w in ADVERTS]
        if not NAMES.isdisjoint(words) or (not in_main and "header" in words):
            return True
    return False


@dataclass
class Weights:
    """Score of a word, and of each tag; a tag that was not met has ``other``."""

    word: float = 2.0
    other: float = -1.0
    tags: dict[str, float] = field(default_factory=dict)


def count_parts(page: str) -> Counter:
    """Words and tags of a page with an article element, inside and outside of it, by (tag or '', inside)."""
    parts, out = [p for p in parts_of(page) if not p.apart], Counter()
    if any(p.main >= 0 for p in parts):
        for p in parts:
            out[p.tag, p.main >= 0] += 1 if p.tag else p.words
    return out


def weights_of(counts: Counter) -> Weights:
    """Log-odds of lying in an article: words at least 0.5, tags at most -0.1, both at most 10 in size."""
    w = Weights()
    inside, outside = (sum(n for (_, i), n in counts.items() if i is side) + 1 for side in (True, False))

    def odds(tag: str) -> float:
        return math.log((counts[tag, True] + 0.5) / inside) - math.log((counts[tag, False] + 0.5) / outside)

    if counts:
        w.word = min(10.0, max(0.5, odds("")))
        w.tags = {t: max(-10.0, min(-0.1, odds(t))) for t in {t for t, _ in counts} if t}
    return w


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last place (exclusive) of the contiguous run of the largest sum; the first of equals, (0, 0) if none is above zero."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: Weights) -> str:
    """The best run's words by block. A run that ends inside an article element is widened to the whole of it."""
    parts = parts_of(page)
    scores = [
        0.0 if p.apart else p.words * weights.word if not p.tag else weights.tags.get(p.tag, weights.other)
        for p in parts
    ]
    start, stop = best_run(scores)
    if start == stop:
        return ""
    for i in (start, stop - 1):
        if parts[i].main >= 0:
            while start > 0 and parts[start - 1].main == parts[i].main:
                start -= 1
            while stop < len(parts) and parts[stop].main == parts[i].main:
                stop += 1
    blocks: list[list[str]] = [[]]
    for p in parts[start:stop]:
        if p.tag in BLOCK:
            blocks.append([])
        elif not p.apart:
            blocks[-1].append(p.text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def fit_weights(
    pages: DataFrame, sample: int = 2000, page_id: str = "page_id", page: str = "html", most_tags: int = 2000
) -> Weights:
    """Weights from the ``sample`` pages of least hashed id: an article element labels its words and tags as content.

    Of the tags of the sample the ``most_tags`` commonest, by inside and outside, have weights of their own; all others, which a
    page may make up, have that of unknown ones.
    """
    rows = pages.select(F.col(page_id).cast("string").alias("id"), text_or_empty(page).alias("page"))
    taken = rows.select("id", F.xxhash64("id").alias("h")).where("id IS NOT NULL").orderBy("h").limit(sample)
    schema = "tag string, inside boolean, n bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["page"].to_pylist():
                total.update(count_parts(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()),
             pa.array(list(total.values()), pa.int64())], names=["tag", "inside", "n"],
        )

    # ``sample`` ids: small enough to send to every task.
    counted = rows.join(F.broadcast(taken.select("id").distinct()), "id").select("page").mapInArrow(count, schema)
    met = counted.groupBy("tag", "inside").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag", "inside").limit(most_tags)
    return weights_of(Counter({(r.tag, r.inside): r.n for r in met.collect()}))


def extract(pages: DataFrame, weights: Weights, keep: list[str], page: str = "html") -> DataFrame:
    """Columns ``keep`` with ``text``: the article's blocks, joined by a newline.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by their
    element or by words of their class, id or role, inside an article by whole class names, ids and roles, and score nothing. All
    else scores by ``weights``: words above zero, tags below. The best contiguous run is the content. Null and empty pages give ''.
    """
    rows = pages.select(F.struct(*keep).alias("row"), text_or_empty(page).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "page"):
            found = [main_text(p, weights) for p in batch["page"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, pa.string())], names=["row", "text"])

    schema = rows.schema.__class__(rows.schema.fields[:1]).add("text", "string")
    return rows.mapInArrow(run, schema).select("row.*", "text")

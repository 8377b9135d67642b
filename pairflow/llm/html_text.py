"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its path of tags from the root. Per path, text length and
punctuation are summed over the path's blocks and divided by their number; both ratios are smoothed along the
page with a Gaussian, fused by multiplication, and paths whose mean fused value reaches a share of the page's
standard deviation are content. Blocks in regions that are named as something else (navigation, page header
and footer, asides, forms, adverts, notices, comments) carry no weight and are never content. The smallest
element that holds all content blocks (the whole article or main element, if they lie in one) then gives the
article: every block of it that is not excluded belongs to the text, so that short paragraphs, headings and lists
inside an article stay, and so do a headline (h1) before it and what lies between.

White space (as Python's str.split takes it, no-break spaces included) inside a block is one space, <br> too;
blocks are joined by a line feed. Character references are decoded once, in text only.

Results for odd input: a null or empty page, and one without content, has an empty text and 0 characters; a
page that ends inside a tag or script loses that tail only; a page whose blocks tie is kept whole; repeated
rows get a row each; a null id stays null; only the three named columns are read.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Content paths reach this share of the standard deviation of the fused ratios.
SHARE = 0.5
RADIUS = 1
RESULT = "page_id long, url string, text string, n_chars long"

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

# Element names of HTML by their part in a page.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
    "sup", "time", "tt", "u", "var", "wbr", "br"}
_NEVER = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option",
    "textarea", "input", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "dialog", "menu", "title",
    "datalist", "map", "math", "noembed", "noframes", "xmp"}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main",
    "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
# An element of the first kind ends an open one of the second kind, unless one of the third kind lies between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
    "body": ({"head"}, set())}
_REGIONS = {"article", "main"}
# Words of class, id and role that name something other than the article.
_OTHER = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo",
    "promoted", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead",
    "comment", "comments", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice",
    "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "search", "widget",
    "toolbar", "complementary", "contentinfo", "skip", "paywall", "disclaimer"}

# An article of this name is a reader's; a name with one of these words says that something is absent or beside.
_REMARKS = {"comment", "comments", "reply", "replies"}
_UNLESS = {"no", "not", "without", "with", "has", "free"}


@dataclass
class Block:
    path: str
    text: str
    other: bool
    regions: tuple[int, ...]  # open elements from the root, as numbers


def _is_other(tag: str, attributes: str, inside_region: bool) -> bool:
    if tag in _NEVER or tag == "header" and not inside_region:
        return True
    if tag in ("body", "html") or not attributes:
        return False
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = set(_WORD.findall(name))
            if words & _UNLESS:
                continue
            if words & (_REMARKS if tag in _REGIONS else _OTHER) or tag not in ("header", *_REGIONS) and "header" in words and not inside_region:
                return True
    return "hidden" in attributes.lower().split()


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, number, other, inside a region
    parts: list[str] = []
    number = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            outer = [s for s in stack if s[0] not in _INLINE]
            out.append(Block(">".join(s[0] for s in outer), text, bool(stack) and any(s[2] for s in stack),
                             tuple(s[1] for s in outer)))

    def close(until: int) -> None:
        if any(s[0] not in _INLINE for s in stack[until:]):
            flush()
        del stack[until:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at:m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if found is not None:
                close(found)
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in _CLOSES_P:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if found is not None:
                close(found)
        if tag in _IMPLIED:
            ended, borders = _IMPLIED[tag]
            first = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in borders:
                    break
                if stack[i][0] in ended:
                    first = i
            if first is not None:
                close(first)
        if tag == "br":
            parts.append(" ")
        if tag in _VOID:
            if tag not in _INLINE:
                flush()
            continue
        if tag not in _INLINE:
            flush()
        if tag in _RAW:
            ending = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            at = ending.end()
            continue
        if attributes.endswith("/") and tag in ("path", "rect", "circle", "use", "g"):
            continue
        number += 1
        inside = bool(stack) and stack[-1][3]
        stack.append((tag, number, _is_other(tag, attributes, inside), inside or tag in _REGIONS))
    flush()
    return out


def smoothed(values: list[float], radius: int = RADIUS) -> list[float]:
    """Gaussian mean along the page, weights of the values in reach."""
    weights = [math.exp(-(d * d) / (2.0 * max(radius, 1) ** 2)) for d in range(radius + 1)]
    out = []
    for i in range(len(values)):
        total = mass = 0.0
        for j in range(max(0, i - radius), min(len(values), i + radius + 1)):
            w = weights[abs(i - j)]
            total += w * values[j]
            mass += w
        out.append(total / mass)
    return out


def content_paths(found: list[Block]) -> set[str]:
    """Tag paths whose smoothed and fused ratios reach the threshold."""
    sums: dict[str, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        if not b.other:
            s[0] += len(b.text)
            s[1] += len(_PUNCTUATION.findall(b.text))
            s[2] += 1
    ratio = {p: (s[0] / s[2], s[1] / s[2]) if s[2] else (0.0, 0.0) for p, s in sums.items()}
    lengths = smoothed([0.0 if b.other else ratio[b.path][0] for b in found])
    marks = smoothed([0.0 if b.other else ratio[b.path][1] for b in found])
    fused = [x * (1.0 + y) for x, y in zip(lengths, marks)]
    mean = sum(fused) / len(fused)
    threshold = SHARE * math.sqrt(sum((v - mean) ** 2 for v in fused) / len(fused))
    by_path: dict[str, list[float]] = {}
    for b, v in zip(found, fused):
        if not b.other:
            by_path.setdefault(b.path, []).append(v)
    return {p for p, v in by_path.items() if sum(v) / len(v) >= threshold}


def main_text(page: str) -> str:
    """The article of a page, blocks joined by line feeds."""
    found = blocks(page)
    if not found:
        return ""
    paths = content_paths(found)
    chosen = [b for b in found if b.path in paths and not b.other]
    if not chosen:
        return ""
    # The smallest element that holds all content blocks, article and main elements of their own included.
    region = chosen[0].regions
    for b in chosen[1:]:
        n = next((i for i, (x, y) in enumerate(zip(region, b.regions)) if x != y), min(len(region), len(b.regions)))
        region = region[:n]
    tags = chosen[0].path.split(">")[:len(region)]
    whole = next((i for i, t in enumerate(tags) if t in _REGIONS), None)
    if whole is not None:
        region = region[:whole + 1]
    elif region and len({b.regions for b in chosen}) == 1:
        # One block is all content; its neighbours below the same parent are the article's other blocks.
        region = region[:-1]
    inside = [b.regions[:len(region)] == region for b in found]
    first = start = inside.index(True)
    headline = [i for i, b in enumerate(found) if "h1" in b.path.split(">") and not b.other]
    if headline and headline[0] < first and not any(inside[i] for i in headline):
        # The headline stands before the element: it belongs to the text, with what lies between.
        start = max(i for i in headline if i < first)
    return "\n".join(b.text for i, b in enumerate(found) if not b.other and (inside[i] or start <= i < first))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py() or "") for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])
    return pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
        pages[html_col].cast("string").alias("html")).mapInArrow(run, RESULT)

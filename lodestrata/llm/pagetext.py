"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its tag path: the block-level
elements from the root to the block (inline markup is left out, and a tag's
telling class or id words are kept).  All blocks of a path are judged
together: the path's length of text outside links and its punctuation, each
per block, are smoothed over the paths in page order and fused by
multiplication.  A path within a marked article leans half on the ratio of
all the article's blocks, so that short headings and items stay with the text
around them.  The values are weighed by what the elements on the path say (an
article or main element, or a class word of advertising, comments and the like),
and, where marked articles hold most of the page's text, what stands outside
them weighs less.  Paths of at least a share of the best path's value are
content; their blocks, in page order, are the text.  Only elements that hold no
text of a page (navigation, footers, forms, controls, scripts, what is hidden)
are out whatever their ratios.

A path is a node that knows the one above it, so memory grows with a page's
length, however deep it nests.

Defined results: a null or empty page, and one without content, gives an empty
text; an empty table an empty result.  Markup that ends early (truncated
pages) is closed at the end of the page; an unfinished tag at the very end is
dropped.  A script, style, title or text area without an end tag takes the
rest of the page, as in browsers; a control (button, select, option) ends at
the next paragraph, heading or article at the latest.  Blocks of equal paths
tie and go together.  A very long page is read whole.  Each row is extracted
by itself, so repeated rows get equal results.  Ill-formed UTF-8 counts as
U+FFFD.  Only page_id, url and html are read, whatever other columns are named.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by role (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded semantics".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
CONTROLS = frozenset("button select option optgroup datalist".split())
BOILERPLATE = CONTROLS | frozenset("head nav header footer aside form menu dialog fieldset template svg iframe object canvas audio video annotation".split())
TEXTUAL = frozenset("article main section p h1 h2 h3 h4 h5 h6 ul ol table blockquote pre".split())
SECTIONING = frozenset("article main".split())
#: A start tag of the key ends an open element of the value (fixed values of the HTML syntax).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id and role that mark what isn't the article (fixed values).
ASIDE = frozenset("ad ads adv advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted promotion recommended related replies reply responses search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe tags teaser toolbar widget disclaimer disclaimers copyright imprint".split())
#: Words that say nothing beside one of those (fixed values).
LAYOUT = frozenset("area bar block box column container group inner item items links list outer panel row section wrap wrapper".split())
BODY = frozenset("article articlebody content entry main maincontent post postbody story".split())

#: Quotes count only after an equals sign.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?>[^>=]+|=\s*(?>\"[^\"]*\"|'[^']*')|=)*+>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PIECES = re.compile(r"[^a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Weights by role: "hint" has a telling class word, "inner" has one within an article.  Only
#: elements that hold no text of the page, and what is hidden, weigh nothing.
PRIOR = {"article": 3.0, "plain": 1.0, "inner": 0.3, "hint": 0.01, "aside": 0.0}
#: The share of the text that marked articles must hold for the rest to count as ``OUTSIDE``, and its weight.
MOST, OUTSIDE = 0.5, 0.15
#: A path is content at this share of the best path's value; the part of the value of a path
#: in an article that is the article's.
SHARE, LEAN = 0.15, 0.5


def _hints(tag: str) -> set[str]:
    """Class, id and role names of which every part says what isn't the article; and those
    that say what is."""
    out = set()
    for m in _HINT.finditer(tag):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [x for x in _PIECES.split(name) if x]
            if name in ASIDE or any(x in ASIDE for x in parts) and all(x in ASIDE or x in LAYOUT for x in parts):
                out.add("!" + name)
            elif name in BODY or parts and BODY.issuperset(parts):
                out.add(name)
    return out


def _role(name: str, tag: str, inside: bool) -> tuple[str, str]:
    """The path element that a tag adds, and its role."""
    hints = set()
    if "=" in tag or "hidden" in tag:
        hints = _hints(tag)
        if _HIDDEN.search(tag):
            return name + "!hidden", "aside"
    against = sorted(x for x in hints if x[0] == "!")
    if name in BOILERPLATE and not (name == "header" and inside):
        return f"{name}{'.'.join(against)}", "aside"
    if name == "noscript" and not inside:
        return name, "hint"
    if against and name not in ("html", "body") and not (name in SECTIONING and len(against) < len(hints)):
        return f"{name}{'.'.join(against)}", "inner" if inside else "hint"
    if name in SECTIONING or len(against) < len(hints):
        return name + "+", "article"
    return name, "plain"


class Path:
    """An element on a path, below the one above it; equal paths are one object."""

    __slots__ = ("above", "element", "below")

    def __init__(self, above: Path | None, element: str):
        self.above, self.element, self.below = above, element, {}

    def child(self, element: str) -> Path:
        found = self.below.get(element)
        if found is None:
            found = self.below[element] = Path(self, element)
        return found

    def __str__(self) -> str:
        parts, at = [], self
        while at is not None and at.above is not None:
            parts.append(at.element)
            at = at.above
        return "".join(f"/{x}" for x in reversed(parts))


class ByPath(dict):
    """Values by path, which may also be asked for by a path's text."""

    def __missing__(self, text: str) -> float:
        for path, value in self.items():
            if str(path) == text:
                return value
        raise KeyError(text)


Block = tuple[Path, str, str, int]


def blocks_of(page: str) -> list[Block]:
    """(path, role, text, characters outside links) of each block of text, in page order."""
    out: list[Block] = []
    root = Path(None, "")
    stack: list[tuple[str, Path, str]] = []  # name, path, role
    opened: Counter = Counter()  # names on the stack
    text: list[str] = []
    at, path, role, link, linked = 0, root, "plain", -1, 0  # link: the depth that it began at

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((path, role, joined, max(0, len(joined) - linked)))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if link >= 0:
            linked += len(piece)

    def pop(n: int) -> None:
        nonlocal link, path, role
        for gone, _, _ in stack[n:]:
            opened[gone] -= 1
        del stack[n:]
        if link > n:
            link = -1
        path, role = (stack[-1][1], stack[-1][2]) if stack else (root, "plain")

    while m := _TOKEN.search(page, at):
        start, end = m.span()
        if start > at:
            add(page[at:start])
        tag, at = page[start:end], end
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                add(html.escape(tag[9:].removesuffix("]]>")))
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] != "/":
            if name in RAW:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, end)
                at = close.end() if close else len(page)
                text.append(" ")
                continue
            if name == "br":
                flush()
                continue
            if name == "a":
                link = len(stack)
            if name in INLINE or name in VOID and name != "hr":
                continue
            flush()
            if name == "hr" or name == "svg" and tag.endswith("/>"):
                continue
            if name in ENDS:
                n = len(stack)
                while n and stack[n - 1][0] in ENDS[name]:
                    n -= 1
                pop(n)
            elif stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if name in TEXTUAL or name in ("button", "select"):  # a control that was left open
                n = len(stack)
                while n and stack[n - 1][0] in CONTROLS:
                    n -= 1
                pop(n)
            added, own = _role(name, tag, role == "article")
            path, role = path.child(added), role if role in ("aside", "hint", "inner") and own != "aside" or own == "plain" else own
            stack.append((name, path, role))
            opened[name] += 1
            continue
        if name in INLINE or name in VOID:
            if name == "a":
                link = -1
            elif name == "br":
                flush()
            continue
        flush()
        if opened[name]:
            i = len(stack) - 1
            while stack[i][0] != name:
                i -= 1
            pop(i)
    rest = page[at:]
    unfinished = re.search(r"<[/!a-zA-Z][^>]*\Z|<\Z", rest)
    add(rest[: unfinished.start()] if unfinished else rest)
    flush()
    return out


def _ratio(length: float, marks: float, n: int) -> tuple[float, float]:
    return log(1 + length / n), 1 + log(1 + marks / n)


def path_values(blocks: list[Block]) -> ByPath:
    """Each path's fused and weighed value."""
    paths: dict[Path, list] = {}
    article, plain = [0, 0, 0], 0
    for path, role, text, own in blocks:
        sums = paths.setdefault(path, [role, 0, 0, 0])
        marks = len(_PUNCTUATION.findall(text)) if own else 0
        for i, x in enumerate((own, marks, 1)):
            sums[i + 1] += x
            if role == "article":
                article[i] += x
        plain += own if role == "plain" else 0
    kinds = list(paths.values())
    size, marks = np.array([_ratio(*k[1:]) for k in kinds]).T

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(x, 1, mode="edge"), [0.1, 0.8, 0.1], mode="valid")

    value = smooth(size) * smooth(marks)
    if article[2]:
        whole = np.multiply(*_ratio(*article))
        value = np.where([k[0] in ("article", "inner") for k in kinds], (1 - LEAN) * value + LEAN * whole, value)
    weights = PRIOR | ({"plain": OUTSIDE} if article[0] > MOST * (article[0] + plain) else {})
    return ByPath(zip(paths, (value * np.array([weights[k[0]] for k in kinds])).tolist(), strict=True))


def main_text(page: str | None) -> str:
    """The text of the whole page's content blocks, one block to a line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    value = path_values(blocks)
    least = SHARE * max(value.values())
    return "\n".join(text for path, role, text, _ in blocks if role != "aside" and value[path] >= least)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    found = pages.select("page_id", "url", text_of(F.make_valid_utf8("html")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))

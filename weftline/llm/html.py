"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line's weight is the length of its text outside
links, and weights are summed over sliding windows of SPAN lines. Text surges where a window's sum passes the
threshold and dives where the sums fall back to nothing; the weighing lines between a surge and its dive are the text.

Lines in menus, headers, footers, sidebars, notices, adverts, forms or reader comments (ASIDE, STRONG) are set apart:
however long, they are no text on a page where any other line weighs. Where nothing else weighs, they are judged as
what stands beside an article, at FAR_LOWER of their weight. Lines beside a marked article or main part weigh BESIDE as
much. Such lines stand in a sequence of their own, so the windows of the other lines reach across them; of theirs,
those are text whose window passes THRESHOLD and SHARE of the page's densest window, each holding its part of it.
Ambiguous names (WEAK) halve a line's weight. Of the other lines, where an article or main part is marked, a single character passes;
elsewhere THRESHOLD characters do, or any weight where no window has as much. So no page with text comes out empty, a
marked part does not silence a denser text beside it, and a name does not silence a page's only text.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one line feed. Null or empty html gives an empty text. Nothing is capped. Pages are independent, so repeated rows
give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import trimmed

SPAN, THRESHOLD, SHARE = 3, 60, 0.2
FAR_LOWER, BESIDE = 0.02, 0.1

# Element names of HTML, by how this operator treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript".split())
UNSEEN = frozenset("head template object svg math canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
ASIDE = frozenset("nav header footer aside form dialog menu button fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("article main".split())
# Names in class, id or role that mark what is not the article, names that may or may not, and words
# that say nothing at the end of a name.
STRONG = frozenset("ad ads advert adverts advertisement advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription popup nav navbar navigation menu breadcrumb breadcrumbs sidebar complementary contentinfo footer masthead comment comments commentlist respond replies disqus share sharing pagination pager toolbar login signup hidden".split())
WEAK = frozenset("alert header foot side modal overlay social related recommended recommendations widget search skip".split())
PLAIN = frozenset("area bar block box container content form group inner item items links list outer section slot text unit wrap wrapper".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _named(value: str) -> int:
    """2 if a class, id or role holds a name of STRONG, 1 if one of WEAK, else 0.

    Of a name with hyphens the last part that says something decides: "site-footer" is one, "side-effects" is none.
    """
    best = 0
    for name in value.lower().split():
        parts = name.replace("_", "-").strip("-").split("-")
        while len(parts) > 1 and (parts[-1] in PLAIN or parts[-1].isdigit()):
            parts.pop()
        best = max(best, 2 if parts[-1] in STRONG else 1 if parts[-1] in WEAK else 0)
    return best


def _set_apart(name: str, attrs: str) -> int:
    """How far an element's name or attributes say that it isn't part of an article: 2, 1 or 0."""
    if name in ASIDE:
        return 2
    if not attrs or name in PARTS or name in ("html", "body"):
        return 0
    best = 0
    for key, a, b, c in _ATTR.findall(attrs):
        key = key.lower()
        if key in ("class", "id", "role"):
            best = max(best, _named(a or b or c))
        elif key == "hidden" or key == "aria-hidden" and (a or b or c) == "true" or key == "style" and "display:none" in (a or b or c).replace(" ", ""):
            return 2
    return best


def lines_of(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """The page's blocks as (text, characters outside links, set apart, of an ambiguous name, in a marked part)."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    pieces: list[str] = []
    linked = 0
    open_: list[tuple[str, int, int, int, int]] = []  # name, and the depths of set-apart, part, link and weak before it
    apart = part = link = weak = 0
    skip = ""
    at = 0
    started = (0, 0, 0)

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            if text:
                out.append((text, max(1 if started[1] and not started[0] else 0, len(text) - linked), bool(started[0]), bool(started[2]), bool(started[1])))
        pieces, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked, started
        if not text:
            return
        if not pieces:
            if text.isspace():
                return
            started = (apart, part, weak)
        elif bool(started[0]) != bool(apart):
            if text.isspace():
                return
            flush()
            started = (apart, part, weak)
        pieces.append(text)
        if link:
            linked += len(text.strip())

    def close(k: int) -> None:
        nonlocal apart, part, link, weak
        _, apart, part, link, weak = open_[k]
        del open_[k:]

    while m := _TOKEN.search(page, at):
        if not skip:
            add(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        ends = m.group(1) == "/"
        if name in RAW:  # their content isn't markup
            if not ends:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if skip:
            if ends and name == skip or skip == "head" and name in ("body", "article", "main", "div"):
                skip = ""
            if skip or ends:
                continue
        if name in UNSEEN:
            if not ends and not m.group(3).endswith("/"):
                skip = name
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            if pieces:
                pieces.append(" ")
            continue
        if name in VOID:
            continue
        if ends:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    close(k)
                    break
            continue
        if name not in INLINE:  # blocks end what a writer left open: paragraphs, items and inline styles
            while open_ and (open_[-1][0] in INLINE or open_[-1][0] == "p" or open_[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                close(len(open_) - 1)
        open_.append((name, apart, part, link, weak))
        if name == "a":
            link += 1
        elif name in PARTS:
            part += 1
        if name in HEADINGS and part and apart and len(open_) > 1 and open_[-2][0] == "header" and open_[-2][1] == 0:
            apart = 0  # an article's own heading
        elif (how := _set_apart(name, m.group(3))) == 2:
            apart += 1
        elif how:
            weak += 1
    if not skip:
        add(page[at:])
    flush()
    return out


def window_sums(weights: list[float]) -> list[float]:
    return [sum(weights[i : i + SPAN]) for i in range(len(weights))]


def main_text(page: str | None) -> str:
    """The text between the surges and dives of the page's lines."""
    if not page:
        return ""
    lines = lines_of(page)
    marked = any(m and w and not a for _, w, a, _, m in lines)
    own = [k for k, (_, _, a, _, m) in enumerate(lines) if not a and (m or not marked)]
    silent = not any(w and not a for _, w, a, _, _ in lines)
    rest = [k for k, (_, _, a, _, m) in enumerate(lines) if (silent if a else marked and not m)]
    weights = [lines[k][1] * (0.5 if lines[k][3] else 1) for k in own]
    lowered = [lines[k][1] * (FAR_LOWER if lines[k][2] else 1) * (BESIDE if marked and not lines[k][4] else 1) for k in rest]
    sums, low_sums = window_sums(weights), window_sums(lowered)
    least = 0 if marked or max(sums, default=0) < THRESHOLD else THRESHOLD
    kept: list[int] = []
    i, n = 0, len(own)
    while i < n:
        if sums[i] < least or not weights[i]:
            i += 1
            continue
        dive = i
        while dive < n and sums[dive] > 0:
            dive += 1
        kept += [own[k] for k in range(i, dive) if weights[k]]
        i = dive
    dense = max(THRESHOLD, SHARE * max([*sums, *low_sums], default=0))
    for i, total in enumerate(low_sums):
        if total >= dense:
            kept += [rest[k] for k in range(i, min(i + SPAN, len(rest))) if lowered[k] * SPAN >= dense]
    return "\n".join(lines[k][0] for k in sorted(set(kept)))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    kind = lambda c: pages.schema[c].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(trimmed(run), f"page_id {kind(id_col)}, url {kind(url_col)}, text string, n_chars bigint")

"""Main text of web pages by two-pass block rules.

A page is read as a sequence of blocks (the text between block-level tags).  Pass one decides blocks
on their own: those inside menus, page headers, footers, asides, forms, adverts, notices, comments
and the like, and those made of links, are boilerplate; long blocks with enough stop words are
content; short ones stay open.  Pass two gives an open block the label of its nearest decided
neighbours in the same region (an article or the rest of the page): content if both sides are, or
if the nearer one is (of two as near: the one before; for a heading the one after).  In an article
an open block without decided neighbours is content, elsewhere boilerplate.

What a page lacks is made up for.  Where its text has few of the stop words known here, its language
is taken as unknown, and length and link density decide.  Holders that are named like boilerplate,
and forms, are only softly unwanted: an article in them is judged by what it holds, and if a page has
no content otherwise, they count as wanted.  A name that says what a page has or lacks ("no-sidebar")
names no boilerplate.  Menus and page headers left open end where an article begins.  A link holds
all blocks up to its end, or the end of the element that it began in.

Null and empty html give the empty text.  Null and repeated page_ids are kept: one row out for one
row in.  An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: Frequent function words of English, French, German, Spanish, Italian, Portuguese and Dutch (fixed values).
STOP_WORDS = frozenset(
    "the of and to in is it for that with as on was by this be are from at or an not have but which "
    "le la les de des du et un une en que qui est dans pour pas sur au par ce il ne se plus avec son "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei um am "
    "el los las del y que se por con para una su al lo como más pero sus no "
    "il di che è non per della sono gli alla dei nel anche più come delle ma questo "
    "o os do da em um uma não com mais dos das foi ao pelo "
    "het een van op te dat niet zijn met voor ook aan maar bij naar".split()
)
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript object ol optgroup option p pre section select "
    "summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head title nav footer aside button select option textarea dialog menu noscript template svg iframe object video audio canvas".split())
ENDED = frozenset("head title nav menu header button select option".split())  # by an article, if they were left open
HOLDERS = BLOCK - frozenset("p hr li dt dd tr td th thead tbody tfoot h1 h2 h3 h4 h5 h6 option optgroup".split()) | {"span", "a"}
NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot banner sponsor sponsored promo promotion sidebar widget menu nav navbar "
    "navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies disqus respond cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "pagination pager toolbar navigation contentinfo complementary search dialog alertdialog".split()
)
#: Names of what belongs to readers or to other pages.
OTHERS = frozenset("comment comments reply replies disqus respond related recommended".split())
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)?+)*+"""  # a quote opens a value only after "="; other values end at a blank
DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style)\b{ATTRS}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({ATTRS})>?",
    re.S | re.I,
)
#: One attribute after the other, whole names, so that nothing within a value or a longer name counts.
ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?+""")
STATES = frozenset("no has with without".split())  # before a name: what the page has or lacks


def _unwanted(attrs: str) -> tuple[int, bool]:
    """2: hidden, or named after comments or other pages; 1: named after another kind of boilerplate; 0: wanted.  And whether it has a target."""
    out, target = 0, False
    for name, a, b, c in ATTR.findall(attrs):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            out = 2
        elif name == "style":
            if re.search(r"display\s*:\s*none", value):
                out = 2
        elif name == "href":
            target = True
        elif name in ("class", "id", "role"):
            for word in value.split():
                parts = re.split(r"[^a-z]+", word)
                if word == "hidden":
                    out = 2
                elif STATES.isdisjoint(parts):
                    out = max(out, 2 * (not OTHERS.isdisjoint(parts)), not NAMES.isdisjoint(parts))
    return out, target


def blocks(page: str) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """``(text, characters in links, region, articles around, how unwanted, heading)`` of each block in page order.

    An article or main element within a holder that is only named like boilerplate (such as
    "has-sidebar") is judged by what it holds itself.
    """
    stack: list[tuple[str, int, int]] = []  # open holders, how unwanted each is, and ``base`` before it
    parts: list[tuple[str, bool]] = []
    opened = Counter()  # holders on the stack by tag
    heading = False
    soft = hard = base = articles = region = links = within = at = 0  # within: blocks opened since the link

    def block():
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        linked = sum(len(" ".join(html.unescape(p).split())) for p, x in parts if x)
        parts.clear()
        return (text, linked, region, articles, 2 * (hard > 0) or int(soft > base), heading) if text else None

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in BLOCK:
            if b := block():
                yield b
            heading = not closing and tag in HEADINGS
            if links and tag not in HOLDERS:  # a paragraph that ends and began before the link ends the link
                within += -1 if closing else 1
                links = int(within >= 0)
        if tag not in HOLDERS:
            continue
        if not closing:
            if m[4].endswith("/") and tag in ("svg", "iframe", "object"):
                continue
            named, target = _unwanted(m[4])
            if tag == "a":
                links, within = int(target), 0
            while tag in ("article", "main") and any(opened[t] for t in ENDED):
                t, off, was = stack.pop()
                opened[t] -= 1
                soft, hard = soft - (off == 1), hard - (off == 2)
                if t in ("article", "main"):
                    articles, base = articles - 1, was
            if tag in NEVER or (tag == "header" and not articles):
                off = 2
            elif tag in ("html", "body", "main") or (tag == "article" and not articles):
                off = named if tag == "article" and named == 2 else 0
            else:
                off = max(named, tag == "form")
            stack.append((tag, off, base))
            opened[tag] += 1
            soft, hard = soft + (off == 1), hard + (off == 2)
            if tag in ("article", "main"):
                articles, region = articles + 1, region + 1
                base = soft - (off == 1)
        elif opened[tag]:
            while True:
                t, off, was = stack.pop()
                opened[t] -= 1
                soft, hard = soft - (off == 1), hard - (off == 2)
                if t == "a":
                    links = 0
                if t in ("article", "main"):
                    articles, region = articles - 1, region + 1
                    base = was
                if t == tag:
                    break
    parts.append((page[at:], links > 0))
    if b := block():
        yield b


def main_text(page: str | None, short: int = 70, long: int = 200, high: float = 0.30, low: float = 0.15, linked: float = 0.5) -> str:
    """The text of a page's content blocks, joined by two line ends."""
    found = list(blocks(page or ""))
    sizes = (short, long, high, low, linked)
    return "\n\n".join(_content(found, 1, *sizes) or _content(found, 2, *sizes))


def _weight(text: str) -> int:
    """Characters, those of scripts that write without blanks as two."""
    return len(text) + len(DENSE.findall(text))


def _content(found: list[tuple], off: int, short: int, long: int, high: float, low: float, linked: float) -> list[str]:
    """Texts of the content blocks; blocks are unwanted from ``off`` on."""
    stops = []
    for text, *_ in found:
        words = [w.strip(".,;:!?()[]{}\"'*#$%&|<>").lower() for w in text.split()]
        stops.append((sum(w in STOP_WORDS for w in words), len(words)))
    plain = [(s, n) for (s, n), (text, in_links, _, _, unwanted, _) in zip(stops, found) if unwanted < off and in_links <= linked * len(text) and _weight(text) >= short]
    unknown = sum(s for s, _ in plain) < low * sum(n for _, n in plain)  # the page's language
    labels: list[bool | None] = []
    for (text, in_links, _, articles, unwanted, _), (stop, words) in zip(found, stops):
        density, size = in_links / len(text), _weight(text)
        stop /= words
        if unwanted >= off or density > linked:
            labels.append(False)
        elif size < short:
            labels.append(False if density > 0 and not articles else None)
        elif articles:
            labels.append(True if stop >= low or size >= long else None)
        elif unknown:
            labels.append(True if size > long and density < linked / 2 else None)
        elif stop >= high and size > long:
            labels.append(True)
        else:
            labels.append(None if stop >= low else False)
    # nearest decided neighbour in the same region and on the page's wanted side, from either end
    n = len(found)
    near: list[list[tuple[int, bool] | None]] = []
    for order in (range(n), range(n - 1, -1, -1)):
        seen: dict[int, tuple[int, bool]] = {}
        side: list[tuple[int, bool] | None] = [None] * n
        for i in order:
            side[i] = seen.get(found[i][2])
            if labels[i] is not None and not (found[i][3] and found[i][4] >= off):
                seen[found[i][2]] = (i, labels[i])
        near.append(side)
    keep = []
    for i, label in enumerate(labels):
        if label is None:
            a, b = near[0][i], near[1][i]
            if a and b:
                label = a[1] if a[1] == b[1] else (a if i - a[0] < b[0] - i + (not found[i][5]) else b)[1]
            else:
                label = (a or b or (0, found[i][3] > 0))[1]
        if label:
            keep.append(found[i][0])
    return keep


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py()) for h in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

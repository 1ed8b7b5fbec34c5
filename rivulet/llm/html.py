"""Operator 8: main text of web pages by two-pass block rules.

A page is cut into blocks. Pass one scores each by its length, its share of stop words and its share of linked text; two
points or more make it good, minus two or less bad, anything between, such as a short block, is ambiguous. Where a block
stands is evidence of the same kind: a point for an article that holds a good part of the page's text, five against
for menus, footers, forms, adverts, comments and the like. A container that is only named so (by class, id or role) and
holds most of the page's text is no evidence. Pass two gives an ambiguous block the label of its nearest decided
neighbour: in its article if that has any, else on the page. Blocks in menus and the like are bad, but not neighbours.

Languages outside the stop-word lists are judged by length and links alone: where no long block of a page reaches the
lower density, density is not asked. Characters of scripts without spaces count as three.

Defined cases: null or empty html gives an empty text; unclosed tags and pages cut off anywhere are read as far as they
go, a comment without end ends the page; undecodable references stay as written; repeated rows each get a row; a tie
between neighbours goes to good; if nothing on a page is decided, ambiguous blocks are good; an empty table gives an
empty result; ``extract`` carries other columns along, but replaces a column with the name of the text column.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent words of four languages, in alphabetical order.
STOP_WORDS = frozenset(
    """
    a and are as at be by for from had has have he her his i in is it not of on or she that the they this to was we were which will with you
    als auch auf aus bei das dem den der des die ein eine einen er es für hat ich im ist mit nach nicht noch sich sie sind so über um und von war werden wie wird zu zum zur
    au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous ont ou par pas plus pour qui que sa se ses son sont sur un une vous
    al como con cuando del el ella ellos entre era esta este fue ha hay las lo los más mi muy nos o para pero por sin sobre su sus también un una y ya
    """.split()
)
# Element names.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("applet audio button canvas datalist head iframe map noframes noscript object option select script style svg template textarea title video".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
OUTER = frozenset("aside dialog footer menu nav".split())
MAIN = frozenset("article main".split())
#: What an opening tag ends: the open element of the first name, unless one of the others is nearer.
ENDS = {"li": (("li",), ("ol", "ul", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "form": (("form",), ())}
# Words in class and id that name what is not the article, in alphabetical order.
NAMES = frozenset(
    "ad adbox ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
ROLES = frozenset("banner complementary contentinfo form menu menubar navigation search alert dialog".split())
#: First parts of class names that say something about other elements, and parts that tell an article's header.
ABOUT, OWN = frozenset("has hide is no show with without".split()), frozenset("article entry post section".split())
#: Scripts written without spaces.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
#: Limits of length, of stop-word density and of link density.
LONG, DENSE, SPARSE, LINKED, SOME_LINKS = 70, 0.2, 0.1, 0.5, 0.2
#: Points for and against by place, the share of the page's text that makes a named container the page's own, and the
#: share that makes an article one.
ARTICLE, SIDE, OWN_SHARE, ARTICLE_SHARE = 1, -5, 2 / 3, 1 / 4
OUT, NAMED, INNER = 1, 2, 3


class Blocks(HTMLParser):
    """The blocks of a page as (text, linked characters, box), and its boxes as [outer box, unlinked characters, kind]."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, box, link, silent
        self.open: Counter[str] = Counter()
        self.box, self.link, self.silent = 0, False, False
        self.boxes = [[-1, 0, 0]]
        self.found: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.feed(html)
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""
        self.close()
        self.end_block()
        for outer, size, _ in reversed(self.boxes[1:]):  # an outer box has the smaller number
            self.boxes[outer][1] += size

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append((text, self.linked, self.box))
                self.boxes[self.box][1] += max(0, len(text) - self.linked)
            self.parts, self.linked = [], 0

    def _pop(self, n: int) -> None:
        for tag, *_ in self.stack[n:]:
            self.open[tag] -= 1
        del self.stack[n:]
        _, self.box, self.link, self.silent = self.stack[-1] if self.stack else ("", 0, False, False)

    def _close(self, tags: tuple[str, ...], within: tuple[str, ...] | frozenset[str] = ()) -> None:
        """Ends the innermost open element of ``tags`` that is not outside one of ``within``."""
        if any(self.open[tag] for tag in tags):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in tags:
                    self._pop(i)
                    return
                if self.stack[i][0] in within:
                    return

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """What an element says about the text in it."""
        if tag in OUTER:
            return OUT
        inside = any(self.open[x] for x in MAIN)
        if tag == "form" or (tag == "header" and not inside):
            return NAMED
        for k, v in attrs:
            if k == "role" and v in ROLES:
                return NAMED
            if k in ("class", "id") and v and (tag in BLOCKS or tag in ("span", "ins")):
                for name in v.lower().split():
                    words = re.split("[-_]+", name)
                    if words[0] in ABOUT or (tag in MAIN and len(words) > 1):
                        continue
                    if not NAMES.isdisjoint(words) or ("header" in words and not inside and OWN.isdisjoint(words)):
                        return NAMED
        return INNER if tag in MAIN else 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in IN_HEAD:
            self._close(("head",), BLOCKS)
        if tag in BLOCKS:
            self.end_block()
            self._close(("p",), BLOCKS - {"p"})  # a block ends an open paragraph
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in VOID:
            return
        kind = self._kind(tag, attrs) if tag not in ("html", "body") else 0
        if kind:
            if tag not in BLOCKS:
                self.end_block()
            self.boxes.append([self.box, 0, kind])
            self.box = len(self.boxes) - 1
        self.link, self.silent = self.link or tag == "a", self.silent or tag in SILENT
        self.stack.append((tag, self.box, self.link, self.silent))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or (self.stack and self.stack[-1][0] == tag and self.stack[-1][1] != (self.stack[-2][1] if len(self.stack) > 1 else 0)):
            self.end_block()
        self._close((tag,))

    def handle_data(self, data: str) -> None:
        if self.silent and self.stack[-1][0] == "head" and data.strip():
            self._close(("head",))
        if not self.silent:
            self.parts.append(data)
            if self.link:
                self.linked += len(data)


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(UNSPACED.findall(text))


def density(text: str) -> float:
    """The share of stop words."""
    words = [w.strip(".,;:!?#*%$&|()[]\"'") for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def content_scores(blocks: list[tuple[str, int, int]]) -> list[int]:
    """Points of each block for its length, stop words and links."""
    sizes = [_size(text) for text, _, _ in blocks]
    shares = [density(b[0]) if size >= LONG and b[1] <= LINKED * len(b[0]) else None for b, size in zip(blocks, sizes, strict=True)]
    told = any(x is not None and x >= SPARSE for x in shares)
    out = []
    for (text, linked, _), size, share in zip(blocks, sizes, shares, strict=True):
        if linked > LINKED * len(text) or (size < 3 * LONG and "\u00a9" in text):
            out.append(-2)
        elif share is None:
            out.append(-1 if linked else 0)
        elif linked > SOME_LINKS * len(text):
            out.append(0)
        else:
            out.append(2 if not told or share >= DENSE else 1 if share >= SPARSE else -1)
    return out


def places(boxes: list[list[int]]) -> list[tuple[bool, int]]:
    """For each box, whether it is a menu, footer or the like, or in one, and the article that it is in (0: none)."""
    total = boxes[0][1]
    out = [(False, 0)]
    for i, (outer, size, kind) in enumerate(boxes[1:], 1):
        side, article = out[outer]
        side = side or kind == OUT or (kind == NAMED and size <= OWN_SHARE * total)
        out.append((side, i if kind == INNER and size >= ARTICLE_SHARE * total else article))
    return out


def labels(blocks: list[tuple[str, int, int]], boxes: list[list[int]]) -> list[bool]:
    """Whether each block belongs to the main text."""
    place = places(boxes)
    where = [place[b] for _, _, b in blocks]
    scores = [x + (SIDE if side else 0) + (ARTICLE if article else 0) for x, (side, article) in zip(content_scores(blocks), where, strict=True)]
    first = [1 if x >= 2 else -1 if x <= -2 else 0 for x in scores]
    voters = [i for i, x in enumerate(first) if x and not where[i][0]]
    deciding = {where[i][1] for i in voters}
    nearest: dict[int, tuple[int, int]] = {}  # block: (distance, minus its label)
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[int | None, int] = {}
        for i in order:
            side, article = where[i]
            if first[i] and not side:
                last[article] = last[None] = i
            elif not first[i]:
                j = last.get(article if article in deciding and article else None)
                if j is not None:
                    nearest[i] = min(nearest.get(i, (len(blocks), 0)), (abs(i - j), -first[j]))
    return [x > 0 or (x == 0 and (not voters or nearest[i][1] < 0)) for i, x in enumerate(first)]


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Blocks(html)
    return " ".join(b[0] for b, good in zip(page.found, labels(page.found, page.boxes), strict=True) if good)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the html column replaced by the main text."""
    columns = [c for c in pages.columns if c not in (html, text)]
    chosen = pages.select(*columns, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(columns))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*columns, text])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)
    return chosen.mapInArrow(run, f"{kinds}, `{text}` string" if kinds else f"`{text}` string")

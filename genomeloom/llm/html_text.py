"""Visible text of web pages, laid out as a reader sees it.

Method. A tokeniser feeds a tree builder that keeps the open elements, adds the end tags
that HTML implies (a block ends a paragraph, an item the item before, a cell the cell
before, and so on) and ignores end tags that close nothing. Elements that show nothing
(scripts, styles, the head, templates, hidden ones) are dropped with all they hold;
everything else is text to keep, menus and footers included. The renderer separates
blocks by line breaks, paragraphs and headings by a blank line (margins collapse),
marks list items by a dash or their number, indents nested lists and quotes, keeps
preformatted text as it is, and pads the cells of a table's rows to columns. Cells that span
columns or rows take up their places in the grid; every option of a choice stands on its own
line; a line break on an empty line is an empty line; lists count from ``start`` and ``value``.

Each page is worked off on its own, whole, in one pass over its tokens and without
recursion, so deep nesting is no limit; there is no shuffle.

Defined cases. Null html gives null text; empty or textless pages give "". An unclosed
comment or script runs to the end; a "<" that starts no tag is text. Unknown elements
are inline. Cells wider than WIDEST don't widen their column, so one long cell can't blow up all
rows. Where the spans of a table cover more than SPARSE places a cell, they count as 1. Empty lines
at either end of a page or cell are dropped. Repeated rows give repeated results; an empty table an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeloom.sources.shared import table

# Fixed values of HTML: element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
UNSEEN = frozenset("head script style title template noscript iframe noframes object audio video canvas svg math datalist".split())
LINES = frozenset("option optgroup".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup hr html legend li main menu nav section summary".split())
#: start tag: (open elements it ends, elements beyond which it doesn't look)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption html body template".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/><]*)([^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
MAY_HIDE = re.compile("hidden|style", re.I)
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Fixed values of HTML: the most columns and rows that a cell spans.
MAX_COLUMNS, MAX_ROWS = 1000, 65534
WIDEST, SPARSE = 200, 100
SPACES = re.compile(r"[ \t\n\r\f]+")


def _attributes(s: str) -> dict[str, str]:
    """Values by lower-case name, the first of equal names; "" without a value."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(s):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _hidden(s: str) -> bool:
    if not MAY_HIDE.search(s):
        return False
    found = _attributes(s)
    return "hidden" in found or bool(HIDES.search(found.get("style", "")))


def _number(s: str | None) -> int | None:
    """The whole number that ``s`` begins with."""
    m = re.match(r"\s*([+-]?[0-9]{1,9})", s or "")
    return int(m[1]) if m else None


def _span(attributes: str) -> tuple[int, int]:
    """Columns and rows that a cell spans; 0 rows: down to the last."""
    if "span" not in attributes.lower():
        return 1, 1
    found = _attributes(attributes)
    columns, rows = _number(found.get("colspan")), _number(found.get("rowspan"))
    columns = columns if columns is not None and columns > 0 else 1
    rows = rows if rows is not None and rows >= 0 else 1
    return min(columns, MAX_COLUMNS), min(rows, MAX_ROWS)


class _Flow:
    """Lines of one block context: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""
        self.space = False

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s == " ":
            self.space = bool(self.line)
            return
        if s[0] == " ":
            self.space, s = bool(self.line), s[1:]
        tail = s.endswith(" ")
        if self.space:
            self.line.append(" ")
        self.line.append(s[:-1] if tail else s)
        self.space = tail

    def end_line(self) -> None:
        if self.line:
            self._emit("".join(self.line))
            self.line = []
        self.space = False

    def _emit(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        lead = "".join(self.indent)
        if self.mark:
            lead = lead[: len(lead) - len(self.mark)] + self.mark
            self.mark = ""
        self.lines.append(lead + s)

    def line_break(self) -> None:
        if self.line:
            self.end_line()
        elif self.mark:
            self._emit("")
        elif self.lines:
            self.lines.extend([""] * (1 + self.gap))
            self.gap = 0

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced:
            self.gap = 1

    def preformatted(self, s: str) -> None:
        parts = s.split("\n")
        for part in parts[:-1]:
            self.line.append(part)
            self._emit("".join(self.line))
            self.line = []
        if parts[-1]:
            self.line.append(parts[-1])

    def done(self) -> str:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        first = next((k for k, x in enumerate(self.lines) if x.strip()), 0)
        return "\n".join(self.lines[first:])


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """(first column, columns, lines) of the cells (text, columns, rows) of a table: each in the first place of its row that no cell above reaches into."""
    height, cells = len(rows), sum(map(len, rows))
    fit = lambda i, r: min(r or height, height - i)
    dense = sum(c * fit(i, r) for i, row in enumerate(rows) for _, c, r in row) <= SPARSE * cells
    below: dict[int, int] = {}
    out = []
    for i, row in enumerate(rows):
        at, places = 0, []
        for text, c, r in row:
            c, r = (c, fit(i, r)) if dense else (1, 1)
            while below.get(at, 0) > i:
                at += 1
            places.append((at, c, text.split("\n")))
            if r > 1:
                below.update(dict.fromkeys(range(at, at + c), i + r))
            at += c
        out.append(places)
    return out


def _aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table: every column as wide as its widest line, two spaces between; rows without text are left out."""
    placed = _placed(rows)
    wide = [0] * max((at + c for row in placed for at, c, _ in row), default=0)
    sized = [(c, at, size) for row in placed for at, c, lines in row if (size := max(map(len, lines))) <= WIDEST]
    for c, at, size in sorted(sized, key=lambda x: x[0]):
        lacks = size - sum(wide[at : at + c]) - 2 * (c - 1)
        if lacks > 0:
            wide[at + c - 1] += lacks
    begin = [0, *accumulate(w + 2 for w in wide)]
    out = []
    for row in placed:
        if not any(any(lines) for _, _, lines in row):
            continue
        for i in range(max(len(lines) for _, _, lines in row)):
            line = ""
            for at, _, lines in row:
                if i < len(lines) and lines[i]:
                    line = line.ljust(max(begin[at], len(line) + 2 if line else 0)) + lines[i]
            out.append(line.rstrip())
    return out


class _Page:
    def __init__(self) -> None:
        self.flows = [_Flow()]
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.unseen = 0
        self.lists: list[list] = []
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.spans: list[tuple[int, int]] = []
        self.pre = 0

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._end_within({"p"}, SCOPE)
        if name in IMPLIED:
            self._end_within(*IMPLIED[name])
        if name in ("td", "th") and self.tables and not (self.open and "tr" in self.open[-3:]):
            self.start("tr", "")
        if name == "br":
            if not self.unseen:
                self.flows[-1].line_break()
            return
        if name == "hr" and not self.unseen:
            self.flows[-1].block(False)
            self.flows[-1].text("---")
            self.flows[-1].block(False)
        if name in VOID:
            return
        gone = self.unseen or name in UNSEEN or (attributes and _hidden(attributes))
        self.open.append(name)
        self.count[name] += 1
        if gone:
            self.unseen += 1
            return
        flow = self.flows[-1]
        if name == "table":
            flow.block(True)
            self.tables.append([])
        elif name == "tr" and self.tables:
            self.tables[-1].append([])
        elif name in ("td", "th") and self.tables:
            self.flows.append(_Flow())
            self.spans.append(_span(attributes))
        elif name in ("ul", "ol", "menu", "dir"):
            flow.block(not self.lists)
            first = _number(_attributes(attributes).get("start")) if name == "ol" and attributes else None
            self.lists.append([name == "ol", 0 if first is None else first - 1])
        elif name == "li":
            flow.block(False)
            if self.lists:
                value = _number(_attributes(attributes).get("value")) if attributes else None
                self.lists[-1][1] = self.lists[-1][1] + 1 if value is None else value
            mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] else "- "
            flow.indent.append(" " * len(mark))
            flow.mark = mark
        elif name in ("blockquote", "dd"):
            flow.block(name in SPACED)
            flow.indent.append("    " if name == "dd" else "> ")
        elif name in LINES:
            flow.block(False)
        elif name in BLOCK:
            flow.block(name in SPACED)
            self.pre += name == "pre"

    def end(self, name: str) -> None:
        if self.count[name]:
            k = len(self.open) - 1
            while self.open[k] != name:
                k -= 1
            self._end_to(k)

    def _end_within(self, names: set[str], stop: set[str]) -> None:
        """End the outermost open element of ``names`` that no element of ``stop`` encloses from within."""
        if not any(self.count[name] for name in names):
            return
        found = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in names:
                found = k
            elif self.open[k] in stop:
                break
        if found is not None:
            self._end_to(found)

    def _end_to(self, k: int) -> None:
        while len(self.open) > k:
            name = self.open.pop()
            self.count[name] -= 1
            if self.unseen:
                self.unseen -= 1
                continue
            flow = self.flows[-1]
            if name in ("td", "th") and self.tables and len(self.flows) > 1:
                self.flows.pop()
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append((flow.done(), *self.spans.pop()))
            elif name == "table" and self.tables:
                for line in _aligned(self.tables.pop()):
                    flow.end_line()
                    flow._emit(line)
                flow.block(True)
            elif name in ("ul", "ol", "menu", "dir"):
                self.lists.pop()
                flow.block(not self.lists)
            elif name in ("li", "blockquote", "dd"):
                flow.end_line()
                flow.mark = ""
                if flow.indent:
                    flow.indent.pop()
                flow.block(name == "blockquote")
            elif name in LINES:
                flow.block(False)
            elif name in BLOCK:
                flow.block(name in SPACED)
                self.pre -= name == "pre"

    def text(self, s: str) -> None:
        if self.unseen:
            return
        if self.pre:
            self.flows[-1].preformatted(s)
        else:
            self.flows[-1].text(s)

    def done(self) -> str:
        self._end_to(0)
        return self.flows[0].done()


def visible_text(source: str) -> str:
    """The text that ``source`` shows, laid out."""
    page, at, size = _Page(), 0, len(source)
    while at < size:
        m = TOKEN.match(source, at)
        at = m.end()
        name = m[2]
        if name is None:
            s = m[0]
            if not s.startswith(("<!", "<?")) and s:
                page.text(html.unescape(s) if "&" in s else s)
            continue
        name = name.lower()
        if m[1]:
            page.end(name)
            continue
        attributes = m[3]
        page.start(name, attributes)
        if name in ("pre", "textarea") and source.startswith(("\n", "\r\n"), at):
            at = source.index("\n", at) + 1
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            inner = source[at : close.start()] if close else source[at:]
            if name in ("textarea", "xmp"):
                page.text(html.unescape(inner))
            at = close.start() if close else size
            if not close:
                page.end(name)
        elif attributes.endswith("/") and name not in BLOCK and name not in VOID and name in ("svg", "math"):
            page.end(name)
    return page.done()


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines) of every page of ``pages`` (page_id, html)."""

    def rows(batches):
        for batch in batches:
            texts = [None if x is None else visible_text(x) for x in batch.column(1).to_pylist()]
            lines = [0 if not t else t.count("\n") + 1 for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_lines"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(rows, "page_id long, text string, n_lines long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))

"""Layout-aware text of HTML pages.

A tokeniser feeds a tree builder with implied tags; the tree is then rendered as what a reader would
see: blocks on lines of their own, paragraphs apart, list items with markers and indents, table
cells in aligned columns.  Nothing recurses, so nesting of any depth works.  Where an element of a name
is open is known without a search, so that time is linear in the page whatever its end tags; what layout
adds is bounded for each line and each cell.

Defined results
---------------
* Hidden, with all their content: script, style, template, head but not its title, svg, math,
  object, iframe, audio, video, canvas, datalist; elements with the attribute ``hidden``, with
  ``aria-hidden=true``, or with ``display:none`` or ``visibility:hidden`` in their style; comments,
  doctypes and processing instructions.
* Of a select's options the first that is ``selected`` is shown, else the first; all if it is ``multiple``.
* The title is the first line if ``title`` is asked for, else hidden (the default).
* ``noscript`` is shown, as no script runs.
* White space is collapsed outside ``pre`` and ``textarea``; a no-break space stays a space.
* Unclosed elements end with their parents; stray end tags are passed over; ``</p>`` and ``</br>``
  without a start break the line; a ``<`` that begins no tag is text.
* Lists, quotes and definitions indent up to ``DEEPEST`` levels; deeper ones as the last of these.
* In a table, rows whose cells have one line each are aligned.  A column is as wide as its widest cell of
  at most ``WIDEST`` columns; wider cells stick out.  A cell over several columns (``colspan``) is padded to
  their common width, to ``4 * WIDEST`` at most; ``rowspan`` is not looked at.  In other rows (layouts of
  paragraphs, tables in cells) the cells come one below the other.
* A null or empty page has the text "".  Every row gives one row, also where ids repeat; an empty
  table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

WIDEST, DEEPEST = 60, 16

# Groups: end tag's name; start tag's name, attributes; text.  What matches none is passed over.
_token = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>?|([^<]+|<)", re.S).finditer
_attribute = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?").findall
_unseen = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I).search
_blank = re.compile(r"[ \t\n\r\f]+").sub

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template head svg math object iframe audio video canvas datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag closes these open elements, looking no further than the given ones.
CLOSES: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset({"li"}), LISTS),
    **{t: (frozenset({"dt", "dd"}), frozenset({"dl"})) for t in ("dt", "dd")},
    **{t: (frozenset({"td", "th"}), frozenset({"table", "tr"})) for t in ("td", "th")},
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    **{t: (frozenset({"thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "body": (frozenset({"head"}), frozenset()),
}
STOPS_P = frozenset("table td th caption button object template html body".split())
SECTIONS = ("thead", "tbody", "tfoot")


class Canvas:
    """Lines of text as they are laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.blank = True
        self.indents: list[str] = []
        self.marker = ""

    @property
    def prefix(self) -> str:
        return "".join(self.indents[:DEEPEST])

    def text(self, s: str, verbatim: bool) -> None:
        if verbatim:
            first, *rest = s.split("\n")
            self.now.append(first)
            for x in rest:
                self.end(True)
                self.now.append(x)
            self.blank = False
            return
        s = _blank(" ", s)
        if self.blank:
            s = s.lstrip(" ")
        if s:
            self.now.append(s)
            self.blank = s[-1] == " "

    def end(self, always: bool = False) -> None:
        """Ends the line, if there is one."""
        line = "".join(self.now).replace("\xa0", " ").rstrip()
        self.now, self.blank = [], True
        if line or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.marker or self.prefix) + line if line else "")
            if line:
                self.marker = ""

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap |= spaced

    def done(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Table:
    def __init__(self):
        #: By row: text of each cell, and over how many columns it goes.
        self.rows: list[list[tuple[str, int]]] = []

    def lines(self) -> list[str]:
        width: dict[int, int] = defaultdict(int)  # of the columns that a cell begins in
        aligned = [all("\n" not in c for c, _ in row) for row in self.rows]
        for row, even in zip(self.rows, aligned, strict=True):
            at = 0
            for cell, span in row if even else ():
                size = _width(cell)
                width[at] = max(width[at], size if span == 1 and size <= WIDEST else 0)
                at += span
        out = []
        for row, even in zip(self.rows, aligned, strict=True):
            if not even:
                out += [line for cell, _ in row for line in cell.split("\n")]
                continue
            at, cells = 0, []
            for cell, span in row:
                own = [width[k] for k in range(at, at + span) if k in width]
                room = min(sum(own) + 3 * (len(own) - 1), 4 * WIDEST)
                cells.append(cell + " " * (room - _width(cell)))
                at += span
            if row:
                out.append(" | ".join(cells).rstrip())
        return out


class Node:
    """An element; its children are elements and texts."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, wanted: str) -> str | None:
        for name, value in _attribute(self.attributes) if self.attributes else ():
            if name.lower() == wanted:
                return value.strip("\"'")
        return None

    def unseen(self) -> bool:
        for name, value in _attribute(self.attributes) if self.attributes else ():
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _unseen(value):
                return True
        return False


class Builder:
    """The tree of a page, with implied tags."""

    def __init__(self):
        self.root = Node("#root")
        self.stack = [self.root]
        #: By name: depths at which such elements are open, the innermost last.
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.title = ""

    def last(self, tags: Iterable[str]) -> int:
        """Depth of the innermost open element of some names; 0 if there is none."""
        return max([self.depths[t][-1] for t in tags if self.depths.get(t)], default=0)

    def push(self, tag: str, attributes: str = "") -> None:
        node = Node(tag, attributes)
        self.stack[-1].children.append(node)
        self.depths[tag].append(len(self.stack))
        self.stack.append(node)

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES:
            inner, limit = CLOSES[tag]
            depth = self.last(inner)
            if depth > self.last(limit):
                self.close_to(depth)
        if tag in BLOCK and self.depths.get("p") and (depth := self.depths["p"][-1]) > self.last(STOPS_P):
            self.close_to(depth)
        table = self.last(("table",))
        if table and tag in ("td", "th") and self.last(("tr",)) < table:
            self.push("tr")
        if table and tag == "tr" and self.last(SECTIONS) < table:
            self.push("tbody")
        if tag in VOID:
            self.stack[-1].children.append(Node(tag, attributes))
        else:
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        depth = self.last((tag,))
        limit = 0 if tag in ("table", "body", "html") else self.last(("table", "td", "th") if tag in BLOCK else ("table",))
        if depth > limit:
            self.close_to(depth)
        elif tag in ("br", "p"):
            self.stack[-1].children.append(Node(tag if tag == "p" else "wbr-line"))

    def text(self, s: str) -> None:
        self.stack[-1].children.append(s)

    def feed(self, page: str) -> Builder:
        at = 0
        while at is not None:
            tokens, at = _token(page, at), None
            for m in tokens:
                if m[4] is not None:
                    self.text(m[4])
                elif m[1] is not None:
                    self.end(m[1].lower())
                elif m[2] is not None:
                    tag = m[2].lower()
                    self.start(tag, m[3])
                    if tag in RAW:  # its content isn't markup; tokens begin again behind it
                        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, m.end())
                        at = end.start() if end else len(page)
                        if tag in ("textarea", "noembed", "noframes", "xmp"):
                            self.text(page[m.end() : at])
                        elif tag == "title" and not self.title:
                            self.title = _blank(" ", html.unescape(page[m.end() : at])).strip()
                        break
        return self


class Renderer:
    """Writes the visible text of a tree, as elements are entered and left."""

    def __init__(self):
        self.canvas = [Canvas()]
        self.lists: list[int | None] = []
        self.tables: list[Table] = []
        self.verbatim = 0
        self.closed: set[int] = set()  # options that a select doesn't show

    def run(self, root: Node) -> str:
        work: list[tuple[Node | str, bool]] = [(root, False)]
        while work:
            node, leaving = work.pop()
            if isinstance(node, str):
                self.canvas[-1].text(html.unescape(node) if "&" in node else node, self.verbatim > 0)
            elif leaving:
                self.leave(node)
            elif not self.hidden(node):
                self.enter(node)
                work.append((node, True))
                work.extend((c, False) for c in reversed(node.children))
        return self.canvas[0].done()

    def hidden(self, node: Node) -> bool:
        return node.tag in HIDDEN or node.tag == "title" or id(node) in self.closed or node.unseen()

    def choose(self, select: Node) -> None:
        """Hides the options that a closed list doesn't show."""
        options, work = [], list(reversed(select.children))
        while work:
            node = work.pop()
            if isinstance(node, Node) and node.tag != "select":
                options += [node] if node.tag == "option" else []
                work.extend(reversed(node.children))
        if select.attribute("multiple") is None:
            shown = next((o for o in options if o.attribute("selected") is not None), options[0] if options else None)
            self.closed.update(id(o) for o in options if o is not shown)

    def enter(self, node: Node) -> None:
        tag, now = node.tag, self.canvas[-1]
        if tag in ("br", "wbr-line"):
            now.end(True) if tag == "br" else now.end()
        elif tag == "hr":
            now.block(True)
        elif tag == "table":
            now.block(True)
            self.tables.append(Table())
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.canvas.append(Canvas())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag == "caption":
            now.block(False)
        elif tag == "select":
            self.choose(node)
        elif tag in BLOCK:
            now.block(tag in SPACED and not (tag in LISTS and self.lists))
            if tag in LISTS:
                self.lists.append(0 if tag == "ol" else None)
                if len(self.lists) > 1:
                    now.indents.append("  ")
            elif tag == "li":
                if self.lists and self.lists[-1] is not None:
                    self.lists[-1] += 1
                now.marker = now.prefix + (f"{self.lists[-1]}. " if self.lists and self.lists[-1] is not None else "- ")
            elif tag in ("dd", "blockquote"):
                now.indents.append("  " if tag == "dd" else "> ")
        if tag in ("pre", "textarea", "xmp"):
            self.verbatim += 1

    def leave(self, node: Node) -> None:
        tag, now = node.tag, self.canvas[-1]
        if tag in ("pre", "textarea", "xmp"):
            self.verbatim -= 1
        if tag in ("td", "th") and self.tables and len(self.canvas) > 1:
            span = node.attribute("colspan") or ""
            self.tables[-1].rows[-1].append((self.canvas.pop().done(), min(max(int(span), 1), 1000) if span.isascii() and span.isdigit() and len(span) < 6 else 1))
        elif tag == "table":
            for line in self.tables.pop().lines():
                now.now.append(line)
                now.end(True)
            now.block(True)
        elif tag == "caption":
            now.block(False)
        elif tag in BLOCK and tag != "hr":
            now.block(tag in SPACED and not (tag in LISTS and len(self.lists) > 1))
            if tag in LISTS:
                self.lists.pop()
                if self.lists:
                    now.indents.pop()
            elif tag == "li":
                now.marker = ""
            elif tag in ("dd", "blockquote"):
                now.indents.pop()


def render(page: str | None, title: bool = False) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    tree = Builder().feed(page)
    return "\n\n".join(filter(None, (tree.title if title else "", Renderer().run(tree.root))))


def _run(title: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(p, title) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])],
                ["id", "text", "n_chars", "text_sha256"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", title: bool = False) -> DataFrame:
    """id, text, n_chars, text_sha256: one row for each row of ``pages``."""
    _io.bounded_batches(pages.sparkSession)
    pages = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return pages.mapInArrow(_run(title), f"id {pages.schema['id'].dataType.simpleString()}, text string, n_chars bigint, text_sha256 string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")

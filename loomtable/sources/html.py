"""Tables and links from HTML pages, on the standard library's parser.

One page is parsed in one piece in an Arrow-batched Python table function;
what can be told from the grid afterwards (types of links, cleaning) is left
to SQL expressions.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "li": {"li"}, "p": {"p"}, "option": {"option"}}
HIDDEN = {"script", "style", "template"}


class Node:
    __slots__ = ("tag", "attrs", "parts", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.up, self.parts = tag, attrs, up, []

    def walk(self, stop: frozenset[str] = frozenset()):
        """Elements below, in document order; those named in ``stop`` are given but not entered."""
        for p in self.parts:
            if isinstance(p, Node):
                yield p
                if p.tag not in stop:
                    yield from p.walk(stop)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in CLOSES.get(tag, ()):
            self.at = self.at.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.parts.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            if tag in ("td", "th", "tr", "li", "p") and node.tag == "table":
                return  # the end belongs to a cell outside this table
            node = node.up
        if node is not self.root:
            self.at = node.up

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def text_and_links(node: Node) -> tuple[str, list[tuple[int, int, str]]]:
    """Visible text with runs of white space as one space, and its links as (start, end, href)."""
    out: list[str] = []
    links: list[tuple[int, int, str]] = []
    size = 0

    def add(data: str):
        nonlocal size
        for i, word in enumerate(data.split()):
            if size and (i or data[0].isspace() or gap[0]):
                out.append(" ")
                size += 1
            gap[0] = False
            out.append(word)
            size += len(word)
        if data and (data[-1].isspace() or data.isspace()):
            gap[0] = True

    gap = [False]

    def visit(n: Node):
        for p in n.parts:
            if isinstance(p, str):
                add(p)
            elif p.tag not in HIDDEN and "reference" not in p.attrs.get("class", "").split():
                if p.tag in ("br", "p", "div", "li", "td", "th", "tr"):
                    gap[0] = True
                before = size
                visit(p)
                if p.tag == "a" and size > before:
                    start = before + 1 if before and "".join(out)[before : before + 1] == " " else before
                    links.append((start, size, p.attrs.get("href", "")))
                if p.tag in ("p", "div", "li", "td", "th", "tr"):
                    gap[0] = True

    visit(node)
    return "".join(out), links


#: The HTML standard's largest spans.
MOST = {"rowspan": 65_534, "colspan": 1000}


def _span(cell: Node, name: str) -> int:
    try:
        return max(1, min(MOST[name], int(cell.attrs.get(name, "1"))))
    except ValueError:
        return 1


def own_rows(table: Node) -> list[Node]:
    return [n for n in table.walk(frozenset({"table"})) if n.tag == "tr"]


def grid(table: Node) -> list[list[Node | None]]:
    """Cells by row and column with spans spread out; the first cell to claim a place keeps it; short rows end in None."""
    rows = own_rows(table)
    at: dict[tuple[int, int], Node] = {}
    for r, row in enumerate(rows):
        c = 0
        for cell in (p for p in row.parts if isinstance(p, Node) and p.tag in ("td", "th")):
            while (r, c) in at:
                c += 1
            for i in range(min(_span(cell, "rowspan"), len(rows) - r)):
                for j in range(_span(cell, "colspan")):
                    at.setdefault((r + i, c + j), cell)
            c += _span(cell, "colspan")
    width = max((c for _, c in at), default=-1) + 1
    return [[at.get((r, c)) for c in range(width)] for r in range(len(rows))]


def split_on_subheaders(rows: list[list[Node | None]]) -> list[tuple[list, list]]:
    """(head rows, body rows) of each subtable: a row of header cells only, below a body row, begins a new one; one that is a single spanning cell is a body row instead."""
    out: list[tuple[list, list]] = [([], [])]
    for row in rows:
        is_head = bool(row) and all(c is not None and c.tag == "th" for c in row)
        single = len({id(c) for c in row}) == 1 and len(row) > 1
        head, body = out[-1]
        if is_head and not (single and body):
            if body:
                out.append(([row], []))
            else:
                head.append(row)
        else:
            body.append(row)
    return [t for t in out if t[1]]


def split_on_repeats(head: list, body: list[list[Node | None]]) -> list[tuple[list, list]]:
    """Tables of careers: a body row whose first three cells are one spanning cell with text, or repeat one text, begins a new part that keeps the head; the row itself is dropped."""
    text = lambda c: text_and_links(c)[0] if c is not None else ""
    parts: list[list] = [[]]
    for row in body:
        first = [text(c) for c in row[:3]]
        if len(row) > 3 and first[0] and len(set(first)) == 1:
            parts.append([])
        else:
            parts[-1].append(row)
    return [(head, p) for p in parts if p]


def page_tables(html: str, restrict: list[str] | None = None, careers: bool = False) -> tuple[str, list[dict]]:
    """Page title and tables: head and body (rows of text), links of body cells, caption.  ``restrict``: classes of which a table must have one; none: all tables.  ``careers``: split tables of careers too."""
    root = tree(html)
    if not any(n.tag == "html" for n in root.walk()):
        return "", []
    title = next((text_and_links(n)[0] for n in root.walk() if n.tag == "h1"), "")
    found, section = [], ""
    for node in root.walk():
        if node.tag in ("h2", "h3"):
            section = text_and_links(node)[0]
        if node.tag != "table" or restrict and not set(restrict) & set(node.attrs.get("class", "").split()):
            continue
        caption = next((text_and_links(n)[0] for n in node.walk(frozenset({"table"})) if n.tag == "caption"), node.attrs.get("summary", ""))
        parts = split_on_subheaders(grid(node))
        if careers:
            parts = [p for head, body in parts for p in split_on_repeats(head, body)]
        for head, body in parts:
            cell = lambda c: text_and_links(c) if c is not None else ("", [])
            h, b = ([[cell(c) for c in row] for row in rows] for rows in (head, body))
            if not any(t for row in h + b for t, _ in row):
                continue
            links = [(r, c, s, e, u) for r, row in enumerate(b) for c, (_, ls) in enumerate(row) for s, e, u in ls]
            found.append({"head": [[t for t, _ in row] for row in h], "body": [[t for t, _ in row] for row in b], "links": links, "caption": caption, "section": section})
    return title, found


TABLES = (
    "table_id string, url string, pg_title string, section_title string, caption string, head array<array<string>>, body array<array<string>>, num_cols int, num_rows int, "
    "links array<struct<ri: int, ci: int, start: int, end: int, href: string>>"
)


def tables(pages: DataFrame, restrict: list[str] | None = None, careers: bool = False) -> DataFrame:
    """Tables of pages (url, html); ids are ``url#n``.  Pages that are not HTML, and null ones, have none."""

    def run(batches):
        for batch in batches:
            rows = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                title, found = page_tables(html or "", restrict, careers)
                for n, t in enumerate(found):
                    width = max(len(r) for r in t["body"])
                    links = [{"ri": r, "ci": c, "start": s, "end": e, "href": u} for r, c, s, e, u in t["links"]]
                    rows.append((f"{url}#{n}", url, title, t["section"], t["caption"], t["head"], t["body"], width, len(t["body"]), links))
            link = pa.struct([("ri", pa.int32()), ("ci", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("href", pa.string())])
            grid_ = pa.list_(pa.list_(pa.string()))
            types = [pa.string()] * 5 + [grid_, grid_, pa.int32(), pa.int32(), pa.list_(link)]
            names = ["table_id", "url", "pg_title", "section_title", "caption", "head", "body", "num_cols", "num_rows", "links"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return pages.select("url", "html").mapInArrow(run, TABLES)


def links(pages: DataFrame) -> DataFrame:
    """Every ``<a href="...">`` of each page, one row each, the other columns kept."""
    rest = [c for c in pages.columns if c != "html"]
    return pages.select(*rest, F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))).alias("href"))


def surface_links(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Further links: cells whose whole text is the anchor text of a link on the same page (page, surface, href); of several targets the commonest."""
    best = links.filter("surface <> ''").groupBy("page", "surface", "href").agg(F.count("*").alias("n")).groupBy("page", "surface").agg(F.min_by("href", F.struct((-F.col("n")).alias("n"), F.col("href"))).alias("href"))
    return cells.join(best, (cells["page"] == best["page"]) & (cells["text"] == best["surface"])).select(cells["*"], best["href"])

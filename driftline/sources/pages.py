"""Pages as dated sections.

A page is read once into its outline: the text of its content root, and the parts of it (headings, labels, table cells,
sentences) with their offsets. Its sections are cut in the same task, by one pass over its parts for each way to read it, as
no page needs another: pages are dealt once, and neither parts nor texts are shuffled. Only pages whose embedded index may
replace what was cut go on, to be read relationally.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import dates as D
from driftline.plans.store import materialise

#: Elements and roles that are no text for readers, elements that end a line, containers of content, the least
#: size of such a container, ids that are no anchors, the limits of sections, labels and sentences.
SILENT = frozenset("script style noscript template svg path canvas nav header footer form input select option textarea iframe video audio source picture link meta head img".split())
SILENT_ROLES = frozenset("navigation banner contentinfo search".split())
BLOCKS = frozenset(
    "address article aside blockquote details div dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section summary table tbody tfoot thead tr ul".split()
)
CONTENT_TAGS, CONTENT_IDS, CONTENT_CLASSES = ("main", "article"), ("content", "main-content", "mainContent"), ("markdown-body", "prose")
HEADINGS, CELLS = frozenset("h1 h2 h3 h4 h5 h6".split()), ("td", "th")
MIN_CONTENT, MIN_BODY, MAX_SECTION, MAX_LABEL, HEADING_GAP, MAX_SENTENCES, LONG_LINE, MAX_LINE = 200, 16, 20_000, 80, 120, 200, 24, 120
GENERIC_IDS = frozenset("app body content content-area main main-content mainContent page page-title root __next".split())
ANCHOR, NO_ANCHOR = re.compile(r"^[\w][\w.:-]*$"), re.compile(r"(^|-)_[Rr]_|^radix-")
#: What an element is, looked up once: silent, a block, a heading, a cell, a leaf without being a block.
IS_SILENT, IS_BLOCK, IS_HEADING, IS_CELL, IS_LEAF = 1, 2, 4, 8, 16
KINDS = {t: IS_SILENT * (t in SILENT) + IS_BLOCK * (t in BLOCKS) + IS_HEADING * (t in HEADINGS) + IS_CELL * (t in CELLS) + IS_LEAF * (t in ("time", "button")) for t in (*SILENT, *BLOCKS, *HEADINGS, *CELLS, "time", "button")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which column of a table has the day of the event, by words of its header, best first.
DATE_COLUMNS = (
    ("announced", "announcement", "notice", "deprecated", "deprecation", "published", "released"),
    ("retirement", "retired", "sunset", "shutdown", "end of life", "eol", "effective", "expires"),
    ("date",),
)
#: Keys of an embedded index that hold an entry's address, day and name, in order of preference.
LINK_KEYS = ("href", "url", "link", "permalink", "slug", "path")
DATE_KEYS = ("date", "published", "publishedat", "published_at", "datepublished", "publishdate", "releasedate", "released", "pubdate")
LABEL_KEYS = ("title", "name", "version", "label", "heading")
#: Hints that name the way to read a page, first of all.
HINTS = {"sections": "headings", "table": "tables", "month_then_day": "marks", "embedded_json_index": "json"}

#: Characters of pages with an embedded index that a task sorts, about: tasks are more as pages are, so none holds more.
INDEXED_OF_TASK = 16_000_000
#: Tags that have no angles or slashes but their own and quoted values only; elements whose content is no markup.
PLAIN_TAG = re.compile(r"""<(/)?([A-Za-z][A-Za-z0-9]*)(?(1)|((?:[ \t\n\r\f]+[A-Za-z][A-Za-z0-9_-]*=(?:"[^"<>]*"|'[^'<>]*'))*)[ \t\n\r\f]*)>""")
PLAIN_ATTRIBUTE = re.compile(r"""([A-Za-z][A-Za-z0-9_-]*)=(?:"([^"]*)"|'([^']*)')""")
OPAQUE = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
_SPACE, _PRIVATE, _SENTENCE, _DIGIT = re.compile(r"\s+"), re.compile("[\u200b-\u200f\ufeff\ue000-\uf8ff]"), re.compile(r"[^\n.!?]+(?:[.!?]+|\n|$)"), re.compile(r"\d")
#: What the JVM takes for white space, and for the end of a last line besides.
_BLANK, _LINE_ENDS = " \t\n\x0b\f\r", ("\x85", "\u2028", "\u2029")

PARTS = "array<struct<kind:string,level:int,title:string,anchor:string,start:int,end:int,lead:boolean,grid:int,line:int,cell:int,header:boolean>>"

DATE_FIELDS = tuple(c.split()[0] for c in D.DATE.split(", "))
DATED_PARTS = PARTS.removesuffix(">>") + f",d:struct<{','.join(c.replace(' ', ':') for c in D.DATE.split(', '))}>>>"


#: A section as it is cut from a page.
SECTION = "title:string,raw_text:string,anchor:string,event_date:date,date_precision:string,date_text:string,year_from:string"
CUT = f"way string, index_from int, sections array<struct<{SECTION}>>"


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "celled", "header")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.celled, self.header = False, None  # of a row: whether a cell of it was passed, whether its cells are headers


def _contains(node: Node) -> tuple[bool, ...]:
    """The ways in which an element may be a container of content, in order of preference."""
    if node.tag not in CONTENT_TAGS and not node.attrs:
        return ()
    own = node.attrs.get("class", "").split()
    return (node.tag == CONTENT_TAGS[0], node.tag == CONTENT_TAGS[1], node.attrs.get("role") == "main", *(node.attrs.get("id") == i for i in CONTENT_IDS), *(c in own for c in CONTENT_CLASSES))


_CONTENT_CLASSES = frozenset(CONTENT_CLASSES)


class _Tree(HTMLParser):
    """Elements and their texts; ends that markup leaves out are put in where a block, a row or a cell begins."""

    #: what an element ends if it is open, and what it looks no further than
    CLOSES = {"li": ("li", "ul ol"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select")}
    CLOSES = {tag: (frozenset(tags.split()), frozenset(within.split())) for tag, (tags, within) in CLOSES.items()}
    OPEN_P, NO_P = frozenset(["p"]), frozenset("td th li div table button".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.title: Node | None = None
        self.bodies: list[Node] = []
        self.contained = False  # whether any element may be a container of content

    def read(self, html: str) -> None:
        """Tags and texts of a page; where markup is plain, one pattern finds them all, several times as fast as the parser."""
        found = PLAIN_TAG.split(html) if "&" not in html else ()
        if 4 * html.count("<") + 1 != len(found) or not OPAQUE.isdisjoint(names := [t.lower() for t in found[2::4]]):
            self.feed(html)
            self.close()
            return
        if found[0]:
            self.handle_data(found[0])
        for end, tag, attrs, text in zip(found[1::4], names, found[3::4], found[4::4], strict=True):
            if end:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, [(k.lower(), a or b) for k, a, b in PLAIN_ATTRIBUTE.findall(attrs)] if attrs else ())
            if text:
                self.at.children.append(text)

    def _close(self, tags: frozenset[str], within: frozenset[str]) -> None:
        node = self.at
        while node.parent and node.tag not in within:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._close(self.OPEN_P, self.NO_P)
        if tag in self.CLOSES:
            self._close(*self.CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs} if attrs else {}, self.at)
        self.at.children.append(node)
        if tag == "title" and self.title is None:
            self.title = node
        elif tag == "body":
            self.bodies.append(node)
        if tag in CONTENT_TAGS or attrs and (node.attrs.get("id") in CONTENT_IDS or node.attrs.get("role") == "main" or not _CONTENT_CLASSES.isdisjoint(node.attrs.get("class", "").split())):
            self.contained = True
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID:
            self.at = self.at.parent or self.at

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _walk(root: Node):
    """Nodes and texts in order, with whether they are entered (True) or left."""
    stack: list[tuple[Node | str, bool]] = [(root, True)]
    while stack:
        node, entered = stack.pop()
        yield node, entered
        if entered and isinstance(node, Node):
            stack.append((node, False))
            stack.extend((c, True) for c in reversed(node.children))


def _squeeze(text: str) -> str:
    """One line without zero-width and private characters."""
    return " ".join((text if text.isascii() else _PRIVATE.sub("", text)).split())


def content_root(root: Node) -> Node:
    """The largest container of content, sizes of texts summed from the leaves up; the body where none has MIN_CONTENT characters."""
    size: dict[int, tuple[int, int]] = {}
    body, best, most, order = root, None, 0, 99
    for node, entered in _walk(root):
        if isinstance(node, str) or entered:
            continue
        parts = [(len(c.strip()), bool(c.strip())) if isinstance(c, str) else size.pop(id(c), (0, 0)) for c in node.children]
        chars, pieces = sum(p[0] for p in parts), sum(p[1] for p in parts)
        size[id(node)] = (0, 0) if node.tag in ("script", "style", "template") else (chars, pieces)
        if node.tag == "body":
            body = node
        ways = _contains(node)
        total = chars + max(0, pieces - 1)
        if any(ways) and (total > most or total == most and ways.index(True) < order):
            best, most, order = node, total, ways.index(True)
    return best if best is not None and most >= MIN_CONTENT else body


def _place(part: dict) -> tuple[int, bool]:
    return part["start"], part["kind"] != "heading"


class Outline:
    """Text of a subtree, and its headings, labels and cells by offset.

    Elements lose their parents as they are left, so that trees go with their last use and need no collection of cycles.
    """

    def __init__(self, root: Node) -> None:
        self.out: list[str] = []
        self.size, self.tail, self.parts = 0, "\n", []
        grids = blocks = verbatim = 0
        tables: list[list[int]] = []
        opened: list[str] = []
        stack: list = [root]
        while stack:
            node = stack.pop()
            if type(node) is str:
                plain = node.isprintable() and "  " not in node or verbatim and "pre" in opened[-3:]
                self._add(node if plain else _SPACE.sub(" ", node))
                continue
            if type(node) is Node:
                tag, attrs = node.tag, node.attrs
                kind = KINDS.get(tag, 0)
                if kind & IS_CELL:
                    up = node.parent
                    beside = up.celled or node is root and any(isinstance(c, Node) and c.tag in CELLS for c in up.children[: up.children.index(node)])
                    up.celled = True
                if kind & IS_SILENT or attrs and (attrs.get("aria-hidden") == "true" or "hidden" in attrs or attrs.get("role", "").lower() in SILENT_ROLES):
                    node.parent = None
                    continue
                if kind & IS_CELL and beside:
                    self._add(" | ")
                if (kind & IS_BLOCK or tag == "br") and self.tail != "\n" and self.size:
                    self._line()
                stack.append((node, tag, kind, self.size, blocks))
                if tag == "table":
                    tables.append([grids, -1, 0])
                    grids += 1
                elif tag == "tr" and tables:
                    tables[-1][1:] = [tables[-1][1] + 1, 0]
                elif tag == "pre":
                    verbatim += 1
                opened.append(tag)
                blocks += kind & IS_BLOCK
                stack += node.children[::-1]
                continue
            node, tag, kind, start, before = node
            opened.pop()
            heading, cell = kind & IS_HEADING, kind & IS_CELL and tables
            leaf = kind & (IS_BLOCK | IS_LEAF) and not heading and blocks == before + (kind & IS_BLOCK)
            if heading or cell or leaf:
                text = _squeeze(self._since(start))
                if heading:
                    if text:
                        self._part("heading", start, text, level=int(tag[1]), anchor=self._anchor_below(node))
                elif cell:
                    row, up = tables[-1], node.parent
                    if up.header is None:
                        cells = {c.tag for c in up.children if isinstance(c, Node)}
                        up.header = "th" in cells and "td" not in cells
                    self._part("cell", start, text, grid=row[0], line=row[1], cell=row[2], header=up.header)
                    row[2] += 1
                if leaf and text and len(text) <= MAX_LABEL:
                    self._part("label", start, text, anchor=self._anchor_above(node))
            if tag == "table" and tables:
                tables.pop()
            elif tag == "pre":
                verbatim -= 1
            if kind & IS_BLOCK and self.tail != "\n" and self.size:
                self._line()
            node.parent = None
        self.text = "".join(self.out)
        self.parts.sort(key=_place)
        self._lead()

    def _add(self, text: str) -> None:
        if self.tail in "\n ":
            text = text.lstrip(" ")
        if text:
            self.out.append(text)
            self.size += len(text)
            self.tail = text[-1]

    def _line(self) -> None:
        self.out.append("\n")
        self.size += 1
        self.tail = "\n"

    def _since(self, start: int) -> str:
        if self.out and self.size - len(self.out[-1]) == start:
            return self.out[-1]
        found, at = [], self.size
        for piece in reversed(self.out):
            if at <= start:
                break
            at -= len(piece)
            found.append(piece[max(0, start - at) :])
        return "".join(found[::-1])

    def _part(self, kind: str, start: int, title: str, level: int = 0, anchor: str = "", grid: int = -1, line: int = -1, cell: int = -1, header: bool = False) -> None:
        self.parts.append({"kind": kind, "level": level, "title": title, "anchor": anchor, "start": start, "end": self.size, "lead": False, "grid": grid, "line": line, "cell": cell, "header": header})

    @staticmethod
    def _is_anchor(value: str | None) -> bool:
        return bool(value and ANCHOR.match(value) and not NO_ANCHOR.search(value))

    def _anchor_below(self, node: Node) -> str:
        if self._is_anchor(own := node.attrs.get("id")):
            return own
        if all(type(c) is str for c in node.children):
            return ""
        return next((n.attrs["id"] for n, entered in _walk(node) if entered and isinstance(n, Node) and self._is_anchor(n.attrs.get("id"))), "")

    def _anchor_above(self, node: Node | None) -> str:
        for _ in range(4):
            if node is None:
                break
            if (value := node.attrs.get("id")) and value not in GENERIC_IDS and self._is_anchor(value):
                return value
            node = node.parent
        return ""

    def _lead(self) -> None:
        """Which labels stand right under a heading."""
        last = None
        for p in self.parts:
            if p["kind"] == "heading":
                last = p["end"]
            elif p["kind"] == "label" and last is not None and last <= p["start"]:
                if self.text[last : p["start"]].strip():
                    last = None  # nor do those after it
                else:
                    p["lead"] = True

    def sentences(self) -> list[tuple[int, str]]:
        """Sentences with a digit, by place."""
        found = []
        for m in _SENTENCE.finditer(self.text):
            sentence = m.group().strip()
            if len(sentence) >= MIN_BODY and _DIGIT.search(sentence):
                found.append((m.start() + len(m.group()) - len(m.group().lstrip()), sentence))
        return found

    def with_sentences(self) -> list[dict]:
        """All parts by place, sentences among them."""
        blank = {"kind": "sentence", "level": 0, "anchor": "", "lead": False, "grid": -1, "line": -1, "cell": -1, "header": False}
        return sorted(self.parts + [{**blank, "title": t, "start": at, "end": at + len(t)} for at, t in self.sentences()], key=_place)


def read_page(html: str | None) -> tuple[str, Outline]:
    """Title and outline of a page."""
    tree = _Tree()
    tree.read(html or "")
    title = " ".join("".join(c for c in tree.title.children if isinstance(c, str)).split()) if tree.title else ""
    if tree.contained or len(tree.bodies) > 1:
        return title, Outline(content_root(tree.root))
    return title, Outline(tree.bodies[0] if tree.bodies else tree.root)  # nothing to choose from, so no sizes are summed


def _struct(fields: str) -> pa.StructType:
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "date": pa.date32()}
    return pa.struct([(f.replace(":", " ").split()[0], types[f.replace(":", " ").split()[1]]) for f in fields.split(",")])


def _outlines(html: pa.Array, dated: bool = False) -> pa.Array:
    """Outlines of pages, with the date that each part states if wanted. Arrow makes the rows: by pandas, each field of each part would pass Python."""
    read, known = [(t, o.text, o.with_sentences()) for t, o in map(read_page, html.to_pylist())], {}
    part = _struct(PARTS.removeprefix("array<struct<").removesuffix(">>"))
    if dated:
        part = pa.struct([*part, ("d", _struct(D.DATE))])
        for _, _, parts in read:
            for p in parts:
                if (title := p["title"]) not in known:
                    known[title] = (d := D.read_date(title)) and dict(zip(DATE_FIELDS, d, strict=True))
                p["d"] = known[title]
    columns = {"title": pa.array([t for t, _, _ in read], pa.string()), "text": pa.array([t for _, t, _ in read], pa.string()), "parts": pa.array([p for _, _, p in read], pa.list_(part))}
    return pa.StructArray.from_arrays(columns.values(), columns.keys())


def outline(html: Column, dated: bool = False) -> Column:
    """struct(title, text, parts) of a page: its title, the text of its content root and the parts of it; null html has none.

    With ``dated``, parts have the date that each states (``d``), read where the page is, so that titles are sent once.
    """

    def read(html: pa.Array) -> pa.Array:
        return _outlines(html, dated)

    return F.arrow_udf(read, f"title string, text string, parts {DATED_PARTS if dated else PARTS}")(html)


def html_to_text(html: Column) -> Column:
    """struct(title, text): the text of the content root, one line a block."""
    o = outline(html)
    lines = F.filter(F.transform(F.split(o["text"], "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.struct(o["title"].alias("title"), F.array_join(lines, "\n").alias("text"))


def _bare(text: str) -> str:
    """A text without white space around it, as the JVM's ``^\\s+|\\s+$`` finds it."""
    bare = text.strip(_BLANK)
    if bare and text.endswith(_LINE_ENDS):
        bare = bare[:-1].rstrip(_BLANK) + bare[-1]
    return bare


class Cuts:
    """The sections of a page, by each of the ways to read it; a section is a tuple of the fields of SECTION."""

    def __init__(self, page: Outline, most_sentences: int, known: dict[str, tuple | None]) -> None:
        self.page, self.text, self.most, self.known = page, page.text, most_sentences, known
        self.heads = [p for p in page.parts if p["kind"] == "heading"]

    def _date(self, title: str) -> tuple | None:
        if title not in self.known:
            self.known[title] = D.read_date(title)
        return self.known[title]

    def _alone(self, title: str) -> tuple | None:
        """The date that a title states by itself."""
        d = self._date(title)
        return d if d and D.is_alone(title, d[2]) else None

    def _raw(self, start: int, until: int | None) -> str:
        return _bare(self.text[start : start + MAX_SECTION if until is None else min(until, start + MAX_SECTION)])

    @staticmethod
    def _section(title: str, raw: str, anchor: str | None, d: tuple, year_from: str | None = None) -> tuple:
        return title, raw, anchor or None, d[0], d[1], d[2], year_from

    def headings(self) -> list[tuple]:
        """A section for each dated heading, to the next heading that is dated or not below it.

        A date without a year takes that of the nearest enclosing heading that states one. The headings that enclose are a
        stack by level: a heading closes those of its own and of lower levels.
        """
        dates = [self._date(h["title"]) for h in self.heads]
        if not any(dates):
            return []
        ends: list[int | None] = [None] * len(dates)
        after: list[int | None] = [None] * 7  # the next heading of each level or a higher one
        next_dated = None
        for i in range(len(dates) - 1, -1, -1):
            h = self.heads[i]
            ends[i] = min((x for x in (next_dated, after[h["level"]]) if x is not None), default=None)
            after[h["level"] :] = [h["start"]] * (7 - h["level"])
            next_dated = h["start"] if dates[i] else next_dated
        found, enclosing = [], []
        for h, d, end in zip(self.heads, dates, ends, strict=True):
            while enclosing and enclosing[-1][0] >= h["level"]:
                enclosing.pop()
            own = d and d[0]
            if d:
                year, year_from = next(((y, t) for _, y, t in reversed(enclosing) if y), (None, None)) if d[5] else (None, None)
                body, raw = _bare(self.text[h["end"] : end]), self._raw(h["start"], end)
                if len(body) >= MIN_BODY and raw:
                    found.append(self._section(h["title"], raw, h["anchor"], D.in_year(d, year), year_from))
            enclosing.append((h["level"], own and own.year, h["title"]))
        return found

    def tables(self) -> list[tuple]:
        """A section for each table row that states a day, taken from the column whose header suits best, the leftmost among equals."""
        rows, names, heads, above = {}, {}, {}, None
        for p in self.page.parts:
            if p["kind"] == "heading":
                above = p
            elif p["kind"] == "cell" and p["header"]:
                heads[p["grid"]] = min(p["line"], heads.get(p["grid"], p["line"]))
                at = (p["grid"], p["line"], p["cell"])
                names[at] = max(p["title"].lower(), names.get(at, ""))
            elif p["kind"] == "cell":
                rows.setdefault((p["grid"], p["line"]), []).append((p["cell"], p, above))
        found, ranks = [], {}
        for (grid, line), cells in rows.items():
            cells.sort(key=lambda c: c[0])
            best = None
            for n, p, _ in cells:
                if (d := self._date(p["title"])) and d[0]:
                    name = names.get((grid, heads.get(grid), n), "")
                    if name not in ranks:
                        ranks[name] = next((i for i, words in enumerate(DATE_COLUMNS) if any(w in name for w in words)), len(DATE_COLUMNS))
                    if best is None or ranks[name] < best[0]:
                        best = ranks[name], n, d
            if best is None:
                continue
            _, column, d = best
            above = cells[0][2]
            label = next((p["title"] for n, p, _ in cells if n != column and p["title"]), None)
            start, until = min(p["start"] for _, p, _ in cells), max(p["end"] for _, p, _ in cells)
            if raw := self._raw(start, until):
                found.append(self._section(" - ".join(x for x in (above and above["title"], label) if x is not None) or d[2], raw, above and above["anchor"], d))
        return found

    def marks(self) -> list[tuple]:
        """A section for each label that states a date by itself, to the next label or dated heading; an undated heading right above opens it."""
        marks, above, year_above, behind = [], None, None, 0
        for p in self.page.parts:
            if p["kind"] == "heading":
                above, behind = p, behind + 1
                if (d := self._date(p["title"])) and d[0]:
                    year_above = d[0].year, p["title"]
            elif p["kind"] == "label" and (d := self._alone(p["title"])):
                led = p["lead"] and above is not None and not ((a := self._date(above["title"])) and a[0])
                marks.append((p, d, above if led else None, year_above, behind))
        if not marks:
            return []
        dated_below = [None] * (len(self.heads) + 1)  # start of the first dated heading behind so many
        for i in range(len(self.heads) - 1, -1, -1):
            d = self._date(self.heads[i]["title"])
            dated_below[i] = self.heads[i]["start"] if d and d[0] else dated_below[i + 1]
        starts = [(led or p)["start"] for p, _, led, _, _ in marks]
        found = []
        for i, (p, d, led, year_above, behind) in enumerate(marks):
            ahead = (starts[i + 1] if i + 1 < len(marks) else None, dated_below[behind] if (dated_below[behind] or -1) >= p["end"] else None)
            until = min((x for x in ahead if x is not None), default=None)
            raw = self._raw(starts[i], until)
            if not raw:
                continue
            below = self.heads[behind] if behind < len(self.heads) else None
            if led:
                title = led["title"]
            elif below and p["end"] <= below["start"] < (p["end"] + HEADING_GAP if until is None else min(until, p["end"] + HEADING_GAP)):
                title = f"{p['title']} - {below['title']}"
            else:
                lines = [x for x in (y.strip(" ") for y in _bare(self.text[p["end"] : until]).split("\n")) if x]
                line = next((x for x in lines if len(x) >= LONG_LINE), lines[0] if lines else None)
                title = p["title"] if line is None else f"{p['title']} - {line[:MAX_LINE]}"
            dated = D.in_year(d, year_above and year_above[0])
            found.append(self._section(title, raw, (led and led["anchor"]) or p["anchor"], dated, year_above[1] if d[5] and dated[0] and year_above else None))
        return found

    def sentences(self) -> list[tuple]:
        """A section for each of the first sentences of a page that state a date by themselves, finer than a year."""
        found, passed, n = [], 0, 0
        for start, sentence in self.page.sentences():
            d = self._alone(sentence)
            if not d or not d[0] or d[1] == "year":
                continue
            if n == self.most:
                break
            n += 1
            while passed < len(self.heads) and self.heads[passed]["start"] <= start:
                passed += 1
            above = self.heads[passed - 1] if passed else None
            if raw := self._raw(start, start + len(sentence)):
                found.append(self._section(f"{above['title']} - {d[2]}" if above else d[2], raw, above and above["anchor"], d))
        return found


def may_hold_index(html: str) -> bool:
    """Whether a page may hold what ``json_index`` finds; never false where it does."""
    return "{" in html or bool(_NAMED.search(html))


_NAMED = re.compile(r'"(?:version|title|name|label)\\*"\s*:')


def cut_page(html: str | None, hint: str | None, most_sentences: int, known: dict[str, tuple | None]) -> tuple[str | None, int | None, list[tuple]]:
    """The way that a page is read by, its sections, and how many entries an embedded index needs to replace them; none where none can."""
    if not html:
        return None, None, []
    cuts, hinted = Cuts(read_page(html)[1], most_sentences, known), HINTS.get(hint)
    way, found = None, []
    for way in dict.fromkeys((*((hinted,) if hinted not in (None, "json") else ()), "headings", "tables", "marks", "sentences")):
        if found := getattr(cuts, way)():
            break
    settled = found and (way == hinted or hinted != "json" and way in ("headings", "tables"))
    needed = len(found) + 1 if way == "marks" and hinted != "json" else 1
    return way, needed if not settled and may_hold_index(html) else None, found


def _cuts(html: pa.Array, hint: pa.Array, most_sentences: int) -> pa.Array:
    known: dict[str, tuple | None] = {}
    ways, needed, found = zip(*[cut_page(h, x, most_sentences, known) for h, x in zip(html.to_pylist(), hint.to_pylist(), strict=True)], strict=True) if len(html) else ((), (), ())
    section, ends = _struct(SECTION), [0]
    for f in found:
        ends.append(ends[-1] + len(f))
    columns = list(zip(*[x for f in found for x in f], strict=True)) or [()] * len(section)
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, section, strict=True)], fields=list(section))
    return pa.StructArray.from_arrays([pa.array(ways, pa.string()), pa.array(needed, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], ["way", "index_from", "sections"])


def cuts(html: Column, hint: Column, most_sentences: int = MAX_SENTENCES) -> Column:
    """struct(way, index_from, sections) of a page: see ``cut_page``."""

    def cut(html: pa.Array, hint: pa.Array) -> pa.Array:
        return _cuts(html, hint, most_sentences)

    return F.arrow_udf(cut, CUT)(html, hint)


def json_index(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page, title, link, d``: dated entries of an index that a page holds as JSON, each day and name once.

    Entries are flat objects of 8 to 2000 characters with an address and a day (or a name that is one), and, where entries
    are nested, names that are days.
    """
    text = F.replace(F.col(html), F.lit('\\"'), F.lit('"'))
    flat = pages.select("page", F.explode(F.regexp_extract_all(text, F.lit(r"\{[^{}]{8,2000}\}"), F.lit(0))).alias("raw")).withColumn("m", F.from_json("raw", "map<string,string>"))
    low = F.transform(F.map_entries("m"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    flat = flat.withColumn("e", F.filter(low, lambda e: F.coalesce(e["value"], F.lit("")) != "")).filter("size(e) > 0")

    def of(key: str) -> Column:
        return F.get(F.filter("e", lambda e: e["key"] == key), F.lit(0))["value"]

    entries = flat.withColumns({"link": F.coalesce(*map(of, LINK_KEYS)), "label": F.coalesce(*map(of, LABEL_KEYS))}).filter("link is not null")
    values = F.array(*[F.struct(of(k).alias("v"), F.lit(k in LABEL_KEYS).alias("named")) for k in (*DATE_KEYS, *LABEL_KEYS)])
    entries = entries.select("page", "raw", "link", "label", F.posexplode(F.filter(values, lambda x: x["v"].isNotNull())).alias("n", "x")).select("page", "raw", "link", "label", "n", "x.*")
    names = pages.select("page", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r'"(?:version|title|name|label)"\s*:\s*"([^"\\]{4,48})"'), F.lit(1)))).alias("v"))
    names = names.select("page", F.col("v").alias("raw"), F.lit("").alias("link"), F.lit(None).cast("string").alias("label"), F.lit(-1).alias("n"), F.trim("v").alias("v"), F.lit(True).alias("named"))
    stated = entries.unionByName(names).withColumn("d", D.parse_date_fragment(F.col("v")))
    stated = stated.filter(F.col("d.value").isNotNull() & (~F.col("named") | (D.stated_alone(F.col("v"), F.col("d.text")) & (F.length("v") <= 48))))
    first = stated.groupBy("page", "raw", "link", "label").agg(F.min_by(F.struct("d", F.when(F.col("named"), F.col("v")).alias("name")), "n").alias("found"))
    first = first.select("page", F.coalesce("found.name", "label", F.lit("")).alias("label"), "link", F.col("found.d").alias("d"))
    each = first.groupBy("page", "d.value", "label").agg(F.min_by(F.struct("link", "d"), F.struct((F.col("link") == "").alias("none"), "link")).alias("x"))
    return each.select("page", F.col("label").alias("title"), "x.link", "x.d")


def page_sections(pages: DataFrame, url: str = "url", html: str = "html", hint: str | None = None, since: Column | None = None, most_sentences: int = MAX_SENTENCES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dated sections of pages: ``page, url, title, raw_text, anchor, event_date, date_precision, date_text, year_from, way, page_section``,
    and the input columns that ``keep`` names.

    A page is read by the way that its hint column names, if that finds anything; else by dated headings, else by dated table rows,
    else by date labels or an embedded index, whichever finds more (labels among equals), else by dated sentences. With
    ``since``, sections whose date ends before it are left out; undated ones always stay. ``page`` numbers the input rows,
    so repeated rows are read each by itself; null html has no sections. ``page_section`` is the address of the page that a
    section was cut from, null for entries of an index, which have addresses of their own.
    """
    spark = pages.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pages.select(F.monotonically_increasing_id().alias("page"), F.col(url).alias("url"), F.col(html).alias("html"), (F.lower(F.trim(hint)) if hint else F.lit(None).cast("string")).alias("hint"), F.struct(*keep, F.lit(0).alias("_")).alias("kept"))
    dealt = rows.repartition(tasks, "page")  # small files hold many pages, and to read one takes long
    read = dealt.select("page", "url", "html", "kept", cuts(F.col("html"), F.col("hint"), most_sentences).alias("c"))
    read = materialise(read.select("page", "url", "kept", "c.*", F.when(F.col("c.index_from").isNotNull(), F.col("html")).alias("html")))
    settled, out = read.filter("index_from is null"), ("page", "url", "title", "raw_text", "anchor", "event_date", "date_precision", "date_text", "year_from", "way", "page_section", "kept")

    def sections(df: DataFrame) -> DataFrame:
        address = F.when(F.col("anchor").isNotNull(), F.concat_ws("#", "at", "anchor")).otherwise(F.col("at"))
        s = df.select("page", F.col("url").alias("at"), "way", "kept", F.explode("sections").alias("s")).select("page", "at", "way", "kept", "s.*")
        return s.withColumns({"url": address, "page_section": F.col("at")}).select(*out)

    found = sections(settled)
    size = read.agg(F.sum(F.length("html"))).first()[0] or 0
    if size:
        by_page = lambda df: df.repartition(max(size // INDEXED_OF_TASK, tasks), "page")
        open_ = read.filter("index_from is not null")
        index = materialise(json_index(by_page(open_.select("page", "html"))).withColumn("n", F.count("*").over(Window.partitionBy("page"))))
        counts = by_page(index.groupBy("page").agg(F.first("n").alias("n")))
        kept_cuts = by_page(open_.drop("html")).join(counts.hint("merge"), "page", "left").filter(F.col("n").isNull() | (F.col("n") < F.col("index_from")))
        index = by_page(index).join(by_page(open_.select("page", F.col("url").alias("at"), "index_from", "kept")).hint("merge"), "page").filter(F.col("n") >= F.col("index_from"))
        site = F.regexp_extract("at", r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
        own = F.when(F.col("link").rlike("^https?:"), F.col("link")).when(F.col("link").startswith("//"), F.concat(F.regexp_extract("at", r"^([A-Za-z][\w+.-]*:)", 1), "link")).when(F.col("link").startswith("/"), F.concat(site, "link"))
        index = index.select("page", F.coalesce(own, "at").alias("url"), F.coalesce(F.nullif("title", F.lit("")), "link").alias("title"), F.concat_ws(" | ", "d.text", F.nullif("title", F.lit("")), F.nullif("link", F.lit(""))).alias("raw_text"), F.lit(None).cast("string").alias("anchor"), F.col("d.value").alias("event_date"), F.col("d.precision").alias("date_precision"), F.col("d.text").alias("date_text"), F.lit(None).cast("string").alias("year_from"), F.lit("json").alias("way"), F.when(own.isNull(), F.col("at")).alias("page_section"), "kept")
        found = found.unionByName(sections(kept_cuts)).unionByName(index.select(*out))
    out = found.select(*out[:-1], *[F.col(f"kept.{k}").alias(k) for k in keep])
    if since is not None:
        out = out.filter(F.col("event_date").isNull() | (D.period_end(F.col("event_date"), F.col("date_precision")) >= since))
    return out

"""HTML extraction: a tree with implied tags, visibility rules, and rendering as laid-out text.

A null or empty page renders to an empty text. Repeated rows are rendered each;
other columns are not read; an empty table gives an empty one. Pages are
rendered whole and one at a time; depth is not limited, as nothing recurses.
Time and text grow with a page's length, however hostile it is: no text is left
out, but layout has bounds (``DEEPEST``, ``NESTED``, ``COLUMNS``, ``ALIGNED``).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from .arrow import map_texts

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe noembed noframes area param source track "
                   "audio video canvas desc defs metadata symbol annotation annotation-xml".split())
#: Blank lines around a block; blocks that are not named have none.
MARGINS = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split(), 1)
BLOCKS = frozenset(MARGINS) | frozenset(
    "html body div section article aside header footer main nav address form li dt dd tr thead tbody tfoot caption details summary "
    "figcaption center legend option optgroup td th hgroup search menu dir text".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template head".split())
#: A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"})),
}
ENDS_PARAGRAPH = (BLOCKS | {"hr"}) - frozenset("html body td th tr thead tbody tfoot caption option optgroup text".split())
#: Inside a cell, an end tag reaches no further than the cell, unless it ends a part of the table.
CELL_WALLS, TABLE_PARTS = frozenset({"td", "th", "caption"}), frozenset("td th tr thead tbody tfoot table caption".split())

HEAD = re.compile(r"<(?:(?P<comment>!--)|[!?]|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*))")
#: The rest of a tag; quoted values may hold its end sign.
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NO_TAG = re.compile(r"<[!?]")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
BLANKS = re.compile(r"[ \t\n\r\f]+")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
BRACES = re.compile(r"[{};]")
PROPERTY = re.compile(r"(?:\A|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.IGNORECASE)
#: Media that a style sheet for a wide screen names.
ON_SCREEN = re.compile(r"\s*(?:(?:only\s+)?(?:all|screen)\b|not\s+print\b|\(|\Z)", re.IGNORECASE)
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?([.#][\w-]+)?\Z", re.IGNORECASE)
#: A cell longer than this does not widen its column.
WIDEST = 40
#: Blanks before a line: deeper levels stand where the last of these does.
DEEPEST = 40
#: Tables inside so many others flow cell by cell in the cell around them.
NESTED = 8
#: Cells from this column on, and what would start further right than this, follow without alignment.
COLUMNS, ALIGNED = 250, 200


class Node:
    """An element; its children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "indent")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children, self.indent = tag, attrs, [], 0


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


class Tree:
    """Builds the tree of a page: optional end tags, implied html, head, body, tbody and tr, and stray end tags.

    The places of open elements are kept by tag, so no tag walks through all that is open.
    """

    def __init__(self, page: str) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.styles: list[str] = []
        self.title = ""
        at, size, quoted = 0, len(page), True
        while at < size:
            head = HEAD.search(page, at)
            if not head:
                self._text(page[at:])
                break
            name, stop = head["name"], head.end()
            if head["comment"]:
                close = 1 if page.startswith(">", stop) else 2 if page.startswith("->", stop) else page.find("-->", stop) + 3 - stop
                stop = stop + close if close > 0 and stop + close > 2 and page[stop + close - 1] == ">" else size
            elif not name:
                stop = page.find(">", stop) + 1 or size
            else:
                rest = REST.match(page, stop) if quoted else None
                if rest is None:
                    # A quote that nothing closes: from here on a tag ends at its first end sign.
                    quoted, close = False, page.find(">", stop)
                    if close < 0:  # only comments can follow
                        other = NO_TAG.search(page, stop)
                        self._text(page[at:other.start() if other else size])
                        at = other.start() if other else size
                        continue
                    attrs, stop = page[stop:close], close + 1
                else:
                    attrs, stop = rest[1], rest.end()
            if head.start() > at:
                self._text(page[at:head.start()])
            at = stop
            if not name:
                continue
            name = name.lower()
            if head["end"]:
                self._end(name)
                continue
            given = _attributes(attrs) if "=" in attrs or attrs.strip(" /\n\t\r") else {}
            self._start(name, given)
            if name in RAW:
                close = re.compile(rf"</{name}\b", re.IGNORECASE).search(page, at)
                end = page.find(">", close.end()) + 1 if close else 0
                text = page[at:close.start() if close and end else size]
                if name != "style" or any(map(ON_SCREEN.match, given.get("media", "").split(","))):
                    self._raw(name, text)
                at = end or size
                self._end(name)

    def _raw(self, name: str, text: str) -> None:
        if name == "style":
            self.styles.append(text)
        elif name == "title":
            if not self.places.get("svg"):  # a drawing's title is no page's
                self.title = self.title or BLANKS.sub(" ", unescape(text)).strip()
        elif name in ("textarea", "xmp") and self.open[-1].tag == name:
            self.open[-1].children.append(unescape(text) if name == "textarea" else text)

    def _text(self, text: str) -> None:
        top = self.open[-1]
        if top.tag in ("html", "head") and text.strip():
            self._body()
            top = self.open[-1]
        elif top.tag in ("table", "thead", "tbody", "tfoot", "tr") and not text.strip():
            return
        top.children.append(unescape(text) if "&" in text else text)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, place: int) -> None:
        """End the element at this place, with all inside it."""
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0 where there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _body(self) -> None:
        """Open the body where it was left out; content may no longer go to the head."""
        if self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)
        if self.open[-1] is self.root:
            self._push("body", {})

    def _start(self, name: str, attrs: dict[str, str]) -> None:
        if name in ("html", "body"):
            if self.places.get(name):  # attributes of a repeated tag are added
                node = self.open[self.places[name][-1]]
                node.attrs.update((k, v) for k, v in attrs.items() if k not in node.attrs)
                return
        if name not in HEAD_ONLY and name not in ("html", "body", "frameset") or name == "body":
            if self.open[-1].tag == "head":
                self._cut(len(self.open) - 1)
            if name != "body" and self.open[-1] is self.root:
                self._push("body", {})
        if name in ENDS_PARAGRAPH:
            self._close({"p"}, {"td", "th", "table", "button", "body"})
        if name in CLOSES:
            self._close(*CLOSES[name])
        if name == "tr" and self.open[-1].tag == "table":
            self._push("tbody", {})
        if name in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._start("tr", {})
        self._push(name, attrs)
        if name in VOID:
            self._cut(len(self.open) - 1)

    def _close(self, tags: set[str], walls: set[str]) -> None:
        """End the outermost open element of ``tags`` this side of the walls, with all inside it."""
        wall = self._last(walls)
        inside = [places[i] for t in tags if (places := self.places.get(t)) and (i := bisect_right(places, wall)) < len(places)]
        if inside:
            self._cut(min(inside))

    def _end(self, name: str) -> None:
        if name == "br":
            self._push("br", {})
            self._cut(len(self.open) - 1)
            return
        if name in ("html", "body"):
            return
        wall = 0 if name in TABLE_PARTS else self._last(CELL_WALLS)
        place = self._last((name,))
        if place > wall:
            self._cut(place)
            return
        if wall:
            return
        if name == "p":  # a stray end tag is an empty paragraph
            self._start("p", {})
            self._cut(len(self.open) - 1)


def _style_rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of a style sheet that hold on a wide screen."""
    css = COMMENT.sub(" ", css)
    at, head, around = 0, "", []  # around: whether each open outer block holds
    for sign in BRACES.finditer(css):
        text = css[at:sign.start()]
        if sign[0] == "{":
            at = sign.end()
            if head:
                around.append(_holds(head))
            head = text.strip() or " "
        elif sign[0] == "}":
            at = sign.end()
            if head:
                if head[0] != "@" and all(around[-3:]):
                    yield head, text
                head = ""
            elif around:
                around.pop()
        elif not head:  # a statement such as an import
            at = sign.end()


def _holds(head: str) -> bool:
    if head[:6].lower() != "@media":
        return head[:9].lower() in ("@supports", "@layer") or head[:6].lower() == "@layer"
    return any(ON_SCREEN.match(q) and "max-" not in q for q in head[6:].split(","))


class Visibility:
    """What the element, its attributes and plain rules of the page's style sheets show or hide.

    Of several rules the important, then the more specific, then the later one holds; an element's own style comes before them.
    """

    def __init__(self, styles: list[str]) -> None:
        self.rules: dict[tuple[str, str], list[tuple]] = {}
        order = 0
        for body in styles:
            for selectors, rules in _style_rules(body):
                if found := PROPERTY.findall(rules):
                    for s in selectors.split(","):
                        if (m := SELECTOR.match(s.strip())) and (m[1] or m[2]):
                            kind = (bool(m[2]) + (m[2] or "").startswith("#"), bool(m[1]))
                            known = self.rules.setdefault(((m[1] or "").lower(), m[2] or ""), [])
                            for prop, value, weight in found:
                                order += 1
                                known.append(((bool(weight), False, *kind, order), prop.lower(), value.lower()))
        for key, known in self.rules.items():  # of one selector only the strongest can matter
            best: dict[str, tuple] = {}
            for rule in known:
                best[rule[1]] = max(best.get(rule[1], rule), rule)
            self.rules[key] = list(best.values())

    def of(self, node: Node) -> tuple[bool, bool | None]:
        """Whether the element is gone with all inside, and whether its own text shows (None: as around it)."""
        tag, attrs = node.tag, node.attrs
        if tag in HIDDEN or tag == "input" or tag == "dialog" and "open" not in attrs:
            return True, None
        if not attrs and not self.rules:
            return False, None
        held: list[tuple] = []
        if self.rules:
            names = {"", *("." + c for c in attrs.get("class", "").split()), *(["#" + attrs["id"]] if "id" in attrs else [])}
            for n in names:
                held += self.rules.get((tag, n), ())
                held += self.rules.get(("", n), ())
        if "style" in attrs:
            held += [((bool(w), True, i), prop.lower(), value.lower()) for i, (prop, value, w) in enumerate(PROPERTY.findall(attrs["style"]))]
        held.sort()
        values = {prop: value for _, prop, value in held}
        display, seen = values.get("display"), values.get("visibility")
        gone = display == "none" if display else "hidden" in attrs
        return gone, None if seen in (None, "inherit") else seen not in ("hidden", "collapse")


class Flow:
    """Text laid out in lines: inline text joins, blocks part, margins collapse."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.indent = 0
        self.bullet = ""

    def inline(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if text == " " and (not self.parts or self.parts[-1].endswith(" ")):
            return
        self.parts.append(text[1:] if text.startswith(" ") and self.parts and self.parts[-1].endswith(" ") else text)

    def end_line(self) -> None:
        line = "".join(self.parts).strip(" ")
        self.parts = []
        if line:
            self._put(line)

    def _put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = " " * min(self.indent, DEEPEST)
        self.lines.append(indent[:max(0, len(indent) - len(self.bullet))] + self.bullet + line)
        self.bullet = ""

    def block(self, margin: int) -> None:
        self.end_line()
        self.gap = max(self.gap, margin)

    def kept(self, text: str) -> None:
        """Preformatted text: lines and blanks as they are."""
        first, *rest = text.expandtabs(8).replace("\r\n", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self._put("".join(self.parts).rstrip())
            self.parts = [line]

    def text(self) -> str:
        self.end_line()
        return "\n".join(x.rstrip() for x in self.lines).strip("\n").replace(" ", " ")


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1")
    return min(most, max(1, int(value))) if value.isdecimal() else 1


class Grid:
    """Cells of one table by row and column; a cell that spans rows leaves blanks below it."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, str]]] = []
        self.next = 0
        self.below: dict[int, int] = {}  # last row that a cell above reaches, by column
        self.captions: list[str] = []

    def row(self) -> None:
        self.rows.append([])
        self.next = 0

    def cell(self, text: str, columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        at, last = self.next, len(self.rows) - 1
        while self.below.get(at, -1) >= last:
            at += 1
        self.next = min(at + columns, COLUMNS)
        if rows > 1:
            self.below.update(dict.fromkeys(range(at, self.next), last + rows - 1))
        if text := " ".join(text.split()):
            self.rows[-1].append((at, text))

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}  # of columns with text; others take no room
        for row in self.rows:
            for at, text in row:
                widths[at] = max(widths.get(at, 0), len(text) if at < COLUMNS and len(text) <= WIDEST else 0)
        starts, place = {}, 0
        for at in sorted(widths):
            starts[at] = place
            place = min(place + widths[at] + 2, ALIGNED)
        laid = []
        for row in self.rows:
            line, size, moved = [], 0, 0  # what is longer than its column moves the rest of the row
            for at, text in row:
                pad = max(starts[at] + moved - size, 2 if line else 0)
                line += [" " * pad, text]
                size += pad + len(text)
                moved += max(0, len(text) - widths[at]) if len(text) > widths[at] else 0
            laid.append("".join(line))
        return self.captions + [x for x in laid if x]


def render(page: str) -> tuple[str, str, int]:
    """Title, visible text, and number of tables of a page."""
    tree = Tree(page)
    shown = Visibility(tree.styles)
    flows, grids, lists = [Flow()], [], []
    tables = pre = 0
    inner = 0  # open tables that are not laid out
    work: list[tuple[str, Node | str, bool]] = [("in", tree.root, True)]
    while work:
        what, node, seen = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not seen:
                continue
            if pre:
                flow.kept(node)
            else:
                flow.inline(node)
            continue
        tag = node.tag
        laid = grids and not inner
        if what == "in":
            gone, own = shown.of(node)
            if gone:
                continue
            seen = seen if own is None else own
            if tag == "br":
                if pre:
                    flow.kept("\n")
                else:
                    flow.end_line()
                continue
            if tag == "img":
                if seen and (alt := node.attrs.get("alt")):
                    flow.inline(alt)
                continue
            if tag in BLOCKS and (inner or tag not in ("tr", "td", "th", "caption")):
                # A list inside a list has no margin of its own.
                flow.block(0 if tag in ("ul", "ol") and lists else MARGINS.get(tag, 0))
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag, int(node.attrs["start"]) if node.attrs.get("start", "").isdecimal() else 1])
            elif tag == "li":
                ordered = bool(lists) and lists[-1][0] == "ol"
                flow.bullet = f"{lists[-1][1]}. " if ordered else "- "
                if ordered:
                    lists[-1][1] += 1
                node.indent = len(flow.bullet)
                flow.indent += node.indent
            elif tag in ("blockquote", "dd"):
                node.indent = 4
                flow.indent += 4
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables += 1
                if inner or len(grids) == NESTED:
                    inner += 1
                else:
                    grids.append(Grid())
            elif tag == "tr" and laid:
                grids[-1].row()
            elif tag in ("td", "th", "caption") and laid:
                flows.append(Flow())
            work.append(("out", node, seen))
            work += [("in", child, seen) for child in reversed(node.children)]
            continue
        if tag in ("td", "th", "caption") and laid and len(flows) > 1:
            cell = flows.pop().text()
            if tag == "caption":
                grids[-1].captions += [cell] if cell else []
            else:
                grids[-1].cell(cell, _span(node, "colspan", 1000), _span(node, "rowspan", 65_534))
        elif tag == "table" and inner:
            inner -= 1
            flow.block(1)
        elif tag == "table":
            flow.end_line()
            for line in grids.pop().lines():
                flow._put(line)
            flow.block(1)
        elif tag in BLOCKS and (inner or tag != "tr"):
            if pre and tag == "pre":
                pre -= 1
                if last := "".join(flow.parts).rstrip():
                    flow._put(last)
                flow.parts = []
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            flow.block(0 if tag in ("ul", "ol") and lists else MARGINS.get(tag, 0))
            if tag in ("li", "blockquote", "dd"):
                flow.indent -= node.indent
                flow.bullet = ""
    return tree.title, flows[0].text(), tables


def extract_text(df: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The ``keep`` columns beside title, laid-out text, and numbers of characters, lines and tables."""

    def make(pages: list[bytes | None]) -> list[pa.Array]:
        rows = [render((p or b"").decode("utf-8", "replace")) for p in pages]
        titles, texts = [r[0] for r in rows], [r[1] for r in rows]
        return [pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]

    return map_texts(df, html, keep, [
        StructField("title", StringType()), StructField("text", StringType()), StructField("text_chars", LongType()),
        StructField("text_lines", LongType()), StructField("tables", LongType())], make)

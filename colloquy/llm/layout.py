"""One page of HTML as laid-out text: a tree with implied tags, then its visible text.

The tree builder closes what HTML lets authors leave open (paragraphs, list items, rows,
cells, the head), so that text stands where a browser would show it. The renderer leaves out
what is not shown and keeps the layout of the rest: paragraphs and headings apart by a blank
line, other blocks on lines of their own, list items behind bullets or numbers, table cells
in aligned columns over the rows and columns they span, preformatted text as it is.

Time is linear in the page, whatever its tags. A quote that never closes does not hide the page:
from the tag it stands in, quotes no longer group anything. Elements may nest to any depth; those
deeper than DEPTH stand, with their text, in the one at that depth, and what is hidden stays so.
Cells are wrapped at WRAP characters, so that one long cell does not widen every row; a word that
is longer is not cut.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from itertools import zip_longest

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
HEAD = frozenset("title meta link base style script noscript template".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes datalist title object audio video canvas".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure form fieldset menu hr".split())
BLOCK = APART | frozenset(
    "html body address article aside center details dialog dd dir div dt figcaption footer header hgroup legend li "
    "listing main nav optgroup option search section summary caption tr td th thead tbody tfoot xmp".split())
CLOSES_P = BLOCK - frozenset("html body option optgroup tr td th thead tbody tfoot caption".split())
# What a start tag closes, and where the search for it ends.
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"), "tr": ("tr td th caption", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "thead": ("thead tbody tfoot tr td th caption", "table"),
    "tbody": ("thead tbody tfoot tr td th caption", "table"), "tfoot": ("thead tbody tfoot tr td th caption", "table")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
WALLS = frozenset("table td th caption button template".split())
DEPTH = 200
WRAP = 60
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # the spans that HTML allows


class Node:
    """`seen` is false for an element that is left out with all it holds; `lit` for one whose own
    text is invisible, which elements inside it may undo."""

    __slots__ = ("tag", "attributes", "children", "seen", "lit")

    def __init__(self, tag: str, attributes: str = "", seen: bool = True, lit: bool = True):
        self.tag, self.attributes, self.children, self.seen, self.lit = tag, attributes, [], seen, lit

    def get(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def _shown(tag: str, attributes: str) -> bool:
    if tag in UNSEEN:
        return False
    if not attributes:
        return tag != "dialog"
    node, low = Node(tag, attributes), attributes.lower()
    if "hidden" in low and node.get("hidden") is not None:
        return False
    if tag == "dialog" and node.get("open") is None:
        return False
    return not ("style" in low and HIDING.search(node.get("style") or ""))


def _lit(tag: str, attributes: str, inherited: bool) -> bool:
    if "isib" not in attributes and "ISIB" not in attributes.upper():
        return inherited
    said = VISIBILITY.findall(Node(tag, attributes).get("style") or "")
    return said[-1].lower() == "visible" if said else inherited


class Tokens:
    """Tags and the text between them, read once from left to right."""

    def __init__(self, page: str):
        self.page, self.at, self.grouping, self.last = page, 0, True, page.rfind(">")

    def _end(self, start: int, after: int) -> int:
        """Where the tag at `start` ends; its name ends at `after`."""
        page, at = self.page, after
        while self.grouping:
            at = PLAIN.match(page, at).end()
            if at < len(page) and page[at] == ">":
                return at
            close = page.find(page[at], at + 1) if at < len(page) else -1
            if close < 0:
                self.grouping = False
            at = close + 1
        return page.find(">", after)

    def next(self) -> tuple[str, str, str, str] | None:
        """(text before, "/" of an end tag, name, attributes); the name is empty for what is no tag."""
        page, start = self.page, self.at
        look = start
        while (cut := page.find("<", look)) >= 0 and cut + 1 < len(page):
            if page.startswith("<!--", cut):
                end = page.find("-->", cut + 4)
                self.at = len(page) if end < 0 else end + 3
                return page[start:cut], "", "", ""
            if page.startswith("<![CDATA[", cut) and (end := page.find("]]>", cut)) >= 0:
                self.at = end + 3
                return page[start:cut] + page[cut + 9:end].replace("&", "&amp;"), "", "", ""
            if cut > self.last:
                break  # no tag can end any more
            if page[cut + 1] in "!?":
                self.at = page.find(">", cut) + 1
                return page[start:cut], "", "", ""
            if (m := NAME.match(page, cut + 1)) is not None:
                end = self._end(cut, m.end())
                self.at = end + 1
                return page[start:cut], m[1], m[2].lower(), page[m.end():end]
            look = cut + 1
        return None

    def rest(self) -> str:
        return self.page[self.at:]

    def raw(self, tag: str) -> str:
        """The text up to this element's end tag, which is passed over."""
        m = RAW_END[tag].search(self.page, self.at)
        end = m.start() if m else len(self.page)
        data = self.page[self.at:end]
        after = self.page.find(">", end)
        self.at = len(self.page) if after < 0 else after + 1
        return data


class Open:
    """The open elements, and where those of each name stand."""

    def __init__(self):
        self.nodes = [Node("html")]
        self.where: dict[str, list[int]] = defaultdict(list)

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, tag: str, attributes: str = "") -> None:
        node = Node(tag, attributes, _shown(tag, attributes), _lit(tag, attributes, self.top.lit))
        if len(self.nodes) < DEPTH:
            self.top.children.append(node)
        elif node.seen:
            node.children = self.top.children  # what is hidden is not attached at all
        self.where[tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        for node in self.nodes[at:]:
            self.where[node.tag].pop()
        del self.nodes[at:]

    def wall(self, walls: frozenset) -> int:
        """Where the innermost of `walls` stands, 0 without one."""
        return max((at[-1] for tag in walls if (at := self.where.get(tag))), default=0)

    def close(self, tags: frozenset, walls: frozenset) -> None:
        """Close the outermost open element of `tags` inside the innermost of `walls`."""
        if any(self.where.get(tag) for tag in tags):
            wall = self.wall(walls)
            inside = [at[i] for tag in tags if (at := self.where.get(tag)) and (i := bisect_right(at, wall)) < len(at)]
            if inside:
                self.cut(min(inside))

    def close_last(self, tag: str, walls: frozenset) -> bool:
        """Close the innermost open element of this tag unless a wall stands after it."""
        at = self.where.get(tag)
        if not at or (at[-1] < len(self.nodes) - 1 and self.wall(walls) > at[-1]):
            return False
        self.cut(at[-1])
        return True

    def text(self, data: str) -> None:
        if self.top.tag == "head":
            if not data.strip():
                return
            self.cut(len(self.nodes) - 1)
        if data and self.top.lit:
            self.top.children.append(html.unescape(data) if "&" in data else data)


def tree(page: str) -> Node:
    """The page's elements, nested as implied tags demand."""
    tokens, stack = Tokens(page), Open()
    root = stack.top
    while (found := tokens.next()) is not None:
        before, end, tag, attributes = found
        stack.text(before)
        if not tag:
            continue
        if stack.top.tag == "head" and not end and tag not in HEAD:
            stack.cut(len(stack.nodes) - 1)
        if end:
            if tag == "br":
                stack.top.children.append(Node("br"))
            elif tag in ("html", "body"):
                pass  # what follows still belongs to the page
            elif tag in BLOCK or tag in UNSEEN:
                walls = frozenset() if tag in WALLS else WALLS - {tag}
                if not stack.close_last(tag, walls) and tag == "p":
                    stack.top.children.append(Node("p"))
            else:
                stack.close_last(tag, BLOCK)
            continue
        if tag in ("html", "body"):
            if not _shown(tag, attributes) or not _lit(tag, attributes, True):
                stack.push("div", attributes)
            continue
        if tag in CLOSES_P:
            stack.close(frozenset(["p"]), WALLS)
        if tag in IMPLIED:
            stack.close(*IMPLIED[tag])
        if tag in ("td", "th") and stack.top.tag != "tr" and stack.where.get("table"):
            stack.push("tr")
        if tag in VOID:
            stack.top.children.append(Node(tag, attributes, _shown(tag, attributes)))
            continue
        stack.push(tag, attributes)
        if tag in RAW:
            data = tokens.raw(tag)
            if stack.top.lit:
                stack.top.children.append(html.unescape(data) if tag in ("title", "textarea") else data)
            stack.cut(len(stack.nodes) - 1)
    stack.text(tokens.rest())
    return root


class Lines:
    """Lines of text with blank lines between blocks that stand apart."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.apart = False

    def flush(self) -> None:
        line = SPACE.sub(" ", "".join(self.now)).strip(" ")
        self.now = []
        if line:
            self.add([line])

    def add(self, lines: list[str]) -> None:
        if lines:
            if self.apart and self.lines:
                self.lines.append("")
            self.lines += lines
            self.apart = False

    def block(self, apart: bool) -> None:
        self.flush()
        self.apart = self.apart or apart


def flow(node: Node, out: Lines) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.now.append(child)
            continue
        if not child.seen:
            continue
        tag = child.tag
        if tag == "br":
            line = out.now and "".join(out.now).strip()
            out.flush()
            if not line and out.lines:
                out.apart = True
        elif tag == "hr":
            out.block(True)
        elif tag == "img":
            continue
        elif tag not in BLOCK:
            flow(child, out)
        else:
            apart = tag in APART and not (node.tag == "li" and tag in ("ul", "ol", "menu", "dir"))
            out.block(apart)
            if tag in ("ul", "ol", "menu", "dir"):
                out.add(_list(child))
            elif tag == "table":
                out.add(_table(child))
            elif tag in ("pre", "listing", "xmp"):
                out.add(_plain(child).strip("\n").split("\n") if _plain(child).strip() else [])
            elif tag == "blockquote":
                out.add(["> " + x if x else ">" for x in rendered(child)])
            elif tag == "dd":
                out.add(["  " + x if x else "" for x in rendered(child)])
            else:
                flow(child, out)
            out.block(apart)


def rendered(node: Node) -> list[str]:
    out = Lines()
    flow(node, out)
    out.flush()
    return out.lines


def _plain(node: Node) -> str:
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.seen:
            parts.append("\n" if child.tag == "br" else _plain(child))
    return "".join(parts)


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?\d{1,9}\s*", value) else default


def _list(node: Node) -> list[str]:
    count, lines = _number(node.get("start"), 1), []
    for child in node.children:
        if isinstance(child, str) or not child.seen:
            loose = [SPACE.sub(" ", child).strip()] if isinstance(child, str) and child.strip() else []
            lines += ["  " + x for x in loose]
        elif child.tag == "li":
            mark = "- "
            if node.tag == "ol":
                count = _number(child.get("value"), count)
                mark = f"{count}. "
                count += 1
            body = rendered(child)
            lines += [(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(body)]
        else:
            shell = Node("div")
            shell.children = [child]
            lines += ["  " + x if x else "" for x in rendered(shell)]
    return lines


class Cell:
    __slots__ = ("lines", "columns", "rows")

    def __init__(self, node: Node):
        spans = node.tag in ("td", "th")
        self.lines = [part for line in rendered(node) for part in wrapped(line)]
        self.columns = min(max(_number(node.get("colspan"), 1), 1), MOST_COLUMNS) if spans else 1
        self.rows = min(max(_number(node.get("rowspan"), 1), 0), MOST_ROWS) if spans else 1


def wrapped(line: str) -> list[str]:
    """A line in pieces of at most WRAP characters, cut at blanks."""
    if len(line) <= WRAP:
        return [line]
    out, now = [], ""
    for word in line.split(" "):
        if now and len(now) + 1 + len(word) > WRAP:
            out.append(now)
            now = word
        else:
            now = f"{now} {word}" if now else word
    return [*out, now] if now else out


def _rows(node: Node, before: list[str]) -> list[list[list[Cell]]]:
    """Groups of rows of cells; captions and text outside cells go to `before`."""
    groups: list[list[list[Cell]]] = []
    own: list[list[Cell]] = []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                before.append(SPACE.sub(" ", child).strip())
        elif not child.seen:
            continue
        elif child.tag == "tr":
            cells = []
            for cell in child.children:
                if isinstance(cell, str):
                    if cell.strip():
                        before.append(SPACE.sub(" ", cell).strip())
                elif cell.seen:
                    cells.append(Cell(cell))
            own.append(cells)
        elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
            groups += [own, *_rows(child, before)]
            own = []
        else:
            shell = Node("div")
            shell.children = [child]
            before += rendered(shell)
    return [g for g in [*groups, own] if g]


def _placed(group: list[list[Cell]]) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of (column, columns, lines): a cell stands in its first row, and its columns are taken
    in the others, with no lines. Spans end with the group."""
    out, taken = [], {}  # taken: column -> (rows left, columns); rows 0 means to the end
    for cells in group:
        row, at, waiting = [], 0, iter(cells)
        cell = next(waiting, None)
        held = sorted(taken)
        while cell is not None or held:
            if held and (cell is None or held[0] <= at):
                column = held.pop(0)
                row.append((column, taken[column][1], []))
                at = max(at, column + taken[column][1])
                continue
            row.append((at, cell.columns, cell.lines))
            if cell.rows != 1:
                taken[at] = (cell.rows, cell.columns)
            at += cell.columns
            cell = next(waiting, None)
        new = {}
        for column, (left, columns) in taken.items():
            if left == 0:
                new[column] = (0, columns)
            elif left > 1:
                new[column] = (left - 1, columns)
        taken = new
        out.append(sorted(row, key=lambda c: c[0]))
    return out


def _table(node: Node) -> list[str]:
    before: list[str] = []
    rows = [row for group in _rows(node, before) for row in _placed(group)]
    rows = [row for row in rows if any(lines for _, _, lines in row)]
    widths: dict[int, int] = {}
    for row in rows:
        for at, span, lines in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(WRAP, max(map(len, lines), default=0)))
    columns = sorted(widths)
    total = [0]
    for at in columns:
        total.append(total[-1] + widths[at])
    out = before
    for row in rows:
        for parts in zip_longest(*[lines for _, _, lines in row], fillvalue=""):
            line = []
            for (at, span, _), part in zip(row, parts):
                i, j = bisect_right(columns, at - 1), bisect_right(columns, at + span - 1)
                line.append(part.ljust(total[j] - total[i] + 3 * max(j - i - 1, 0)))
            out.append(" | ".join(line).rstrip())
    return out


def _title(node: Node) -> str | None:
    for child in node.children:
        if not isinstance(child, str):
            if child.tag == "title":
                return SPACE.sub(" ", _plain(child)).strip()
            if child.tag == "head" and (found := _title(child)) is not None:
                return found
    return None


def page_text(page: str) -> tuple[str | None, str]:
    """Title and visible text."""
    root = tree(page)
    return _title(root), "\n".join(rendered(root))

"""Visible text of web pages, laid out: a tree with implied tags, visibility rules, blocks, lists and aligned tables."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from vektorloom.llm.common import map_rows

# Fixed values of the HTML standard: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul "
    "caption tr thead tbody tfoot xmp option optgroup".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table fieldset menu dir xmp".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp li dd dt".split()
)
NEVER_SHOWN = frozenset(
    "head script style template noscript iframe object embed audio video canvas svg math datalist title meta link base "
    "param source track noembed noframes area".split()
)
#: Tags that an opening tag closes, and the elements beyond which it does not look for them.
CLOSES = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset("thead tbody tfoot table".split())),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset({"table"})),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset({"table"})),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: Tags that may stand in a head; any other tag, and text, ends it.
IN_HEAD = frozenset("title meta link style script noscript noframes base basefont bgsound template head".split())

#: Cells of a row stand this far apart; a cell is padded up to the widest of its column, but not beyond WIDEST.
GAP, WIDEST = "  ", 60

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_RULE = re.compile(r"((?:[^{};\"'(]++|\"[^\"]*\"|'[^']*'|\([^()]*\)|[\"'(])*+)([{};]|\Z)")
_CONDITION = re.compile(r"(not\s+)?\(([^()]*)\)")
_LENGTH = r"([\d.]+)(px|r?em|in|cm|mm|pt|)"
_BOUND = re.compile(rf"(min|max)-(?:device-)?(width|height)\s*:\s*{_LENGTH}")
_RANGE = re.compile(rf"(?:{_LENGTH}\s*(<=?|>=?)\s*)?(width|height)\s*(?:(<=?|>=?|=)\s*{_LENGTH})?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)


#: The normal rendering for style sheets: a desktop screen, in CSS pixels, and its other features.
SCREEN = {"width": 1280.0, "height": 800.0}
FEATURES = frozenset(
    "color|hover|hover:hover|any-hover|any-hover:hover|pointer|pointer:fine|any-pointer|any-pointer:fine|orientation:landscape|"
    "prefers-color-scheme:light|prefers-reduced-motion:no-preference|scripting|scripting:enabled|update|update:fast".split("|")
)
PIXELS = {"": 1.0, "px": 1.0, "em": 16.0, "rem": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 96 / 72}


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Element | str] = []


class Open(list):
    """Elements that are open, and how many of each tag, so that a tag that is not open is not searched for."""

    def __init__(self, root: Element):
        super().__init__([root])
        self.counts: dict[str, int] = {}

    def push(self, element: Element) -> None:
        self.append(element)
        self.counts[element.tag] = self.counts.get(element.tag, 0) + 1

    def cut(self, at: int) -> None:
        for element in self[at:]:
            self.counts[element.tag] -= 1
        del self[at:]

    def has(self, tag: str) -> bool:
        return self.counts.get(tag, 0) > 0


def attributes_of(source: str) -> dict[str, str]:
    if not source or source == "/":
        return {}
    return {n.lower(): unescape(a or b or c) for n, a, b, c in reversed(_ATTRIBUTE.findall(source))}


def parse(html: str) -> Element:
    """The tree of a page. Any text is accepted: missing, implied and stray tags are mended."""
    root = Element("#root", {})
    stack, at = Open(root), 0
    while at < len(html):
        found = _MARKUP.search(html, at)
        text = html[at : found.start()] if found else html[at:]
        if text:
            if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
                _end_head(stack)
            stack[-1].children.append(unescape(text))
        if not found:
            break
        at = found.end()
        closing, tag = found[1], (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                stack[-1].children.append(found[0][9:].removesuffix("]]>"))
        elif closing:
            _close(stack, tag)
        else:
            element = _open(stack, tag, attributes_of(found[3]))
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(html, at)
                body = html[at : end.start()]
                element.children.append(unescape(body) if tag in ("textarea", "title") else body)
                at = end.end()
            elif tag not in VOID and not (found[3].endswith("/") and tag in ("path", "rect", "circle", "use")):
                stack.push(element)
    return root


def _end_head(stack: Open) -> None:
    """The implied end of a head, and the implied body behind it."""
    while stack[-1].tag == "head":
        stack.cut(len(stack) - 1)
    if not stack.has("body"):
        stack.push(_add(stack[-1], "body", {}))


def _open(stack: Open, tag: str, attributes: dict[str, str]) -> Element:
    if stack[-1].tag == "head" and tag not in IN_HEAD and tag not in ("body", "html", "frameset"):
        _end_head(stack)
    if tag in ENDS_PARAGRAPH:
        _close_upto(stack, frozenset({"p"}), frozenset("td th table button object caption li dd".split()) - {tag})
    if tag in CLOSES:
        _close_upto(stack, *CLOSES[tag])
    if tag in ("td", "th") and stack[-1].tag != "tr" and stack.has("table"):
        stack.push(_add(stack[-1], "tr", {}))
    return _add(stack[-1], tag, attributes)


def _add(parent: Element, tag: str, attributes: dict[str, str]) -> Element:
    element = Element(tag, attributes)
    parent.children.append(element)
    return element


def _close_upto(stack: Open, tags: frozenset, bounds: frozenset) -> None:
    """Close the outermost open element of ``tags`` that is within ``bounds``."""
    cut = None
    if not any(map(stack.has, tags)):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            cut = i
        elif stack[i].tag in bounds:
            break
    if cut is not None:
        stack.cut(cut)


def _close(stack: Open, tag: str) -> None:
    if tag == "br":
        _add(stack[-1], "br", {})
        return
    in_table = tag in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption")
    for i in range(len(stack) - 1, 0 if stack.has(tag) else len(stack), -1):
        if stack[i].tag == tag:
            stack.cut(i)
            return
        if stack[i].tag in ("td", "th", "caption") and not in_table and tag not in ("html", "body"):
            break
    if tag == "p":
        _add(stack[-1], "p", {})


def _length(number: str, unit: str) -> float:
    return float(number) * PIXELS[unit] if re.fullmatch(r"\d*\.?\d+|\d+\.", number) else float("nan")


def _compared(a: float, sign: str, b: float) -> bool:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[sign]


def _has_feature(feature: str) -> bool:
    feature = feature.strip()
    if bound := _BOUND.fullmatch(feature):
        return _compared(SCREEN[bound[2]], ">=" if bound[1] == "min" else "<=", _length(bound[3], bound[4]))
    if sides := _RANGE.fullmatch(feature):
        own = SCREEN[sides[4]]
        left = not sides[3] or _compared(_length(sides[1], sides[2]), sides[3], own)
        return left and (not sides[5] or _compared(own, sides[5], _length(sides[6], sides[7])))
    return re.sub(r"\s*:\s*", ":", feature) in FEATURES


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds for the normal rendering; unknown features do not."""
    queries = [q.strip() for q in media.lower().split(",")]
    return queries == [""] or any(map(_query_holds, queries))


def _query_holds(query: str) -> bool:
    kind = re.match(r"(?:(not|only)\s+)?([a-z][a-z-]*)?", query)
    met = [bool(negated) != _has_feature(feature) for negated, feature in _CONDITION.findall(query)]
    if kind[2] and kind[2] not in ("not", "only"):
        holds = kind[2] in ("all", "screen") and all(met)
        return holds != (kind[1] == "not")
    return bool(met) and (any(met) if re.search(r"\)\s*or\b", query) else all(met))


def _applies(at_rule: str) -> bool:
    name, _, condition = _SPACE.sub(" ", at_rule[1:].replace("(", " (", 1)).lower().partition(" ")
    if name == "media":
        return on_screen(condition)
    return name == "layer" or (name == "supports" and not condition.strip().startswith("not"))


class Sheet:
    """Rules of a page's style sheets that hide elements by a tag, a class or an id. Rules within at-rules count if
    these apply to the normal rendering."""

    def __init__(self, *sheets: str):
        self.hidden: set[str] = set()
        for css in sheets:
            rules: list[tuple[str | None, bool]] = []
            for text, mark in _RULE.findall(_COMMENT.sub(" ", css)):
                text = text.strip()
                selectors, applies = rules[-1] if rules else (None, True)
                if mark != "{":
                    if selectors and applies and _HIDING.search(text):
                        self.hidden.update(s.strip().lower() for s in selectors.split(","))
                    if mark == "}" and rules:
                        rules.pop()
                elif text.startswith("@"):
                    rules.append((selectors, applies and _applies(text)))
                else:
                    # a rule in a rule hides only some of what its own selectors name
                    rules.append((text if selectors is None else "", applies))

    def hides(self, element: Element) -> bool:
        if not self.hidden:
            return False
        a = element.attributes
        names = [element.tag, f"#{a.get('id', '').lower()}", *(f".{c.lower()}" for c in a.get("class", "").split())]
        return any(n in self.hidden or f"{element.tag}{n}" in self.hidden for n in names)


class Page:
    """Lines of text with collapsed white space; blocks begin new lines, spaced blocks leave one line empty."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = False
        self.prefix, self.indent = "", ""

    def write(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.line += text

    def end_line(self, forced: bool = False) -> None:
        line = self.line.rstrip(" ")
        self.line = ""
        if line or forced:
            self._put(line)

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        start = self.prefix or self.indent
        self.prefix = ""
        self.lines.append((start + line).rstrip() if line else "")

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced

    def verbatim(self, text: str) -> None:
        self.end_line()
        for line in text.split("\n"):
            self._put(line)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


class Renderer:
    """Walks a tree without recursion; cells are laid out on pages of their own and put side by side."""

    def __init__(self, sheet: Sheet):
        self.sheet = sheet
        self.pages = [Page()]
        self.lists: list[int | None] = []
        self.tables: list[list[list[tuple[str, int]]]] = []
        self.verbatim = 0

    def render(self, root: Element) -> str:
        work: list[tuple[Element | str, bool]] = [(root, False)]
        while work:
            node, leaving = work.pop()
            if isinstance(node, str):
                self.text(node)
            elif leaving:
                self.leave(node)
            elif self.visible(node):
                self.enter(node)
                work.append((node, True))
                shown = node.children
                if node.tag == "details" and "open" not in node.attributes:
                    shown = [c for c in shown if isinstance(c, Element) and c.tag == "summary"][:1]
                work += [(child, False) for child in reversed(shown)]
        return self.pages[0].text()

    def visible(self, element: Element) -> bool:
        a = element.attributes
        if element.tag in NEVER_SHOWN or "hidden" in a or (element.tag == "dialog" and "open" not in a):
            return False
        if element.tag == "input" and a.get("type", "").lower() == "hidden":
            return False
        return not _HIDING.search(a.get("style", "")) and not self.sheet.hides(element)

    def text(self, text: str) -> None:
        page = self.pages[-1]
        if self.verbatim:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            page.line += first
            for line in rest:
                page.end_line(forced=True)
                page.line = line
        else:
            page.write(text)

    def enter(self, element: Element) -> None:
        tag, page = element.tag, self.pages[-1]
        if tag == "br":
            page.end_line(forced=True)
        elif tag == "input":
            if element.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url"):
                page.write(" " + element.attributes.get("value", "") + " ")
        elif tag in ("td", "th"):
            self.pages.append(Page())
        elif tag in BLOCKS:
            page.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and self.lists))
        if tag in ("ul", "menu", "dir"):
            self.lists.append(None)
        elif tag == "ol":
            start = element.attributes.get("start", "1")
            self.lists.append(int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
        elif tag == "li":
            self._item(page)
        elif tag == "dd":
            page.indent += "  "
        elif tag == "blockquote":
            page.indent += "> "
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("pre", "xmp"):
            self.verbatim += 1

    def _item(self, page: Page) -> None:
        mark = "- "
        if self.lists and self.lists[-1] is not None:
            mark = f"{self.lists[-1]}. "
            self.lists[-1] += 1
        page.prefix = page.indent + mark
        page.indent += "  "

    def leave(self, element: Element) -> None:
        tag = element.tag
        if tag in ("td", "th"):
            cell = self.pages.pop().text()
            span = element.attributes.get("colspan", "1")
            span = min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,8}", span) else 1
            if self.tables and self.tables[-1]:
                self.tables[-1][-1].append((cell, span))
            else:
                self.pages[-1].write(" " + cell + " ")
            return
        page = self.pages[-1]
        if tag == "table":
            laid = lay_out(self.tables.pop())
            if laid:
                page.verbatim(laid)
        if tag in BLOCKS:
            page.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and len(self.lists) > 1))
        if tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            page.indent, page.prefix = page.indent[:-2], ""
        elif tag in ("pre", "xmp"):
            self.verbatim -= 1


def lay_out(rows: list[list[tuple[str, int]]]) -> str:
    """Cells side by side, each column as wide as its widest line (at most WIDEST); a wide cell may reach beyond."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for cell, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(WIDEST, max(map(len, cell.split("\n")))))
            at += span
    out = []
    for row in rows:
        split = [(cell.split("\n"), span) for cell, span in row]
        for k in range(max((len(lines) for lines, _ in split), default=0)):
            at, line = 0, []
            for lines, span in split:
                width = sum(widths.get(at + j, 0) for j in range(span)) + len(GAP) * (span - 1)
                line.append((lines[k] if k < len(lines) else "").ljust(width))
                at += span
            out.append(GAP.join(line).rstrip())
    return "\n".join(out).strip("\n")


def page_text(html: str) -> tuple[str, str]:
    """Title and visible text of a page."""
    root = parse(html)
    css, title, work = [], "", [root]
    while work:
        node = work.pop()
        for child in node.children:
            if isinstance(child, Element):
                work.append(child)
        if node.tag == "style":
            if on_screen(node.attributes.get("media", "")):
                css += [c for c in node.children if isinstance(c, str)]
        elif node.tag == "title":
            title = "".join(c for c in node.children if isinstance(c, str))
    return _SPACE.sub(" ", title).strip(), Renderer(Sheet(*css)).render(root)


def visible_text(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, title, text, n_chars, n_lines``.

    A null or empty page has an empty title and text; a page without markup is its own text with collapsed white
    space. Repeated pages are laid out again, other columns are not read, an empty table gives no rows. The work is
    in proportion to the page's length, and nesting may be of any depth.
    """

    def make():
        def work(rows):
            made = [page_text(html or "") for html in rows["html"]]
            return {
                "page_id": rows["page_id"],
                "url": rows["url"],
                "title": [title for title, _ in made],
                "text": [text for _, text in made],
                "n_chars": [len(text) for _, text in made],
                "n_lines": [len(text.split("\n")) if text else 0 for _, text in made],
            }

        return work

    columns = pages.select("page_id", "url", "html")
    return map_rows(columns, make, "page_id long, url string, title string, text string, n_chars long, n_lines long")

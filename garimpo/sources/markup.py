"""Small element tree on the standard HTML parser, used inside tasks."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

from garimpo.functions.html import HIDDEN_ELEMENTS

VOID = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
KEEPS_SPACES = frozenset(("pre", "textarea"))
# elements whose content the parser reads in a way of its own
_MODES = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())
_RAW = ("script", "style")
_ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9_:]*+)(?:="([^"<>]*+)")?')
# what stands between the brackets of an end tag, a start tag or a comment
_PLAIN = re.compile(
    r'/([a-zA-Z][a-zA-Z0-9]*+)|([a-zA-Z][a-zA-Z0-9]*+)((?:[ \n]++[a-zA-Z][-a-zA-Z0-9_:]*+(?:="[^"<>]*+")?)*+)[ \n]*+(/?)'
    r"|!--(?:[^->]|-(?!-))*+--"
)


@lru_cache(1 << 14)
def _class_matches(pattern: re.Pattern, value: str) -> bool:
    return any(pattern.search(token) for token in value.split()) or bool(pattern.search(value))


class Element:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.items: list[Element | str] = []

    def has_class(self, pattern: re.Pattern) -> bool:
        value = self.attrs.get("class")
        return bool(value) and _class_matches(pattern, value)

    def walk(self):
        """Descendants in document order."""
        todo = self.items[::-1]
        while todo:
            item = todo.pop()
            if isinstance(item, Element):
                yield item
                todo.extend(item.items[::-1])

    def find(self, pattern: re.Pattern, tag: str | None = None) -> Element | None:
        todo = self.items[::-1]
        while todo:
            item = todo.pop()
            if isinstance(item, Element):
                value = item.attrs.get("class")
                if value and (tag is None or item.tag == tag) and _class_matches(pattern, value):
                    return item
                if item.items:
                    todo.extend(item.items[::-1])
        return None

    def strings(self, marks: bool = False) -> list[str]:
        """Visible strings; ``marks`` renders line breaks, paragraphs and list items."""
        out: list[str] = []
        todo: list[Element | str] = [*reversed(self.items)]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
            elif item.tag not in HIDDEN_ELEMENTS:
                if marks and item.tag == "br":
                    out.append("\n")
                    continue
                if marks and item.tag in ("p", "li"):
                    todo.append("\n")
                todo.extend(reversed(item.items))
                if marks and item.tag == "li":
                    out.append("- ")
        return out


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]
        self.pieces: list[str] = []

    def flush(self):
        text = "".join(self.pieces)
        self.pieces.clear()
        if text:
            if not text.strip(" \n\t\f\r") and not any(e.tag in KEEPS_SPACES for e in self.open):
                text = "\n" if "\n" in text else " "
            self.open[-1].items.append(text)

    def handle_data(self, data):
        self.pieces.append(data)

    def handle_starttag(self, tag, attrs, closed=False):
        self.flush()
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(element)
        if not closed and tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag):
        self.flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()

    def handle_pi(self, data):
        self.flush()

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            self.pieces.append(data[len("CDATA["):])
            self.flush()


def _shown(text: str, open_: list[Element]) -> str:
    """White space alone is one blank or line break, but where it is kept."""
    if text.isspace() and not text.strip(" \n\t\f\r") and not any(e.tag in KEEPS_SPACES for e in open_):
        return "\n" if "\n" in text else " "
    return text


@lru_cache(1 << 14)
def _tag(inner: str) -> tuple[str, str, dict[str, str]] | None:
    """Kind, name and attributes of a plain tag or comment, None if it is not plain.

    Most tags of a site come again on each page; the attributes are shared and stay as they are.
    """
    found = _PLAIN.fullmatch(inner)
    if found is None:
        return None
    end, name, given, closed = found.groups()
    if end:
        return "end", end.lower(), {}
    if not name:
        return "comment", "", {}
    attrs = {}
    for key, value in _ATTRIBUTE.findall(given):
        if value.count("&") != value.count("&amp;"):
            return None
        attrs[key.lower()] = value.replace("&amp;", "&")
    name = name.lower()
    if name in _MODES:
        return ("raw", name, attrs) if name in _RAW and not closed else None
    return ("empty" if closed or name in VOID else "start"), name, attrs


def _plain(html: str) -> Element | None:
    """The tree `_Builder` makes of a page in plain markup, in a fraction of its time; None for any other page.

    Plain are tags whose attributes stand in double quotes, comments without a double dash, and
    scripts and styles without an end tag or comment in them.
    """
    root = Element("", {})
    open_ = [root]
    parts = iter(html.split("<"))
    text = next(parts)
    while True:
        if text:
            text = _shown(unescape(text) if "&" in text else text, open_)
            if text:
                open_[-1].items.append(text)
        part = next(parts, None)
        if part is None:
            return root
        inner, bracket, text = part.partition(">")
        read = _tag(inner) if bracket else None
        if read is None:
            return None
        kind, name, attrs = read
        if kind == "end":
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth].tag == name:
                    del open_[depth:]
                    break
        elif kind != "comment":
            element = Element(name, attrs)
            open_[-1].items.append(element)
            if kind == "start":
                open_.append(element)
            elif kind == "raw":
                content, close = text, f"/{name}>"
                while not (part := next(parts, "/")).startswith(close):
                    if part.startswith(("/", "!")):
                        return None
                    content += "<" + part
                if content:
                    element.items.append(_shown(content, open_))
                text = part[len(close):]


def parse(html: str) -> Element:
    plain = _plain(html)
    if plain is not None:
        return plain
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.flush()
    return builder.root

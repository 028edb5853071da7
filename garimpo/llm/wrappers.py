"""Main text of web pages by inferred wrappers: union-free regular expressions for each host.

A page is a tree of its block elements with text slots for leaves. Equal or like-labelled
neighbours fold into a repeated group, so a page is an expression of its own. The expressions
of a host's pages are aligned one after the other: items in both are aligned on, items only
one of them has become optional, like items side by side become repeated, and texts become
slots. No alternative is ever needed, so the wrapper stays union-free. Wrappers align with
each other as pages do: each host is inferred in salted parts first, over its distinct
expressions, then over the parts; a task holds one wrapper at a time.

A wrapper's slots are judged once for a host, by their path of labels and by sums over all of
the host's pages: slots inside the article (or else main, or else the element with most of
the varying, unlinked text; text that several pages of different content share does not vary) that no menu, header, footer, sidebar, notice, advert, form or
comment element encloses. Extraction takes the texts of each page whose paths are those of such
slots: pages are not matched against the expression, so its options, repeats and order change no
text. A page without text in the host's article slots is judged by its own tree alone.

Elements deeper than `DEPTH` lie side by side under their ancestor of that depth, or under the
menu, notice, article or the like that holds them there; so trees of any page stay shallow.

Defined cases: null html is an empty page; a null or malformed url belongs to the host ''; a
page without article text yields the empty text; rows that repeat a page_id are rows of their
own in the result, while copies of a page count once in what is judged; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo import runtime

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|\Z|[\"'])", re.IGNORECASE)
_CONTROL = re.compile(r"<(?:button|select)(?=[\s/>])", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg canvas object audio video button select".split())
DEPTH = 120
BLOCKS = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot caption tr td th blockquote pre figure "
    "figcaption header footer nav aside form fieldset legend label option menu dialog details summary address hr center".split()
)
CLOSES = {  # an element that begins ends an open one of these just around it
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
ASIDE_TAGS = frozenset("head nav footer aside form fieldset select option button menu dialog label legend".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead banner ad ads advert adverts advertisement advertising sponsor "
    "sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments disqus reply replies respond pagination pager widget toolbar "
    "copyright legal skip search complementary contentinfo form".split()
)
HEAD = "^"
CORE_TAGS = frozenset(("html", "body", "article", "main"))


class Page:
    """Blocks of a page in order, (path, text, linked characters), and its tree of labels."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, str, int]] = []
        self.root: list = ["", []]  # label, children; a slot is the string '#'
        stack: list[tuple[str, str, list, tuple | None]] = [("", "", self.root, None)]  # name, path, node, what holds deeper ones
        open_: Counter[str] = Counter()
        text: list[str] = []
        linked, in_link, at, end = 0, False, 0, len(source)

        def flush() -> None:
            nonlocal linked
            joined = " ".join("".join(text).split())
            if joined:
                self.blocks.append((stack[-1][1], joined, min(linked, len(joined))))
                children = stack[-1][2][1]
                if not children or children[-1] != "#":
                    children.append("#")
            text.clear()
            linked = 0

        while at < end:
            match = _TAG.search(source, at)
            piece = source[at : match.start() if match else end]
            if piece:
                piece = html.unescape(piece) if "&" in piece else piece
                text.append(piece)
                linked += len(piece.strip()) if in_link else 0
            if not match:
                break
            at = match.end()
            close, name = match[1], match[2] or match[4]
            if close:
                close = close.lower()
                if close == "a":
                    in_link = False
                elif close in BLOCKS:
                    flush()
                    while open_[close]:
                        gone = stack.pop()[0]
                        open_[gone] -= 1
                        if gone == close:
                            break
            elif name:
                name = name.lower()
                if name in RAW:
                    if name == "svg" and (match[3] or match[5] or "").endswith("/"):
                        continue
                    ends = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
                    begins = _CONTROL.search(source, at) if name in ("button", "select") else None
                    if begins and ends and begins.start() < ends.start():
                        ends = None  # it was never closed
                    at = ends.end() if ends else (end if name in ("script", "style") else at)
                elif name == "a":
                    in_link = True
                elif name == "br" or name == "img":
                    text.append(" ")
                elif name in BLOCKS:
                    flush()
                    in_link = False
                    if name == "hr":
                        continue
                    if stack[-1][0] == "p" or (stack[-1][0] in CLOSES.get(name, ()) and len(stack) > 1):
                        open_[stack.pop()[0]] -= 1
                    while len(stack) > 1 and stack[-1][0] in CLOSES.get(name, ()):
                        open_[stack.pop()[0]] -= 1
                    label = _label(name, match[3] or match[5] or "")
                    stack.append((name, *self._placed(stack[-1], len(stack), label)))
                    open_[name] += 1
        flush()

    @staticmethod
    def _placed(parent: tuple[str, str, list, tuple | None], level: int, label: str) -> tuple[str, list, tuple | None]:
        """Path and node of an element, and what holds its descendants if they are too deep:
        (path, node, kind), the kind 0 for any element, 1 for one of an article, 2 for one beside it."""
        _, path, node, holder = parent
        if level < DEPTH:
            holder = None
        elif holder is None:
            holder = (path, node, 0)
        if holder:
            path, node, kind = holder
            if kind == 2:  # all below is aside, whatever it is
                return path, node, holder
        child = [label, []]
        node[1].append(child)
        below = f"{path}/{label}"
        if holder:
            own = 2 if _aside(label, kind == 1) else int(_is_core(label) > 0)
            holder = (below, child, own) if own > kind else holder
        return below, child, holder


def _label(name: str, attributes: str) -> str:
    """Element name and the words of its class, id and role."""
    if len(attributes) < 3:
        return name
    words: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            words.append("hidden")
        elif key in ("class", "id", "role", "itemprop"):
            words += [w.lower() for w in _WORD.findall(value)]
    return ".".join([name, *sorted(set(words))])


# Wrappers: [label, children, optional, repeated]; a slot is ["#", [], optional, repeated], a group ["+", items, ...]


def folded(node: list | str) -> list:
    """The expression of one page."""
    if node == "#":
        return ["#", [], False, False]
    return [node[0], _fold([folded(c) for c in node[1]]), False, False]


def _fold(items: list) -> list:
    """Neighbours with one label, and sequences of labels that repeat, become repeated groups."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0] and item[0] != "+":
            out[-1] = _aligned(out[-1], item)
            out[-1][3] = True
        else:
            out.append(item)
    for size in range(2, 5):
        i = 0
        while i + 2 * size <= len(out):
            one, two = out[i : i + size], out[i + size : i + 2 * size]
            if [x[0] for x in one] == [x[0] for x in two] and all(x[0] != "+" for x in one):
                group = ["+", [_aligned(a, b) for a, b in zip(one, two, strict=True)], False, True]
                j = i + 2 * size
                while [x[0] for x in out[j : j + size]] == [x[0] for x in one]:
                    group[1] = [_aligned(a, b) for a, b in zip(group[1], out[j : j + size], strict=True)]
                    j += size
                out[i:j] = [group]
            i += 1
    return out


def _aligned(a: list, b: list) -> list:
    """Expression that covers two with the same label."""
    return [a[0], _merged(a[1], b[1]), a[2] or b[2], a[3] or b[3]]


def _merged(one: list, two: list) -> list:
    if one == two:
        return one
    keys = [[x[0] if x[0] != "+" else "+" + " ".join(y[0] for y in x[1]) for x in items] for items in (one, two)]
    out: list = []
    for kind, a, b, c, d in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_aligned(x, y) for x, y in zip(one[a:b], two[c:d], strict=True)]
        else:
            out += [[x[0], x[1], True, x[3]] for x in (*one[a:b], *two[c:d])]
    return _fold(out)


def expression(node: list) -> str:
    """A wrapper as a regular expression over labels, `#` for a slot."""
    inside = " ".join(expression(c) for c in node[1])
    body = "#" if node[0] == "#" else f"({inside})" if node[0] == "+" else f"{node[0]}({inside})"
    return body + ("+" if node[3] else "") + ("?" if node[2] else "")


def _aside(label: str, in_core: bool) -> bool:
    name, *words = label.split(".")
    if name in ASIDE_TAGS or "hidden" in words:
        return True
    if name in CORE_TAGS:
        return False
    if name == "header" or "header" in words or "banner" in words:
        return not in_core
    return any(w in ASIDE_WORDS for w in words)


def _is_core(label: str) -> int:
    """2 for an article, 1 for main, 0 else."""
    name, *words = label.split(".")
    if name == "article" or {"article", "body"} <= set(words) and name != "body":
        return 2
    return int(name == "main" or "main" in words and name in ("div", "section"))


def _slots(wrapper: list) -> list[tuple[str, int, bool]]:
    """(path, core, aside) of each slot of a wrapper or of a page's own expression."""
    slots: list[tuple[str, int, bool]] = []

    def holds_core(node: list) -> bool:
        return bool(_is_core(node[0])) or any(holds_core(c) for c in node[1])

    def walk(node: list, path: str, core: int, aside: bool) -> None:
        for child in node[1]:
            label = child[0]
            if label == "#":
                slots.append((path, core, aside))
            elif label == "+":
                walk(child, path, core, aside)
            else:
                away = aside or _aside(label, core > 0) and not (holds_core(child) and label.split(".")[0] not in ASIDE_TAGS)
                walk(child, f"{path}/{label}", max(core, _is_core(label)), away)

    walk(wrapper, "", 0, False)
    return slots


def _content(page: Page, tree: list) -> bytes:
    """A name of what a page says outside menus, adverts and lists of links: copies have it in common."""
    own = {path for path, _, aside in _slots(tree) if not aside}
    blocks = [(p, t) for p, t, n in page.blocks if p in own and 2 * n <= len(t)] or [(p, t) for p, t, _ in page.blocks]
    return hashlib.blake2b(json.dumps(blocks).encode(), digest_size=16).digest()


def judged(wrapper: list, stats: dict[str, tuple[int, int, int, int]]) -> list[str]:
    """Paths of the wrapper's article slots, those of headlines before it marked; stats: path -> pages, copies counted once, characters, linked ones, texts (2: several)."""
    slots = _slots(wrapper)
    mass: dict[str, int] = {}
    for path, _, aside in slots:
        pages, chars, linked, texts = stats.get(path, (0, 0, 0, 0))
        mass[path] = 0 if aside or 2 * linked > chars or texts < 2 and pages > 2 else chars
    for level in (2, 1):
        inside = {p for p, core, aside in slots if core >= level and not aside}
        if sum(stats.get(p, (0, 0, 0, 0))[1] for p in inside):
            # the headline may stand before the article
            heads = {p for p, _, aside in slots if not aside and p.rsplit("/", 1)[-1].split(".")[0] == "h1" and mass[p]}
            return sorted(inside) + [HEAD + p for p in sorted(heads - inside)]
    # the deepest element with most of the text
    total, best = sum(mass.values()), ""
    holders = {"/".join(p.split("/")[:i]) for p in mass for i in range(1, len(p.split("/")) + 1)}
    for holder in sorted(holders, key=lambda h: h.count("/")):
        if total and sum(m for p, m in mass.items() if p == holder or p.startswith(holder + "/")) >= 0.8 * total and holder.startswith(best) and holder.rsplit("/", 1)[-1].split(".")[0] not in ("p", "li", "td"):
            best = holder
    return sorted(p for p, m in mass.items() if m and (p == best or p.startswith(best + "/")))


def main_text(page: Page, paths: frozenset[str]) -> str:
    if page.blocks and not any(p in paths for p, _, _ in page.blocks):
        own = {p: (1, c, n, 2) for p, (_, c, n, _) in _sums(page).items()}
        paths = frozenset(judged(folded(page.root), own))
    return "\n".join(t for p, t, _ in page.blocks if p in paths or HEAD + p in paths)


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for value in batch.column(batch.schema.get_field_index("html")):
        yield value.as_py() or ""


def wrappers(pages: DataFrame, parts: int = 16) -> DataFrame:
    """(host, expression, paths) from (host, html): each host's wrapper and its article slots."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
            for host, source in zip(hosts, _texts(batch), strict=True):
                page = Page(source)
                tree = folded(page.root)
                rows.append((host, json.dumps(tree, separators=(",", ":")), None, None, 0, 0, None))
                content = _content(page, tree)
                rows += [(host, None, path, content, *s[1:]) for path, s in _sums(page).items()]
            # equal expressions of a batch go on once
            rows = list(dict.fromkeys(r for r in rows if r[1])) + [r for r in rows if not r[1]]
            kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["host", "tree", "path", "content", "chars", "linked", "first"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    seen = runtime.stage(pages.mapInArrow(read, "host string, tree string, path string, content binary, chars long, linked long, first long"), "trees")
    trees = seen.filter("tree IS NOT NULL").groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))

    def infer(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wrapper = None
        for batch in batches:
            for tree in batch["tree"]:
                node = json.loads(tree)
                wrapper = node if wrapper is None else _aligned(wrapper, node)
        if wrapper is not None:
            yield pd.DataFrame({"host": [key[0]], "tree": [json.dumps(wrapper, separators=(",", ":"))]})

    part = F.pmod(F.xxhash64("tree"), F.lit(parts))
    partial = trees.select("host", "tree", part.alias("part")).groupBy("host", "part").applyInPandas(infer, "host string, tree string")
    whole = partial.groupBy("host").applyInPandas(infer, "host string, tree string")
    # copies of a page are one page, however many rows they have
    once = seen.filter("path IS NOT NULL").groupBy("host", "path", "content").agg(
        F.max("chars").alias("chars"), F.max("linked").alias("linked"), F.min("first").alias("least"), F.max("first").alias("most")
    )
    sums = once.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.when(F.min("least") == F.max("most"), 1).otherwise(2).alias("texts"),
    )
    slots = sums.groupBy("host").agg(F.collect_list(F.struct("path", "pages", "chars", "linked", "texts")).alias("slots"))  # one entry a path of the wrapper

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, expressions = [], []
            for tree, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                wrapper = json.loads(tree)
                expressions.append(expression(wrapper))
                paths.append(judged(wrapper, {s["path"]: (s["pages"], s["chars"], s["linked"], s["texts"]) for s in found or ()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expressions, pa.string()), pa.array(paths, pa.list_(pa.string()))], names=["host", "expression", "paths"])

    return whole.join(slots, "host", "left").select("host", "tree", "slots").mapInArrow(judge, "host string, expression string, paths array<string>")


def _sums(page: Page) -> dict[str, tuple[int, int, int, int]]:
    """Per path: one page, characters, linked characters, and a name of its text."""
    texts: dict[str, list[str]] = {}
    links: Counter[str] = Counter()
    for path, text, n in page.blocks:
        texts.setdefault(path, []).append(text)
        links[path] += n
    out = {}
    for path, found in texts.items():
        linked = links[path]
        name = int.from_bytes(hashlib.blake2b("\n".join(found).encode(), digest_size=7).digest())
        out[path] = (1, sum(map(len, found)), linked, name)
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page of (page_id, url, html): page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    found = runtime.stage(wrappers(rows.select("host", "html")), "wrappers").select("host", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, frozenset] = {}
            texts = []
            for source, paths in zip(_texts(batch), batch.column(3).to_pylist(), strict=True):
                key = tuple(paths or ())
                texts.append(main_text(Page(source), known.setdefault(key, frozenset(key))))
            chars = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), chars], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "paths")
    kinds = dict(rows.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

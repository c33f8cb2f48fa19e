"""One page of markup: clean it, and list its blocks. Used inside pandas UDFs only."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

# What is removed from a page, and the patterns involved.
NOISE_TAGS = {"script", "style", "noscript", "iframe", "svg", "form", "nav", "aside", "button", "img"}
NOISE_CLASS = re.compile(
    r"(advert|adsense|cta|share-|social|newsletter|popup|related-posts|wp-block-embed)", re.I
)
SHORTCODE = re.compile(r"\[[a-zA-Z][^\[\]]{0,400}\]")
JUMP_TO = re.compile(r"jump\s+to", re.I)
NBSP = re.compile(r"(?:\xa0|&nbsp;)+", re.I)
ANY_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
CONTAINERS = {"div", "section", "article", "main", "blockquote"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3}
MAY_BE_EMPTY = {"p", "div", "span", "li"}
KEEPS_EMPTY = {"img", "table", "ul", "ol"}

# Markup rules for void elements and for tags that may stay open.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEAD_ONLY = {"title", "meta", "link", "base", "style", "script"}
H = {"h1", "h2", "h3", "h4", "h5", "h6"}
FONT = {"tt", "i", "b", "u", "s", "strike", "big", "small"}
CELLS = {"td", "th"}
CLOSED_BY = {
    "p": {"p"} | H | FONT,
    "li": {"p", "li"} | H,
    "tr": {"p", "tr"} | CELLS,
    **dict.fromkeys(CELLS, {"p"} | CELLS),
    **dict.fromkeys(H, {"p"} | H),
    **dict.fromkeys(("div", "ul", "ol", "table", "dl", "pre", "hr", "form", "address"), {"p"}),
}
STRENGTH = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190}


class Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def nodes(self):
        """All below, in page order; pages nest to any depth, so without recursion.
        Who takes an element may change its children before going on."""
        open_ = self.children[::-1]
        while open_:
            node = open_.pop()
            yield node
            if isinstance(node, Element):
                open_.extend(reversed(node.children))

    def elements(self):
        return (n for n in self.nodes() if isinstance(n, Element))

    def strings(self):
        return (n for n in self.nodes() if isinstance(n, str))

    def text(self) -> str:
        return tidy(" ".join(s.strip() for s in self.strings() if s.strip()))


def tidy(value: str) -> str:
    return " ".join(value.split())


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Element("body", {})]

    def handle_starttag(self, tag, attrs):
        if tag in {"html", "body"}:
            del self.stack[1:]
            return
        if self.stack[-1].tag == "head" and tag not in HEAD_ONLY:
            self.stack.pop()
        while len(self.stack) > 1 and self.stack[-1].tag in CLOSED_BY.get(tag, ()):
            self.stack.pop()
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(element)
        if tag not in VOID:
            self.stack.append(element)

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                del self.stack[depth:]
                return
            if STRENGTH.get(self.stack[depth].tag, 100) > STRENGTH.get(tag, 100):
                return

    def handle_data(self, data):
        children = self.stack[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def _prune(element: Element, drop) -> None:
    def kept(e: Element) -> list:
        return [c for c in e.children if not (isinstance(c, Element) and drop(c))]

    element.children = kept(element)
    for e in element.elements():
        e.children = kept(e)


def _is_noise(e: Element) -> bool:
    return e.tag in NOISE_TAGS or e.tag in HEAD_ONLY or e.tag == "head" or bool(NOISE_CLASS.search(e.attrs.get("class", "")))


def _is_anchor_list(e: Element) -> bool:
    links = [a.attrs["href"] for a in e.elements() if a.tag == "a" and "href" in a.attrs]
    return e.tag == "ul" and bool(links) and all(link.startswith("#") for link in links)


def _announces_contents(child) -> bool:
    if isinstance(child, str):
        return bool(JUMP_TO.search(child))
    return any(isinstance(c, str) and JUMP_TO.search(c) for c in child.children)


def _without_contents(parent: Element) -> list:
    """The children, but for what says "jump to" and the list of anchors that follows it."""
    kept, after = [], False
    for child in parent.children:
        if isinstance(child, Element):
            if after and _is_anchor_list(child):
                after = False
                continue
            after = False
        if _announces_contents(child):
            after = True
        else:
            kept.append(child)
    return kept


def _drop_contents(body: Element) -> None:
    body.children = _without_contents(body)
    for e in body.elements():
        e.children = _without_contents(e)


def _clean_strings(body: Element) -> None:
    for e in [body, *body.elements()]:
        e.children = [NBSP.sub(" ", SHORTCODE.sub("", c)) if isinstance(c, str) else c for c in e.children]


def _drop_empty(body: Element) -> None:
    full: set[int] = set()  # elements with a text, list, table or image in them
    for e in reversed([*body.elements()]):
        if any(c.strip() if isinstance(c, str) else c.tag in KEEPS_EMPTY or id(c) in full for c in e.children):
            full.add(id(e))
    _prune(body, lambda e: e.tag in MAY_BE_EMPTY and id(e) not in full)


def clean_tree(html: str) -> Element:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    body = reader.stack[0]
    _prune(body, _is_noise)
    _drop_contents(body)
    _clean_strings(body)
    _drop_empty(body)
    body.children = [c for c in body.children if isinstance(c, Element) or c.strip()]
    return body


def _markup(body: Element) -> str:
    out: list[str] = []
    todo = [(c, False) for c in reversed(body.children)]
    while todo:
        node, written = todo.pop()
        if written:
            out.append(node)
        elif isinstance(node, str):
            out.append(escape(node, quote=False))
        else:
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
            void = node.tag in VOID
            out.append(f"<{node.tag}{attrs}/>" if void else f"<{node.tag}{attrs}>")
            if not void:
                todo.append((f"</{node.tag}>", True))
                todo.extend((c, False) for c in reversed(node.children))
    return "".join(out)


def clean_page(html: str | None) -> str:
    """The page body without noise; blank input gives an empty string."""
    if not html or not html.strip():
        return ""
    return _markup(clean_tree(html))


def _list_text(e: Element) -> str:
    items = [c.text() for c in e.children if isinstance(c, Element) and c.tag == "li"]
    items = [i for i in items if i]
    return "\n".join(f"{n}. {i}" if e.tag == "ol" else f"- {i}" for n, i in enumerate(items, 1))


def _table_text(e: Element) -> str:
    rows = []
    for row in e.elements():
        if row.tag == "tr":
            cells = [c.text() for c in row.children if isinstance(c, Element) and c.tag in CELLS]
            rows.append(" | ".join(c for c in cells if c))
    return "\n".join(r for r in rows if r)


def _blocks(body: Element):
    todo = body.children[::-1]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            yield "paragraph", None, tidy(node)
        elif node.tag in HEADINGS:
            yield "heading", HEADINGS[node.tag], node.text()
        elif node.tag in {"ul", "ol"}:
            yield "list", None, _list_text(node)
        elif node.tag == "table":
            yield "table", None, _table_text(node)
        elif node.tag in CONTAINERS:
            todo.extend(reversed(node.children))
        else:
            yield "paragraph", None, node.text()


def page_blocks(html: str | None) -> list[tuple[str, int | None, str]]:
    """``(kind, level, text)`` in page order. Text without any tag is split at blank lines."""
    if not html or not html.strip():
        return []
    if not ANY_TAG.search(html):
        plain = NBSP.sub(" ", SHORTCODE.sub("", html))
        return [("paragraph", None, tidy(p)) for p in re.split(r"\n\s*\n", plain) if p.strip()]
    return [b for b in _blocks(clean_tree(html)) if b[2]]

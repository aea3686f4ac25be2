"""Web pages to marked-up text, by the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Where a page's own content is looked for, in order, and what is dropped.
MAIN = [("tag", "main"), ("tag", "article"), ("role", "main"), ("id", "content"), ("class", "entry-content"), ("id", "main"), ("class", "post"), ("class", "content")]
DROPPED = frozenset("head script style noscript nav footer header aside form iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article blockquote body dd div dl dt figure figcaption h1 h2 h3 h4 h5 h6 hr li main ol p pre section table tr ul".split())


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parts, self.parent = tag, attrs, [], parent

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def text(self) -> str:
        """All text, pieces trimmed and joined by spaces."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node.strip())
            else:
                todo += reversed(node.parts)
        return " ".join(t for t in out if t)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def _is(node: Node, kind: str, value: str) -> bool:
    if kind == "tag":
        return node.tag == value
    return value in node.attrs.get("class", "").split() if kind == "class" else node.attrs.get(kind) == value


def _remove(root: Node, gone) -> None:
    for node in list(root.walk()):
        node.parts = [p for p in node.parts if isinstance(p, str) or not gone(p)]


def _link_list(node: Node) -> bool:
    if node.tag not in ("ul", "ol"):
        return False
    links, size = [n for n in node.walk() if n.tag == "a"], len(node.text())
    return len(links) >= 5 and size > 0 and sum(len(a.text()) for a in links) / size > 0.8


def _render(node: Node, out: list[str], depth: int = 0) -> None:
    if depth > 400:  # deeper nesting is flattened
        out.append(node.text())
        return
    inline: list[str] = []

    def flush() -> None:
        line = " ".join("".join(inline).split())
        inline.clear()
        if line:
            out.append(line)

    def collect(n: Node, level: int) -> None:
        for p in n.parts:
            if isinstance(p, str):
                inline.append(p)
            elif p.tag == "br":
                flush()
            elif p.tag in BLOCKS or level > 400:
                flush()
                begin = len(out)
                _render(p, out, depth + 1)
                if re.fullmatch("h[1-6]", p.tag) and len(out) > begin:
                    out[begin:] = ["#" * int(p.tag[1]) + " " + " ".join(out[begin:])]
                elif p.tag == "li" and len(out) > begin:
                    out[begin] = "- " + out[begin]
            else:
                if p.tag in ("td", "th"):
                    inline.append(" | ")
                collect(p, level + 1)

    collect(node, depth)
    flush()


def load_html(html: str) -> tuple[str | None, str]:
    """(title, text): the content container with a fifth of the page's text, without menus; headings marked by "#"."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    title = next((n.text() for n in tree.root.walk() if n.tag == "title"), None)
    _remove(tree.root, lambda n: n.tag in DROPPED)
    total = len(tree.root.text()) or 1
    content = next((n for n in tree.root.walk() if n.tag == "body"), tree.root)
    for kind, value in MAIN:
        first = next((n for n in tree.root.walk() if _is(n, kind, value)), None)
        if first is not None and len(first.text()) >= total / 5:
            content = first
            break
    _remove(content, _link_list)
    lines: list[str] = []
    _render(content, lines)
    return title, "\n\n".join(lines)

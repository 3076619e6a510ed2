"""A small, forgiving HTML tree: elements with their label and children, texts with references decoded."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of HTML: elements without content, with raw text, and those that a sibling start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An end tag, or a sibling that closes an open one, reaches no further up than these.
BARRIER = frozenset("table ul ol dl article section main nav aside header footer form body html div".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^>]*\Z", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)  # Node or str

    def label(self) -> str:
        """The tag, with the class or id that tells it from others of the kind."""
        mark = self.attrs.get("class") or self.attrs.get("id") or self.attrs.get("role") or ""
        return f"{self.tag}.{'.'.join(sorted(re.sub(r'[0-9]+', '', mark).split()))}" if mark else self.tag


def parse(source: str) -> Node:
    """The tree of a page. Never fails: what is not understood is dropped as markup, what is open at the end is closed."""
    root = Node("#root", {})
    stack, at, n = [root], 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in BARRIER and tag not in BARRIER:
                    break
            continue
        closed = SAME_CLOSED.get(tag, ()) if tag not in CLOSES_P else ("p",)
        if closed:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    del stack[k:]
                    break
                if stack[k].tag in BARRIER:
                    break
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[3])} if m[3] else {}
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root

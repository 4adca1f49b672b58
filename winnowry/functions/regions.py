"""Regions of stored pages chosen by CSS selectors.

The only Python step is the small tree walk below: it returns candidate regions, and every rule
about them (which selector wins, minimum lengths, defaults) is a Spark expression.
"""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .pieces import arrow_type, pieces

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# A start tag on the right ends an open element on the left.
ENDED_BY = {
    "p": set(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
        "main menu nav ol p pre section table ul".split()
    ),
    "li": {"li"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "tr": {"tr"},
    "option": {"option"},
}
BLOCKS = {"div", "article", "section", "table", "ul", "ol", "body", "main", "nav", "button"}
HIDDEN = {"script", "style", "svg", "noscript"}
_STEP = re.compile(
    r"(?P<tag>[a-z][\w-]*)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)\"(?P<val>[^\"]*)\")?\]"
    r"|:has\((?P<has>[^)]*)\)"
)


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if not isinstance(n, str):
                yield n
                stack.extend(reversed(n.children))

    def texts(self, skip=()):
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in skip:
                stack.extend(reversed(n.children))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = self.at
        while n.parent is not None and n.tag not in ENDED_BY and n.tag not in BLOCKS:
            n = n.parent
        if tag in ENDED_BY.get(n.tag, ()):
            self.at = n.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _compile(selector):
    """Alternatives (comma), each a list of descendant steps, each a list of tests on one element."""
    return [
        [[m.groupdict() for m in _STEP.finditer(step)] for step in re.findall(r"(?:\[[^\]]*\]|\([^)]*\)|\S)+", one)]
        for one in selector.split(", ")
    ]


def _passes(node, tests):
    for m in tests:
        if m["tag"]:
            ok = node.tag == m["tag"]
        elif m["cls"]:
            ok = m["cls"] in node.attrs.get("class", "").split()
        elif m["attr"]:
            value = node.attrs.get(m["attr"])
            ok = value is not None and (
                m["op"] is None or (value == m["val"] if m["op"] == "=" else m["val"] in value)
            )
        else:
            inner = _compile(m["has"])
            ok = any(_matches(n, inner) for n in node.walk())
        if not ok:
            return False
    return True


def _matches(node, alternatives):
    return any(_matches_steps(node, steps) for steps in alternatives)


def _matches_steps(node, steps):
    if not _passes(node, steps[-1]):
        return False
    at = node.parent
    for tests in reversed(steps[:-1]):
        while at is not None and not _passes(at, tests):
            at = at.parent
        if at is None:
            return False
        at = at.parent
    return True


def _markup(node):
    parts, stack = [], list(reversed(node.children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n.replace("<", "&lt;"))
        else:
            attrs = "".join(f' {k}="{v}"' for k, v in n.attrs.items())
            parts.append(f"<{n.tag}{attrs}>")
            stack.append(f"</{n.tag}>")
            stack.extend(reversed(n.children))
    return "".join(parts).lower()


def _element(node):
    return {"visible": _visible(node), "markup": _markup(node)}


def _visible(node):
    return " ".join(t.strip() for t in node.texts(HIDDEN) if t.strip())


def _field(node):
    if node is None:
        return None
    return {"text": "".join(node.texts()), "visible": _visible(node), "content": node.attrs.get("content")}


ELEMENT = "struct<visible:string,markup:string>"
FIELD = "struct<text:string,visible:string,content:string>"


def find_regions(
    html: Column, page: dict[str, list[str]] | None = None, scope: list[str] | None = None,
    fields: dict[str, list[str]] | None = None, element: bool = False,
) -> Column:
    """struct<page, items>, from one walk of each page.

    ``page`` and ``fields`` name lists of selectors; the result holds the first match of every selector, in
    selector order. ``items`` are the elements that match any ``scope`` selector, in document order and
    without repeats; with ``element`` each also carries its own text and markup as ``self``. A page without a
    body element is its own body. A null page has no regions; one that cannot be parsed has none either and
    says why in ``error``. To have a page parsed once, put the result into ``operators.stages.computed``.
    """
    page, scope, fields = page or {}, scope or [], fields or {}
    shape = lambda names: ",".join(f"{n}:array<{FIELD}>" for n in names)
    item = ",".join(filter(None, [f"self:{ELEMENT}" if element else "", shape(fields)]))
    items = f"items:array<struct<{item}>>," if scope else ""
    schema = f"struct<page:struct<{shape(page)}>,{items}error:string>"
    scope_steps = [_compile(s) for s in scope]
    compiled = lambda named: {name: [_compile(s) for s in selectors] for name, selectors in named.items()}
    page_steps, field_steps = compiled(page), compiled(fields)

    def firsts(node, steps_of):
        missing = {(name, i): steps for name, all_steps in steps_of.items() for i, steps in enumerate(all_steps)}
        found = dict.fromkeys(missing)
        for n in node.walk() if missing else ():
            for key in [k for k, steps in missing.items() if _matches(n, steps)]:
                found[key] = n
                del missing[key]
            if not missing:
                break
        return {name: [_field(found[name, i]) for i in range(len(s))] for name, s in steps_of.items()}

    def one(text):
        tree = _Tree()
        tree.feed(text)
        tree.close()
        out = {"page": firsts(tree.root, page_steps)}
        if page.get("body") == ["body"] and out["page"]["body"] == [None]:
            out["page"]["body"] = [_field(tree.root)]
        if scope_steps:
            nodes = [n for n in tree.root.walk() if any(_matches(n, s) for s in scope_steps)]
            out["items"] = [({"self": _element(n)} if element else {}) | firsts(n, field_steps) for n in nodes]
        # Nodes that know their parents are rings, which would stay in memory until they are searched for.
        for n in tree.root.walk():
            n.parent = None
        return out

    def safe(text):
        try:
            return one(text)
        except Exception as e:
            return {"error": str(e) or type(e).__name__}

    found = arrow_type(schema)
    nothing = dict.fromkeys(["page", *(["items"] if scope else []), "error"])

    @F.arrow_udf(schema)
    def regions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from pieces(texts, lambda some: [nothing | (safe(t) if t is not None else {}) for t in some.to_pylist()], found)

    return regions(html)

"""A small namespace-aware XML tree on expat: comments and processing instructions dropped, CDATA merged into text."""

from __future__ import annotations

from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

XML_NS = "http://www.w3.org/XML/1998/namespace"
XSI_NS = "http://www.w3.org/2001/XMLSchema-instance"
DOC, ELEM, ATTR, TEXT = "doc", "elem", "attr", "text"


class XmlError(ValueError):
    """The text is not well-formed XML."""


class Node:
    __slots__ = ("attrs", "children", "kind", "name", "order", "parent", "prefix", "scope", "uri", "value")

    def __init__(self, kind: str, name: str = "", uri: str = "", prefix: str = "", value: str = "", parent: "Node | None" = None, order: int = 0):
        self.kind, self.name, self.uri, self.prefix, self.value, self.parent, self.order = kind, name, uri, prefix, value, parent, order
        self.children: list[Node] = []
        self.attrs: list[Node] = []
        self.scope: dict[str, str] = {}

    @property
    def qname(self) -> str:
        return f"{self.prefix}:{self.name}" if self.prefix else self.name

    def text(self) -> str:
        """The string value: all text below, in order."""
        if self.kind in (TEXT, ATTR):
            return self.value
        return "".join(c.text() for c in self.children if c.kind != ATTR)

    def add(self, node: "Node") -> "Node":
        node.parent = self
        (self.attrs if node.kind == ATTR else self.children).append(node)
        return node

    def attr(self, name: str, uri: str = "") -> str | None:
        return next((a.value for a in self.attrs if a.name == name and a.uri == uri), None)

    def elements(self) -> list["Node"]:
        return [c for c in self.children if c.kind == ELEM]


def parse(text: str | bytes) -> Node:
    """The document node of an XML text."""
    root = Node(DOC)
    root.scope = {"xml": XML_NS}
    at, counter = root, 0
    pending: dict[str, str] = {}
    buffer: list[str] = []

    def split(name: str) -> tuple[str, str, str]:
        parts = name.split("\x1f")
        if len(parts) == 1:
            return name, "", ""
        return parts[1], parts[0], parts[2] if len(parts) > 2 else ""

    def flush() -> None:
        nonlocal counter
        if buffer:
            if at.kind == ELEM:
                counter += 1
                at.add(Node(TEXT, value="".join(buffer), order=counter))
            buffer.clear()

    def start(name: str, attrs: list[str]) -> None:
        nonlocal at, counter
        flush()
        counter += 1
        local, uri, prefix = split(name)
        node = at.add(Node(ELEM, local, uri, prefix, order=counter))
        node.scope = {**at.scope, **pending} if pending else at.scope
        pending.clear()
        for k in range(0, len(attrs), 2):
            counter += 1
            local, uri, prefix = split(attrs[k])
            node.add(Node(ATTR, local, uri, prefix, attrs[k + 1], order=counter))
        at = node

    def end(_: str) -> None:
        nonlocal at
        flush()
        at = at.parent

    parser = expat.ParserCreate(namespace_separator="\x1f")
    parser.namespace_prefixes = True
    parser.ordered_attributes = True
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = buffer.append
    parser.StartNamespaceDeclHandler = lambda prefix, uri: pending.__setitem__(prefix or "", uri or "")
    try:
        parser.Parse(text.encode() if isinstance(text, str) else text, True)
    except expat.ExpatError as e:
        raise XmlError(str(e)) from e
    return root


def serialize(node: Node) -> str:
    """XML text without declaration or indentation; namespaces are declared where they come into use."""
    out: list[str] = []

    def write(n: Node, scope: dict[str, str]) -> None:
        if n.kind == TEXT:
            out.append(escape(n.value, {"\r": "&#13;"}))
        elif n.kind == DOC:
            for c in n.children:
                write(c, scope)
        elif n.kind == ELEM:
            new = {}
            if scope.get(n.prefix, "") != n.uri:
                new[n.prefix] = n.uri
            attrs = []
            for a in n.attrs:
                prefix = a.prefix
                if a.uri and a.uri != XML_NS:
                    if not prefix or {**scope, **new}.get(prefix) != a.uri:
                        while not prefix or (prefix in new and new[prefix] != a.uri) or prefix == n.prefix and n.uri != a.uri:
                            prefix = f"ns{len(new)}" if not prefix or prefix in new else prefix + "0"
                        new[prefix] = a.uri
                attrs.append(f" {prefix + ':' if prefix else ''}{a.name}={quoteattr(a.value)}")
            declared = "".join(f" xmlns{':' + p if p else ''}={quoteattr(u)}" for p, u in new.items())
            out.append(f"<{n.qname}{declared}{''.join(attrs)}")
            if n.children:
                out.append(">")
                inner = {**scope, **new} if new else scope
                for c in n.children:
                    write(c, inner)
                out.append(f"</{n.qname}>")
            else:
                out.append("/>")

    write(node, {"xml": XML_NS, "": ""})
    return "".join(out)


def walked_text(node: Node) -> str:
    """Text of a node with a line feed after every child, at every depth; not trimmed."""
    if node.kind in (TEXT, ATTR):
        return node.value
    return "".join(walked_text(c) + "\n" for c in node.children)


def normalize(node: Node) -> None:
    """Merge neighbouring text nodes and drop empty ones, below a node."""
    merged: list[Node] = []
    for c in node.children:
        if c.kind == TEXT and merged and merged[-1].kind == TEXT:
            merged[-1].value += c.value
        elif c.kind != TEXT or c.value:
            merged.append(c)
            normalize(c)
    node.children = merged

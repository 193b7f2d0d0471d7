"""Structural validation by a subset of XML Schema: sequences, choices, occurrence bounds, simple built-in types,
attributes with defaults, references and named types. Other constructs are refused when a schema is read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from gleanery.functions.xmltree import ATTR, ELEM, TEXT, XSI_NS, Node, parse

XS = "http://www.w3.org/2001/XMLSchema"
_LEXICAL = {
    "integer": r"[+-]?\d+", "int": r"[+-]?\d+", "long": r"[+-]?\d+", "nonNegativeInteger": r"\+?\d+", "positiveInteger": r"\+?0*[1-9]\d*",
    "decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)", "double": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|-?INF|NaN", "float": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|-?INF|NaN",
    "boolean": r"true|false|0|1", "date": r"-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?", "dateTime": r"-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?",
}


@dataclass
class Part:
    """A particle: an element (uri, name, type) or a group of particles."""

    kind: str
    least: int
    most: float
    name: tuple[str, str] = ("", "")
    type: "Type | None" = None
    parts: list["Part"] = field(default_factory=list)


@dataclass
class Type:
    simple: str | None = None
    allowed: list[str] = field(default_factory=list)
    content: Part | None = None
    mixed: bool = False
    open: bool = False
    attributes: dict[tuple[str, str], tuple[bool, str | None, "Type | None"]] = field(default_factory=dict)


class SchemaError(ValueError):
    """The schema uses something that is not understood."""


class Schema:
    def __init__(self, text: str):
        self.root = parse(text).elements()[0]
        self.target = self.root.attr("targetNamespace") or ""
        self.qualified = self.root.attr("elementFormDefault") == "qualified"
        named = lambda kind: {e.attr("name"): e for e in self.root.elements() if e.uri == XS and e.name == kind}
        self.elements, self.complex, self.simple, self.groups = named("element"), named("complexType"), named("simpleType"), named("group")
        self.types: dict[int, Type] = {}

    def _xs(self, e: Node, *skip: str) -> list[Node]:
        return [c for c in e.elements() if c.uri == XS and c.name not in ("annotation", *skip)]

    def named_type(self, e: Node, qname: str) -> Type:
        prefix, _, local = qname.rpartition(":")
        if e.scope.get(prefix, "") == XS:
            return Type(simple=local, open=local == "anyType")
        if local in self.complex:
            return self.type_of(self.complex[local])
        if local in self.simple:
            return self.type_of(self.simple[local])
        raise SchemaError(f"unknown type {qname}")

    def type_of(self, e: Node) -> Type:
        if id(e) in self.types:
            return self.types[id(e)]
        out = self.types[id(e)] = Type()
        if e.name == "simpleType":
            for c in self._xs(e):
                if c.name == "restriction":
                    base = self.named_type(c, c.attr("base")) if c.attr("base") else Type(simple="string")
                    out.simple = base.simple
                    out.allowed = [x.attr("value") for x in self._xs(c) if x.name == "enumeration"] or base.allowed
                else:
                    out.simple = "string"
            return out
        out.mixed = e.attr("mixed") == "true"
        for c in self._xs(e):
            if c.name in ("sequence", "choice", "all", "group"):
                out.content = self.part(c)
            elif c.name == "attribute":
                self.attribute(c, out)
            elif c.name == "anyAttribute":
                out.attributes[("*", "*")] = (False, None, None)
            elif c.name in ("simpleContent", "complexContent"):
                inner = self._xs(c)[0]
                base = self.named_type(inner, inner.attr("base"))
                out.simple, out.content, out.mixed, out.open = base.simple, base.content, base.mixed, base.open
                out.attributes.update(base.attributes)
                for x in self._xs(inner):
                    if x.name == "attribute":
                        self.attribute(x, out)
                    elif x.name in ("sequence", "choice", "all"):
                        more = self.part(x)
                        out.content = Part("sequence", 1, 1, parts=[base.content, more]) if base.content and inner.name == "extension" else more
            else:
                raise SchemaError(f"xs:{c.name} is not understood")
        return out

    def attribute(self, e: Node, out: Type) -> None:
        name = e.attr("name") or (e.attr("ref") or "").rpartition(":")[2]
        uri = e.scope.get((e.attr("ref") or "").rpartition(":")[0], "") if e.attr("ref") else ""
        inner = next((self.type_of(c) for c in self._xs(e) if c.name == "simpleType"), None)
        kind = self.named_type(e, e.attr("type")) if e.attr("type") else inner
        out.attributes[(uri, name)] = (e.attr("use") == "required", e.attr("default") or e.attr("fixed"), kind)

    def element_type(self, e: Node) -> Type:
        if e.attr("type"):
            return self.named_type(e, e.attr("type"))
        inner = next((c for c in self._xs(e) if c.name in ("complexType", "simpleType")), None)
        return self.type_of(inner) if inner is not None else Type(open=True)

    def part(self, e: Node) -> Part:
        most = e.attr("maxOccurs") or "1"
        least = int(e.attr("minOccurs") or 1)
        bound = float("inf") if most == "unbounded" else int(most)
        if e.name == "element":
            if e.attr("ref"):
                local = e.attr("ref").rpartition(":")[2]
                if local not in self.elements:
                    raise SchemaError(f"unknown element {local}")
                return Part("element", least, bound, (self.target, local), self.element_type(self.elements[local]))
            form = e.attr("form") or ("qualified" if self.qualified else "")
            return Part("element", least, bound, (self.target if form == "qualified" else "", e.attr("name")), self.element_type(e))
        if e.name == "group":
            if e.attr("ref"):
                return self.part(self._xs(self.groups[e.attr("ref").rpartition(":")[2]])[0])
            return self.part(self._xs(e)[0])
        if e.name == "any":
            return Part("any", least, bound)
        if e.name not in ("sequence", "choice", "all"):
            raise SchemaError(f"xs:{e.name} is not understood")
        return Part(e.name, least, bound, parts=[self.part(c) for c in self._xs(e)])

    # ---- validation

    def _ends(self, part: Part, children: list[Node], at: int) -> set[int]:
        """Where one or more occurrences of a particle can end that begin at `at`."""

        def once(k: int) -> set[int]:
            if part.kind in ("element", "any"):
                ok = k < len(children) and (part.kind == "any" or (children[k].uri, children[k].name) == part.name)
                return {k + 1} if ok else set()
            if part.kind == "choice":
                return set().union(*(self._ends(p, children, k) for p in part.parts))
            if part.kind == "all":
                names = {p.name: p for p in part.parts}
                seen: set[tuple[str, str]] = set()
                while k < len(children) and (n := (children[k].uri, children[k].name)) in names and n not in seen:
                    seen.add(n)
                    k += 1
                return {k} if all(p.least == 0 or p.name in seen for p in part.parts) else set()
            here = {k}
            for p in part.parts:
                here = set().union(*(self._ends(p, children, x) for x in here)) if here else set()
            return here

        reached = {at} if part.least == 0 else set()
        now, count = {at}, 0
        while now and count < part.most:
            now = set().union(*(once(k) for k in now)) - ({at} if count else set())
            count += 1
            if count >= part.least:
                before = len(reached)
                reached |= now
                if len(reached) == before:
                    break
        return reached

    def _types(self, part: Part | None, out: dict[tuple[str, str], Type]) -> dict[tuple[str, str], Type]:
        if part is not None:
            if part.kind == "element":
                out[part.name] = part.type
            for p in part.parts:
                self._types(p, out)
        return out

    def check(self, node: Node, augment: bool = False) -> list[str]:
        """Errors of a document; augment adds attribute defaults to the tree."""
        root = node.elements()[0] if node.elements() else None
        if root is None:
            return ["no root element"]
        if root.uri != self.target or root.name not in self.elements:
            return [f"unknown root element {root.name}"]
        errors: list[str] = []
        self._check(root, self.element_type(self.elements[root.name]), errors, augment)
        return errors

    def _value(self, text: str, type_: Type | None, what: str, errors: list[str]) -> None:
        if type_ is None:
            return
        value = text.strip(" \t\r\n")
        pattern = _LEXICAL.get(type_.simple or "")
        if pattern and not re.fullmatch(pattern, value):
            errors.append(f"{what}: {value!r} is no {type_.simple}")
        if type_.allowed and value not in type_.allowed and text not in type_.allowed:
            errors.append(f"{what}: {value!r} is not allowed")

    def _check(self, e: Node, type_: Type, errors: list[str], augment: bool) -> None:
        if type_.open:
            return
        for a in e.attrs:
            if a.uri == XSI_NS or (a.uri, a.name) in type_.attributes:
                self._value(a.value, type_.attributes.get((a.uri, a.name), (0, 0, None))[2], f"{e.name}@{a.name}", errors)
            elif ("*", "*") not in type_.attributes:
                errors.append(f"{e.name}: unknown attribute {a.name}")
        for (uri, name), (required, default, _) in type_.attributes.items():
            if name != "*" and e.attr(name, uri) is None:
                if required:
                    errors.append(f"{e.name}: attribute {name} is missing")
                elif default is not None and augment:
                    e.add(Node(ATTR, name, uri, "", default, order=e.order))
        children = e.elements()
        text = "".join(c.value for c in e.children if c.kind == TEXT)
        if type_.simple is not None and type_.content is None:
            if children:
                errors.append(f"{e.name}: no elements are allowed")
            self._value(e.text(), type_, e.name, errors)
            return
        if text.strip() and not type_.mixed:
            errors.append(f"{e.name}: no text is allowed")
        if type_.content is None:
            if children:
                errors.append(f"{e.name}: no elements are allowed")
            return
        if len(children) not in self._ends(type_.content, children, 0):
            errors.append(f"{e.name}: its elements don't fit the schema")
        kinds = self._types(type_.content, {})
        for c in children:
            if (t := kinds.get((c.uri, c.name))) is not None and c.kind == ELEM:
                self._check(c, t, errors, augment)

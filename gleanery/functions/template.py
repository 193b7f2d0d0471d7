"""A subset of XSLT 1.0: template bodies for fields and variables, and whole stylesheets for documents.

for-each (with sort), value-of, text, if, choose, copy, copy-of, element, attribute, variable, param, with-param,
call-template, apply-templates (with select and mode), template (match, name, mode, priority), strip-space and output are
understood; any other instruction is refused when the template is compiled. Built-in rules apply to nodes without template.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from gleanery.functions import xpath as X
from gleanery.functions.xmltree import ATTR, DOC, ELEM, TEXT, Node, parse

XSL = "http://www.w3.org/1999/XSL/Transform"


class TemplateError(ValueError):
    """The template uses something that is not understood."""


@dataclass
class Rule:
    match: str | None
    name: str | None
    mode: str | None
    priority: float
    body: Callable
    namespaces: dict[str, str]
    params: list[str] = field(default_factory=list)


@dataclass
class Frame:
    node: Node
    position: int
    size: int
    variables: dict[str, object]
    passed: dict[str, object] = field(default_factory=dict)

    def context(self) -> X.Context:
        return X.Context(self.node, self.position, self.size, self.variables, self.node)


class _Orders:
    """Fresh document order numbers for result nodes."""

    def __init__(self):
        self.last = 0

    def __call__(self) -> int:
        self.last += 1
        return self.last


def _copy(node: Node, fresh: _Orders) -> list[Node]:
    if node.kind == DOC:
        return [x for c in node.children for x in _copy(c, fresh)]
    out = Node(node.kind, node.name, node.uri, node.prefix, node.value, order=fresh())
    out.scope = node.scope
    for a in node.attrs:
        out.add(_copy(a, fresh)[0])
    for c in node.children:
        out.add(_copy(c, fresh)[0])
    return [out]


class Template:
    """A compiled body; `run` gives the result nodes (or a document for a stylesheet)."""

    def __init__(self, source: str | Node, namespaces: dict[str, str] | None = None):
        root = parse(source) if isinstance(source, str) else source
        top = root.elements()[0] if root.kind == DOC else root
        self.rules: list[Rule] = []
        self.globals: list[tuple[str, Callable, bool]] = []
        self.fresh = _Orders()
        if top.uri == XSL and top.name in ("stylesheet", "transform"):
            for child in top.elements():
                if child.uri != XSL:
                    continue
                if child.name == "template":
                    self.rule(child)
                elif child.name in ("variable", "param"):
                    self.globals.append((child.attr("name"), self.value(child), child.name == "param"))
                elif child.name not in ("output", "strip-space", "preserve-space"):
                    raise TemplateError(f"xsl:{child.name} is not understood")
            self.body = None
        else:
            if namespaces:
                top.scope = {**namespaces, **top.scope}
            self.body = self.sequence(top)

    def rule(self, e: Node) -> None:
        match = e.attr("match")
        given = e.attr("priority")
        for part in re.split(r"\|(?![^\[]*\])", match) if match else [None]:
            default = 0.5
            if part is not None:
                part = part.strip()
                if re.fullmatch(r"@?\*|node\(\)|text\(\)|@?node\(\)", part):
                    default = -0.5
                elif re.fullmatch(r"@?[\w.\-]+:\*", part):
                    default = -0.25
                elif re.fullmatch(r"@?[\w.\-:]+", part):
                    default = 0.0
            params = [c.attr("name") for c in e.elements() if c.uri == XSL and c.name == "param"]
            self.rules.append(Rule(part, e.attr("name"), e.attr("mode"), float(given) if given else default, self.sequence(e), self.names(e), params))

    @staticmethod
    def names(e: Node) -> dict[str, str]:
        """Prefixes in scope; the default one doesn't count for XPath."""
        return {p: u for p, u in e.scope.items() if p}

    def select(self, e: Node, text: str) -> X.Closure:
        return X.compile_xpath(text, self.names(e))

    def required(self, e: Node, name: str) -> str:
        value = e.attr(name)
        if value is None:
            raise TemplateError(f"xsl:{e.name} needs {name}")
        return value

    def sequence(self, e: Node) -> Callable[[Frame], list[Node]]:
        parts = []
        preserve = e.uri == XSL and e.name == "text"
        for c in e.children:
            if c.kind == TEXT:
                if c.value.strip(" \t\r\n") or preserve:
                    parts.append(lambda f, v=c.value: [Node(TEXT, value=v, order=self.fresh())])
            elif c.kind == ELEM:
                parts.append(self.instruction(c))

        def run(f: Frame) -> list[Node]:
            inner = Frame(f.node, f.position, f.size, dict(f.variables), f.passed)  # variables end with their body
            return [n for p in parts for n in p(inner)]

        return run

    def value(self, e: Node) -> Callable[[Frame], object]:
        """The value of a variable or parameter: select, or a fragment; nothing means an empty string."""
        if e.attr("select") is not None:
            chosen = self.select(e, e.attr("select"))
            return lambda f: chosen(f.context())
        if not e.children:
            return lambda f: ""
        body = self.sequence(e)

        def fragment(f: Frame) -> list[Node]:
            top = Node(DOC, order=self.fresh())
            for n in body(f):
                top.add(n)
            return [top]

        return fragment

    def avt(self, e: Node, text: str) -> Callable[[Frame], str]:
        parts = re.split(r"\{\{|\}\}|(\{[^{}]*\})", text)
        made: list[Callable[[Frame], str]] = []
        at = 0
        for m in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}", text):
            if m.start() > at:
                made.append(lambda f, v=text[at : m.start()]: v)
            if m[1] is None:
                made.append(lambda f, v=m[0][0]: v)
            else:
                chosen = self.select(e, m[1])
                made.append(lambda f, run=chosen: X.string(run(f.context())))
            at = m.end()
        if at < len(text) or not parts:
            made.append(lambda f, v=text[at:]: v)
        return lambda f: "".join(p(f) for p in made)

    def literal(self, e: Node) -> Callable[[Frame], list[Node]]:
        body = self.sequence(e)
        attrs = [(a, self.avt(e, a.value)) for a in e.attrs if a.uri != XSL]

        def run(f: Frame) -> list[Node]:
            out = Node(ELEM, e.name, e.uri, e.prefix, order=self.fresh())
            out.scope = e.scope
            for a, v in attrs:
                out.add(Node(ATTR, a.name, a.uri, a.prefix, v(f), order=self.fresh()))
            for n in body(f):
                out.add(n)
            return [out]

        return run

    def instruction(self, e: Node) -> Callable[[Frame], list[Node]]:
        if e.uri != XSL:
            return self.literal(e)
        make = getattr(self, "do_" + e.name.replace("-", "_"), None)
        if make is None:
            raise TemplateError(f"xsl:{e.name} is not understood")
        return make(e)

    def do_text(self, e: Node):
        text = e.text()
        return lambda f: [Node(TEXT, value=text, order=self.fresh())] if text else []

    def do_value_of(self, e: Node):
        chosen = self.select(e, self.required(e, "select"))

        def run(f: Frame) -> list[Node]:
            text = X.string(chosen(f.context()))
            return [Node(TEXT, value=text, order=self.fresh())] if text else []

        return run

    def do_if(self, e: Node):
        test, body = self.select(e, self.required(e, "test")), self.sequence(e)
        return lambda f: body(f) if X.boolean(test(f.context())) else []

    def do_choose(self, e: Node):
        cases = [(self.select(c, self.required(c, "test")) if c.name == "when" else None, self.sequence(c)) for c in e.elements()]

        def run(f: Frame) -> list[Node]:
            for test, body in cases:
                if test is None or X.boolean(test(f.context())):
                    return body(f)
            return []

        return run

    def sorted_by(self, e: Node):
        keys = []
        for s in (c for c in e.elements() if c.uri == XSL and c.name == "sort"):
            run = self.select(s, s.attr("select") or ".")
            keys.append((run, s.attr("data-type") == "number", s.attr("order") == "descending"))

        def order(nodes: list[Node], f: Frame) -> list[Node]:
            for run, numeric, down in reversed(keys):
                value = lambda n, r=run: r(X.Context(n, variables=f.variables, current=n))
                nodes = sorted(nodes, key=(lambda n, v=value: (lambda x: (x == x, x if x == x else 0.0))(X.number(v(n)))) if numeric else (lambda n, v=value: X.string(v(n))), reverse=down)
            return nodes

        return order

    def do_sort(self, e: Node):
        return lambda f: []

    def do_for_each(self, e: Node):
        chosen, body, order = self.select(e, self.required(e, "select")), self.sequence(e), self.sorted_by(e)

        def run(f: Frame) -> list[Node]:
            nodes = order(chosen(f.context()), f)
            return [n for k, x in enumerate(nodes, 1) for n in body(Frame(x, k, len(nodes), f.variables))]

        return run

    def do_copy_of(self, e: Node):
        chosen = self.select(e, self.required(e, "select"))

        def run(f: Frame) -> list[Node]:
            v = chosen(f.context())
            if isinstance(v, list):
                return [x for n in v for x in _copy(n, self.fresh)]
            return [Node(TEXT, value=X.string(v), order=self.fresh())]

        return run

    def do_copy(self, e: Node):
        body = self.sequence(e)

        def run(f: Frame) -> list[Node]:
            n = f.node
            if n.kind == DOC:
                return body(f)
            out = Node(n.kind, n.name, n.uri, n.prefix, n.value, order=self.fresh())
            out.scope = n.scope
            if n.kind == ELEM:
                for c in body(f):
                    out.add(c)
            return [out]

        return run

    def do_element(self, e: Node):
        name, uri, body = self.avt(e, self.required(e, "name")), self.avt(e, e.attr("namespace") or ""), self.sequence(e)

        def run(f: Frame) -> list[Node]:
            prefix, _, local = name(f).rpartition(":")
            out = Node(ELEM, local, uri(f) or e.scope.get(prefix, ""), prefix, order=self.fresh())
            for n in body(f):
                out.add(n)
            return [out]

        return run

    def do_attribute(self, e: Node):
        name, uri, body = self.avt(e, self.required(e, "name")), self.avt(e, e.attr("namespace") or ""), self.sequence(e)

        def run(f: Frame) -> list[Node]:
            prefix, _, local = name(f).rpartition(":")
            return [Node(ATTR, local, uri(f) or (e.scope.get(prefix, "") if prefix else ""), prefix, "".join(n.text() for n in body(f)), order=self.fresh())]

        return run

    def do_variable(self, e: Node):
        name, value = self.required(e, "name"), self.value(e)

        def run(f: Frame) -> list[Node]:
            f.variables[name] = value(f)
            return []

        return run

    def do_param(self, e: Node):
        name, value = self.required(e, "name"), self.value(e)

        def run(f: Frame) -> list[Node]:
            if name in f.passed:
                f.variables[name] = f.passed[name]
            elif name not in f.variables:
                f.variables[name] = value(f)
            return []

        return run

    def with_params(self, e: Node) -> Callable[[Frame], dict[str, object]]:
        given = [(self.required(c, "name"), self.value(c)) for c in e.elements() if c.uri == XSL and c.name == "with-param"]
        return lambda f: {n: v(f) for n, v in given}

    def do_call_template(self, e: Node):
        name, given = self.required(e, "name"), self.with_params(e)

        def run(f: Frame) -> list[Node]:
            rule = next((r for r in self.rules if r.name == name), None)
            if rule is None:
                raise TemplateError(f"no template {name}")
            return rule.body(Frame(f.node, f.position, f.size, dict(self.seen), given(f)))

        return run

    def do_apply_templates(self, e: Node):
        chosen = self.select(e, e.attr("select") or "node()")
        mode, order, given = e.attr("mode"), self.sorted_by(e), self.with_params(e)

        def run(f: Frame) -> list[Node]:
            nodes = order(chosen(f.context()), f)
            return [n for k, x in enumerate(nodes, 1) for n in self.apply(x, k, len(nodes), mode, given(f))]

        return run

    def apply(self, node: Node, position: int, size: int, mode: str | None, given: dict[str, object]) -> list[Node]:
        best = None
        for r in self.rules:
            if r.match is not None and r.mode == mode and (best is None or r.priority >= best.priority) and X.matches(r.match, node, r.namespaces, self.seen):
                best = r
        if best:
            return best.body(Frame(node, position, size, dict(self.seen), given))
        if node.kind in (TEXT, ATTR):
            return [Node(TEXT, value=node.value, order=self.fresh())]
        return [n for k, c in enumerate(node.children, 1) for n in self.apply(c, k, len(node.children), mode, {})]

    def run(self, node: Node, variables: dict[str, object] | None = None) -> list[Node]:
        self.fresh = _Orders()
        self.seen = dict(variables or {})
        if self.body is not None:
            return self.body(Frame(node, 1, 1, dict(self.seen)))
        for name, value, is_param in self.globals:
            if not (is_param and name in self.seen):
                self.seen[name] = value(Frame(node, 1, 1, self.seen))
        return self.apply(node, 1, 1, None, {})

    def document(self, node: Node, variables: dict[str, object] | None = None) -> Node:
        """The result as a document of its own."""
        top = Node(DOC)
        for n in self.run(node, variables):
            top.add(n)
        return top

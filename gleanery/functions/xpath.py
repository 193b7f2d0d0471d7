"""XPath 1.0, compiled to closures over the tree of xmltree; expressions are compiled once a worker."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import pairwise

from gleanery.functions.xmltree import ATTR, DOC, ELEM, TEXT, XML_NS, Node


class XPathError(ValueError):
    """The expression is not valid, or it names an unknown function, prefix or variable."""


@dataclass
class Context:
    node: Node
    position: int = 1
    size: int = 1
    variables: dict[str, object] = field(default_factory=dict)
    current: Node | None = None

    def at(self, node: Node, position: int = 1, size: int = 1) -> "Context":
        return Context(node, position, size, self.variables, self.current)


TOKEN = re.compile(
    r"\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<lit>\"[^\"]*\"|'[^']*')|(?P<var>\$[\w.\-]+(?::[\w.\-]+)?)|(?P<op>::|//|\.\.|!=|<=|>=|[/|+\-=<>()\[\],@.*])|(?P<name>[^\W\d][\w.\-]*(?::(?:\*|[^\W\d][\w.\-]*))?))"
)
AXES = "ancestor ancestor-or-self attribute child descendant descendant-or-self following following-sibling namespace parent preceding preceding-sibling self".split()
TYPES = ("comment", "text", "processing-instruction", "node")


def tokens(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    at = 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise XPathError(f"unexpected character at {at} in {text!r}")
        kind, value = m.lastgroup, m.group(m.lastgroup)
        if kind == "name" and ":" in value and text[m.end() - 1 : m.end() + 1] == "::":
            kind, value = "name", value.split(":")[0]
        # a name or * after an operand is an operator
        operand = out and (out[-1][0] in ("num", "lit", "var", "name") or out[-1][1] in (")", "]", ".", "..", "*") and out[-1][0] != "and")
        if operand and out[-1][0] != "oper":
            if value in ("and", "or", "div", "mod") and kind == "name" or value == "*":
                kind = "oper"
        out.append((kind, value))
        at = m.end()
    return out


# ---- values

def is_nodes(v) -> bool:
    return isinstance(v, list)


def string(v) -> str:
    if isinstance(v, list):
        return v[0].text() if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        if v == int(v):
            return str(int(v))
        text = repr(v)
        return f"{v:.20f}".rstrip("0") if "e" in text else text
    return v


def number(v) -> float:
    if isinstance(v, bool):
        return 1.0 if v else 0.0
    if isinstance(v, float):
        return v
    text = string(v).strip(" \t\r\n")
    return float(text) if re.fullmatch(r"-?(\d+(\.\d*)?|\.\d+)", text) else math.nan


def boolean(v) -> bool:
    if isinstance(v, list):
        return bool(v)
    if isinstance(v, float):
        return not (v == 0 or math.isnan(v))
    return bool(v)


def _compare(op: str, a, b) -> bool:
    if op in ("=", "!="):
        if isinstance(a, bool) or isinstance(b, bool):
            a, b = boolean(a), boolean(b)
        elif isinstance(a, float) or isinstance(b, float):
            a, b = number(a), number(b)
        return a == b if op == "=" else a != b
    a, b = number(a), number(b)
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def compare(op: str, a, b) -> bool:
    if is_nodes(a) and is_nodes(b):
        left, right = [n.text() for n in a], [n.text() for n in b]
        return any(_compare(op, x, y) for x in left for y in right)
    if is_nodes(a):
        if isinstance(b, bool):
            return _compare(op, boolean(a), b)
        return any(_compare(op, n.text(), b) for n in a)
    if is_nodes(b):
        if isinstance(a, bool):
            return _compare(op, a, boolean(b))
        return any(_compare(op, a, n.text()) for n in b)
    return _compare(op, a, b)


# ---- axes

def _below(node: Node):
    for c in node.children:
        yield c
        yield from _below(c)


def _above(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def _siblings(node: Node, after: bool) -> list[Node]:
    if node.parent is None or node.kind == ATTR:
        return []
    all_ = node.parent.children
    k = next(i for i, c in enumerate(all_) if c is node)
    return all_[k + 1 :] if after else all_[:k][::-1]


def axis(name: str, node: Node) -> list[Node]:
    """Nodes on an axis, in the axis's order (reverse axes from the nearest)."""
    if name == "child":
        return node.children
    if name == "attribute":
        return node.attrs
    if name == "self":
        return [node]
    if name == "parent":
        return [node.parent] if node.parent is not None else []
    if name == "descendant":
        return list(_below(node))
    if name == "descendant-or-self":
        return [node, *_below(node)]
    if name == "ancestor":
        return list(_above(node))
    if name == "ancestor-or-self":
        return [node, *_above(node)]
    if name in ("following-sibling", "preceding-sibling"):
        return _siblings(node, name[0] == "f")
    if name == "following":
        start = node.parent if node.kind == ATTR else node
        out = list(_below(start)) if node.kind == ATTR else []
        for n in (start, *_above(start)):
            for s in _siblings(n, True):
                out += [s, *_below(s)]
        return out
    if name == "preceding":
        start = node.parent if node.kind == ATTR else node
        out = []
        for n in (start, *_above(start)):
            for s in _siblings(n, False):
                out += [*reversed(list(_below(s))), s]
        return out
    return []  # namespace nodes aren't kept


def in_order(nodes: list[Node]) -> list[Node]:
    seen = {id(n): n for n in nodes}
    return sorted(seen.values(), key=lambda n: n.order)


# ---- functions

def _substring(s: str, start: float, length: float | None = None) -> str:
    first = math.floor(start + 0.5) if math.isfinite(start) else start
    if length is None:
        last = math.inf
    else:
        rounded = math.floor(length + 0.5) if math.isfinite(length) else length
        last = first + rounded
    return "".join(c for k, c in enumerate(s, 1) if k >= first and k < last)


def _round(x: float) -> float:
    return x if math.isnan(x) or math.isinf(x) else float(math.floor(x + 0.5))


def _translate(s: str, old: str, new: str) -> str:
    table: dict[int, str | None] = {}
    for k, c in enumerate(old):
        table.setdefault(ord(c), new[k] if k < len(new) else None)
    return s.translate(table)


def _lang(ctx: Context, want: str) -> bool:
    for n in (ctx.node, *_above(ctx.node)):
        have = n.attr("lang", XML_NS)
        if have is not None:
            return have.lower() == want.lower() or have.lower().startswith(want.lower() + "-")
    return False


def _first(args: list, ctx: Context) -> Node | None:
    if not args:
        return ctx.node
    return args[0][0] if args[0] else None


def _need_nodes(v) -> list[Node]:
    if not is_nodes(v):
        raise XPathError("a node-set is needed")
    return v


def _named(f: Callable[[Node], str]):
    return lambda ctx, *a: (lambda n: f(n) if n is not None and n.kind in (ELEM, ATTR) else "")(_first([_need_nodes(x) for x in a], ctx))


#: name -> (least and most arguments, function of the context and the values)
CORE: dict[str, tuple[int, float, Callable]] = {
    "last": (0, 0, lambda c: float(c.size)),
    "position": (0, 0, lambda c: float(c.position)),
    "count": (1, 1, lambda c, v: float(len(_need_nodes(v)))),
    "local-name": (0, 1, _named(lambda n: n.name)),
    "namespace-uri": (0, 1, _named(lambda n: n.uri)),
    "name": (0, 1, _named(lambda n: n.qname)),
    "string": (0, 1, lambda c, v=None: c.node.text() if v is None else string(v)),
    "concat": (2, math.inf, lambda c, *v: "".join(map(string, v))),
    "starts-with": (2, 2, lambda c, a, b: string(a).startswith(string(b))),
    "contains": (2, 2, lambda c, a, b: string(b) in string(a)),
    "substring-before": (2, 2, lambda c, a, b: string(a).partition(string(b))[0] if string(b) in string(a) else ""),
    "substring-after": (2, 2, lambda c, a, b: string(a).partition(string(b))[2] if string(b) else string(a)),
    "substring": (2, 3, lambda c, s, a, n=None: _substring(string(s), number(a), None if n is None else number(n))),
    "string-length": (0, 1, lambda c, v=None: float(len(c.node.text() if v is None else string(v)))),
    "normalize-space": (0, 1, lambda c, v=None: " ".join(x for x in re.split(r"[ \t\r\n]+", c.node.text() if v is None else string(v)) if x)),
    "translate": (3, 3, lambda c, s, a, b: _translate(string(s), string(a), string(b))),
    "boolean": (1, 1, lambda c, v: boolean(v)),
    "not": (1, 1, lambda c, v: not boolean(v)),
    "true": (0, 0, lambda c: True),
    "false": (0, 0, lambda c: False),
    "lang": (1, 1, lambda c, v: _lang(c, string(v))),
    "number": (0, 1, lambda c, v=None: number(c.node.text() if v is None else v)),
    "sum": (1, 1, lambda c, v: float(sum(number(n.text()) for n in _need_nodes(v)))),
    "floor": (1, 1, lambda c, v: float(math.floor(number(v))) if math.isfinite(number(v)) else number(v)),
    "ceiling": (1, 1, lambda c, v: float(math.ceil(number(v))) if math.isfinite(number(v)) else number(v)),
    "round": (1, 1, lambda c, v: _round(number(v))),
    "current": (0, 0, lambda c: [c.current if c.current is not None else c.node]),
    "id": (1, 1, lambda c, v: []),  # no document type declares identifiers here
}
#: Extension functions by {uri}name; register with `extension`.
EXTENSIONS: dict[str, Callable] = {}


def extension(uri: str, name: str, function: Callable) -> None:
    """Make function(context, *values) callable as prefix:name, prefix bound to uri."""
    EXTENSIONS[f"{{{uri}}}{name}"] = function
    _compiled.clear()


Closure = Callable[[Context], object]


class Parser:
    def __init__(self, text: str, namespaces: dict[str, str]):
        self.source, self.tokens, self.k, self.ns = text, tokens(text), 0, namespaces

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.k + ahead] if self.k + ahead < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if value in values and kind in ("op", "oper", "name"):
            self.k += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise XPathError(f"{value!r} expected in {self.source!r}")

    def uri(self, prefix: str) -> str:
        if prefix == "xml":
            return XML_NS
        if prefix not in self.ns:
            raise XPathError(f"unknown prefix {prefix!r} in {self.source!r}")
        return self.ns[prefix]

    def parse(self) -> Closure:
        out = self.either()
        if self.peek()[0] != "end":
            raise XPathError(f"unexpected {self.peek()[1]!r} in {self.source!r}")
        return out

    def chain(self, below: Callable[[], Closure], ops: tuple[str, ...], kind: str, make: Callable) -> Closure:
        out = below()
        while self.peek()[0] == kind and self.peek()[1] in ops:
            op = self.peek()[1]
            self.k += 1
            out = make(op, out, below())
        return out

    def either(self) -> Closure:
        return self.chain(self.both, ("or",), "oper", lambda _, a, b: lambda c: boolean(a(c)) or boolean(b(c)))

    def both(self) -> Closure:
        return self.chain(self.equal, ("and",), "oper", lambda _, a, b: lambda c: boolean(a(c)) and boolean(b(c)))

    def equal(self) -> Closure:
        return self.chain(self.order, ("=", "!="), "op", lambda op, a, b: lambda c: compare(op, a(c), b(c)))

    def order(self) -> Closure:
        return self.chain(self.sum, ("<", "<=", ">", ">="), "op", lambda op, a, b: lambda c: compare(op, a(c), b(c)))

    def sum(self) -> Closure:
        plus = lambda op, a, b: (lambda c: number(a(c)) + number(b(c))) if op == "+" else (lambda c: number(a(c)) - number(b(c)))
        return self.chain(self.product, ("+", "-"), "op", plus)

    def product(self) -> Closure:
        def divided(x: float, y: float) -> float:
            if y == 0:
                return math.nan if x == 0 or math.isnan(x) else math.copysign(math.inf, x) * math.copysign(1, y)
            return x / y

        make = {"*": lambda x, y: x * y, "div": divided, "mod": lambda x, y: math.fmod(x, y) if y and math.isfinite(x) else math.nan}
        return self.chain(self.unary, ("*", "div", "mod"), "oper", lambda op, a, b: lambda c: make[op](number(a(c)), number(b(c))))

    def unary(self) -> Closure:
        if self.take("-"):
            inner = self.unary()
            return lambda c: -number(inner(c))
        return self.union()

    def union(self) -> Closure:
        parts = [self.path()]
        while self.take("|"):
            parts.append(self.path())
        if len(parts) == 1:
            return parts[0]
        return lambda c: in_order([n for p in parts for n in _need_nodes(p(c))])

    def path(self) -> Closure:
        kind, value = self.peek()
        call = kind == "name" and self.peek(1) == ("op", "(") and value not in TYPES
        if kind in ("num", "lit", "var") or value == "(" or call:
            start = self.filtered()
            if self.peek()[1] not in ("/", "//") or self.peek()[0] != "op":
                return start
            steps = self.steps()
            return lambda c: self.walk(_need_nodes(start(c)), steps, c)
        if value in ("/", "//") and kind == "op":
            def root(c: Context) -> list[Node]:
                node = c.node
                while node.parent is not None:
                    node = node.parent
                return [node]

            after = self.peek(1)
            if value == "/" and not (after[0] == "name" or after[1] in (".", "..", "@", "*")):
                self.k += 1
                return root
            steps = self.steps()
            return lambda c: self.walk(root(c), steps, c)
        steps = [self.step(), *self.steps()]
        return lambda c: self.walk([c.node], steps, c)

    @staticmethod
    def walk(nodes: list[Node], steps: list[Callable], c: Context) -> list[Node]:
        for step in steps:
            found = [n for node in nodes for n in step(node, c)]
            nodes = in_order(found) if len(nodes) > 1 or any(a.order > b.order for a, b in pairwise(found)) else found
        return nodes

    def steps(self) -> list[Callable]:
        out = []
        while self.peek()[0] == "op" and (slash := self.take("/", "//")):
            if slash == "//":
                out.append(lambda node, c: axis("descendant-or-self", node))
            out.append(self.step())
        return out

    def step(self) -> Callable:
        if self.take("."):
            return lambda node, c: [node]
        if self.take(".."):
            return lambda node, c: axis("parent", node)
        name = "child"
        if self.take("@"):
            name = "attribute"
        elif self.peek(1) == ("op", "::"):
            name = self.peek()[1]
            if name not in AXES:
                raise XPathError(f"unknown axis {name!r}")
            self.k += 2
        test, predicates = self.test(name), self.predicates()

        def step(node: Node, c: Context) -> list[Node]:
            found = [n for n in axis(name, node) if test(n)]
            for p in predicates:
                found = self.kept(found, p, c)
            return found

        return step

    @staticmethod
    def kept(nodes: list[Node], predicate: Closure, c: Context) -> list[Node]:
        out = []
        for k, n in enumerate(nodes, 1):
            v = predicate(c.at(n, k, len(nodes)))
            if v == k if isinstance(v, float) else boolean(v):
                out.append(n)
        return out

    def test(self, axis_name: str) -> Callable[[Node], bool]:
        kind, value = self.peek()
        principal = ATTR if axis_name == "attribute" else ELEM
        self.k += 1
        if value == "*":
            return lambda n: n.kind == principal
        if kind != "name":
            raise XPathError(f"a node test is expected in {self.source!r}, not {value!r}")
        if value in TYPES and self.peek() == ("op", "("):
            self.k += 1
            if self.peek()[0] == "lit":
                self.k += 1
            self.need(")")
            if value == "text":
                return lambda n: n.kind == TEXT
            return (lambda n: True) if value == "node" else (lambda n: False)
        prefix, _, local = value.rpartition(":")
        uri = self.uri(prefix) if prefix else ""
        if local == "*":
            return lambda n: n.kind == principal and n.uri == uri
        return lambda n: n.kind == principal and n.name == local and n.uri == uri

    def predicates(self) -> list[Closure]:
        out = []
        while self.take("["):
            out.append(self.either())
            self.need("]")
        return out

    def filtered(self) -> Closure:
        base, predicates = self.primary(), self.predicates()
        if not predicates:
            return base

        def run(c: Context) -> list[Node]:
            nodes = _need_nodes(base(c))
            for p in predicates:
                nodes = self.kept(nodes, p, c)
            return nodes

        return run

    def primary(self) -> Closure:
        kind, value = self.peek()
        self.k += 1
        if kind == "num":
            n = float(value)
            return lambda c: n
        if kind == "lit":
            text = value[1:-1]
            return lambda c: text
        if kind == "var":
            prefix, _, local = value[1:].rpartition(":")
            key = f"{{{self.uri(prefix)}}}{local}" if prefix else local

            def variable(c: Context):
                if key not in c.variables:
                    raise XPathError(f"unknown variable ${key}")
                return c.variables[key]

            return variable
        if value == "(":
            inner = self.either()
            self.need(")")
            return inner
        self.need("(")
        args = []
        if not self.take(")"):
            args.append(self.either())
            while self.take(","):
                args.append(self.either())
            self.need(")")
        prefix, _, local = value.rpartition(":")
        if prefix:
            function = EXTENSIONS.get(f"{{{self.uri(prefix)}}}{local}")
            if function is None:
                raise XPathError(f"unknown function {value}")
        else:
            if local not in CORE:
                raise XPathError(f"unknown function {value}")
            least, most, function = CORE[local]
            if not least <= len(args) <= most:
                raise XPathError(f"wrong number of arguments for {value}()")
        return lambda c: function(c, *(a(c) for a in args))


class Cache(dict):
    """A cache of a process: it travels to executors empty, and starts anew when it is full."""

    def __reduce__(self):
        return Cache, ()

    def get_or_make(self, key, make: Callable):
        if key not in self:
            if len(self) >= 4096:
                self.clear()
            self[key] = make()
        return self[key]


_compiled = Cache()


def compile_xpath(text: str, namespaces: dict[str, str] | None = None) -> Closure:
    key = (text, tuple(sorted((namespaces or {}).items())))
    return _compiled.get_or_make(key, lambda: Parser(text, dict(namespaces or {})).parse())


def evaluate(text: str, node: Node, namespaces: dict[str, str] | None = None, variables: dict[str, object] | None = None):
    """A node-set as list, or a string, float or bool."""
    return compile_xpath(text, namespaces)(Context(node, variables=variables or {}, current=node))


_SIMPLE = re.compile(r"(@?)(?:(\*)|(?:([\w.\-]+):)?([\w.\-]+|\*))|(text|node)\(\)")
_patterns = Cache()


def _pattern(part: str, namespaces: dict[str, str]) -> Callable[[Node, dict], bool]:
    """A test for one alternative of a pattern; single steps without predicates need no search."""
    if part == "/":
        return lambda node, variables: node.kind == DOC
    m = _SIMPLE.fullmatch(part)
    if m and m[5]:
        kinds = (TEXT,) if m[5] == "text" else (ELEM, TEXT)
        return lambda node, variables: node.kind in kinds
    if m:
        kind = ATTR if m[1] else ELEM
        if m[2]:
            return lambda node, variables: node.kind == kind
        if m[3] and m[3] not in namespaces:
            raise XPathError(f"unknown prefix {m[3]!r} in {part!r}")
        uri, name = namespaces[m[3]] if m[3] else "", m[4]
        return lambda node, variables: node.kind == kind and node.uri == uri and name in ("*", node.name)
    run = compile_xpath(part, namespaces)
    # where the pattern's last step is a text test, no other node can match
    only = TEXT if re.search(r"(^|/)text\(\)(\[[^\]]*\])?$", part) else None

    def search(node: Node, variables: dict) -> bool:
        if only is not None and node.kind != only:
            return False
        start = node.parent
        while start is not None:
            if any(n is node for n in run(Context(start, variables=variables))):
                return True
            start = start.parent
        return False

    return search


def matches(pattern: str, node: Node, namespaces: dict[str, str], variables: dict[str, object]) -> bool:
    """Whether a node matches an XSLT pattern: some ancestor selects it."""
    key = (pattern, tuple(sorted(namespaces.items())))
    tests = _patterns.get_or_make(key, lambda: [_pattern(p.strip(), namespaces) for p in re.split(r"\|(?![^\[]*\])", pattern)])
    return any(t(node, variables) for t in tests)

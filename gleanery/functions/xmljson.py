"""Nested values from XML elements, and multi-valued maps that render as JSON."""

from __future__ import annotations

import base64
import json
import re
from datetime import date, datetime

from gleanery.functions.xmltree import ELEM, TEXT, XML_NS, XSI_NS, Node

XMLNS = "http://www.w3.org/2000/xmlns/"
_HIDDEN = (XMLNS, XML_NS, XSI_NS)
_SPECIAL = re.compile(r"__AT_(.+)")
_INTEGERS = frozenset("integer int long short byte nonNegativeInteger positiveInteger negativeInteger nonPositiveInteger unsignedInt unsignedLong unsignedShort unsignedByte".split())


class Multi(dict):
    """Ordered map whose keys hold lists of values; one value renders as itself, none is left out."""

    def put(self, key: str, *values) -> None:
        if values:
            self.setdefault(key, []).extend(values)

    def plain(self):
        """Scalars for single values, lists for several, None for an empty map."""
        if not self:
            return None
        out = {}
        for key, values in self.items():
            plain = [v.plain() if isinstance(v, Multi) else v for v in values]
            if plain:
                out[key] = plain[0] if len(plain) == 1 else plain
        return out

    def json(self) -> str:
        return json.dumps(self.plain(), ensure_ascii=False, default=_text, separators=(",", ":"))


def _text(v) -> str:
    if isinstance(v, datetime):
        return f"{v:%Y-%m-%dT%H:%M:%S}.{v.microsecond // 1000:03d}Z"
    return v.isoformat() if isinstance(v, date) else str(v)


def typed(text: str, kind: str | None):
    """A leaf by its xsi:type: numbers and booleans become such, others stay text."""
    local = (kind or "string").rpartition(":")[2]
    value = text.strip(" \t\r\n")
    if local in _INTEGERS:
        return int(value)
    if local in ("double", "float", "decimal"):
        return float(value.replace("INF", "inf"))
    if local == "boolean":
        if value not in ("true", "false", "1", "0"):
            raise ValueError(f"no boolean: {value}")
        return value in ("true", "1")
    if local == "base64Binary":
        return base64.b64decode(value).decode("utf-8", "replace")
    return text


def converted(node: Node, attributes: bool = True):
    """None, a leaf, or a Multi of the children by local name; text beside elements or attributes is an error, unless it
    is blank."""
    shown = [a for a in node.attrs if a.uri not in _HIDDEN] if attributes else []
    if not shown and not node.elements():
        text = node.text()
        return typed(text, node.attr("type", XSI_NS)) if text.strip() else None
    out = Multi()
    for a in shown:
        out.put("@" + a.name, a.value)
    for c in node.children:
        if c.kind == ELEM:
            special = _SPECIAL.fullmatch(c.name) if attributes else None
            out.put("@" + special[1] if special else c.name, converted(c, attributes))
        elif c.kind == TEXT and c.value.strip():
            raise ValueError("text beside elements can't become JSON")
    return out or None


def to_json(node: Node, attributes: bool = True) -> str | None:
    value = converted(node, attributes)
    if value is None:
        return None
    return value.json() if isinstance(value, Multi) else json.dumps(value, ensure_ascii=False)

"""Index queries as Columns: a JSON query language and a query-string syntax."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QueryError(ValueError):
    """The query is not understood."""


def _any(schema: T.StructType, name: str, test) -> Column:
    """test on a column, or on any value of an array column; false for null."""
    field = next((f for f in schema.fields if f.name == name), None)
    if field is None:
        return F.lit(False)
    col = F.col(f"`{name}`")
    out = F.exists(col, lambda v: test(v)) if isinstance(field.dataType, T.ArrayType) else test(col)
    return F.coalesce(out, F.lit(False))


def _like(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def _phrase(words: list[str]) -> str:
    """A pattern of whole words in a row, for lower-case text."""
    return r"(?U)(^|\W)" + r"\W+".join(re.escape(w) for w in words) + r"(\W|$)"


def _match(schema: T.StructType, field: str, value, phrase: bool) -> Column:
    """match: any of the words (all with operator and), each in any of the values; match_phrase: the words in a row in one
    value. Words are unanalysed, in any case; other than text fields are compared whole. A text without words fits nothing."""
    options = value if isinstance(value, Mapping) else {"query": value}
    if unknown := set(options) - {"query", "operator", "boost"}:
        raise QueryError(f"unknown in match: {sorted(unknown)}")
    kind = next((f.dataType for f in schema.fields if f.name == field), None)
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if kind is not None and not isinstance(kind, T.StringType):
        return _any(schema, field, lambda c: c == F.lit(options["query"]).try_cast(kind))
    words = re.findall(r"\w+", str(options["query"]).lower())
    if not words:
        return F.lit(False)
    found = [_any(schema, field, lambda c, w=w: F.lower(c).rlike(_phrase(w))) for w in ([words] if phrase else [[w] for w in words])]
    every = str(options.get("operator", "or")).lower() == "and"
    out = found[0]
    for one in found[1:]:
        out = out & one if every else out | one
    return out


def _one(body: Mapping, kind: str) -> tuple[str, object]:
    if not isinstance(body, Mapping) or len(body) != 1:
        raise QueryError(f"{kind} needs one field")
    return next(iter(body.items()))


def compile_json(query: str | Mapping, schema: T.StructType, id_col: str = "id") -> Column:
    """match_all, match_none, match, match_phrase, term, terms, range, exists, prefix, wildcard, regexp (whole values, Java's
    syntax), ids, bool, constant_score and query_string; else an error."""
    q = json.loads(query) if isinstance(query, str) else query
    kind, body = _one(q, "a query")
    again = lambda x: compile_json(x, schema, id_col)
    if kind == "match_all":
        return F.lit(True)
    if kind == "match_none":
        return F.lit(False)
    if kind == "ids":
        return F.coalesce(F.col(id_col).isin(list(body["values"])), F.lit(False))
    if kind == "exists":
        return _any(schema, body["field"], lambda c: c.isNotNull())
    if kind == "query_string":
        return compile_string(body["query"], schema, body.get("default_field"), body.get("default_operator", "OR"))
    if kind == "constant_score":
        return again(body["filter"])
    if kind == "bool":
        many = lambda name: (lambda v: v if isinstance(v, list) else [v])(body.get(name, []))
        if unknown := set(body) - {"must", "filter", "must_not", "should", "minimum_should_match", "boost"}:
            raise QueryError(f"unknown in bool: {sorted(unknown)}")
        out = F.lit(True)
        for x in (*many("must"), *many("filter")):
            out = out & again(x)
        for x in many("must_not"):
            out = out & ~again(x)
        should = [again(x) for x in many("should")]
        least = body.get("minimum_should_match", 0 if many("must") or many("filter") else 1)
        if should and least:
            out = out & (sum((s.cast("int") for s in should), F.lit(0)) >= int(least))
        return out
    field, value = _one(body, kind)
    if kind == "term":
        value = value["value"] if isinstance(value, Mapping) else value
        return _any(schema, field, lambda c: c == F.lit(value))
    if kind == "terms":
        return _any(schema, field, lambda c: c.isin(list(value)))
    if kind == "prefix":
        value = value["value"] if isinstance(value, Mapping) else value
        return _any(schema, field, lambda c: c.cast("string").startswith(value))
    if kind == "wildcard":
        value = value["value"] if isinstance(value, Mapping) else value
        return _any(schema, field, lambda c: c.cast("string").rlike(_like(value)))
    if kind in ("match", "match_phrase"):
        return _match(schema, field, value, kind == "match_phrase")
    if kind == "regexp":
        value = value["value"] if isinstance(value, Mapping) else value
        return _any(schema, field, lambda c: c.cast("string").rlike(rf"^(?:{value})\z"))
    if kind == "range":
        ops = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
        if unknown := set(value) - set(ops) - {"format", "boost", "time_zone"}:
            raise QueryError(f"unknown in range: {sorted(unknown)}")
        bounds = [(ops[k], v) for k, v in value.items() if k in ops]

        def inside(c: Column) -> Column:
            out = F.lit(True)
            for op, v in bounds:
                out = out & op(c, F.lit(v))
            return out

        return _any(schema, field, inside)
    raise QueryError(f"unknown query: {kind}")


_TERM = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<op>AND\b|OR\b|NOT\b|&&|\|\||!|\+(?=\S)|-(?=\S))|(?:(?P<field>[\w.\-]+):)?(?:"(?P<phrase>(?:[^"\\]|\\.)*)"|(?P<range>[\[{][^\]}]+ TO [^\]}]+[\]}])|(?P<group>(?=\())|(?P<word>[^\s()"]+)))')


def compile_string(text: str, schema: T.StructType, default_field: str | None = None, default_operator: str = "AND") -> Column:
    """field:word, field:"phrase", ranges [a TO b] and {a TO b}, wildcards, AND, OR, NOT, +, -, parentheses. Words match
    parts of text fields (unanalysed, in any case) and equal other fields."""
    found, at = [], 0
    while text[at:].strip():
        m = _TERM.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"can't read {text[at:]!r}")
        found.append({k: v for k, v in m.groupdict().items() if v is not None})
        at = m.end()
    pos = 0
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType) or isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)]

    def leaf(t: dict, field: str | None) -> Column:
        names = [field] if field else [default_field] if default_field else strings
        out = F.lit(False)
        for name in names:
            kind = next((f.dataType for f in schema.fields if f.name == name), None)
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
            is_text = isinstance(kind, T.StringType)
            if "phrase" in t:
                value = re.sub(r"\\(.)", r"\1", t["phrase"])
                test = (lambda c, v=value: F.lower(c).contains(v.lower())) if is_text else (lambda c, v=value: c == F.lit(v).cast(kind))
            elif "range" in t:
                lo, hi = t["range"][1:-1].split(" TO ")
                lo, hi = lo.strip().strip('"'), hi.strip().strip('"')
                left, right = t["range"][0] == "[", t["range"][-1] == "]"

                def test(c, lo=lo, hi=hi, left=left, right=right, kind=kind):
                    a = F.lit(True) if lo == "*" else (c >= F.lit(lo).cast(kind)) if left else (c > F.lit(lo).cast(kind))
                    b = F.lit(True) if hi == "*" else (c <= F.lit(hi).cast(kind)) if right else (c < F.lit(hi).cast(kind))
                    return a & b
            else:
                value = re.sub(r"\\(.)", r"\1", t["word"])
                if value == "*":
                    test = lambda c: c.isNotNull()
                elif m := re.fullmatch(r"(>=|<=|>|<)(.+)", value):
                    op, v = m.groups()
                    test = lambda c, o=op, v=v, k=kind: {">": c > F.lit(v).cast(k), ">=": c >= F.lit(v).cast(k), "<": c < F.lit(v).cast(k), "<=": c <= F.lit(v).cast(k)}[o]
                elif "*" in value or "?" in value:
                    test = lambda c, v=value: F.lower(c.cast("string")).rlike(_like(v.lower()))
                elif is_text:
                    test = lambda c, v=value: F.lower(c).rlike(r"(?U)(^|\W)" + re.escape(v.lower()) + r"(\W|$)")
                else:
                    test = lambda c, v=value, k=kind: c == F.lit(v).try_cast(k)
            out = out | _any(schema, name, test)
        return out

    def primary(field: str | None) -> Column:
        nonlocal pos
        if pos >= len(found):
            raise QueryError("the query ends early")
        t = found[pos]
        pos += 1
        if t.get("op") in ("NOT", "!", "-"):
            return ~primary(field)
        if t.get("op") == "+":
            return primary(field)
        if "open" in t or "group" in t:
            if "group" in t:
                pos += 1
            out = either(t.get("field", field))
            if pos >= len(found) or "close" not in found[pos]:
                raise QueryError("a parenthesis is missing")
            pos += 1
            return out
        if "close" in t or "op" in t:
            raise QueryError("an operand is missing")
        return leaf(t, t.get("field", field))

    def both(field: str | None) -> Column:
        nonlocal pos
        out = primary(field)
        while pos < len(found) and "close" not in found[pos]:
            op = found[pos].get("op")
            if op in ("OR", "||"):
                break
            if op in ("AND", "&&"):
                pos += 1
            elif default_operator.upper() == "OR" and op not in ("NOT", "!", "-", "+"):
                break
            out = out & primary(field)
        return out

    def either(field: str | None) -> Column:
        nonlocal pos
        out = both(field)
        while pos < len(found) and "close" not in found[pos]:
            if found[pos].get("op") in ("OR", "||"):
                pos += 1
            out = out | both(field)
        return out

    result = either(None) if found else F.lit(True)
    if pos != len(found):
        raise QueryError("a parenthesis is left over")
    return result


def query(table: DataFrame, json_query: str | Mapping | None = None, query_string: str | None = None, default_field: str | None = None, id_col: str = "id") -> DataFrame:
    """Rows that match a JSON query or a query string; giving both is an error, neither means all."""
    if json_query is not None and query_string is not None:
        raise QueryError("give a JSON query or a query string, not both")
    if json_query is not None:
        return table.where(compile_json(json_query, table.schema, id_col))
    if query_string is not None:
        return table.where(compile_string(query_string, table.schema, default_field))
    return table


def overlaps(low, high, a, b) -> Column:
    """Whether the range from low to high meets the range from a to b; an open end is null."""
    low, high = (F.col(x) if isinstance(x, str) else x for x in (low, high))
    return (F.lit(b).isNull() | low.isNull() | (low <= F.lit(b))) & (F.lit(a).isNull() | high.isNull() | (high >= F.lit(a)))


def facets(table: DataFrame, field: str) -> DataFrame:
    """Values of a field with the number of rows that hold them."""
    kind = table.schema[field].dataType
    value = F.explode(F.array_distinct(field)) if isinstance(kind, T.ArrayType) else F.col(field)
    return table.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n"))

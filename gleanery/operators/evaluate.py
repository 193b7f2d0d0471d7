"""Evaluating a pipeline on documents: variables, filters, fields.

One Arrow-batched UDF parses each document once and returns the verdict, an error and all fields as strings; conversion to
types, defaults and the error policy are Columns, so Catalyst sees them. Filters on dates come before it and reach the scan.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import dates, scalars
from gleanery.functions import xpath as X
from gleanery.functions.template import Template
from gleanery.functions.xmljson import to_json
from gleanery.functions.xmltree import ATTR, DOC, ELEM, Node, normalize, parse, serialize, walked_text
from gleanery.functions.xsd import Schema
from gleanery.operators.verdict import operation, with_policy
from gleanery.plans.config import SYSTEM_VARIABLES, Expression, FieldSpec, PipelineSpec

BLANKS = "".join(map(chr, range(33)))

#: Columns of a raw document, as all sources give them.
RAW = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("datestamp", T.TimestampType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("xml", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


class Evaluator:
    """A compiled pipeline; lives in a worker."""

    def __init__(self, spec: PipelineSpec):
        self.spec = spec
        made = lambda e: Template(e.text) if e.template else X.compile_xpath(e.text, dict(e.namespaces))
        self.variables = [(name, e.template, made(e)) for name, e in spec.variables]
        self.filters = [(accept, made(e)) for accept, e in spec.filters]
        self.fields = [(f, made(f.expression)) for f in spec.fields]

    def scope(self, doc: Node, source: str, identifier: str, datestamp: str, more: dict[str, str] | None = None) -> dict[str, object]:
        system = dict(zip(SYSTEM_VARIABLES, (source or "", identifier or "", datestamp or ""), strict=True)) | {k: v or "" for k, v in (more or {}).items()}
        scope: dict[str, object] = {f"{{{uri}}}{k}": v for uri in self.spec.system_namespaces for k, v in system.items()}
        scope |= system
        for name, is_template, run in self.variables:
            if is_template:
                top = Node(DOC)
                for n in run.run(doc, scope):
                    top.add(n)
                scope[name] = [top]
            else:
                scope[name] = run(X.Context(doc, variables=scope, current=doc))
        return scope

    def accepts(self, doc: Node, scope: dict[str, object]) -> bool:
        verdict = self.spec.default_accept
        for accept, run in self.filters:
            if X.boolean(run(X.Context(doc, variables=scope, current=doc))):
                verdict = accept
        return verdict

    def values(self, spec: FieldSpec, run, doc: Node, scope: dict[str, object]) -> list[str]:
        if spec.expression.template:
            nodes = run.run(doc, scope)
            if spec.datatype == "XHTML":
                return ["".join(serialize(n) for n in nodes)]
            top = Node(DOC)
            for n in nodes:
                top.add(n)
            normalize(top)
            found: object = [*top.attrs, *top.children]
        else:
            found = run(X.Context(doc, variables=scope, current=doc))
        if not isinstance(found, list):
            if spec.datatype in ("XML", "JSON"):
                raise ValueError(f"field {spec.name}: {spec.datatype} needs nodes")
            found = [Node(ATTR, value=X.string(found))]
        out = []
        for n in found:
            if spec.datatype == "XML":
                value = serialize(n) if n.kind == ELEM else None
            elif spec.datatype == "JSON":
                value = to_json(n) if n.kind == ELEM else None
            else:
                value = walked_text(n).strip(BLANKS)
                if value and spec.datatype == "DATETIME":
                    value = str(dates.parse_millis(value))
            if value:
                out.append(value)
        return out

    def run(self, xml: str, source: str, identifier: str, datestamp: str, more: dict[str, str] | None = None) -> tuple[bool | None, str | None, list[list[str] | None]]:
        none: list[list[str] | None] = [None] * len(self.fields)
        try:
            doc = parse(xml)
            scope = self.scope(doc, source, identifier, datestamp, more)
            if not self.accepts(doc, scope):
                return False, None, none
            return True, None, [self.values(f, run, doc, scope) for f, run in self.fields]
        except (ValueError, RecursionError) as e:
            return None, f"{type(e).__name__}: {e}", none


_templates = X.Cache()


def _typed(spec: FieldSpec, raw: Column) -> tuple[Column, Column]:
    """(typed array, whether a value could not be converted)."""
    convert = {
        "NUMBER": scalars.number,
        "INTEGER": scalars.integer,
        "BOOLEAN": scalars.boolean_word,
        "DATETIME": lambda x: F.timestamp_millis(x.cast("bigint")),
    }.get(spec.datatype)
    if convert is None:
        return raw, F.lit(False)
    typed = F.transform(raw, convert)
    if spec.default is not None:
        if spec.datatype == "DATETIME":
            default = F.timestamp_millis(F.lit(dates.parse_millis(spec.default)))
        else:
            default = convert(F.lit(spec.default))
        typed = F.when(F.size(raw) == 0, F.array(default)).otherwise(typed)
    return typed, F.coalesce(F.exists(typed, lambda v: v.isNull()), F.lit(False))


def evaluated(docs: DataFrame, spec: PipelineSpec, source: str, policy: str = "STOP", more: dict[str, Column] | None = None) -> DataFrame:
    """Change rows (id, op, error, seq, internal columns, fields, xml) of raw documents. `more` adds system variables:
    names with string columns of docs.

    Tombstones, documents without XML and rejected documents become deletes; rows without identifier are left out."""
    spec.check()
    names = [f"f{k}" for k in range(len(spec.fields))]
    schema = T.StructType([T.StructField("accept", T.BooleanType()), T.StructField("error", T.StringType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in names)])
    holder: dict[str, Evaluator] = {}
    extra = list(more or {})

    @F.pandas_udf(schema)
    def run(xml: pd.Series, identifier: pd.Series, datestamp: pd.Series, given: pd.Series) -> pd.DataFrame:
        own = holder.setdefault("one", Evaluator(spec)) if "one" not in holder else holder["one"]
        rows = [own.run(x, source, i, d, dict(zip(extra, g, strict=True)) if extra else None) if x is not None else (None, None, [None] * len(names)) for x, i, d, g in zip(xml, identifier, datestamp, given, strict=True)]
        out = {"accept": pd.Series([r[0] for r in rows], dtype="boolean"), "error": pd.Series([r[1] for r in rows], dtype="object")}
        for k, n in enumerate(names):
            out[n] = pd.Series([r[2][k] for r in rows], dtype="object")
        return pd.DataFrame(out)

    run = run.asNondeterministic()  # else a filter on the verdict above would evaluate each document once more
    rows = docs.where(F.col("identifier").isNotNull())
    live = ~F.coalesce(F.col("deleted"), F.lit(False)) & F.col("xml").isNotNull()
    stamp = F.coalesce(scalars.index_text("datestamp"), F.lit(""))
    rows = rows.withColumn("_e", run(F.when(live, F.col("xml")), F.col("identifier"), stamp, F.array(*(more[k].cast("string") for k in extra)).cast("array<string>")))
    columns, failed = [], F.lit(None).cast("string")
    for f, n in zip(spec.fields, names, strict=True):
        typed, bad = _typed(f, F.col(f"_e.{n}"))
        columns.append(typed.alias(f.name))
        failed = F.coalesce(failed, F.when(bad, F.lit(f"field {f.name}: not a {f.datatype.lower()}")))
    accept = live & F.coalesce(F.col("_e.accept"), F.lit(False))
    changes = rows.select(
        F.col("identifier"),
        F.col("identifier").alias("id"),
        operation(accept | F.col("_e.error").isNotNull()).alias("op"),
        F.coalesce(F.col("_e.error"), F.when(accept, failed)).alias("error"),
        F.col("seq") if "seq" in docs.columns else F.lit(0).cast("long").alias("seq"),
        F.lit(source).alias(spec.source_field),
        F.col("datestamp").alias(spec.datestamp_field),
        *columns,
        F.col("xml").alias(spec.xml_field) if spec.xml_field != "xml" else F.col("xml"),
    )
    return with_policy(changes, policy).drop("identifier")


def index_columns(spec: PipelineSpec) -> list[str]:
    return ["id", spec.source_field, spec.datestamp_field, *(f.name for f in spec.fields), spec.xml_field]


def transformed(docs: DataFrame, expression: Expression | None, source: str, params: dict[str, str] | None = None) -> DataFrame:
    """Documents whose XML went through a stylesheet; without one they stay. A failing document has its `parse_error`."""
    given = dict(params or {})

    @F.pandas_udf(T.StructType([T.StructField("xml", T.StringType()), T.StructField("error", T.StringType())]))
    def run(xml: pd.Series, identifier: pd.Series, datestamp: pd.Series) -> pd.DataFrame:
        out = []
        for x, i, d in zip(xml, identifier, datestamp, strict=True):
            if x is None:
                out.append((None, None))
                continue
            try:
                doc = parse(x)
                if expression is not None:
                    system = dict(zip(SYSTEM_VARIABLES, (source, i or "", d or ""), strict=True))
                    doc = _templates.get_or_make(expression.text, lambda: Template(expression.text)).document(doc, {**given, **system})
                out.append((serialize(doc), None))
            except ValueError as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["xml", "error"], dtype="object")

    stamp = F.coalesce(scalars.index_text("datestamp"), F.lit(""))
    return docs.withColumn("_t", run("xml", "identifier", stamp)).withColumn("xml", F.col("_t.xml")).withColumn("parse_error", F.col("_t.error")).drop("_t")


def parse_policy(docs: DataFrame, policy: str = "IGNOREDOCUMENT") -> DataFrame:
    """Apply the policy for documents that don't parse: leave out, delete (deleted = true) or stop."""
    bad = F.col("parse_error").isNotNull()
    if policy == "IGNOREDOCUMENT":
        return docs.where(~bad).drop("parse_error")
    if policy == "DELETEDOCUMENT":
        return docs.withColumn("deleted", F.coalesce(F.col("deleted"), F.lit(False)) | bad).drop("parse_error")
    stop = F.when(bad, F.raise_error(F.concat(F.lit("document "), F.col("identifier"), F.lit(": "), F.col("parse_error"))).cast("string")).otherwise(F.col("xml"))
    return docs.withColumn("xml", stop).drop("parse_error")


def validated(docs: DataFrame, spec: PipelineSpec) -> DataFrame:
    """Documents with `schema_errors`; with halt_on_error a bad one stops the run. With augmentation, attribute defaults
    of the schema enter the XML."""
    if not spec.schemas:
        return docs.withColumn("schema_errors", F.array().cast("array<string>"))
    schemas, augment = spec.schemas, spec.augmentation
    holder: dict[str, list[Schema]] = {}

    @F.pandas_udf(T.StructType([T.StructField("xml", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))]))
    def run(xml: pd.Series) -> pd.DataFrame:
        if "one" not in holder:
            holder["one"] = [Schema(s) for s in schemas]
        out = []
        for x in xml:
            if x is None:
                out.append((None, []))
                continue
            doc = parse(x)
            uri = doc.elements()[0].uri
            schema = next((s for s in holder["one"] if s.target == uri), holder["one"][0])
            errors = schema.check(doc, augment)
            out.append((serialize(doc) if augment else x, errors))
        return pd.DataFrame(out, columns=["xml", "errors"])

    done = docs.withColumn("_v", run("xml"))
    xml = F.col("_v.xml")
    if spec.halt_on_error:
        xml = F.when(F.size("_v.errors") > 0, F.raise_error(F.concat(F.lit("document "), F.col("identifier"), F.lit(": "), F.array_join("_v.errors", "; "))).cast("string")).otherwise(xml)
    return done.withColumn("xml", xml).withColumn("schema_errors", F.col("_v.errors")).drop("_v")


def _shower(kind: T.DataType, is_json: bool):
    """A function from a value's Column to its JSON text."""

    def show(v: Column) -> Column:
        if is_json:
            return v
        if isinstance(kind, T.TimestampType):
            return F.concat(F.lit('"'), scalars.index_text(v), F.lit('"'))
        if isinstance(kind, (T.BooleanType, T.LongType)):
            return v.cast("string")
        return F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")

    return show


def rendered(table: DataFrame, spec: PipelineSpec, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(id, json): one value as scalar, several as array, none left out; JSON fields as objects."""
    parts = []
    for f in table.schema.fields:
        name, kind = f.name, f.dataType
        if name == "id" or name in exclude:
            continue
        own = next((x for x in spec.fields if x.name == name), None)
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        show = _shower(inner, own is not None and own.datatype == "JSON")
        col = F.col(f"`{name}`")
        if isinstance(kind, T.ArrayType):
            items = F.transform(col, show)
            text = F.when(F.size(col) == 1, F.get(items, F.lit(0))).when(F.size(col) > 1, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
        else:
            text = F.when(col.isNotNull(), show(col))
        parts.append(F.concat(F.lit(f'"{name}":'), text))
    return table.select("id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))

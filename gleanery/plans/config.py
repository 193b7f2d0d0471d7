"""Pipeline configuration: dataclasses, and a strict reader of the declarative XML form."""

from __future__ import annotations

import json
import re
import urllib.request
from dataclasses import dataclass, field
from pathlib import Path

from gleanery.functions.scalars import byte_size
from gleanery.functions.template import Template
from gleanery.functions.xmltree import ELEM, Node, parse, serialize
from gleanery.functions.xpath import compile_xpath

DATATYPES = ("STRING", "NUMBER", "DATETIME", "INTEGER", "BOOLEAN", "XML", "XHTML", "JSON")
WITH_DEFAULT = ("NUMBER", "INTEGER", "BOOLEAN", "DATETIME")
XINCLUDE = "http://www.w3.org/2001/XInclude"
POLICIES = ("STOP", "IGNOREDOCUMENT", "DELETEDOCUMENT")
SYSTEM_VARIABLES = ("harvesterIdentifier", "docIdentifier", "docDatestamp")
#: Options by kind of source; anything else is refused.
BASE_OPTIONS = frozenset("numThreads maxQueue bulkSize maxBulkMemory concurrentBulkRequests deleteUnseenBulkSize conversionErrorAction harvestMessageStep validate sourceContentType".split())
FILE_OPTIONS = BASE_OPTIONS | {"parseErrorAction", "deleteMissingDocuments"}
OAI_OPTIONS = BASE_OPTIONS | frozenset("metadataPrefix setSpec retryCount retryAfterSeconds timeoutAfterSeconds authorizationHeader identifierPrefix ignoreDatestamps deleteMissingDocuments".split())
OPTIONS = {
    "directory": FILE_OPTIONS | {"directory", "recursive", "identifierPrefix", "filenameFilter"},
    "zip": FILE_OPTIONS | frozenset("zipFile identifierPrefix filenameFilter useZipFileDate retryCount retryAfterSeconds timeoutAfterSeconds authorizationHeader".split()),
    "crawl": FILE_OPTIONS | frozenset("baseUrl contentTypes filenameFilter excludeUrlPattern pauseBetweenRequests retryCount retryAfterSeconds timeoutAfterSeconds authorizationHeader".split()),
    "oai": OAI_OPTIONS | {"baseUrl"},
    "oai_static": OAI_OPTIONS | {"url"},
    "table": BASE_OPTIONS | frozenset("indexes types queryString jsonQuery datestampField xmlField identifierPrefix deleteMissingDocuments parseErrorAction tableRoot".split()),
    "legacy": FILE_OPTIONS | frozenset("indexDir query identifierPrefix defaultQueryParserOperator".split()),
    "noop": BASE_OPTIONS,
}
#: Sources by the last words of a class name.
KINDS = (("OAIStaticRepositoryHarvester", "oai_static"), ("OAIHarvester", "oai"), ("DirectoryHarvester", "directory"), ("ZipFileHarvester", "zip"), ("WebCrawlingHarvester", "crawl"), ("ElasticsearchHarvester", "table"), ("IndexHarvester", "legacy"), ("NoOpHarvester", "noop"))


class ConfigError(ValueError):
    """The configuration is not valid."""


@dataclass(frozen=True)
class Expression:
    """An XPath, or a template's XML, with the prefixes it may use."""

    text: str
    template: bool = False
    namespaces: tuple[tuple[str, str], ...] = ()

    def check(self) -> None:
        try:
            if self.template:
                Template(self.text)
            else:
                compile_xpath(self.text, dict(self.namespaces))
        except ValueError as e:
            raise ConfigError(str(e)) from e


@dataclass(frozen=True)
class FieldSpec:
    name: str
    expression: Expression
    datatype: str = "STRING"
    default: str | None = None

    def __post_init__(self):
        if self.datatype not in DATATYPES:
            raise ConfigError(f"field {self.name}: unknown datatype {self.datatype}")
        if self.datatype == "XHTML" and not self.expression.template:
            raise ConfigError(f"field {self.name}: XHTML needs a template")
        if self.default is not None and self.datatype not in WITH_DEFAULT:
            raise ConfigError(f"field {self.name}: {self.datatype} has no default")


@dataclass
class PipelineSpec:
    fields: list[FieldSpec] = field(default_factory=list)
    variables: list[tuple[str, Expression]] = field(default_factory=list)
    filters: list[tuple[bool, Expression]] = field(default_factory=list)
    default_accept: bool = True
    xml_field: str = "xml"
    source_field: str = "internal-source"
    datestamp_field: str = "internal-datestamp"
    schemas: list[str] = field(default_factory=list)
    halt_on_error: bool = False
    augmentation: bool = True
    mapping: dict = field(default_factory=dict)
    type_name: str = "doc"
    system_namespaces: tuple[str, ...] = ()

    def check(self) -> "PipelineSpec":
        names = [f.name for f in self.fields]
        internal = [self.xml_field, self.source_field, self.datestamp_field]
        if len({*names, *internal}) < len(names) + 3:
            raise ConfigError("field names must differ, from each other and from the internal fields")
        for e in (*(f.expression for f in self.fields), *(e for _, e in self.variables), *(e for _, e in self.filters)):
            e.check()
        if any(e.template for _, e in self.filters):
            raise ConfigError("filters can't be templates")
        if taken := set(internal) & set(self.mapping.get("properties", {})):
            raise ConfigError(f"the mapping may not declare {sorted(taken)}")
        return self


@dataclass
class SourceSpec:
    id: str
    kind: str
    options: dict[str, str] = field(default_factory=dict)
    transform: Expression | None = None
    transform_params: dict[str, str] = field(default_factory=dict)

    def check(self) -> "SourceSpec":
        allowed = OPTIONS.get(self.kind)
        if allowed is not None and (unknown := set(self.options) - allowed):
            raise ConfigError(f"source {self.id}: unknown options {sorted(unknown)}")
        for name in ("conversionErrorAction", "parseErrorAction"):
            if name in self.options and self.options[name].upper() not in POLICIES:
                raise ConfigError(f"source {self.id}: unknown {name}")
        if "maxBulkMemory" in self.options:
            byte_size(self.options["maxBulkMemory"])
        if self.options.get("queryString") and self.options.get("jsonQuery"):
            raise ConfigError(f"source {self.id}: queryString and jsonQuery exclude each other")
        return self

    def flag(self, name: str, default: bool) -> bool:
        value = self.options.get(name)
        if value is None:
            return default
        if value.upper() in ("TRUE", "YES", "ON"):
            return True
        if value.upper() in ("FALSE", "NO", "OFF"):
            return False
        raise ConfigError(f"source {self.id}: {name} is no boolean")


@dataclass
class IndexSpec:
    name: str
    suffixes: tuple[str, str] = ("", "")
    settings: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str | None] = field(default_factory=dict)
    sources: list[SourceSpec] = field(default_factory=list)

    def physical(self, second: bool) -> str:
        return self.name + self.suffixes[second]


@dataclass
class Config:
    pipeline: PipelineSpec
    indexes: list[IndexSpec]
    addresses: list[str] = field(default_factory=list)

    def check(self) -> "Config":
        ids = [i.name for i in self.indexes] + [s.id for i in self.indexes for s in i.sources]
        if len(set(ids)) < len(ids):
            raise ConfigError("ids of sources and indexes must differ")
        if any(not re.fullmatch(r"[\w.\-]+", x) or x in ("*", "all") for x in ids):
            raise ConfigError("an id is not valid")
        self.pipeline.check()
        for i in self.indexes:
            if i.suffixes[0] == i.suffixes[1]:
                raise ConfigError(f"index {i.name}: its two suffixes must differ")
            for text in i.aliases.values():
                if text:
                    json.loads(text)
            for s in i.sources:
                s.check()
        return self

    def chosen(self, which: str | None) -> list[tuple[IndexSpec, list[SourceSpec]]]:
        """The index and sources that an id, or * or all, stands for."""
        if which in (None, "*", "all"):
            return [(i, i.sources) for i in self.indexes]
        for i in self.indexes:
            if i.name == which:
                return [(i, i.sources)]
            if own := [s for s in i.sources if s.id == which]:
                return [(i, own)]
        raise ConfigError(f"no source or index {which}")


def resolved(base: Path, ref: str) -> str:
    """The text of a file relative to the configuration, or of a URL."""
    if re.match(r"(https?|file)://", ref):
        with urllib.request.urlopen(ref, timeout=60) as r:
            return r.read().decode()
    return (base / ref).read_text()


def _include(node: Node, base: Path) -> None:
    for k, c in enumerate(node.children):
        if c.kind == ELEM and c.uri == XINCLUDE and c.name == "include":
            new = parse(resolved(base, c.attr("href"))).elements()[0]
            new.parent = node
            node.children[k] = new
        else:
            _include(c, base)


def _prefixes(e: Node) -> tuple[tuple[str, str], ...]:
    return tuple(sorted((p, u) for p, u in e.scope.items() if p and p != "xml"))


def _wrapped(e: Node) -> str:
    """The body of a template element as XML that declares all prefixes in scope."""
    whole = [c for c in e.elements() if c.name in ("stylesheet", "transform")]
    scope = dict((whole[0] if whole else e).scope)
    declared = "".join(f' xmlns:{p}="{u}"' for p, u in sorted(scope.items()) if p and p != "xml")
    if whole:
        text = serialize(whole[0])
        head = re.match(r"<[^\s/>]+", text)[0]
        own = re.match(r"<[^>]*>", text)[0]
        missing = "".join(f' xmlns:{p}="{u}"' for p, u in sorted(scope.items()) if p and p != "xml" and f"xmlns:{p}=" not in own)
        return head + missing + text[len(head) :]
    inner = "".join(serialize(c) for c in e.children)
    # declarations inside win over those of the wrapper
    return f"<body{declared}>{inner}</body>"


def _expression(e: Node, template: bool, base: Path) -> Expression:
    if template:
        if e.attr("src"):
            return Expression(resolved(base, e.attr("src")), True)
        return Expression(_wrapped(e), True)
    return Expression(e.text().strip(), False, _prefixes(e))


def read_config(path: str | Path) -> Config:
    """Read the XML form. Elements are told by local name in the root's namespace; unknown ones are errors."""
    path = Path(path)
    root = parse(path.read_bytes()).elements()[0]
    _include(root, path.parent)
    ns = root.uri
    system = tuple({u for u in root.scope.values() if u not in (ns, "http://www.w3.org/XML/1998/namespace")})

    def kids(e: Node, *allowed: str) -> list[Node]:
        out = e.elements()
        for c in out:
            if c.uri != ns or allowed and c.name not in allowed:
                raise ConfigError(f"unknown element {c.qname} in {e.qname}")
        return out

    spec, indexes, addresses = PipelineSpec(system_namespaces=system), [], []
    for part in kids(root, "metadata", "sources", "elasticsearchCluster"):
        if part.name == "metadata":
            seen_rest = False
            for e in kids(part, "variables", "filters", "fields", "schema", "elasticsearchMapping"):
                if e.name == "variables":
                    if seen_rest:
                        raise ConfigError("variables come before filters and fields")
                    for v in kids(e, "variable", "variable-template"):
                        prefix, _, local = (v.attr("name") or "").rpartition(":")
                        uri = v.scope.get(prefix, "") if prefix else ""
                        if uri in system and local in SYSTEM_VARIABLES:
                            raise ConfigError(f"{local} is reserved")
                        spec.variables.append((f"{{{uri}}}{local}" if uri else local, _expression(v, v.name == "variable-template", path.parent)))
                elif e.name == "filters":
                    seen_rest = True
                    default = (e.attr("default") or "accept").lower()
                    if default not in ("accept", "deny"):
                        raise ConfigError("the default filter is accept or deny")
                    spec.default_accept = default == "accept"
                    spec.filters += [(f.name == "accept", _expression(f, False, path.parent)) for f in kids(e, "accept", "deny")]
                elif e.name == "fields":
                    seen_rest = True
                    for f in kids(e, "field", "field-template", "xml-field", "source-field", "datestamp-field"):
                        name = f.attr("name")
                        if not name:
                            raise ConfigError("a field needs a name")
                        if f.name in ("field", "field-template"):
                            spec.fields.append(FieldSpec(name, _expression(f, f.name == "field-template", path.parent), (f.attr("datatype") or "string").upper(), f.attr("default")))
                        else:
                            setattr(spec, f.name.replace("-", "_"), name)
                elif e.name == "schema":
                    for s in kids(e, "url", "haltOnError", "augmentation"):
                        if s.name == "url":
                            spec.schemas.append(resolved(path.parent, s.text().strip()))
                        else:
                            setattr(spec, {"haltOnError": "halt_on_error"}.get(s.name, s.name), s.text().strip().lower() in ("true", "yes", "on"))
                else:
                    for m in kids(e, "typeName", "file"):
                        if m.name == "typeName":
                            spec.type_name = m.text().strip()
                        else:
                            spec.mapping = json.loads(resolved(path.parent, m.text().strip()))
            if set(spec.mapping) == {spec.type_name}:
                spec.mapping = spec.mapping[spec.type_name]
        elif part.name == "sources":
            index = IndexSpec(part.attr("targetIndex") or "")
            shared: dict[str, str] = {}
            for e in kids(part, "targetIndex", "globalProperties", "harvester"):
                if e.name == "targetIndex":
                    suffixes = list(index.suffixes)
                    for t in kids(e, "nameSuffix1", "nameSuffix2", "settings", "alias"):
                        if t.name == "settings":
                            index.settings = {s.name: s.text().strip() for s in t.elements()}
                            if t.attr("file"):
                                index.settings = json.loads(resolved(path.parent, t.attr("file")))
                        elif t.name == "alias":
                            index.aliases[t.attr("name")] = t.text().strip() or None
                        else:
                            suffixes[t.name == "nameSuffix2"] = t.text().strip()
                    index.suffixes = tuple(suffixes)
                elif e.name == "globalProperties":
                    shared.update({p.name: p.text().strip() for p in e.elements()})
            for e in (x for x in part.elements() if x.name == "harvester"):
                source = SourceSpec(e.attr("id") or "", "")
                for h in kids(e, "class", "properties", "transform"):
                    if h.name == "class":
                        name = h.text().strip()
                        source.kind = next((k for end, k in KINDS if name.endswith(end)), name)
                    elif h.name == "properties":
                        source.options.update({p.name: p.text().strip() for p in h.elements()})
                    else:
                        source.transform = _expression(h, True, path.parent)
                        source.transform_params = {a.name: a.value for a in h.attrs if a.name != "src"}
                source.options = {**shared, **source.options}
                index.sources.append(source)
            indexes.append(index)
        else:
            addresses += [a.text().strip() for a in kids(part, "address", "settings") if a.name == "address"]
    return Config(spec, indexes, addresses).check()


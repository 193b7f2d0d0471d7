"""Versioned index tables on any file system that Spark can write.

An index has two physical names (suffixes) of which one is current. Each physical index is a directory of snapshots,
written whole and never changed; a small pointer names the current physical index, another its snapshot. Readers resolve
pointers once, so a run that fails leaves what they see as it was.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.merge import latest, upserted, without_unseen
from gleanery.operators.search import compile_json
from gleanery.plans.config import IndexSpec, PipelineSpec

KINDS = {"double": T.DoubleType(), "float": T.FloatType(), "integer": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "keyword": T.StringType(), "text": T.StringType(), "string": T.StringType()}
META = "source string, key string, value string"


class IndexError_(RuntimeError):
    """The index is in a state that does not allow the operation."""


class Files:
    """Small text files through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str | bytes) -> None:
        """Replace a file: write beside it, then rename over it."""
        fs, p = self._at(path)
        _, fresh = self._at(path + ".new")
        stream = fs.create(fresh, True)
        try:
            stream.write(bytearray(text.encode() if isinstance(text, str) else text))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.conf)
        rename = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        rename[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        options.rename(fresh, p, rename)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)


def merged_mapping(spec: PipelineSpec) -> dict:
    """The user's mapping with the internal fields' types forced."""
    mapping = dict(spec.mapping.get(spec.type_name, spec.mapping) if set(spec.mapping) == {spec.type_name} else spec.mapping)
    properties = dict(mapping.get("properties", {}))
    internal = {spec.source_field: {"type": "keyword"}, spec.datestamp_field: {"type": "date"}, spec.xml_field: {"type": "text", "index": False}}
    if taken := set(internal) & set(properties):
        raise IndexError_(f"the mapping may not declare {sorted(taken)}")
    mapping["properties"] = {**properties, **internal}
    return mapping


def table_schema(spec: PipelineSpec) -> T.StructType:
    """Fixed columns: an id, the internal ones, and an array for each field."""
    kinds = {"NUMBER": T.DoubleType(), "INTEGER": T.LongType(), "BOOLEAN": T.BooleanType(), "DATETIME": T.TimestampType()}
    fields = [T.StructField(f.name, T.ArrayType(kinds.get(f.datatype, T.StringType()))) for f in spec.fields]
    return T.StructType([T.StructField("id", T.StringType()), T.StructField(spec.source_field, T.StringType()), T.StructField(spec.datestamp_field, T.TimestampType()), *fields, T.StructField(spec.xml_field, T.StringType())])


class Index:
    """One index below a root directory."""

    def __init__(self, spark: SparkSession, root: str, index: IndexSpec, pipeline: PipelineSpec):
        self.spark, self.index, self.pipeline = spark, index, pipeline
        self.root = f"{root.rstrip('/')}/{index.name}"
        self.files = Files(spark)
        self.schema = table_schema(pipeline)

    # ---- names

    def current(self) -> str | None:
        """The physical index that the pointer names."""
        text = self.files.read(f"{self.root}/CURRENT")
        if text is not None and text not in map(self.index.physical, (False, True)):
            raise IndexError_(f"{self.index.name} points at {text}, which is none of its two names")
        return text

    def other(self) -> str:
        """The physical index that is not current."""
        return self.index.physical(self.current() == self.index.physical(False))

    def snapshot(self, physical: str) -> int | None:
        text = self.files.read(f"{self.root}/{physical}/SNAPSHOT")
        return None if text is None else int(text)

    def create(self, rebuild: bool = False) -> str:
        """The physical index to write to: the current one, or with rebuild the other, emptied of leftovers."""
        name = self.current()
        if rebuild:
            name = self.other()
            self.files.delete(f"{self.root}/{name}")
        elif name is None:
            name = self.index.physical(False)
            self.files.write(f"{self.root}/CURRENT", name)
            self.update_aliases()
        self.files.write(f"{self.root}/{name}/MAPPING", json.dumps(merged_mapping(self.pipeline)))
        return name

    # ---- reading

    def read(self, physical: str | None = None) -> DataFrame:
        name = physical or self.current()
        k = self.snapshot(name) if name else None
        if k is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}/{k}").select(*self.schema.fieldNames())

    def source_view(self) -> DataFrame:
        """The stored document without columns that the mapping excludes from it."""
        excluded = self.pipeline.mapping.get("_source", {}).get("excludes", [])
        gone = [c for c in self.schema.fieldNames() if any(c == e or e.startswith("*") and c.endswith(e[1:]) for e in excluded)]
        return self.read().drop(*gone)

    def alias(self, name: str) -> DataFrame:
        aliases = json.loads(self.files.read(f"{self.root}/ALIASES") or "{}")
        if name not in aliases:
            raise IndexError_(f"no alias {name}")
        table = self.read()
        return table.where(compile_json(aliases[name], table.schema)) if aliases[name] else table

    def update_aliases(self) -> None:
        """Make the aliases what the configuration says: others go."""
        self.files.write(f"{self.root}/ALIASES", json.dumps({n: json.loads(t) if t else None for n, t in self.index.aliases.items()}))

    def views(self, prefix: str = "") -> None:
        """Temporary views of the index and its aliases."""
        self.read().createOrReplaceTempView(f"{prefix}{self.index.name}".replace("-", "_"))
        for name in json.loads(self.files.read(f"{self.root}/ALIASES") or "{}"):
            self.alias(name).createOrReplaceTempView(f"{prefix}{name}".replace("-", "_"))

    # ---- writing

    def write(self, table: DataFrame, physical: str) -> None:
        """Write a snapshot, then point at it; the one before the last goes."""
        k = (self.snapshot(physical) or 0) + 1
        place = f"{self.root}/{physical}"
        self.files.delete(f"{place}/{k}")
        table.select(*self.schema.fieldNames()).write.partitionBy(self.pipeline.source_field).parquet(f"{place}/{k}")
        self.files.write(f"{place}/SNAPSHOT", str(k))
        self.files.delete(f"{place}/{k - 2}")

    def apply(self, changes: DataFrame, physical: str | None = None, seen: DataFrame | None = None, source: str | None = None) -> None:
        """Upsert and delete; with seen, rows of the source that were not seen go too. The last change of an id wins."""
        name = physical or self.create()
        table = upserted(self.read(name), latest(changes, "id", F.desc("seq")), "id")
        if seen is not None:
            table = without_unseen(table, seen, source, "id", self.pipeline.source_field)
        self.write(table, name)

    def swap(self, physical: str) -> None:
        """Make a rebuilt physical index current, then drop the orphan."""
        old = self.current()
        self.files.write(f"{self.root}/CURRENT", physical)
        self.update_aliases()
        if old is not None and old != physical:
            self.files.delete(f"{self.root}/{old}")

    # ---- control table

    def metadata(self, source: str) -> dict[str, str]:
        return json.loads(self.files.read(f"{self.root}/META/{source}") or "{}")

    def save_metadata(self, source: str, values: Mapping[str, str]) -> None:
        """Set keys; others stay."""
        self.files.write(f"{self.root}/META/{source}", json.dumps({**self.metadata(source), **values}))

    def metadata_table(self, sources: list[str]) -> DataFrame:
        rows = [(s, k, v) for s in sources for k, v in self.metadata(s).items()]
        return self.spark.createDataFrame(rows, META)

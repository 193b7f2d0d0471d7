"""OAI-PMH: selective harvesting of repositories, and static repository files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from gleanery.functions.scalars import oai_date
from gleanery.functions.xmltree import ELEM, Node, parse, serialize
from gleanery.operators.verdict import in_sets
from gleanery.plans.config import SourceSpec
from gleanery.sources.base import Scan, raw
from gleanery.sources.http import Policy, Response, fetch

OAI = "http://www.openarchives.org/OAI/2.0/"
STATIC = "http://www.openarchives.org/OAI/2.0/static-repository"
#: Fixed values of the protocol: granularities that a repository may name.
DAY, SECOND = "YYYY-MM-DD", "YYYY-MM-DDThh:mm:ssZ"
RECORD = "identifier string, status string, date string, sets array<string>, xml string, seq long"


class OaiError(RuntimeError):
    """The repository reports an error."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _kids(node: Node, name: str) -> list[Node]:
    return [c for c in node.children if c.kind == ELEM and c.name == name and c.uri in (OAI, STATIC)]


def _one(node: Node, name: str) -> Node | None:
    return next(iter(_kids(node, name)), None)


def record(node: Node) -> dict:
    """Header fields and payload of a record; <about> is left out."""
    header, payload = _one(node, "header"), _one(node, "metadata")
    text = lambda name: (lambda n: n.text().strip() if n is not None else None)(_one(header, name))
    body = payload.elements()[0] if payload is not None and payload.elements() else None
    sets = list(dict.fromkeys(s.text().strip() for s in _kids(header, "setSpec")))
    return {"identifier": text("identifier"), "status": header.attr("status"), "date": text("datestamp"), "sets": sets, "xml": serialize(body) if body is not None else None}


def page(text: str | bytes) -> tuple[list[dict], str | None, str | None]:
    """(records, resumption token, response date) of a ListRecords response; noRecordsMatch means none."""
    root = parse(text).elements()[0]
    if root.uri != OAI:
        raise OaiError("badResponse", f"no OAI response: {root.qname}")
    for e in _kids(root, "error"):
        if e.attr("code") != "noRecordsMatch":
            raise OaiError(e.attr("code") or "", e.text().strip())
    date = _one(root, "responseDate")
    listing = _one(root, "ListRecords")
    token = _one(listing, "resumptionToken") if listing is not None else None
    records = [record(r) for r in _kids(listing, "record")] if listing is not None else []
    return records, (token.text().strip() or None) if token is not None else None, date.text().strip() if date is not None else None


def granularity(text: str | bytes) -> str:
    root = parse(text).elements()[0]
    identify = _one(root, "Identify")
    value = _one(identify, "granularity").text().strip() if identify is not None and _one(identify, "granularity") is not None else ""
    if value not in (DAY, SECOND):
        raise OaiError("badGranularity", value)
    return value


def query_url(base: str, **params: str) -> str:
    return base + ("&" if "?" in base else "?") + urlencode(params)


def pages(base: str, prefix: str, sets: list[str], since: datetime | None, get: Callable[[str], Response]) -> Iterator[tuple[list[dict], str | None]]:
    """(records, response date) page by page; `since` in the repository's granularity, one set is asked for."""
    params = {"verb": "ListRecords", "metadataPrefix": prefix}
    if len(sets) == 1:
        params["set"] = sets[0]
    if since is not None:
        fine = granularity(_body(get(query_url(base, verb="Identify")))) == SECOND
        params["from"] = since.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ" if fine else "%Y-%m-%d")
    url = query_url(base, **params)
    while url:
        records, token, date = page(_body(get(url)))
        yield records, date
        url = query_url(base, verb="ListRecords", resumptionToken=token) if token else None


def _body(r: Response) -> bytes:
    if r.status != 200:
        raise OSError(f"{r.url}: status {r.status}")
    return r.body


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # pages come one after the other

    def read(self, _) -> Iterator[pa.RecordBatch]:
        o = self.o
        since = datetime.fromisoformat(o["since"]) if o.get("since") else None
        sets = [s for s in o.get("sets", "").split(" ") if s]
        policy, seq = _policy(o), 0
        for records, date in pages(o["baseurl"], o["metadataprefix"], sets, since, lambda url: fetch(url, policy)):
            rows = records or [{"identifier": None, "status": None, "date": None, "sets": [], "xml": None}]
            yield pa.RecordBatch.from_pylist([{**r, "seq": seq + k, "response_date": date} for k, r in enumerate(rows)], SCHEMA)
            seq += len(rows)


def _policy(o: dict[str, str]) -> Policy:
    return Policy(int(o.get("retrycount", 5)), float(o.get("retryafterseconds", 60)), float(o.get("timeoutafterseconds", 180)), o.get("authorizationheader"))


class StreamReader(SimpleDataSourceStreamReader):
    """A page a batch; the offset is the resumption token, so a harvest goes on where it stopped while the token lives."""

    def __init__(self, options: dict[str, str], get: Callable[[str], Response] | None = None):
        self.o = options
        policy = _policy(options)
        self.get = get or (lambda url: fetch(url, policy))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"token": "", "seq": 0, "done": 0}

    def _page(self, start: dict) -> tuple[list[tuple], dict]:
        o, sets = self.o, [s for s in self.o.get("sets", "").split(" ") if s]
        if start["done"]:
            return [], start
        if start["token"]:
            url = query_url(o["baseurl"], verb="ListRecords", resumptionToken=start["token"])
        else:
            url = query_url(o["baseurl"], verb="ListRecords", metadataPrefix=o["metadataprefix"], **({"set": sets[0]} if len(sets) == 1 else {}))
        records, token, date = page(_body(self.get(url)))
        rows = [(r["identifier"], r["status"], r["date"], r["sets"], r["xml"], start["seq"] + k, date) for k, r in enumerate(records)]
        return rows, {"token": token or "", "seq": start["seq"] + len(rows), "done": int(token is None)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._page(start)[0])

    def commit(self, end: dict) -> None:
        pass


SCHEMA = pa.schema([("identifier", pa.string()), ("status", pa.string()), ("date", pa.string()), ("sets", pa.list_(pa.string())), ("xml", pa.string()), ("seq", pa.int64()), ("response_date", pa.string())])


class OaiDataSource(DataSource):
    """spark.read.format("oai"), or readStream: options baseUrl, metadataPrefix, sets, since (ISO) and those of retries."""

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return RECORD + ", response_date string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return StreamReader({k.lower(): v for k, v in self.options.items()})


def documents(records: DataFrame, source: SourceSpec) -> DataFrame:
    """Raw documents of records: ids prefixed, dates strict (unless ignoreDatestamps, or deleted), set membership."""
    sets = set_names(source.options.get("setSpec"))
    ignore = source.flag("ignoreDatestamps", False)
    gone = F.coalesce(F.col("status") == "deleted", F.lit(False))
    date = oai_date("date")
    strict = F.when(date.isNull() & ~gone & F.col("date").isNotNull(), F.raise_error(F.concat(F.lit("bad datestamp: "), F.col("date"))).cast("timestamp")).otherwise(date)
    rows = records.where(F.col("identifier").isNotNull()).select(
        F.concat(F.lit(source.options.get("identifierPrefix", "")), "identifier").alias("identifier"),
        (F.lit(None).cast("timestamp") if ignore else strict).alias("datestamp"),
        (gone | ~in_sets("sets", sets if len(sets) > 1 or source.kind == "oai_static" else [])).alias("deleted"),
        "xml",
        "seq",
    )
    return raw(rows, source.id)


def set_names(text: str | None) -> list[str]:
    import re

    return list(dict.fromkeys(s for s in re.split(r"[,;\s]+", text or "") if s))


def oai_source(spark: SparkSession, source: SourceSpec, watermark: datetime | None) -> Scan:
    """A repository. With a watermark only changes are asked for; otherwise all, and unseen documents may go."""
    o = source.options
    since = None if source.flag("ignoreDatestamps", False) else watermark
    spark.dataSource.register(OaiDataSource)
    reader = spark.read.format("oai").option("baseUrl", o["baseUrl"]).option("metadataPrefix", o["metadataPrefix"]).option("sets", " ".join(set_names(o.get("setSpec"))))
    for name in ("retryCount", "retryAfterSeconds", "timeoutAfterSeconds", "authorizationHeader"):
        if name in o:
            reader = reader.option(name, o[name])
    if since is not None:
        reader = reader.option("since", since.isoformat())
    records = reader.load().persist()  # a repository is asked once a run
    first = lambda: records.agg(F.min("response_date").alias("d")).select(oai_date("d")).first()[0]
    return Scan(documents(records, source), incremental=False, complete=since is None, only_live=True, watermark=first)


def static_records(xml: str | bytes, prefix: str) -> list[dict]:
    """Records of a static repository in one metadata format."""
    root = parse(xml).elements()[0]
    if root.uri != STATIC or root.name != "Repository":
        raise OaiError("badResponse", "no static repository")
    out = []
    for listing in _kids(root, "ListRecords"):
        have = listing.attr("metadataPrefix")
        if not have:
            raise OaiError("badResponse", "ListRecords without metadataPrefix")
        if have == prefix:
            out += [record(r) for r in _kids(listing, "record")]
    return out


def static_source(spark: SparkSession, source: SourceSpec, watermark: datetime | None, get: Callable[..., Response] = fetch) -> Scan:
    """A static repository file, by URL or path; unchanged since the watermark it gives nothing and deletes nothing."""
    url, prefix = source.options["url"], source.options["metadataPrefix"]
    if url.startswith(("http://", "https://")):
        r = get(url, Policy.of(source), watermark)
        if r.status == 304:
            return Scan(raw(spark.createDataFrame([], RECORD), source.id), complete=False)
        changed, body = r.modified(), spark.createDataFrame([(bytearray(_body(r)),)], "content binary")
    else:
        body = spark.read.format("binaryFile").load(url)
        changed = body.agg(F.max("modificationTime")).first()[0]
        if watermark is not None and changed.replace(tzinfo=changed.tzinfo or timezone.utc) <= watermark:
            return Scan(raw(spark.createDataFrame([], RECORD), source.id), complete=False)

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield pa.RecordBatch.from_pylist([{**r, "seq": k, "response_date": None} for k, r in enumerate(static_records(content, prefix))], SCHEMA)

    records = body.select("content").mapInArrow(run, RECORD + ", response_date string")
    return Scan(documents(records, source), incremental=False, only_live=True, watermark=changed)

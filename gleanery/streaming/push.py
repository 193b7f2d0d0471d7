"""Pushed changes: a small HTTP front writes events to a landing directory, a streaming query applies them to the index."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.evaluate import evaluated, index_columns
from gleanery.operators.verdict import outdated
from gleanery.plans.config import Config
from gleanery.plans.index import Index
from gleanery.plans.run import LAST, stored_time, time_text

EVENT = "source string, op string, identifier string, last_modified timestamp, xml string, seq long"
#: A session without requests for so long ends and commits.
IDLE_SECONDS = 60


def events(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """The landing directory as a stream of events."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(landing)


def applied(batch: DataFrame, config: Config, indexes: dict[str, Index]) -> None:
    """Apply a batch of events: late ones (not after the watermark) are dropped, nothing unseen is deleted, errors stop.

    Applying a batch twice gives the same index."""
    batch = batch.persist()
    try:
        for spec in config.indexes:
            for source in spec.sources:
                own = batch.where(F.col("source") == source.id)
                if own.isEmpty():
                    continue
                index = indexes[spec.name]
                old = stored_time(index.metadata(source.id).get(LAST))
                fresh = own.where((F.col("op") == "delete") | outdated(F.lit(old).cast("timestamp"), "last_modified"))
                docs = fresh.select("identifier", F.col("last_modified").alias("datestamp"), (F.col("op") == "delete").alias("deleted"), "xml", "source", "seq")
                changes = evaluated(docs, config.pipeline, source.id, source.options.get("conversionErrorAction", "STOP").upper())
                index.apply(changes.select("op", "seq", *index_columns(config.pipeline)), index.create())
                latest = fresh.where("op = 'index'").agg(F.max("last_modified")).first()[0]
                if latest is not None:
                    latest = latest.replace(tzinfo=latest.tzinfo or timezone.utc)
                    before = stored_time(index.metadata(source.id).get("pushedUntil"))
                    index.save_metadata(source.id, {"pushedUntil": time_text(max(latest, before) if before else latest)})
    finally:
        batch.unpersist()


def committed(config: Config, indexes: dict[str, Index]) -> None:
    """End of a session: what was pushed sets the watermark."""
    for spec in config.indexes:
        for source in spec.sources:
            meta = indexes[spec.name].metadata(source.id)
            pushed, old = stored_time(meta.get("pushedUntil")), stored_time(meta.get(LAST))
            if pushed is not None and (old is None or pushed > old):
                indexes[spec.name].save_metadata(source.id, {LAST: time_text(pushed)})


def stream(spark: SparkSession, config: Config, root: str, landing: str, checkpoint: str, continuous: bool = False, seconds: int = 5) -> StreamingQuery:
    """The query that applies pushed events: all there are, or on and on."""
    indexes = {i.name: Index(spark, root, i, config.pipeline) for i in config.indexes}
    writer = events(spark, landing).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: applied(batch, config, indexes))
    return writer.trigger(processingTime=f"{seconds} seconds").start() if continuous else writer.trigger(availableNow=True).start()


def sessions(events_: DataFrame, time: str = "ts", by: str = "user_id", gap: str = f"{IDLE_SECONDS} seconds") -> DataFrame:
    """Sessions of events, by key, that end after a gap."""
    own = F.session_window(F.col(time).cast("timestamp"), gap).alias("w")
    return events_.groupBy(by, own).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("started"), "n")


class Front:
    """PUT and DELETE /{source}/{id...} and POST /{source}/_commit.

    202 accepted, 204 committed, 400 bad Last-Modified, 404 unknown source, 405 other methods, 500 other errors."""

    def __init__(self, sources: set[str], landing: str, commit: Callable[[str], None] = lambda source: None, host: str = "127.0.0.1", port: int = 8089, root_path: str = "/"):
        self.sources, self.landing, self.commit = sources, Path(landing), commit
        self.root_path = "/" + root_path.strip("/") + ("/" if root_path.strip("/") else "")
        self.landing.mkdir(parents=True, exist_ok=True)
        self.lock, self.seq = threading.Lock(), int(datetime.now(timezone.utc).timestamp() * 1e6)
        front = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, method: str) -> None:
                length = int(self.headers.get("Content-Length") or 0)
                body = self.rfile.read(length) if length else b""
                try:
                    status = front.handle(method, self.path, dict(self.headers.items()), body)
                except Exception:  # noqa: BLE001  the client gets to know
                    status = 500
                self.send_response(status)
                self.send_header("Content-Length", "0")
                self.end_headers()

            def do_PUT(self):  # noqa: N802
                self.answer("PUT")

            def do_DELETE(self):  # noqa: N802
                self.answer("DELETE")

            def do_POST(self):  # noqa: N802
                self.answer("POST")

            def do_GET(self):  # noqa: N802
                self.answer("GET")

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)

    def handle(self, method: str, path: str, headers: dict[str, str], body: bytes) -> int:
        path = path.split("?")[0]
        if not path.startswith(self.root_path):
            return 404
        source, _, identifier = path[len(self.root_path) :].partition("/")
        source, identifier = unquote(source), unquote(identifier)
        if source not in self.sources or not identifier:
            return 404
        headers = {k.lower(): v for k, v in headers.items()}
        if method == "POST" and identifier == "_commit":
            self.commit(source)
            return 204
        if method not in ("PUT", "DELETE"):
            return 405
        event = {"source": source, "op": "index" if method == "PUT" else "delete", "identifier": identifier}
        if method == "PUT":
            if "last-modified" in headers:
                try:
                    event["last_modified"] = time_text(parsedate_to_datetime(headers["last-modified"]))
                except (ValueError, TypeError):
                    return 400
            charset = headers.get("content-type", "").lower().partition("charset=")[2].split(";")[0].strip().strip('"')
            event["xml"] = body.decode(charset or "utf-8")
        with self.lock:
            self.seq += 1
            event["seq"] = self.seq
        fresh = self.landing / f".{uuid.uuid4().hex}"
        fresh.write_text(json.dumps(event))
        os.replace(fresh, self.landing / f"{event['seq']}.json")  # the stream sees whole files only
        return 202

    def start(self) -> "Front":
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()

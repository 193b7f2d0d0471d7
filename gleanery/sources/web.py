"""Crawling: a frontier of URLs below a base, fetched level by level on executors."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.scalars import base_directory, mime, no_fragment
from gleanery.operators.verdict import crawlable, named_like
from gleanery.plans.config import SourceSpec
from gleanery.sources.base import Scan, newest, raw
from gleanery.sources.http import Policy, Response, fetch

HTML = ("text/html", "application/xhtml+xml")
XML = ("text/xml", "application/xml")
PAGE = "url string, final_url string, status int, content_type string, last_modified timestamp, body string"


class _Links(HTMLParser):
    """Links of a page: A and AREA href and IFRAME src in BODY, FRAME src in FRAMESET, BASE href in HEAD."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.found, self.inside, self.bad = base, [], set(), False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("head", "body", "frameset"):
            self.inside.add(tag)
            if tag != "head":
                self.inside.discard("head")
            return
        get = dict(attrs).get
        if tag == "base" and "head" in self.inside and get("href"):
            try:
                self.base = urljoin(self.base, get("href").strip())
                self.bad = not urlsplit(self.base).scheme
            except ValueError:
                self.bad = True
        elif "body" in self.inside and tag in ("a", "area"):
            self.link(get("href"))
        elif "body" in self.inside and tag == "iframe" or "frameset" in self.inside and tag == "frame":
            self.link(get("src"))

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.inside.discard(tag)

    def link(self, ref: str | None) -> None:
        if ref is None or self.bad:
            return
        try:
            url = urljoin(self.base, ref.strip())
            if urlsplit(url).scheme in ("http", "https"):
                self.found.append(url)
        except ValueError:
            pass  # a bad reference is not followed


def links(base: str, html: str | None) -> list[str]:
    """Absolute links of a page, in order, with fragments."""
    parser = _Links(base)
    parser.feed(html or "")
    return parser.found


def page_links(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, link), after the columns to keep, for each link of each page."""

    @F.pandas_udf("array<string>")
    def run(base: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([links(b, t) for b, t in zip(base, text, strict=True)])

    return pages.select(*keep, F.col(url).alias("url"), F.explode(run(F.col(url), F.col(html))).alias("link"))


def frontier(found: DataFrame, visited: DataFrame, base: str, exclude: str | None = None) -> DataFrame:
    """Distinct URLs (without fragments) of found.link that may be crawled and were not visited."""
    urls = found.select(no_fragment("link").alias("url")).where(crawlable("url", base, exclude)).distinct()
    return urls.join(visited.select("url"), "url", "left_anti")


def fetched(urls: DataFrame, policy: Policy, pause: float = 0, get: Callable[..., Response] = fetch) -> DataFrame:
    """(PAGE) for URLs; a page is fetched once an attempt of its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["url"]:
                r = get(url, policy)
                time.sleep(pause)
                kind = r.header("Content-Type")
                yield pd.DataFrame({"url": [url], "final_url": [r.url], "status": pd.Series([r.status], dtype="int32"), "content_type": [kind], "last_modified": [pd.Timestamp(r.modified()) if r.modified() else None], "body": [r.text() if r.status == 200 else None]})

    return urls.mapInPandas(run, PAGE)


def crawl(spark: SparkSession, start: str, fetch_pages: Callable[[DataFrame], DataFrame], content_types: tuple[str, ...] = XML, filename: str | None = None, exclude: str | None = None, store: Callable[[DataFrame, str], DataFrame] | None = None, levels: int = 10_000) -> DataFrame:
    """Documents (identifier, datestamp, xml) at and below a start URL.

    Each level's new URLs are fetched together and written once (store; a checkpoint by default). After the first answer,
    the base is the directory of the URL that answered. 404 and 410 are passed over, other failures stop the run."""
    keep = store or (lambda df, name: df.checkpoint(eager=True))
    visited, todo, out, base = None, spark.createDataFrame([(start.split("#")[0],)], "url string"), None, None
    for level in range(levels):
        got = keep(fetch_pages(todo), f"crawl-{level}")
        bad = got.where(~F.col("status").isin(200, 404, 410)).select("url", "status").first()
        if bad:
            raise OSError(f"{bad['url']}: status {bad['status']}")
        got = got.where("status = 200")
        if base is None:
            first = got.select(base_directory("final_url").alias("b")).first()
            if first is None:
                raise OSError(f"{start} can't be fetched")
            base = first["b"]
        got = got.where(F.col("final_url").startswith(base)).dropDuplicates(["final_url"])
        kind = mime("content_type")
        found = got.where(kind.isin(*content_types) & named_like(no_fragment("final_url"), filename)).select(F.col("final_url").alias("identifier"), F.col("last_modified").alias("datestamp"), F.col("body").alias("xml"))
        out = found if out is None else out.union(found)
        seen = todo.union(got.select(F.col("final_url").alias("url"))).distinct()
        visited = seen if visited is None else keep(visited.union(seen).distinct(), f"visited-{level}")
        todo = keep(frontier(page_links(got.where(kind.isin(*HTML)), "final_url", "body"), visited, base, exclude), f"todo-{level}")
        if todo.isEmpty():
            return out.dropDuplicates(["identifier"])
    raise RuntimeError(f"the crawl did not end in {levels} levels")


def crawl_source(spark: SparkSession, source: SourceSpec, watermark: datetime | None) -> Scan:
    o = source.options
    types = tuple(t for t in re.split(r"[,;\s]+", o.get("contentTypes", "").lower()) if t) or XML
    policy, pause = Policy.of(source), float(o.get("pauseBetweenRequests", 0)) / 1000
    found = crawl(spark, o["baseUrl"], lambda urls: fetched(urls, policy, pause), types, o.get("filenameFilter"), o.get("excludeUrlPattern"))
    return Scan(raw(found, source.id), watermark=newest(found))

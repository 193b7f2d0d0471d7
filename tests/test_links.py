"""The link queries on whole pages, against brute force; on the supplied pages every link is root-relative."""

import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from gleanery.queries import QUERIES


def brute(pages):
    return sorted((p["page_id"], urljoin(p["url"], href)) for p in pages for href in re.findall(r'<a href="([^"]*)"', p["html"]))


def open_urls(links, pages):
    visited = {p["url"].split("#")[0] for p in pages}
    return sorted({link.split("#")[0] for _, link in links if "?" not in link.split("#")[0]} - visited)


def test_supplied_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = brute(pages)
    assert want and sorted((r["page_id"], r["link"]) for r in QUERIES["html_links"](spark, sf_dir).collect()) == want
    assert sorted(r["url"] for r in QUERIES["crawl_frontier"](spark, sf_dir).collect()) == open_urls(want, pages)


def test_forms_of_links(spark, tmp_path):
    frames = '<html><head><base href="/b/"></head><frameset><frame src="f"></frameset></html>'
    body = '<body><a href="/x">x</a><A class=c HREF=\'y#f\'>y</A><map><area href="../z"></map><iframe src="http://o/i?q"></iframe><a href="mailto:m@o">m</a><a href="p#g">self</a></body>'
    rows = [(1, "http://h/d/p#top", body), (2, "https://h/f/", frames), (3, "http://h/d/p", body), (4, "http://h/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"], r["link"]) for r in QUERIES["html_links"](spark, str(tmp_path)).select(F.col("page_id"), "link").collect())
    every = ["http://h/d/p#g", "http://h/d/y#f", "http://h/x", "http://h/z", "http://o/i?q"]
    assert got == [*((1, x) for x in every), (2, "https://h/b/f"), *((3, x) for x in every)]
    assert sorted(r["url"] for r in QUERIES["crawl_frontier"](spark, str(tmp_path)).collect()) == ["http://h/d/y", "http://h/x", "http://h/z", "https://h/b/f"]

"""One query for each operator over the supplied tables, with SQL that gives the same rows."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import threading
import uuid
import zipfile
import zlib
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import dates, scalars
from gleanery.functions.xmljson import to_json
from gleanery.functions.xmltree import parse
from gleanery.operators import merge, search, verdict
from gleanery.operators.evaluate import evaluated, rendered, transformed, validated
from gleanery.plans.config import Config, Expression, FieldSpec, IndexSpec, PipelineSpec, SourceSpec
from gleanery.plans.index import Files, Index
from gleanery.plans.run import harvest, harvest_source, rebuild, stored_documents
from gleanery.sources.base import Scan, newest, open_source, raw
from gleanery.sources.tables import legacy_documents, table_documents
from gleanery.sources.web import frontier, page_links
from gleanery.streaming.push import sessions, stream

NS = "urn:example:order"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def x(text: str, **ns: str) -> Expression:
    return Expression(text, False, tuple(sorted({"o": NS, **ns}.items())))


def order_xml(orders: DataFrame) -> DataFrame:
    """Orders as namespaced XML documents; the narrow rows are spread before they become documents."""
    orders = orders.repartition(orders.sparkSession.sparkContext.defaultParallelism)
    xml = F.concat(
        F.lit(f'<p:order xmlns:p="{NS}" status="'), "o_orderstatus", F.lit('"><p:key>'), F.col("o_orderkey").cast("string"), F.lit("</p:key><p:cust> "), F.col("o_custkey").cast("string"),
        F.lit(" </p:cust><p:price>"), F.col("o_totalprice").cast("string"), F.lit("</p:price><p:date>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</p:date><p:prio>"), "o_orderpriority", F.lit("</p:prio></p:order>"),
    )
    ids = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    return raw(orders.select(ids.alias("identifier"), F.col("o_orderdate").cast("timestamp").alias("datestamp"), xml.alias("xml"), F.col("o_orderkey").alias("seq")), "orders")


ORDER_FIELDS = [
    FieldSpec("key", x("/o:order/o:key"), "INTEGER"),
    FieldSpec("cust", x("/o:order/o:cust"), "INTEGER"),
    FieldSpec("price", x("/o:order/o:price"), "NUMBER"),
    FieldSpec("day", x("$day"), "DATETIME"),
    FieldSpec("prio", x("/o:order/o:prio"), "STRING"),
]
ORDERS = PipelineSpec(ORDER_FIELDS, variables=[("day", x("/o:order/o:date"))], filters=[(False, x("/o:order/@status = 'F'")), (True, x("starts-with(/o:order/o:prio, '1')"))])


def order_changes(spark: SparkSession, sf_dir: str, policy: str = "STOP", spec: PipelineSpec = ORDERS) -> DataFrame:
    return evaluated(order_xml(table(spark, sf_dir, "orders")), spec, "orders", policy)


_ORDERS_SQL = """
SELECT 'order:' || o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' OR o_orderpriority LIKE '1%' THEN 'index' ELSE 'delete' END AS op,
  CASE WHEN o_orderstatus <> 'F' OR o_orderpriority LIKE '1%' THEN o_orderkey END AS "key",
  CASE WHEN o_orderstatus <> 'F' OR o_orderpriority LIKE '1%' THEN o_custkey END AS cust,
  CASE WHEN o_orderstatus <> 'F' OR o_orderpriority LIKE '1%' THEN o_totalprice END AS price,
  CASE WHEN o_orderstatus <> 'F' OR o_orderpriority LIKE '1%' THEN strftime(o_orderdate, '%Y-%m-%d') END AS "day",
  CASE WHEN o_orderstatus <> 'F' OR o_orderpriority LIKE '1%' THEN o_orderpriority END AS prio
FROM orders"""


@query(_ORDERS_SQL)
def harvest_orders(spark, sf_dir):
    """Flagship: parse, variables, filters and typed fields of namespaced XML, as a change feed."""
    c = order_changes(spark, sf_dir)
    first = lambda n: F.get(n, F.lit(0))
    return c.select("id", "op", first("key").alias("key"), first("cust").alias("cust"), first("price").alias("price"), F.date_format(first("day"), "yyyy-MM-dd").alias("day"), first("prio").alias("prio"))


@query("SELECT o_orderkey AS k, o_orderpriority AS prio, o_totalprice AS price FROM orders")
def xml_project_roundtrip(spark, sf_dir):
    """Fields of plain XML by built-in XPath functions."""
    xml = F.concat(F.lit("<o><k>"), F.col("o_orderkey").cast("string"), F.lit("</k><p>"), "o_orderpriority", F.lit("</p><t>"), F.col("o_totalprice").cast("string"), F.lit("</t></o>"))
    d = table(spark, sf_dir, "orders").select(xml.alias("x"))
    return d.select(F.expr("xpath_long(x, '/o/k')").alias("k"), F.expr("xpath_string(x, '/o/p')").alias("prio"), F.expr("try_cast(xpath_string(x, '/o/t') AS double)").alias("price"))


@query("SELECT l_orderkey AS k, CAST(l_partkey AS VARCHAR) AS item FROM lineitem")
def xml_multi_value(spark, sf_dir):
    """A node-set with many nodes gives many values, in document order."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<i>"), F.col("l_partkey").cast("string"), F.lit("</i>")))), "").alias("i"))
    docs = items.select(F.col("l_orderkey").cast("string").alias("identifier"), F.concat(F.lit("<o>"), "i", F.lit("</o>")).alias("xml"))
    spec = PipelineSpec([FieldSpec("item", Expression("/o/i"))])
    return evaluated(raw(docs), spec, "s").select(F.col("id").cast("bigint").alias("k"), F.explode("item").alias("item"))


@query("SELECT o_orderkey AS id, o_totalprice AS price, CAST(o_custkey AS BIGINT) AS cust FROM orders")
def typed_fields(spark, sf_dir):
    """Number and integer fields."""
    c = order_changes(spark, sf_dir, spec=PipelineSpec(ORDER_FIELDS, variables=ORDERS.variables))
    return c.select(F.substring_index("id", ":", -1).cast("bigint").alias("id"), F.get("price", F.lit(0)).alias("price"), F.get("cust", F.lit(0)).alias("cust"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN -1.5 ELSE o_totalprice END AS price, strftime(CASE WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '1900-01-01' ELSE o_orderdate END, '%Y-%m-%d') AS d FROM orders")
def field_default(spark, sf_dir):
    """Defaults where no value is left."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    xml = F.concat(F.lit("<o><p>"), F.when(k % 3 == 0, F.lit(" ")).otherwise(F.col("o_totalprice").cast("string")), F.lit("</p>"), F.when(k % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("<d>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</d>"))), F.lit("</o>"))
    spec = PipelineSpec([FieldSpec("price", Expression("/o/p"), "NUMBER", "-1.5"), FieldSpec("d", Expression("/o/d"), "DATETIME", "1900-01-01T00:00:00")])
    c = evaluated(raw(o.select(k.cast("string").alias("identifier"), xml.alias("xml"))), spec, "s")
    return c.select(F.col("id").cast("bigint").alias("k"), F.get("price", F.lit(0)).alias("price"), F.date_format(F.get("d", F.lit(0)), "yyyy-MM-dd").alias("d"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || chr(10) || c_mktsegment AS t FROM customer")
def node_text_walk(spark, sf_dir):
    """Text of nested elements has a line feed after every child."""
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").cast("string").alias("identifier"), F.concat(F.lit("<a>"), "c_name", F.lit("<b>"), "c_mktsegment", F.lit("</b></a>")).alias("xml"))
    return evaluated(raw(docs), PipelineSpec([FieldSpec("t", Expression("/*"))]), "s").select("id", F.get("t", F.lit(0)).alias("t"))


@query("SELECT o_orderkey AS k, CASE WHEN o_totalprice > 300000 THEN true WHEN o_orderstatus = 'F' THEN false ELSE true END AS accepted FROM orders")
def filter_accept_deny(spark, sf_dir):
    """The last filter that matches decides."""
    chain = [(False, F.col("o_orderstatus") == "F"), (True, F.col("o_totalprice") > 300000)]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), verdict.accepted(chain).alias("accepted"))


@query("SELECT CASE WHEN o_orderstatus <> 'F' OR o_orderpriority LIKE '1%' THEN 'index' ELSE 'delete' END AS op, count(*) AS n FROM orders GROUP BY 1")
def filter_to_delete_ops(spark, sf_dir):
    """A rejected document becomes a delete."""
    return merge.counters(order_changes(spark, sf_dir))


@query("SELECT event_id FROM events WHERE ts > (SELECT min(ts) + INTERVAL 2 DAY FROM events) OR event_id % 7 = 0")
def freshness_filter(spark, sf_dir):
    """Undated documents and those after the watermark."""
    e = table(spark, sf_dir, "events")
    wm = e.agg((F.min("ts") + F.expr("INTERVAL 2 DAY")).alias("wm")).first()["wm"]
    dated = e.withColumn("d", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    return dated.where(verdict.outdated(F.lit(wm), "d")).select("event_id")


@query("SELECT event_type, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS watermark FROM events GROUP BY 1")
def watermark_max(spark, sf_dir):
    """The new watermark of each source."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("w")).select("event_type", scalars.index_text("w").alias("watermark"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_wins(spark, sf_dir):
    """The last change of an id, summed up before the shuffle."""
    return merge.latest_by_max(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_ranked(spark, sf_dir):
    """The last change of an id by a compound order."""
    return merge.latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_name END AS name FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 5 = 0
UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 11 = 0""")
def upsert_merge(spark, sf_dir):
    """Upserts and deletes by id."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    up = c.where("id % 5 = 0").select("id", F.lit("changed").alias("name"), F.lit("index").alias("op"))
    gone = c.where("id % 7 = 0 AND id % 5 <> 0").select("id", "name", F.lit("delete").alias("op"))
    new = c.where("id % 11 = 0").select((F.col("id") + 1000000).alias("id"), F.lit("new").alias("name"), F.lit("index").alias("op"))
    return merge.upserted(c, up.union(gone).union(new))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def delete_unseen(spark, sf_dir):
    """Documents that a run has not seen."""
    return merge.unseen(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE source <> 'src0' OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def delete_unseen_scoped(spark, sf_dir):
    """Unseen documents of one source go; others stay."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return merge.without_unseen(d, table(spark, sf_dir, "labels"), "src0", "doc_id")


@query("SELECT DISTINCT source AS id FROM documents WHERE source IS NOT NULL")
def seen_distinct(spark, sf_dir):
    return merge.seen_ids(table(spark, sf_dir, "documents"), "source")


@query("SELECT o_orderkey AS k, o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus IN ('1-URGENT', '2-HIGH') AS member FROM orders")
def oai_set_overlap(spark, sf_dir):
    """Set membership of records."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), verdict.in_sets(F.array("o_orderpriority", "o_orderstatus"), ["1-URGENT", "2-HIGH"]).alias("member"))


@query("SELECT 'c:' || c_custkey AS identifier, 'customers' AS source FROM customer UNION ALL SELECT 's:' || s_suppkey, 'suppliers' FROM supplier")
def source_union(spark, sf_dir):
    """Several sources feed one index, with prefixed ids."""
    a = raw(table(spark, sf_dir, "customer").select(scalars.prefixed("c:", "c_custkey").alias("identifier")), "customers")
    b = raw(table(spark, sf_dir, "supplier").select(scalars.prefixed("s:", "s_suppkey").alias("identifier")), "suppliers")
    return a.unionByName(b).select("identifier", "source")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5))")
def alias_terms(spark, sf_dir):
    """A filtered alias by terms."""
    n = table(spark, sf_dir, "nation")
    names = [r[0] for r in n.where("n_nationkey IN (1, 3, 5)").select("n_name").collect()]
    return search.query(n, {"terms": {"n_name": names}}).select("n_nationkey", "n_name")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND NOT (user_id IN (1, 2, 3))")
def bool_filter_mustnot(spark, sf_dir):
    q = {"bool": {"filter": {"term": {"event_type": "click"}}, "must_not": {"terms": {"user_id": [1, 2, 3]}}}}
    return search.query(table(spark, sf_dir, "events"), q).select("event_id")


@query("SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey IN (1, 2, 3, 500)")
def ids_query(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return search.query(c, {"ids": {"values": [1, 2, 3, 500]}}).select("id", "c_name")


@query("SELECT event_id FROM events WHERE (event_type = 'click' OR event_type = 'view') AND value BETWEEN 10 AND 50 AND NOT event_id > 9000")
def query_string(spark, sf_dir):
    return search.query(table(spark, sf_dir, "events"), None, "(event_type:click OR event_type:view) AND value:[10 TO 50] AND NOT event_id:>9000").select("event_id")


@query("SELECT event_id FROM events WHERE value >= 20 AND value < 40")
def json_range_query(spark, sf_dir):
    return search.query(table(spark, sf_dir, "events"), {"range": {"value": {"gte": 20, "lt": 40}}}).select("event_id")


@query(r"SELECT p_partkey FROM part WHERE regexp_matches(lower(p_type), '(^|\W)(promo|economy)(\W|$)') AND regexp_matches(lower(p_brand), '^brand\W+1.$') OR regexp_full_match(p_name, '[a-d].*')")
def match_regexp_query(spark, sf_dir):
    q = {"bool": {"should": [{"bool": {"must": [{"match": {"p_type": "PROMO, economy"}}, {"regexp": {"p_brand": "Brand#1."}}]}}, {"regexp": {"p_name": "[a-d].*"}}]}}
    return search.query(table(spark, sf_dir, "part"), q).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type LIKE 'A%' OR regexp_matches(p_brand, '^Brand#.3$')")
def prefix_wildcard_query(spark, sf_dir):
    q = {"bool": {"should": [{"prefix": {"p_type": "A"}}, {"wildcard": {"p_brand": "Brand#?3"}}]}}
    return search.query(table(spark, sf_dir, "part"), q).select("p_partkey")


@query("SELECT page_id FROM pages WHERE regexp_full_match(list_last(string_split(split_part(url, '#', 1), '/')), '[a-z0-9_-]+(\\.html)?')")
def filename_fullmatch(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(verdict.named_like(scalars.no_fragment("url"), "[a-z0-9_-]+(\\.html)?")).select("page_id")


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(split_part(url, '#', 1), '[?]|1[0-9]') AND starts_with(url, 'http')")
def url_exclude_find(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(verdict.crawlable("url", "http", "[?]|1[0-9]")).select("page_id")


@query("SELECT page_id, split_part(url, '#', 1) AS url, regexp_replace(split_part(url, '#', 1), '[^/]*$', '') AS base FROM pages")
def url_fragment_base(spark, sf_dir):
    """URLs without fragment, and their directories."""
    u = scalars.no_fragment("url")
    return table(spark, sf_dir, "pages").select("page_id", u.alias("url"), scalars.base_directory(u).alias("base"))


#: Links of the supplied pages: all of them are paths from the host's root (test_links.py holds other forms).
_LINKS = """SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') || href AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages)"""


@query(_LINKS)
def html_links(spark, sf_dir):
    """Absolute links of pages, resolved against each page's URL or BASE, by the HTML parser."""
    return page_links(table(spark, sf_dir, "pages"), keep=("page_id",)).select("page_id", "link")


@query(f"""WITH l AS ({_LINKS}), u AS (SELECT DISTINCT split_part(link, '#', 1) AS url FROM l)
SELECT url FROM u WHERE starts_with(url, 'http') AND NOT contains(url, '?') AND url NOT IN (SELECT split_part(url, '#', 1) FROM pages)""")
def crawl_frontier(spark, sf_dir):
    """Distinct links that were not visited and may be."""
    p = table(spark, sf_dir, "pages")
    return frontier(page_links(p), p.select(scalars.no_fragment("url").alias("url")), "http", "[?]")


@query("SELECT page_id, 'text/html' AS mime, 'utf-8' AS charset FROM pages")
def content_type_parse(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.lit("Text/HTML; Charset=UTF-8").alias("ct"))
    return p.select("page_id", scalars.mime("ct").alias("mime"), scalars.charset("ct").alias("charset"))


@query("SELECT o_orderkey AS k, CAST(f AS INTEGER) AS form, strftime(CASE WHEN f = 3 THEN date_trunc('month', o_orderdate) WHEN f = 4 THEN date_trunc('year', o_orderdate) ELSE date_trunc('day', o_orderdate) END, '%Y-%m-%d') AS d FROM orders, range(5) t(f)")
def lenient_date_forms(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    forms = F.array(*(F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'", "yyyy-MM-dd'T'00:00:00'Z'", "yyyy-MM", "yyyy")))
    d = o.select("o_orderkey", F.posexplode(forms).alias("form", "text"))
    return d.select(F.col("o_orderkey").alias("k"), "form", F.date_format(dates.lenient_date("text"), "yyyy-MM-dd").alias("d"))


_ROLL = "SELECT o_orderkey AS k, strftime(make_date(CAST(year(o_orderdate) AS BIGINT), 1, 1) + to_months(CAST(month(o_orderdate) + 11 AS INTEGER)) + to_days(CAST(day(o_orderdate) + 29 AS INTEGER)), '%Y-%m-%d') AS d FROM orders"


@query(_ROLL)
def lenient_date_rollover(spark, sf_dir):
    """Months and days beyond their range roll over: the parser."""
    o = table(spark, sf_dir, "orders")
    text = F.concat_ws("-", F.year("o_orderdate").cast("string"), (F.month("o_orderdate") + 12).cast("string"), (F.day("o_orderdate") + 30).cast("string"))
    return o.select(F.col("o_orderkey").alias("k"), F.date_format(dates.lenient_date(text), "yyyy-MM-dd").alias("d"))


@query(_ROLL)
def rolled_date_columns(spark, sf_dir):
    """The same within the JVM."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.date_format(scalars.rolled_date(F.year("o_orderdate"), F.month("o_orderdate") + 12, F.day("o_orderdate") + 30), "yyyy-MM-dd").alias("d"))


@query("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS s, true AS back FROM orders")
def oai_date_roundtrip(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    second = scalars.oai_text("t")
    return o.select(F.col("o_orderkey").alias("k"), scalars.oai_text("t", False).alias("d"), second.alias("s"), (scalars.oai_date(second) == F.date_trunc("second", "t")).alias("back"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS t, true AS back FROM events")
def index_date_format(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    text = scalars.index_text("ts")
    return e.select("event_id", text.alias("t"), (F.unix_millis(scalars.stored_instant(text)) == F.unix_millis("ts")).alias("back"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS b FROM orders")
def boolean_words(spark, sf_dir):
    words = F.array(*map(F.lit, ("yes", "On", "FALSE", "no", "1", "t")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), scalars.boolean_word(F.element_at(words, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("b"))


@query("SELECT c_custkey AS k, c_name AS t, c_custkey * 2 AS i, c_acctbal AS n FROM customer")
def trim_and_numbers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    padded = F.concat(F.lit("\t\x01 "), "c_name", F.lit(" \r\n"))
    return c.select(F.col("c_custkey").alias("k"), scalars.java_trim(padded).alias("t"), scalars.integer((F.col("c_custkey") * 2).cast("string")).alias("i"), scalars.number(F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit("d"))).alias("n"))


@query("SELECT o_orderkey AS k, unnest(['a', 'b', 'c' || o_orderkey]) AS part FROM orders")
def split_lists(spark, sf_dir):
    text = F.concat(F.lit("a, b;c"), F.col("o_orderkey").cast("string"), F.lit(" a"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.explode(scalars.split_list(text)).alias("part"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    """A nested value of a JSON field."""
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT l_orderkey AS k, '{"i":' || CASE WHEN count(*) = 1 THEN '"' || min(l_linenumber) || '"' ELSE '[' || string_agg('"' || l_linenumber || '"', ',' ORDER BY l_linenumber) || ']' END || '}' AS j FROM lineitem GROUP BY 1""")
def xml_to_json_array(spark, sf_dir):
    """XML to JSON: one child is a scalar, several are an array."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("<i>"), n.cast("string"), F.lit("</i>"))), "").alias("i"))

    @F.pandas_udf(T.StringType())
    def convert(xml):
        return xml.map(lambda t: to_json(parse(t).elements()[0]))

    return items.select(F.col("l_orderkey").alias("k"), convert(F.concat(F.lit("<o>"), "i", F.lit("</o>"))).alias("j"))


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1")
def facet_counts(spark, sf_dir):
    return search.facets(table(spark, sf_dir, "documents"), "lang")


@query("SELECT o_orderkey AS k FROM orders WHERE o_totalprice - 1000 <= 200000 AND o_totalprice + 1000 >= 100000")
def bbox_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(search.overlaps(F.col("o_totalprice") - 1000, F.col("o_totalprice") + 1000, 100000, 200000)).select(F.col("o_orderkey").alias("k"))


@query("SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1995-06-30' AND l_shipdate + INTERVAL 30 DAY >= TIMESTAMP '1995-06-01'")
def date_overlap(spark, sf_dir):
    from datetime import datetime

    d = table(spark, sf_dir, "lineitem").withColumn("until", F.col("l_shipdate") + F.expr("INTERVAL 30 DAY"))
    return d.where(search.overlaps("l_shipdate", "until", datetime(1995, 6, 1), datetime(1995, 6, 30))).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))


@query("SELECT doc_id, lang, source FROM documents")
def source_exclude_columns(spark, sf_dir):
    """The stored document lacks excluded columns; they aren't read."""
    return table(spark, sf_dir, "documents").drop("text", "n_chars")


@query(_ORDERS_SQL.replace("SELECT 'order:'", "SELECT * FROM (SELECT 'order:'") + ") WHERE op = 'index'")
def rebuild_identity(spark, sf_dir):
    """Evaluating stored XML again gives the same fields."""
    c = order_changes(spark, sf_dir)
    again = evaluated(stored_documents(c.where("op = 'index'"), ORDERS, "orders"), ORDERS, "orders")
    first = lambda n: F.get(n, F.lit(0))
    return again.select("id", "op", first("key").alias("key"), first("cust").alias("cust"), first("price").alias("price"), F.date_format(first("day"), "yyyy-MM-dd").alias("day"), first("prio").alias("prio"))


def _broken(spark, sf_dir, policy):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    xml = F.concat(F.lit("<o><p>"), F.when(k % 10 == 0, F.lit("many")).otherwise(k.cast("string")), F.when(k % 10 == 1, F.lit("</o>")).otherwise(F.lit("</p></o>")))
    docs = raw(o.select(k.cast("string").alias("identifier"), xml.alias("xml")))
    return evaluated(docs, PipelineSpec([FieldSpec("p", Expression("/o/p"), "INTEGER")]), "s", policy).select("id", "op")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'index' AS op FROM orders WHERE o_orderkey % 10 > 1")
def error_ignore(spark, sf_dir):
    """Documents that fail are left out."""
    return _broken(spark, sf_dir, verdict.IGNORE)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 10 > 1 THEN 'index' ELSE 'delete' END AS op FROM orders")
def error_delete(spark, sf_dir):
    """Documents that fail are deleted."""
    return _broken(spark, sf_dir, verdict.DELETE)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 60 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_gap(spark, sf_dir):
    """Push sessions end after a gap."""
    s = sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", scalars.index_text("started").alias("started"), "n")


@query("SELECT CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS op, count(*) AS n FROM events GROUP BY 1")
def harvest_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(verdict.operation(F.col("event_type") != "error").alias("op"))
    return merge.counters(e)


@query("SELECT o_orderkey AS k, 'urn:new' AS ns, 'p:' || o_orderpriority AS prio FROM orders")
def xslt_transform(spark, sf_dir):
    """A stylesheet moves documents into another namespace before they are evaluated."""
    sheet = """<xsl:stylesheet version="1.0" xmlns:n="urn:new" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:param name="mark"/>
<xsl:template match="*"><xsl:element name="n:{local-name()}" namespace="urn:new"><xsl:copy-of select="@*"/><xsl:apply-templates/></xsl:element></xsl:template>
<xsl:template match="text()[local-name(..)='prio']"><xsl:value-of select="concat($mark, .)"/></xsl:template></xsl:stylesheet>"""
    docs = transformed(order_xml(table(spark, sf_dir, "orders")), Expression(sheet, True), "orders", {"mark": "p:"})
    ns = {"n": "urn:new"}
    spec = PipelineSpec([FieldSpec("k", x("/n:order/n:key", **ns), "INTEGER"), FieldSpec("ns", x("namespace-uri(/*)", **ns)), FieldSpec("prio", x("/n:order/n:prio", **ns))])
    first = lambda n: F.get(n, F.lit(0)).alias(n)
    return evaluated(docs.drop("parse_error"), spec, "orders").select(first("k"), first("ns"), first("prio"))


@query("SELECT 'order:' || o_orderkey AS id, o_orderpriority || ', ' || o_orderstatus AS facet, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 5 END AS DOUBLE) AS boost FROM orders")
def template_fields(spark, sf_dir):
    """Fields by templates: for-each, text, choose."""
    head = f'<body xmlns:o="{NS}" xmlns:xsl="http://www.w3.org/1999/XSL/Transform">'
    facet = Expression(head + '<xsl:for-each select="/o:order"><tok><xsl:value-of select="o:prio"/><xsl:for-each select="@status"><xsl:text>, </xsl:text><xsl:value-of select="."/></xsl:for-each></tok></xsl:for-each></body>', True)
    boost = Expression(head + "<xsl:choose><xsl:when test=\"/o:order/@status = 'F'\">1.0</xsl:when><xsl:otherwise>5.0</xsl:otherwise></xsl:choose></body>", True)
    spec = PipelineSpec([FieldSpec("facet", facet), FieldSpec("boost", boost, "NUMBER")])
    return evaluated(order_xml(table(spark, sf_dir, "orders")), spec, "orders").select("id", F.get("facet", F.lit(0)).alias("facet"), F.get("boost", F.lit(0)).alias("boost"))


@query("SELECT 'order:' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS errors FROM orders")
def schema_validation(spark, sf_dir):
    """Structural validation against an XML Schema."""
    schema = f"""<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:o="{NS}" targetNamespace="{NS}" elementFormDefault="qualified"><xs:element name="order"><xs:complexType><xs:sequence>
<xs:element name="key" type="xs:long"/><xs:element name="cust" type="xs:long"/><xs:element name="price" type="xs:double"/><xs:element name="date" type="xs:date"/><xs:element name="prio" type="xs:string"/>
</xs:sequence><xs:attribute name="status" type="xs:string" use="required"/></xs:complexType></xs:element></xs:schema>"""
    docs = order_xml(table(spark, sf_dir, "orders"))
    docs = docs.withColumn("xml", F.when(F.col("seq") % 4 == 0, F.regexp_replace("xml", "<p:price>.*</p:price>", "")).otherwise(F.col("xml")))
    return validated(docs, PipelineSpec(schemas=[schema])).select(F.col("identifier").alias("id"), F.size("schema_errors").alias("errors"))


@query("""SELECT 'order:' || o_orderkey AS id, '{"internal-source":"orders","key":' || o_orderkey || ',"cust":' || o_custkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') || '","prio":"' || o_orderpriority || '"}' AS json FROM orders""")
def json_rendering(spark, sf_dir):
    """Stored documents as JSON: scalars for single values, absent ones left out."""
    spec = PipelineSpec([f for f in ORDER_FIELDS if f.name != "price"], variables=ORDERS.variables)
    return rendered(order_changes(spark, sf_dir, spec=spec).drop("op", "error", "seq"), spec, ("xml", "internal-datestamp"))


@query("SELECT 'copy:order:' || o_orderkey AS identifier, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'O'")
def index_table_scan(spark, sf_dir):
    """Documents out of an index table, by a query; only ids, dates and XML are read."""
    o = order_xml(table(spark, sf_dir, "orders"))
    status = F.regexp_extract("xml", 'status="(.)"', 1)
    index = o.select(F.col("identifier").alias("id"), F.col("datestamp").alias("internal-datestamp"), "xml", status.alias("status"))
    return table_documents(index, "copy", "copy:", json_query={"term": {"status": "O"}}).select("identifier", F.date_format("datestamp", "yyyy-MM-dd").alias("day"))


@query("SELECT 'l:' || event_id AS identifier, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS t, '<e>' || event_type || '</e>' AS xml FROM events")
def legacy_scan(spark, sf_dir):
    """An export with millisecond dates (negative: none) and XML as bytes."""
    e = table(spark, sf_dir, "events")
    ms = F.when(F.col("event_id") % 5 == 0, F.lit(-1)).otherwise(F.unix_millis(F.col("ts").cast("timestamp")))
    t = e.select(F.col("event_id").cast("string").alias("internal-identifier"), ms.cast("long").alias("internal-datestamp"), F.concat(F.lit("<e>"), "event_type", F.lit("</e>")).cast("binary").alias("internal-xml"))
    return legacy_documents(t, "legacy", "l:").select("identifier", scalars.index_text("datestamp").alias("t"), "xml")


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS t FROM events")
def http_date_parse(spark, sf_dir):
    """HTTP dates read back."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    names = F.element_at(F.array(*map(F.lit, ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"))), F.dayofweek("ts"))
    text = F.concat(names, F.date_format("ts", ", dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return e.select("event_id", scalars.oai_text(scalars.http_date(text)).alias("t"))


@query("SELECT 'l:' || event_id AS identifier, '<e>' || event_type || '</e>' AS xml FROM events WHERE event_id % 7 <> 0")
def deflated_legacy_scan(spark, sf_dir):
    """An export whose XML is deflated for every other row; rows without an identifier or XML are left out."""
    e = table(spark, sf_dir, "events")

    @F.pandas_udf(T.BinaryType())
    def deflate(text):
        return text.map(lambda t: zlib.compress(t.encode()))

    xml = F.concat(F.lit("<e>"), "event_type", F.lit("</e>"))
    k = F.col("event_id")
    t = e.select(
        F.when(k % 14 != 0, k.cast("string")).alias("internal-identifier"), F.lit(0).cast("long").alias("internal-datestamp"),
        F.when(k % 14 == 7, F.lit(None)).when(k % 2 == 0, deflate(xml)).otherwise(xml.cast("binary")).alias("internal-xml"),
    )
    return legacy_documents(t, "legacy", "l:").select("identifier", "xml")


@query("""SELECT event_id AS k, '<i a="' || event_id || '"><b>' || event_type || '</b><b>x</b></i>' AS xml_field, '{"@a":"' || event_id || '","b":["' || event_type || '","x"]}' AS json_field, '<p>' || event_type || '</p>' AS xhtml_field FROM events""")
def markup_fields(spark, sf_dir):
    """Fields that keep their elements: as XML, as JSON, and as XHTML made by a template."""
    e = table(spark, sf_dir, "events")
    xml = F.concat(F.lit('<o><i a="'), F.col("event_id").cast("string"), F.lit('"><b>'), "event_type", F.lit("</b><b>x</b></i></o>"))
    head = '<body xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><p><xsl:value-of select="/o/i/b[1]"/></p></body>'
    spec = PipelineSpec([FieldSpec("as_xml", Expression("/o/i"), "XML"), FieldSpec("as_json", Expression("/o/i"), "JSON"), FieldSpec("as_xhtml", Expression(head, True), "XHTML")])
    first = lambda n: F.get(n, F.lit(0))
    c = evaluated(raw(e.select(F.col("event_id").cast("string").alias("identifier"), xml.alias("xml"))), spec, "s")
    return c.select(F.col("id").cast("bigint").alias("k"), first("as_xml").alias("xml_field"), first("as_json").alias("json_field"), first("as_xhtml").alias("xhtml_field"))


@query("SELECT 'copy:' || c_custkey AS identifier FROM customer WHERE c_custkey % 4 <> 0")
def scan_without_xml(spark, sf_dir):
    """Rows of an index table without XML are no documents; match_all takes all others."""
    c = table(spark, sf_dir, "customer")
    index = c.select(F.col("c_custkey").cast("string").alias("id"), F.lit(None).cast("timestamp").alias("internal-datestamp"), F.when(F.col("c_custkey") % 4 != 0, F.lit("<c/>")).alias("xml"))
    return table_documents(index, "copy", "copy:", json_query={"match_all": {}}).select("identifier")


@query("SELECT role, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY 1")
def multi_value_counts(spark, sf_dir):
    """Repeated keys of a document, regrouped."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))



# ---- whole runs, in a folder of their own


def scratch(spark: SparkSession) -> str:
    """A new folder: below spark.checkpoint.dir, or a temporary one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/gleanery/run-{uuid.uuid4().hex}"
    own = tempfile.mkdtemp(prefix="gleanery-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


PEOPLE = PipelineSpec([FieldSpec("name", Expression("/c/n")), FieldSpec("balance", Expression("/c/b"), "NUMBER")])


def people(spark, sf_dir, name=None) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    xml = F.concat(F.lit("<c><n>"), name if name is not None else F.col("c_name"), F.lit("</n><b>"), F.col("c_acctbal").cast("string"), F.lit("</b></c>"))
    return raw(c.select(F.col("c_custkey").cast("string").alias("identifier"), xml.alias("xml"), F.col("c_custkey").alias("seq")), "people")


def people_config(aliases=None) -> Config:
    return Config(PEOPLE, [IndexSpec("people", ("_v1", "_v2"), aliases=aliases or {}, sources=[SourceSpec("people", "noop")])])


def people_rows(index: DataFrame) -> DataFrame:
    return index.select(F.col("id").cast("bigint").alias("k"), F.get("name", F.lit(0)).alias("name"), F.get("balance", F.lit(0)).alias("balance"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_name END AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0""")
def index_lifecycle(spark, sf_dir):
    """Two runs into an index: upserts, then removal of what the second run has not seen."""
    config, root = people_config(), scratch(spark)
    index = Index(spark, root, config.indexes[0], PEOPLE)
    source, k = config.indexes[0].sources[0], F.col("c_custkey")
    harvest_source(spark, index, source, index.create(), lambda *a: Scan(people(spark, sf_dir)))
    second = people(spark, sf_dir, F.when(k % 5 == 0, F.lit("changed")).otherwise(F.col("c_name"))).where("seq % 3 <> 0")
    harvest_source(spark, index, source, index.create(), lambda *a: Scan(second))
    return people_rows(index.read())


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal >= 5000")
def index_rebuild_alias(spark, sf_dir):
    """A rebuild beside the live index, the swap, and a filtered alias on the result."""
    config, root = people_config({"rich": '{"range": {"balance": {"gte": 5000}}}'}), scratch(spark)
    index = Index(spark, root, config.indexes[0], PEOPLE)
    harvest_source(spark, index, config.indexes[0].sources[0], index.create(), lambda *a: Scan(people(spark, sf_dir)))
    report = rebuild(spark, config, root)
    if report.errors or index.current() != "people_v2":
        raise RuntimeError(f"the rebuild failed: {report.errors}")
    return people_rows(index.alias("rich"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 10 >= 5 THEN 'new' ELSE c_name END AS name, '2020-01-10T00:00:00Z' AS watermark FROM customer""")
def watermark_runs(spark, sf_dir):
    """The first run's newest date is the second run's watermark: only later documents are evaluated and written."""
    config, root = people_config(), scratch(spark)
    index, source = Index(spark, root, config.indexes[0], PEOPLE), config.indexes[0].sources[0]
    day = F.timestamp_add("DAY", (F.col("seq") % 10).cast("int"), F.lit("2020-01-01").cast("timestamp"))
    first = people(spark, sf_dir).withColumn("datestamp", day).where("seq % 10 < 5")
    harvest_source(spark, index, source, index.create(), lambda *a: Scan(first, complete=False, watermark=newest(first)))
    second = people(spark, sf_dir, F.lit("new")).withColumn("datestamp", day)
    harvest_source(spark, index, source, index.create(), lambda *a: Scan(second, complete=False, watermark=newest(second)))
    return people_rows(index.read()).select("k", "name", F.lit(index.metadata(source.id)["lastHarvested"]).alias("watermark"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer")
def excluded_columns(spark, sf_dir):
    """The stored document lacks the columns that the mapping excludes."""
    spec = replace(PEOPLE, mapping={"_source": {"excludes": ["balance", "*datestamp", "xml", "*source"]}})
    config, root = replace(people_config(), pipeline=spec), scratch(spark)
    index = Index(spark, root, config.indexes[0], spec)
    harvest_source(spark, index, config.indexes[0].sources[0], index.create(), lambda *a: Scan(people(spark, sf_dir)))
    view = index.source_view()
    return view.withColumn("name", F.get("name", F.lit(0)))


@query("SELECT 'file:' || n_nationkey || '.xml' AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'zip:a/' || n_nationkey || '.xml', n_name FROM nation WHERE n_nationkey % 2 = 1")
def directory_and_zip(spark, sf_dir):
    """A directory and an archive feed one index; names must match a pattern."""
    root, files = scratch(spark), Files(spark)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # 25 rows, to lay out the input
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for k, name in rows:
            xml = f"<c><n>{name}</n></c>"
            if k % 2:
                z.writestr(f"a/{k}.xml", xml)
            else:
                files.write(f"{root}/in/{k}.xml", xml)
    files.write(f"{root}/in/note.txt", "no document")
    files.write(f"{root}/z.zip", packed.getvalue())
    like = {"filenameFilter": ".*[.]xml"}
    sources = [SourceSpec("d", "directory", {"directory": f"{root}/in", **like}), SourceSpec("z", "zip", {"zipFile": f"{root}/z.zip", **like})]
    config = Config(PEOPLE, [IndexSpec("mixed", ("_v1", "_v2"), sources=sources)])
    report = harvest(spark, config, f"{root}/out")
    if report.errors:
        raise RuntimeError(str(report.errors))
    return Index(spark, f"{root}/out", config.indexes[0], PEOPLE).read().select("id", F.get("name", F.lit(0)).alias("name"))


@query("SELECT 'r:' || n_nationkey AS identifier, n_regionkey <> 1 AS deleted, '<c><n>' || n_name || '</n></c>' AS xml FROM nation")
def oai_static_scan(spark, sf_dir):
    """Records of a static repository, one format and one set of several."""
    root = scratch(spark)
    rows = table(spark, sf_dir, "nation").collect()  # 25 rows, to lay out the input
    record = "<o:record><o:header><o:identifier>{0}</o:identifier><o:datestamp>2020-01-01</o:datestamp><o:setSpec>s{2}</o:setSpec></o:header><o:metadata><c><n>{1}</n></c></o:metadata></o:record>"
    body = "".join(record.format(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in rows)
    head = '<Repository xmlns="http://www.openarchives.org/OAI/2.0/static-repository" xmlns:o="http://www.openarchives.org/OAI/2.0/">'
    text = f'{head}<ListRecords metadataPrefix="c">{body}</ListRecords><ListRecords metadataPrefix="d">{record.format(99, "x", 1)}</ListRecords></Repository>'.replace("<c>", '<c xmlns="">')
    Files(spark).write(f"{root}/r.xml", text)
    scan = open_source(spark, SourceSpec("r", "oai_static", {"url": f"{root}/r.xml", "metadataPrefix": "c", "setSpec": "s1", "identifierPrefix": "r:"}))
    return scan.documents.select("identifier", "deleted", "xml")


class _Repository:
    """A small OAI-PMH repository for the query below: pages of ten records, a token, one busy answer, changes since a date."""

    def __init__(self, host: str, rows: list):
        busy = [True]

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                asked = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
                if busy and busy.pop():
                    self.send_response(503)
                    self.send_header("Retry-After", "0")
                    self.send_header("Content-Length", "0")
                    self.end_headers()
                    return
                body = f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><responseDate>2020-03-01T00:00:00Z</responseDate>{self.answer(asked)}</OAI-PMH>'.encode()
                self.send_response(200)
                self.send_header("Content-Type", "text/xml")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def answer(self, asked: dict[str, str]) -> str:
                if asked["verb"] == "Identify":
                    return "<Identify><granularity>YYYY-MM-DDThh:mm:ssZ</granularity></Identify>"
                changed, _, start = asked.get("resumptionToken", ("yes" if "from" in asked else "no") + "/0").partition("/")
                own = [r for r in rows if changed == "no" or r["n_nationkey"] % 3 == 0 or r["n_nationkey"] == 1]
                at = int(start)
                token = f"<resumptionToken>{changed}/{at + 10}</resumptionToken>" if at + 10 < len(own) else ""
                return "<ListRecords>" + "".join(self.record(r, changed == "yes") for r in own[at : at + 10]) + token + "</ListRecords>"

            def record(self, r, changed: bool) -> str:
                k = r["n_nationkey"]
                gone = k == 1 if changed else k % 5 == 0
                head = f"<header{' status=\"deleted\"' if gone else ''}><identifier>{k}</identifier><datestamp>2020-0{1 + changed}-01T00:00:00Z</datestamp><setSpec>s{r['n_regionkey']}</setSpec></header>"
                return f"<record>{head}{'' if gone else f'<metadata><c xmlns=\"\"><n>{"new" if changed else r["n_name"]}</n></c></metadata>'}</record>"

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer((host, 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://{host}:{self.server.server_address[1]}/oai"

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()


@query("""SELECT 'o:' || n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS name FROM nation
WHERE n_regionkey IN (0, 1, 2) AND n_nationkey <> 1 AND (n_nationkey % 5 <> 0 OR n_nationkey % 3 = 0)""")
def oai_harvest(spark, sf_dir):
    """A repository harvested twice: pages, tombstones, sets and a busy answer; then only what changed since."""
    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    repository = _Repository(host, table(spark, sf_dir, "nation").orderBy("n_nationkey").collect())  # 25 rows
    try:
        options = {"baseUrl": repository.url, "metadataPrefix": "c", "setSpec": "s0, s1; s2", "identifierPrefix": "o:", "retryAfterSeconds": "0"}
        config, root = Config(PEOPLE, [IndexSpec("oai", ("_v1", "_v2"), sources=[SourceSpec("o", "oai", options)])]), scratch(spark)
        for _ in range(2):
            report = harvest(spark, config, root)
            if report.errors:
                raise RuntimeError(str(report.errors))
    finally:
        repository.stop()
    return Index(spark, root, config.indexes[0], PEOPLE).read().select("id", F.get("name", F.lit(0)).alias("name"))


@query("SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS name FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def push_stream(spark, sf_dir):
    """Pushed changes through a stream: the last change of each id wins, some are deletes."""
    root = scratch(spark)
    e = table(spark, sf_dir, "events")
    pushed = e.select(
        F.lit("people").alias("source"), F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("index")).alias("op"), F.col("user_id").cast("string").alias("identifier"),
        F.lit(None).cast("timestamp").alias("last_modified"), F.concat(F.lit("<c><n>"), "event_type", F.lit("</n></c>")).alias("xml"), F.col("event_id").alias("seq"),
    )
    pushed.write.json(f"{root}/landing")
    config = people_config()
    done = stream(spark, config, f"{root}/out", f"{root}/landing", f"{root}/state")
    done.awaitTermination()
    return Index(spark, f"{root}/out", config.indexes[0], PEOPLE).read().select("id", F.get("name", F.lit(0)).alias("name"))

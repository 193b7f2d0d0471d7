import gzip
import json
import urllib.request
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gleanery.operators import merge, search, verdict
from gleanery.operators.evaluate import evaluated, rendered
from gleanery.plans.config import Config, ConfigError, Expression, FieldSpec, IndexSpec, PipelineSpec, SourceSpec, read_config
from gleanery.plans.index import Index
from gleanery.plans.run import LAST, harvest, rebuild, update_aliases
from gleanery.sources.base import Scan, raw, register
from gleanery.sources.http import Policy, Response, decoded, fetch
from gleanery.sources.oai import OaiError, StreamReader, page, pages, static_source
from gleanery.sources.web import crawl, links
from gleanery.streaming.push import EVENT, Front, committed, stream

FIELDS = [FieldSpec("title", Expression("/r/t")), FieldSpec("n", Expression("/r/n"), "INTEGER", "7"), FieldSpec("d", Expression("$day"), "DATETIME"), FieldSpec("j", Expression("/r/j"), "JSON")]
SPEC = PipelineSpec(FIELDS, variables=[("day", Expression("/r/d"))], filters=[(False, Expression("/r/@hide = 'yes'"))])


def docs(spark, *rows):
    return raw(spark.createDataFrame([(i, x, d, g, k) for k, (i, x, d, g) in enumerate(rows)], "identifier string, xml string, datestamp timestamp, deleted boolean, seq long"), "s")


def config(*sources, suffixes=("_a", "_b"), aliases=None):
    return Config(SPEC, [IndexSpec("ix", suffixes, aliases=aliases or {}, sources=list(sources))]).check()


def test_evaluate(spark):
    got = {
        r["id"]: r
        for r in evaluated(
            docs(spark, ("a", "<r><t>x<b>y</b></t><t>z</t><d>2004-13-01</d><j><k>1</k></j></r>", None, False), ("b", "<r hide='yes'><n>x</n></r>", None, False), ("c", None, None, True), (None, "<r/>", None, False), ("e", "<r>", None, False), ("f", "<r><n>no</n></r>", None, False)),
            SPEC, "s", "DELETEDOCUMENT",
        ).collect()
    }
    assert set(got) == {"a", "b", "c", "e", "f"}
    assert {k: r["op"] for k, r in got.items()} == {"a": "index", "b": "delete", "c": "delete", "e": "delete", "f": "delete"}
    assert got["a"]["title"] == ["x\ny", "z"] and got["a"]["n"] == [7] and got["a"]["d"] == [datetime(2005, 1, 1)] and got["a"]["j"] == ['{"k":"1"}']


def test_policies(spark):
    bad = docs(spark, ("e", "<r>", None, False), ("a", "<r/>", None, False))
    assert [r["id"] for r in evaluated(bad, SPEC, "s", "IGNOREDOCUMENT").collect()] == ["a"]
    with pytest.raises(Exception, match="document e"):
        evaluated(bad, SPEC, "s", "STOP").collect()


def test_rendering(spark):
    c = evaluated(docs(spark, ("a", "<r><t>x</t><t>z</t><n>1</n><j><k>1</k></j></r>", None, False)), SPEC, "s")
    assert json.loads(rendered(c.drop("op", "error", "seq", "xml"), SPEC).first()["json"]) == {"internal-source": "s", "title": ["x", "z"], "n": 1, "j": {"k": "1"}}


def test_last_filter_wins_and_freshness(spark):
    one = spark.range(1)
    chain = [(False, F.lit(True)), (True, F.lit(True))]
    assert one.select(verdict.accepted(chain), verdict.accepted(chain[:1]), verdict.accepted([], False)).first()[:] == (True, False, False)
    t = [datetime(2020, 1, d) for d in (1, 2)]
    assert one.select(*(verdict.outdated(F.lit(w).cast("timestamp"), F.lit(d).cast("timestamp")) for w, d in ((None, t[0]), (t[0], None), (t[0], t[0]), (t[0], t[1])))).first()[:] == (True, True, False, True)
    assert one.select(verdict.named_like(F.lit("/x/a.xml"), r".*\.xml"), verdict.named_like(F.lit("a.xml.bak"), r".*\.xml"), verdict.named_like(F.lit("q"), None)).first()[:] == (True, False, True)


def memory_source(spark, rows, watermark=None):
    """A source kind whose documents a test sets."""
    register("memory", lambda s, source, wm: Scan(docs(s, *rows), watermark=watermark))


def test_harvest_idempotent_and_delete_unseen(spark, tmp_path):
    c = config(SourceSpec("s", "memory"), SourceSpec("other", "noop"))
    t1, t2 = (datetime(2020, 1, d, tzinfo=timezone.utc) for d in (1, 2))
    rows = [("a", "<r><t>1</t></r>", t1, False), ("b", "<r><t>2</t></r>", t1, False)]
    memory_source(spark, rows, t1)
    assert harvest(spark, c, str(tmp_path)).errors == {}
    index = Index(spark, str(tmp_path), c.indexes[0], SPEC)
    content = lambda: {r["id"]: r["title"] for r in index.read().collect()}
    assert content() == {"a": ["1"], "b": ["2"]}
    harvest(spark, c, str(tmp_path))
    assert content() == {"a": ["1"], "b": ["2"]} and index.metadata("s")[LAST] == "2020-01-01T00:00:00Z"
    memory_source(spark, [("a", "<r><t>late</t></r>", t1, False), ("c", "<r><t>3</t></r>", t2, False)], t2)
    harvest(spark, c, str(tmp_path))
    assert content() == {"a": ["1"], "c": ["3"]} and index.metadata("s")[LAST] == "2020-01-02T00:00:00Z"
    memory_source(spark, [("z", "<r>", None, False), ("y", "<r><n>x</n></r>", None, False)], datetime(2021, 1, 1, tzinfo=timezone.utc))
    report = harvest(spark, c, str(tmp_path))
    assert "s" in report.errors and content() == {"a": ["1"], "c": ["3"]} and index.metadata("s")[LAST] == "2020-01-02T00:00:00Z"


def test_rebuild_swaps(spark, tmp_path):
    c = config(SourceSpec("s", "memory"), aliases={"mine": json.dumps({"terms": {"internal-source": ["s"]}}), "none": json.dumps({"term": {"internal-source": "x"}})})
    memory_source(spark, [("a", "<r><t>1</t></r>", None, False)])
    harvest(spark, c, str(tmp_path))
    index = Index(spark, str(tmp_path), c.indexes[0], SPEC)
    assert index.current() == "ix_a" and index.alias("mine").count() == 1 and index.alias("none").count() == 0
    assert rebuild(spark, c, str(tmp_path)).errors == {}
    assert index.current() == "ix_b" and [r["title"] for r in index.read().collect()] == [["1"]] and not index.files.exists(f"{index.root}/ix_a")
    c.indexes[0].aliases.pop("none")
    update_aliases(spark, c, str(tmp_path))
    with pytest.raises(RuntimeError):
        index.alias("none")
    failed = rebuild(spark, c, str(tmp_path), prepare=lambda d: d.withColumn("xml", F.raise_error(F.lit("no")).cast("string")))
    assert failed.errors and index.current() == "ix_b" and index.read().count() == 1


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.xml").write_text("<r><t>1</t></r>")
    (tmp_path / "in/b.txt").write_text("no")
    (tmp_path / "in/sub/c.xml").write_text("<r><t>2</t></r>")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/e.xml", "<r><t>3</t></r>")
        z.writestr("d/f.txt", "no")
    c = config(SourceSpec("d", "directory", {"directory": str(tmp_path / "in"), "recursive": "true", "filenameFilter": r".*\.xml", "identifierPrefix": "p/"}), SourceSpec("z", "zip", {"zipFile": str(tmp_path / "z.zip"), "filenameFilter": r".*\.xml"}))
    report = harvest(spark, c, str(tmp_path / "out"))
    assert report.errors == {}
    index = Index(spark, str(tmp_path / "out"), c.indexes[0], SPEC)
    assert {r["id"] for r in index.read().collect()} == {"file:p/a.xml", "file:p/sub/c.xml", "zip:d/e.xml"}
    (tmp_path / "in/a.xml").unlink()
    assert harvest(spark, c, str(tmp_path / "out")).errors == {}
    assert {r["id"] for r in index.read().collect()} == {"file:p/sub/c.xml", "zip:d/e.xml"}


OAI = 'xmlns="http://www.openarchives.org/OAI/2.0/"'


def test_oai_pages():
    head = f"<OAI-PMH {OAI}><responseDate>2020-01-05T00:00:00Z</responseDate>"
    one = f'{head}<ListRecords><record><header><identifier>1</identifier><datestamp>2020-01-01</datestamp><setSpec>x</setSpec></header><metadata><p:r xmlns:p="u"><p:t>1</p:t></p:r></metadata><about>no</about></record><resumptionToken>next</resumptionToken></ListRecords></OAI-PMH>'
    two = f'{head}<ListRecords><record><header status="deleted"><identifier>2</identifier><datestamp>2020-01-02</datestamp></header></record><resumptionToken/></ListRecords></OAI-PMH>'
    asked = []

    def get(url):
        asked.append(url)
        if "verb=Identify" in url:
            return Response(url, 200, {}, f"<OAI-PMH {OAI}><Identify><granularity>YYYY-MM-DD</granularity></Identify></OAI-PMH>".encode())
        return Response(url, 200, {}, (two if "resumptionToken" in url else one).encode())

    got = [r for records, _ in pages("http://x/oai", "dif", ["x"], datetime(2020, 1, 1, tzinfo=timezone.utc), get) for r in records]
    assert [(r["identifier"], r["status"], r["sets"]) for r in got] == [("1", None, ["x"]), ("2", "deleted", [])]
    assert got[0]["xml"] == '<p:r xmlns:p="u"><p:t>1</p:t></p:r>' and "from=2020-01-01&" in asked[1] + "&" and "set=x" in asked[1]
    assert page(f'<OAI-PMH {OAI}><error code="noRecordsMatch">none</error></OAI-PMH>')[0] == []
    with pytest.raises(OaiError):
        page(f'<OAI-PMH {OAI}><error code="badArgument">bad</error></OAI-PMH>')


def test_oai_static(spark, tmp_path):
    rec = lambda i, s: f"<o:record><o:header><o:identifier>{i}</o:identifier><o:datestamp>2020-01-01</o:datestamp><o:setSpec>{s}</o:setSpec></o:header><o:metadata><r><t>{i}</t></r></o:metadata></o:record>"
    (tmp_path / "s.xml").write_text(f'<Repository xmlns="http://www.openarchives.org/OAI/2.0/static-repository" xmlns:o="http://www.openarchives.org/OAI/2.0/"><ListRecords metadataPrefix="dif">{rec(1, "x")}{rec(2, "y")}</ListRecords><ListRecords metadataPrefix="dc">{rec(3, "x")}</ListRecords></Repository>')
    scan = static_source(spark, SourceSpec("s", "oai_static", {"url": str(tmp_path / "s.xml"), "metadataPrefix": "dif", "setSpec": "x", "identifierPrefix": "p:"}), None)
    assert {(r["identifier"], r["deleted"]) for r in scan.documents.collect()} == {("p:1", False), ("p:2", True)}


def test_fetch_retries():
    answers = [OSError("down"), Response("u", 503, {"Retry-After": "3"}), Response("u", 500), Response("u", 200, {}, b"ok")]
    waits = []

    def get(url, headers, timeout):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert fetch("http://u", Policy(retries=3, wait=9), get=get, sleep=waits.append).body == b"ok" and waits == [9, 3, 9]
    with pytest.raises(OSError):
        fetch("http://u", Policy(retries=1, wait=0), get=lambda *a: Response("u", 500), sleep=waits.append)
    assert decoded(gzip.compress(b"x"), "gzip") == b"x"
    with pytest.raises(OSError):
        decoded(b"", "br")


def test_crawl(spark):
    web = {
        "http://h/d/": ("text/html", '<html><head><base href="http://h/d/"></head><body><a href="a.xml#f">a</a><a href="sub/">s</a><a href="http://else/x.xml">no</a><iframe src="b.xml"></iframe></body></html>'),
        "http://h/d/sub/": ("text/html", '<body><a href="../a.xml">again</a><a href="c.xml">c</a><a href="skip.xml">k</a></body>'),
        "http://h/d/a.xml": ("text/xml; charset=utf-8", "<r/>"), "http://h/d/b.xml": ("application/xml", "<r/>"), "http://h/d/sub/c.xml": ("text/xml", "<r/>"),
    }
    page_type = "url string, final_url string, status int, content_type string, last_modified timestamp, body string"

    def get(urls):
        rows = [(r["url"], r["url"], 200 if r["url"] in web else 404, *(lambda p: (p[0], None, p[1]))(web.get(r["url"], (None, None)))) for r in urls.collect()]
        return spark.createDataFrame(rows, page_type)

    found = crawl(spark, "http://h/d/", get, exclude="skip", store=lambda df, name: df)
    assert {r["identifier"] for r in found.collect()} == {"http://h/d/a.xml", "http://h/d/b.xml", "http://h/d/sub/c.xml"}
    assert links("http://h/", "<p><a href='x'>outside of body</a></p>") == []


def test_search(spark):
    t = spark.createDataFrame([("1", "Red Fox", 5, ["a", "b"]), ("2", "blue fox", 9, ["c"]), ("3", None, None, [])], "id string, text string, n int, tags array<string>")
    ids = lambda **k: sorted(r["id"] for r in search.query(t, **k).collect())
    assert ids(query_string="fox") == ["1", "2"] and ids(query_string="text:red OR n:[8 TO *]") == ["1", "2"] and ids(query_string='"red fox" AND NOT n:9') == ["1"] and ids(query_string="tags:c") == ["2"] and ids(query_string="-tags:a") == ["2", "3"] and ids(query_string="text:bl*") == ["2"]
    assert ids(json_query={"bool": {"must_not": {"exists": {"field": "n"}}}}) == ["3"] and ids(json_query={"range": {"n": {"gt": 5}}}) == ["2"] and ids(json_query={"term": {"tags": "b"}}) == ["1"] and ids() == ["1", "2", "3"]
    wanted = {
        "any": ({"match": {"text": "RED whale"}}, ["1"]), "all": ({"match": {"text": {"query": "fox, blue", "operator": "and"}}}, ["2"]), "values": ({"match": {"tags": {"query": "a b", "operator": "and"}}}, ["1"]),
        "row": ({"match_phrase": {"text": "red fox"}}, ["1"]), "order": ({"match_phrase": {"text": "fox red"}}, []), "part": ({"match": {"text": "fo"}}, []), "none": ({"match": {"text": "!"}}, []), "number": ({"match": {"n": "9"}}, ["2"]),
        "whole": ({"regexp": {"text": "[Rb].* fox"}}, ["2"]), "piece": ({"regexp": {"text": "fox"}}, []), "unknown field": ({"match": {"q": "x"}}, []),
    }
    assert {k: ids(json_query=q) for k, (q, _) in wanted.items()} == {k: v for k, (_, v) in wanted.items()}
    for bad in ({"fuzzy": {"text": "x"}}, {"match": {"text": {"query": "x", "slop": 1}}}, {"range": {"n": {"near": 1}}}):
        with pytest.raises(search.QueryError):
            search.query(t, bad)
    with pytest.raises(search.QueryError):
        search.query(t, {"match_all": {}}, "x")
    assert {r["value"]: r["n"] for r in search.facets(t, "tags").collect()} == {"a": 1, "b": 1, "c": 1}


def test_merge(spark):
    base = spark.createDataFrame([("1", "a", "s"), ("2", "b", "s"), ("3", "c", "q")], "id string, v string, source string")
    ch = spark.createDataFrame([("1", "x", "s", "index", 1), ("1", "y", "s", "index", 2), ("2", None, "s", "delete", 1)], "id string, v string, source string, op string, seq int")
    got = merge.upserted(base, merge.latest(ch))
    assert {(r["id"], r["v"]) for r in got.collect()} == {("1", "y"), ("3", "c")}
    assert {r["id"] for r in merge.without_unseen(base, base.where("id = '1'"), "s").collect()} == {"1", "3"}
    assert {r["v"] for r in merge.latest_by_max(ch.where("id = '1'"), "id", "seq").collect()} == {"y"}


def test_push(spark, tmp_path):
    c = config(SourceSpec("s", "noop"))
    index = Index(spark, str(tmp_path / "out"), c.indexes[0], SPEC)
    front = Front({"s"}, str(tmp_path / "landing"), port=0).start()
    base = f"http://127.0.0.1:{front.server.server_address[1]}"

    def send(method, path, body=None, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, body, headers, method=method), timeout=10) as r:
                return r.status
        except urllib.error.HTTPError as e:
            return e.code

    good = {"Last-Modified": "Wed, 01 Jan 2020 00:00:00 GMT"}
    assert [send("PUT", "/s/a/1", b"<r><t>1</t></r>", **good), send("PUT", "/s/b", b"<r/>", **{"Last-Modified": "x"}), send("PUT", "/q/b", b"<r/>"), send("DELETE", "/s/zz"), send("POST", "/s/_commit"), send("GET", "/s/a")] == [202, 400, 404, 202, 204, 405]
    run = lambda: stream(spark, c, str(tmp_path / "out"), str(tmp_path / "landing"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    committed(c, {"ix": index})
    assert [r["id"] for r in index.read().collect()] == ["a/1"] and index.metadata("s")[LAST] == "2020-01-01T00:00:00Z"
    send("PUT", "/s/late", b"<r/>", **good)
    send("DELETE", "/s/a/1")
    send("PUT", "/s/c", b"<r/>")
    front.stop()
    run()
    assert [r["id"] for r in index.read().collect()] == ["c"]
    assert "seq" in EVENT


CONFIG = """<c:config xmlns:c="urn:c" xmlns:s="urn:sys"><c:metadata xmlns:d="urn:d"><c:variables><c:variable name="v">/d:r/d:t</c:variable></c:variables>
<c:filters default="accept"><c:deny>$s:harvesterIdentifier='no'</c:deny></c:filters>
<c:fields><c:xml-field name="xml"/><c:field name="t" datatype="string">$v</c:field>
<c:field-template name="b" datatype="number" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:choose><xsl:when test="/d:r/d:t">1.0</xsl:when><xsl:otherwise>5.0</xsl:otherwise></xsl:choose></c:field-template></c:fields></c:metadata>
<c:sources targetIndex="ix"><c:targetIndex><c:nameSuffix1>_1</c:nameSuffix1><c:nameSuffix2>_2</c:nameSuffix2></c:targetIndex><c:globalProperties><c:bulkSize>10</c:bulkSize></c:globalProperties>
<c:harvester id="h"><c:class>x.y.DirectoryHarvester</c:class><c:properties><c:directory>in</c:directory>EXTRA</c:properties></c:harvester></c:sources></c:config>"""


def test_config(spark, tmp_path):
    f = tmp_path / "c.xml"
    f.write_text(CONFIG.replace("EXTRA", ""))
    c = read_config(f)
    assert c.indexes[0].sources[0].kind == "directory" and c.indexes[0].sources[0].options == {"bulkSize": "10", "directory": "in"}
    got = evaluated(docs(spark, ("a", '<r xmlns="urn:d"><t>q</t></r>', None, False), ("b", "<r/>", None, False)), c.pipeline, "h").orderBy("id").collect()
    assert [(r["op"], r["t"], r["b"]) for r in got] == [("index", ["q"], [1.0]), ("index", [], [5.0])]
    assert evaluated(docs(spark, ("a", "<r/>", None, False)), c.pipeline, "no").first()["op"] == "delete"
    f.write_text(CONFIG.replace("EXTRA", "<c:colour>red</c:colour>"))
    with pytest.raises(ConfigError):
        read_config(f)
    f.write_text(CONFIG.replace("EXTRA", "").replace("<c:fields>", "<c:fields><c:nonsense/>"))
    with pytest.raises(ConfigError):
        read_config(f)


def test_spec_checks():
    with pytest.raises(ConfigError):
        FieldSpec("x", Expression("/a"), "XHTML")
    with pytest.raises(ConfigError):
        FieldSpec("x", Expression("/a"), "STRING", "d")
    with pytest.raises(ConfigError):
        PipelineSpec([FieldSpec("xml", Expression("/a"))]).check()
    with pytest.raises(ConfigError):
        PipelineSpec([FieldSpec("a", Expression("/a["))]).check()
    assert FieldSpec("x", Expression("/a"), "BOOLEAN", "yes").default == "yes"


def test_oai_stream_offsets():
    head = f"<OAI-PMH {OAI}><responseDate>2020-01-05T00:00:00Z</responseDate><ListRecords>"
    rec = lambda i: f"<record><header><identifier>{i}</identifier><datestamp>2020-01-01</datestamp></header><metadata><r/></metadata></record>"
    bodies = {"": head + rec(1) + rec(2) + "<resumptionToken>t</resumptionToken></ListRecords></OAI-PMH>", "t": head + rec(3) + "</ListRecords></OAI-PMH>"}
    reader = StreamReader({"baseurl": "http://x", "metadataprefix": "p"}, lambda url: Response(url, 200, {}, bodies["t" if "resumptionToken=t" in url else ""].encode()))
    one, end = reader.read(reader.initialOffset())
    two, last = reader.read(end)
    assert [(r[0], r[5]) for r in (*one, *two)] == [("1", 0), ("2", 1), ("3", 2)] and list(reader.read(last)[0]) == [] and [r[0] for r in reader.readBetweenOffsets(end, last)] == ["3"]


def test_own_system_variables(spark):
    spec = PipelineSpec([FieldSpec("who", Expression("concat($docIdentifier, '/', $place)"))])
    got = evaluated(docs(spark, ("a", "<r/>", None, False)).withColumn("p", F.lit("here")), spec, "s", more={"place": F.col("p")})
    assert got.first()["who"] == ["a/here"]

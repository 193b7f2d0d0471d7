import math

import pytest
from pyspark.sql import functions as F

from gleanery.functions import dates, scalars
from gleanery.functions import xpath as X
from gleanery.functions.template import Template, TemplateError
from gleanery.functions.xmljson import Multi, to_json
from gleanery.functions.xmltree import XmlError, parse, serialize, walked_text
from gleanery.functions.xsd import Schema

DOC = '<d:a xmlns:d="u" x="1"><d:b>t1</d:b><d:b k="2">t2<c/>tail</d:b><!-- c --><e><![CDATA[x<y]]></e></d:a>'
NS = {"q": "u"}


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("count(//q:b)", 2.0), ("string(/q:a/q:b[2])", "t2tail"), ("name(/*)", "d:a"), ("namespace-uri(/*)", "u"), ("//q:b[last()]/@k = 2", True), ('substring("12345", 2, 3)', "234"), ('substring("12345", 1.5, 2.6)', "234"),
        ('substring-before("1999/04/01","/")', "1999"), ('substring-after("1999/04/01","/")', "04/01"), ("-3 mod 2", -1.0), ("5 div 2", 2.5), ("not(/zz)", True), ('translate("--aaa--","abc-","ABC")', "AAA"),
        ("round(-2.5)", -2.0), ("2*3+4", 10.0), ("count(//q:b | //q:b)", 2.0), ("boolean(//zz)", False), ("//q:b = 't1'", True), ("//q:b != 't1'", True), ('normalize-space("  a  b ")', "a b"), ("string(1 div 0)", "Infinity"),
        ("count(//e/preceding-sibling::*)", 2.0), ("string(//e/preceding-sibling::*[1]/@k)", "2"), ("count(//@*)", 2.0), ("local-name(//*[local-name()='b'][1])", "b"), ("string-length('abc')", 3.0), ("$v + 1", 5.0), ("starts-with('abc','ab') and contains('abc','c')", True),
        ("string(0.1)", "0.1"), ("string(100)", "100"), ("number('x') = number('x')", False), ("sum(//@*)", 3.0), ("string(//e)", "x<y"),
    ],
)
def test_xpath(expression, value):
    assert X.evaluate(expression, parse(DOC), NS, {"v": 4.0}) == value


@pytest.mark.parametrize("bad", ["//z:b", "nope()", "1 +", "//", "a[", "$unknown", "substring('a')"])
def test_xpath_errors(bad):
    with pytest.raises(X.XPathError):
        X.evaluate(bad, parse(DOC), NS)


def test_xpath_nan_and_extension():
    assert math.isnan(X.evaluate("number('x')", parse(DOC)))
    X.extension("urn:f", "twice", lambda c, v: X.string(v) * 2)
    assert X.evaluate("f:twice('ab')", parse(DOC), {"f": "urn:f"}) == "abab"


def test_tree():
    assert serialize(parse(DOC)) == '<d:a xmlns:d="u" x="1"><d:b>t1</d:b><d:b k="2">t2<c/>tail</d:b><e>x&lt;y</e></d:a>'
    assert walked_text(parse("<a>x<b>y</b></a>")).strip() == "x\ny"
    assert serialize(parse('<a xmlns="u"><b xmlns=""/></a>')) == '<a xmlns="u"><b xmlns=""/></a>'
    with pytest.raises(XmlError):
        parse("<a>")


@pytest.mark.parametrize(
    ("xml", "json"),
    [('<a x="1"><b>1</b><b>2</b></a>', '{"@x":"1","b":["1","2"]}'), ("<a><b/></a>", '{"b":null}'), ("<a><__AT_k>v</__AT_k></a>", '{"@k":"v"}'), ("<a> <b>1</b> </a>", '{"b":"1"}'), ("<a/>", None), ('<a xmlns:i="http://www.w3.org/2001/XMLSchema-instance"><n i:type="xs:int">5</n></a>', '{"n":5}')],
)
def test_json(xml, json):
    assert to_json(parse(xml).elements()[0]) == json


@pytest.mark.parametrize("xml", ["<a>t<b/></a>", '<a x="1">t</a>'])
def test_json_mixed(xml):
    with pytest.raises(ValueError):
        to_json(parse(xml).elements()[0])


def test_multi():
    m = Multi()
    m.put("none")
    m.put("a", 1)
    m.put("b", 1, 2)
    m.put("c", Multi())
    assert m.json() == '{"a":1,"b":[1,2],"c":null}'


@pytest.mark.parametrize(
    ("text", "iso"),
    [("2004", "2004-01-01T00:00:00"), ("2004-05", "2004-05-01T00:00:00"), ("2004-05-06", "2004-05-06T00:00:00"), ("2004-05-06T", "2004-05-06T00:00:00"), ("2004-05-06T01:02:03Z", "2004-05-06T01:02:03"), ("2004-05-06T01:02:03+01:00", "2004-05-06T00:02:03"), ("2004-05-06 10:00", "2004-05-06T10:00:00"), ("2004-13-01", "2005-01-01T00:00:00"), ("2005-13-07", "2006-01-07T00:00:00"), ("Jan 5, 2004", "2004-01-05T00:00:00"), ("2004-05-06T25:00:00", "2004-05-07T01:00:00"), ("2004-05-06T01:02:03.5Z", "2004-05-06T01:02:03.005000")],
)
def test_lenient_dates(text, iso):
    assert dates.parse(text).replace(tzinfo=None).isoformat() == iso


@pytest.mark.parametrize("text", ["2004-05-06x", "01:02:03Z", "2004-05-06T25:00:00Z", "", "x", "2004-05-06T01:02:03.123456Z"])
def test_bad_dates(text):
    with pytest.raises(ValueError):
        dates.parse_millis(text)


def test_year_takes_all_digits():
    assert dates.parse_millis("20040506") > 6e17


def test_template():
    xsl = 'xmlns:xsl="http://www.w3.org/1999/XSL/Transform"'
    t = Template(f'<t {xsl} xmlns:q="u"><xsl:for-each select="/q:a/q:b"><xsl:sort select="." order="descending"/><k n="{{position()}}"><xsl:value-of select="."/></k></xsl:for-each></t>')
    assert [serialize(n) for n in t.run(parse(DOC))] == ['<k n="1">t2tail</k>', '<k n="2">t1</k>']
    with pytest.raises(TemplateError):
        Template(f"<t {xsl}><xsl:number/></t>")


def test_schema():
    s = Schema('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="a"><xs:complexType><xs:sequence><xs:element name="b" type="xs:int" maxOccurs="2"/><xs:element name="c" minOccurs="0" type="xs:string"/></xs:sequence><xs:attribute name="k" default="d"/></xs:complexType></xs:element></xs:schema>')
    assert s.check(parse("<a><b>1</b><c/></a>")) == []
    assert s.check(parse("<a><b>x</b></a>")) and s.check(parse("<a/>")) and s.check(parse("<a><b>1</b><b>1</b><b>1</b></a>")) and s.check(parse("<z/>")) and s.check(parse('<a q="1"><b>1</b></a>'))
    doc = parse("<a><b>1</b></a>")
    assert s.check(doc, augment=True) == [] and doc.elements()[0].attr("k") == "d"


def test_scalars(spark):
    one = spark.range(1)
    got = lambda *c: one.select(*c).first()
    words = [scalars.boolean_word(F.lit(w)) for w in ("yes", "On", "TRUE", "no", "off", "False", "1", "t", "")]
    assert list(got(*words)) == [True] * 3 + [False] * 3 + [None] * 3
    assert list(got(*(scalars.number(F.lit(t)) for t in ("1.5", "1d", " 2 ", "abc", "", "1e3", "0x1")))) == [1.5, 1.0, 2.0, None, None, 1000.0, None]
    assert list(got(*(scalars.integer(F.lit(t)) for t in ("12", "-3", "12.5", "", "99999999999999999999")))) == [12, -3, None, None, None]
    d = [scalars.index_text(scalars.oai_date(F.lit(t))) for t in ("2004-05-06", "2004-05-06T01:02:03Z", "2004-05-06T01:02:03", "2004-02-30")]
    assert list(got(*d)) == ["2004-05-06T00:00:00.000Z", "2004-05-06T01:02:03.000Z", None, None]
    assert got(scalars.split_list(F.lit("a, b;c d a")))[0] == ["a", "b", "c", "d"]
    assert got(scalars.java_trim(F.lit("\t\x01 a b\r\n")))[0] == "a b"
    assert got(scalars.index_text(scalars.epoch_millis(F.lit(5))), scalars.epoch_millis(F.lit(-1)))[:] == ("1970-01-01T00:00:00.005Z", None)


def test_helpers():
    assert scalars.byte_size("5MB") == 5 << 20 and scalars.byte_size("7") == 7
    assert scalars.host_port("a:1", 9) == ("a", 1) and scalars.host_port("[::1]:2", 9) == ("::1", 2) and scalars.host_port("::1", 9) == ("::1", 9)

"""Column functions against the standard library, on edge cases and random text."""

from __future__ import annotations

import html
import random
import re
import unicodedata
from datetime import date, timedelta
from urllib.parse import parse_qsl, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from postlake.functions import dates as D
from postlake.functions import html as H
from postlake.functions import text as T
from postlake.functions import urls as U
from postlake.functions import xml as X
from postlake.functions.entities import unescape


def apply(spark, values, fn, schema="i int, x string"):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, schema).select("i", fn(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(out, key=lambda r: r.i)]


def random_texts(alphabet, n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def ascii_words(value):
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", value or "") if ord(ch) < 128)
    return " ".join(re.findall("[a-z0-9]+", plain.lower()))


def test_norm_text(spark):
    cases = ["Sr. ML Engineer — LLMs", "A—B", "", None, "  x ", "Straße ﬁn ½ ™ …", "ÉÀü Ω 漢字", "a b", "𝐀𝟗 😀x", "Å№⑳"]
    pool = [chr(c) for c in list(range(32, 700)) + [0x1E9E, 0x2122, 0x2153, 0xFB01, 0xFF21, 0x1D400, 0x1F100, 0xAC00]]
    cases += random_texts(pool, 200, 1)
    assert apply(spark, cases, T.norm_text) == [ascii_words(c) for c in cases]


def test_title_and_location_forms(spark):
    assert apply(spark, ["Sr. SWE II", "sre"], T.norm_title) == ["senior software engineer ii", "sre"]
    assert apply(spark, ["U.S.", "U.S.A.", "United States of America", "Us-East", None], T.norm_location) == ["us", "usa", "united states", "us east", ""]


def test_unescape(spark):
    cases = ["&amp;lt;", "a&b", "&copy;&nbsp;&middot;", "&notit;", "&ampx", "&#128512;", "&#x80;", "&#0;", "&#xD800;", "&#1;",
             "&#99999999999999999999;", "&#x110000;", "&unknown;", "&;", "&&amp;", "&#65", "&#x41z", "&AMP", "&NotEqualTilde;", "&#xffff;", "&#13;", "&lt", "&ltx;", None, "plain",
             "&amp;" * 50, "&#x000000000000041;"]
    rng = random.Random(5)
    bits = ["&", "amp", ";", "#", "x", "12", "lt", "not", "in", " ", "copy", "e", "frac12", "<"]
    cases += ["".join(rng.choice(bits) for _ in range(12)) for _ in range(300)]
    assert apply(spark, cases, unescape) == [None if c is None else html.unescape(c) for c in cases]


URL_FORMS = {
    "https://Ex.com/jobs//1/?utm_source=x&b=2&a=1#top": "https://ex.com/jobs/1?a=1&b=2",
    "HTTP://E.com": "http://e.com",
    "": "",
    " https://e.com/a?x ": "https://e.com/a?x=",
    "jobs/1": "https:jobs/1",
    "   ": "https://",
    "//e.com/x/": "https://e.com/x",
    "https://e.com/a?q=a+b&c=%zz&d=~*&e=%7E%2A&f=é&=v&&k=": "https://e.com/a?=v&c=%25zz&d=~%2A&e=~%2A&f=%C3%A9&k=&q=a+b",
    "mailto:a@b": "mailto:a@b",
    "https://user:P@E.com:80/A%20b/c d": "https://user:p@e.com:80/A%20b/c d",
    "/x/y/": "https:///x/y",
    "https://e.com/?ref=1&Ref=2&GH_SRC=3&utm_=4&reference=5": "https://e.com?reference=5",
}


def test_norm_url(spark):
    assert apply(spark, list(URL_FORMS), U.norm_url) == list(URL_FORMS.values())
    assert apply(spark, [None], U.norm_url) == [""]


def test_norm_url_keeps_other_pairs_and_is_stable(spark):
    rng = random.Random(7)
    bits = ["/", "?", "&", "=", "a", "B", "%20", "+", "#f", "é", "%", "~", "c=1"]
    urls = ["https://h.com/x" + "".join(rng.choice(bits) for _ in range(9)) for _ in range(200)]
    once = apply(spark, urls, U.norm_url)
    assert apply(spark, once, U.norm_url) == once
    for before, after in zip(urls, once):
        assert parse_qsl(urlsplit(after).query, keep_blank_values=True) == sorted(parse_qsl(urlsplit(before).query, keep_blank_values=True))
        assert "#" not in after and "//" not in urlsplit(after).path


def test_resolve_url(spark):
    base = "https://h.com/a/b/c.html?q=1#f"
    hrefs = ["x", "/x", "//o.com/y", "https://o.com/z#k", "../x", "../../../x", "./", "..", "?n=2", "#top", "x/../y?z=1", "mailto:a@b", "a//b", "/a/./b/../c", "http://p.com", ""]
    got = apply(spark, hrefs, lambda c: U.resolve_url(F.lit(base), c))
    assert got == [urljoin(base, h) for h in hrefs]
    assert apply(spark, ["x", "/y"], lambda c: U.resolve_url(F.lit("https://h.com"), c)) == ["https://h.com/x", "https://h.com/y"]


def test_query_param_takes_last(spark):
    assert apply(spark, ["https://h/?s=1&s=2", "https://h/"], lambda c: U.query_param(c, "s")) == ["2", None]


@pytest.mark.parametrize("text", ["2026-07-18", "2026-07-18T10:00:00Z", "20260718", "2026-W29-6", "2026W296", "2026-W29", "2026-7-18", "2026-02-30", "x", "", "2020-W53-1", "2021-W53-1", "0000-01-01", "2026-W00-1", "20260718T1", "2026-W296", "20260718T101500", "2026W296xx", "2026W2", "202607181"])
def test_iso_date(spark, text):
    try:
        expected = date.fromisoformat(text[:10])
    except ValueError:
        expected = None
    assert apply(spark, [text], D.iso_date) == [expected]


def test_other_dates(spark):
    assert apply(spark, ["07/17/26", "7/1/2026", "13/1/26", "1/2/126", "2/30/26"], D.us_date) == [date(2026, 7, 17), date(2026, 7, 1), None, date(126, 1, 2), None]
    assert apply(spark, ["Fri, 17 Jul 2026 23:30:00 -0700", "17 Jul 2026 00:00:00 GMT", "nope"], D.rfc_date) == [date(2026, 7, 17), date(2026, 7, 17), None]
    assert apply(spark, ["1784332800000", "abc", None], D.epoch_ms_date) == [date(2026, 7, 18), None, None]
    assert apply(spark, ["1784332800", "0"], D.epoch_s_date) == [date(2026, 7, 18), None]
    assert apply(spark, ["2026-07-18", "07/18/26", "Sat, 18 Jul 2026 00:00:00 GMT", " 2026-07-18 "], D.any_date) == [date(2026, 7, 18)] * 4


def test_relative_dates(spark):
    today = date(2026, 7, 20)
    texts = ["Posted Today", "just posted", "Posted Yesterday", "Posted 10 Days Ago", "Posted 1 Day Ago", "Posted 30+ Days Ago", "posted more than 30 days ago", "2026-07-18", "not a date", " Posted  3 Days Ago "]
    back = [0, 0, 1, 10, 1, 30, 30, 2, None, 3]
    got = apply(spark, texts, lambda c: D.relative_date(c, F.lit(today)))
    assert got == [None if b is None else today - timedelta(days=b) for b in back]


def test_strip_html(spark):
    page = "<p>A &amp; B</p><script>var x='<b>';</script> c d<br>e"
    assert apply(spark, [page], H.strip_html) == ["A & B var x=' '; c d e"]
    assert apply(spark, [page], lambda c: H.strip_html(c, True)) == ["A & B c d e"]
    lines = "<p><b>ID: 1<br>Area: X</b></p>\n  <p> </p><li>Y  z</li>"
    assert apply(spark, [lines], H.strip_html_lines) == ["ID: 1\nArea: X\nY z"]


def test_attributes_and_meta(spark):
    assert apply(spark, [' href="/a?x=1&amp;y=2" title=\' T \''], lambda c: H.attribute(c, "href")) == ["/a?x=1&y=2"]
    assert apply(spark, [' href="/a" title=\' T \'', ""], lambda c: H.attribute(c, "title")) == ["T", None]
    metas = ['<meta name="description" content="D1">', "<meta content='D2' property='description'>", "<p>"]
    assert apply(spark, metas, lambda c: H.meta_content(c, "description")) == ["D1", "D2", None]


def test_labelled_field(spark):
    def field(c):
        return H.labelled_field(H.label_pairs(c, H.DT_DD), H.label_pairs(c, H.LABEL_VALUE_DIVS), H.strip_html(c, True), ["location", "place"])

    div = '<div class="article__content__view__field__label">Place</div> <div class="article__content__view__field__value">Oslo</div>'
    pages = ["<dt>Location</dt> <dd>Bern</dd>" + div, div, "<p>Place: Rome | x</p><p>Location: Paris • y</p>", "<dt>Location</dt><dd> </dd>" + div, "<p>none</p>", "Location: " + "x" * 300]
    assert apply(spark, pages, field) == ["Bern", "Oslo", "Paris", None, None, "x" * 300]


def test_line_field_stays_on_its_line(spark):
    text = "Location:\nWork Area: Design\n Location: Ulm "
    assert apply(spark, [text], lambda c: H.line_field(c, "Location")) == ["Ulm"]
    assert apply(spark, [text], lambda c: H.line_field(c, "location")) == [None]


def test_json_ld(spark):
    def title(c):
        from postlake.functions import variants as V

        return V.text(H.json_ld_posting(c), "title")

    def script(body):
        return f'<script id=x type="application/ld+json">{body}</script>'

    pages = [
        script('{"@type":"JobPosting","title":"a"}'),
        script("{bad") + script('[{"@type":"Org"},{"@type":["X","JobPosting"],"title":"b"}]'),
        script('{"@graph":[{"@type":"Org"},{"@graph":[{"@type":"JobPosting","title":"c"}]}]}'),
        script('{"@type":"JobPosting","title":"&quot;q&quot;"}').replace('"title":"&quot;q&quot;"', '"title":"R&amp;D"'),
        "<p>no script</p>",
        script('{"@type":"Org"}') + script('{"@type":"JobPosting","title":"d"}'),
    ]
    assert apply(spark, pages, title) == ["a", "b", "c", "R&D", None, "d"]


def test_title_case_words(spark):
    assert apply(spark, ["FULL_TIME", "part time", "CONTRACTOR"], T.title_case_words) == ["Full-Time", "Part Time", "Contractor"]


def feed_of(spark, *bodies):
    return apply(spark, list(bodies), lambda c: X.xml_feed(c))


def shown(record):
    return "|".join(f"{f.key}={f.value}" for f in record)


def test_xml_fields(spark):
    feed = """<?xml version="1.0"?><rss xmlns:g="urn:x"><channel><item><title>A &amp;amp; B</title><ref-number>00123</ref-number>
      <g:Job_Type>Full</g:Job_Type><!-- no --><info><division>D</division></info><blank> </blank>
      <description><![CDATA[<p>x</p> & y]]> tail</description></item></channel></rss>"""
    (found,) = feed_of(spark, feed)
    assert found.error is None
    assert shown(found.records[0]) == "title=A & B|refnumber=00123|jobtype=Full|info=D|division=D|description=<p>x</p> & y tail"
    assert apply(spark, ["<?xml?>", "  <jobs>", "<jobsx>", "<html>"], X.is_xml) == [True, True, False, False]


def test_xml_records_at_any_depth(spark):
    deep = "<jobs><a><b><job><c><d><e><f><g><title>five down</title></g></f></e></d></c></job></b></a></jobs>"
    inside = "<jobs><job><title>outer</title><related><job><title>inner</title></job></related></job></jobs>"
    same = "<data><item><item><location>x</location><location>y</location></item></item></data>"
    got = feed_of(spark, deep, inside, same)
    assert [shown(r) for r in got[0].records][0].endswith("title=five down")
    assert [[f.value for f in r if f.key == "title"] for r in got[1].records] == [["outer", "inner"], ["inner"]]
    assert [[f.value for f in r if f.key == "location"] for r in got[2].records] == [["x", "y"], ["x", "y"]]


def test_xml_fallback_and_broken_documents(spark):
    got = feed_of(spark, "<data><row><id>1</id></row><row><id>2</id></row></data>", "<data><row><id>1</id></row><flat/></data>", "<data/>", "<jobs><job><title>cut", "", None, "<jobs><g:x/></jobs>")
    assert [len(g.records) for g in got] == [2, 0, 0, 0, 0, 0, 0]
    assert [g.error is None for g in got] == [True, True, True, False, False, False, False]


def test_articles_of_links_against_brute_force(spark):
    import random
    import re as regex

    draw = random.Random(6)
    pieces = ["<article class='x'>", "</article>", '<a href="/j">in</a>', '<a title="t" href="/k"><b>bold</b></a>', " text ", "<p>é</p>", "<a href='/m'><article></a>", "<area>"]
    pages = ["".join(draw.choices(pieces, k=draw.randrange(0, 25))) for _ in range(60)] + ["", None]
    got = apply(spark, pages, lambda c: H.linked_articles(c))

    def around(page, start, end):
        before, after = page[:start], page[end:]
        if "<article" not in before or "</article>" not in after:
            return None
        return before[before.rindex("<article") :] + page[start:end] + after[: after.index("</article>") + len("</article>")]

    for page, found in zip(pages, got, strict=True):
        matches = list(regex.finditer(r"(?is)<a\b([^>]*?)>(.*?)</a>", page or ""))
        assert [(x.attrs, x.inner) for x in found.links] == [(m[1], m[2]) for m in matches]
        assert [found.articles[x.article] if x.article >= 0 else None for x in found.links] == [around(page, m.start(), m.end()) for m in matches]
        assert len(set(found.articles)) <= len(found.articles)

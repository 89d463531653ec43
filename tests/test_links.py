"""Link extraction details: tag/attribute order, quoting, entities, comments, scripts and media types."""

import random
import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import functions as F

from exposa.functions import fixed
from exposa.functions import references as R
from exposa.operators import discovery as D
from exposa.sources.captures import as_captures

HTML = ('<html><body><!-- <a href="/commented">x</a> -->'
        '<a title="a>b" href="/quoted-gt">q</a>'
        "<img alt='x' src='/img.png'>"
        '<a href=/bare?x=1&amp;y=2>b</a>'
        '<script src="/app.js">var s = "<a href=\\"/in-script\\">";</script>'
        '<a href="mailto:x@y">m</a><a href="#top">t</a><a href="">e</a>'
        '<A HREF="/upper">u</A><link rel="x" href="/style.css">'
        '</body></html>')


def captures(spark, rows):
    return as_captures(spark.createDataFrame(rows, "url string, content_type string, body string"))


def test_html_links(spark):
    rows = D.html_links(captures(spark, [("https://ex.com/dir/page", "text/html", HTML)])).orderBy("tag_rank", "pos").collect()
    got = [(r.context, r.url) for r in rows]
    assert got == [
        ("a.href", "https://ex.com/quoted-gt"),
        ("a.href", "https://ex.com/bare?x=1&y=2"),
        ("a.href", "https://ex.com/upper"),
        ("img.src", "https://ex.com/img.png"),
        ("script.src", "https://ex.com/app.js"),
        ("link.href", "https://ex.com/style.css"),
    ]
    assert all(r.in_scope for r in rows)


def hrefs(spark, html, content_type="text/html"):
    return [r.href for r in D.html_links(captures(spark, [("https://ex.com/", content_type, html)])).orderBy("pos").collect()]


def test_attributes_are_whole_names(spark):
    assert hrefs(spark, '<a href="/real" title="see href=/fake">x</a><a data-href="/no" href=/yes>y</a>'
                        '<a href="/first" HREF = \'/last\'>z</a><a xhref="/no">n</a><a href>e</a><a title="a>b" href="/c">q</a>') == [
        "/real", "/yes", "/last", "/c"]


def test_character_references(spark):
    assert hrefs(spark, '<a href="/caf&#233;&#xE9;&eacute;">1</a><a href="/?a=1&amp;b=2&c=3">2</a><a href="/&amp;lt;&unknown;&#0;&#x110000;">3</a>'
                        '<a href="/&#128512;&#xD800;">4</a>') == [
        "/caf\u00e9\u00e9\u00e9", "/?a=1&b=2&c=3", "/&lt;&unknown;&#0;&#x110000;", "/\U0001F600&#xD800;"]


def parsed(html):
    """(tag, value) of the link attributes, in page order, by the standard library's parser."""
    out = []

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            names = dict(fixed.LINK_TAG_ATTRS)
            if tag in names and dict(attrs).get(names[tag]):
                out.append(dict(attrs)[names[tag]])

        handle_startendtag = handle_starttag
    Parser().feed(html)
    return out


def test_random_tags_against_a_parser(spark):
    """Quotes in odd places, bare values, missing white space, slashes, and references of every kind."""
    r = random.Random(11)
    names = sorted(html5)
    values = ["/a", "/b?x=1", "/it's", '/say"x', "/a>b", "/c/", "p q", "/\u00e9", "", "/x=y", "/#f"]
    pages = []
    for _ in range(300):
        page = ""
        for _ in range(r.randrange(1, 6)):
            value = r.choice(values)
            for _ in range(r.randrange(3)):
                name = r.choice(names)
                value += r.choice([f"&{name}", f"&{name};", f"&{name.rstrip(';')}", f"&{name.rstrip(';')}{r.choice('xyz=1')}", "&#65;", "&#x42", "&#150;",
                                   "&#0067", "&", "&&", "&;", "&amp;amp;", "&nosuchname;", "&\u00e9;"])
            quote = r.choice(['"', "'", ""])
            value = value.replace(quote, "") if quote else re.sub(r"[\s>\"']", "", value) or "v"
            pairs = [f"href{r.choice(['=', ' = ', '= '])}{quote}{value}{quote}"]
            pairs += r.sample(["title=it's", "class='a>b'", 'alt="x\'y"', "disabled", "data-href=/no", "/", "x-y='1'", "HREF2=/no"], r.randrange(4))
            r.shuffle(pairs)
            page += f"<{r.choice(['a', 'A', 'link', 'abbr', 'b'])} {r.choice([' ', chr(10), '  ']).join(pairs)}{r.choice(['', ' ', ' /'])}>text it's "
        pages.append(page)
    caps = captures(spark, [(f"https://ex.com/{i}", "text/html", p) for i, p in enumerate(pages)])
    tags = F.regexp_extract_all("body", F.lit(D.TAG_REGEX), 0)
    got = {u: v for u, v in caps.select("url", F.transform(tags, lambda t: R.decode(D.attribute(t, "href"))).alias("v")).collect()}
    for i, p in enumerate(pages):
        assert [v for v in got[f"https://ex.com/{i}"] if v] == parsed(p), p


def test_every_named_reference(spark):
    cases = [f"&{n}" for n in html5] + [f"/{n}&{n}x" for n in html5] + ["&notit;", "&ampamp;", "&lt", "&g", "&;", "&&lt;&", "&" + "a" * 60 + ";", "&#x;", "&#;"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for c, v in df.select("c", R.decode(F.col("c"))).collect():
        assert v == unescape(c), c


def test_unclosed_quote_does_not_swallow_the_page(spark):
    assert hrefs(spark, '<a href="/lost>x</a><p>text</p><a href=/found>y</a>') == ["/found"]


def test_missing_content_type_is_html(spark):
    assert hrefs(spark, '<a href="/x">x</a>', None) == hrefs(spark, '<a href="/x">x</a>', "") == ["/x"]
    assert hrefs(spark, '<a href="/x">x</a>', "text/plain") == []


def test_scripts_and_style_sheets_of_their_own(spark):
    caps = captures(spark, [("https://ex.com/a.js", "application/javascript", 'get("/api/x"); c = "https://ex.com/y.js";'),
                            ("https://ex.com/s.css", "text/css", "b { background: url(/i.png) } @import '/t.css';"),
                            ("https://ex.com/", "text/html", '<script>f("/in")</script><style>p { background: url(z.gif) }</style>')])
    assert {(r.page_url, r.url) for r in D.js_links(caps).collect()} == {
        ("https://ex.com/a.js", "https://ex.com/api/x"), ("https://ex.com/a.js", "https://ex.com/y.js"), ("https://ex.com/", "https://ex.com/in")}
    assert {(r.page_url, r.url) for r in D.css_links(caps).collect()} == {
        ("https://ex.com/s.css", "https://ex.com/i.png"), ("https://ex.com/s.css", "https://ex.com/t.css"), ("https://ex.com/", "https://ex.com/z.gif")}


def test_recaptured_page_keeps_its_links_once_per_capture(spark):
    caps = captures(spark, [("https://ex.com/", "text/html", '<a href="/x">x</a><a href="https://sub.ex.com/y">y</a>')] * 2)
    rows = D.html_links(caps).collect()
    assert len(rows) == 4
    assert {(r.url, r.in_scope, r.in_scope_with_subdomains) for r in rows} == {
        ("https://ex.com/x", True, True), ("https://sub.ex.com/y", False, True)}

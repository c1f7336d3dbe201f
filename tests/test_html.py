"""Pages as the standard library's parser reads them."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidal.operators import text

ODD = [
    '<a title="a>b">hello</a> world',
    "<p class='x > y' id=z>quoted</p>after",
    '<img alt = "1 > 0" src=x>picture<br/>line',
    "one<!-- <p>not text</p> -->two",
    "x<script>if (a < b) { s = '</p>'; }</script >y",
    '<SCRIPT type="a>b">code</Script>text<style>p > a {}</style>more',
    "a < b and c > d, 1<2",
    "&amp b &lt;tag&gt; &copy2024 &notit; &unknown; &#65 &#x42;&#67; &ampx; AT&T; &",
    "<!DOCTYPE html><?pi x?>doc",
    "<p>unclosed <b>bold<p>next",
    "",
    "plain",
    "<div data-x='\"' title=\"it's > that\">both quotes</div>tail",
    "<scripty>kept</scripty>",
    "<p\nclass=\"a\nb\"\n>many lines</p\n>end",
]


class Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        else:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        else:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def _parsed(page):
    p = Lines()
    p.feed(page)
    p.close()
    return "".join(p.out)


@pytest.fixture(scope="module")
def got(spark):
    pages = spark.createDataFrame(list(enumerate(ODD)), "n int, html string")
    return {r[0]: r[1] for r in pages.select("n", text.html_text(F.col("html"))).collect()}


@pytest.mark.parametrize("n", range(len(ODD)))
def test_equal_to_the_parser(got, n):
    assert got[n] == _parsed(ODD[n])


def _text(spark, page, **options):
    return spark.createDataFrame([(page,)], "html string").select(text.html_text(F.col("html"), **options)).first()[0]


def test_unclosed_parts_run_to_the_end(spark):
    assert _text(spark, "a<script>code") == "a"
    assert _text(spark, "a<!-- rest <p>x</p>") == "a"
    assert _text(spark, 'a<p class="x') == "a"


def test_short_comments_as_in_html_5(spark):
    assert _text(spark, "before<!-->after<!--->end<!--x--!>!") == "beforeafterend!"


def test_body(spark):
    page = '<html><head><title>t</title><!-- <body> --></head><body class="a>b">in{}</body>out</html>'
    assert _text(spark, page.format("side")).split() == ["inside"]
    cut = page.format("side").replace("</body>out</html>", "")
    assert _text(spark, cut).split() == ["t", "inside"]
    assert _text(spark, cut, open_body=True).split() == ["inside"]
    assert _text(spark, page.format("").replace(">in<", "><")).strip() == ""
    assert _text(spark, "<title>t</title>whole").split() == ["t", "whole"]


def test_parts_do_not_grow_together(spark):
    assert _text(spark, "<<!-- x -->b>") == "<b>"


def test_null_and_a_tag_of_many_attributes(spark):
    assert _text(spark, None) is None
    assert _text(spark, "<p" + ' a="x>y"' * 50_000 + ">end") == "\nend"
    assert _text(spark, "<" * 100_000) == "<" * 100_000


def test_references_without_a_semicolon_only_where_asked(spark):
    row = spark.createDataFrame([("&#65 &#x42;&copy2024 &amp;&ampx &eacute",)], "t string").select(
        text.decode_references(F.col("t")), text.decode_references(F.col("t"), unended=True)).first()
    assert tuple(row) == ("&#65 B&copy2024 &&ampx &eacute", "A B©2024 &&x é")

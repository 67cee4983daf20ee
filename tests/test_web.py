import pytest
from pyspark.sql import functions as F

from partloom.functions import web


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://www.frigidaire.com/x", True), ("https://shop.frigidaire.com:443/x", True),
        ("https://www.frigidaire.com:443@evil.com/x", False), ("https://user:a@b@www.frigidaire.com/", True),
        ("https://frigidwww.aire.com/x", False), ("https://evil.com\\@www.frigidaire.com", False), ("https://www.frigidaire.com.evil.com", False),
        ("HTTPS://WWW.FRIGIDAIRE.COM", True), ("https://evil.com/?@www.frigidaire.com", False), ("https://", False),
    ],
)
def test_allowlist(spark, url, want):
    assert one(spark, web.url_allowed(F.lit(url))) is want


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>&frac12; in &deg; &#8482; &#x2122; &eacute; &amp;lt; &#0; &#99999999999; &#xD800;", "½ in ° ™ ™ é &lt; � � �"),
        ("a<script>var x = 1", "a"), ("a<STYLE>p{}</style >b", "a b"), ("&copy; &middot; &nbsp;x", "© · x"), (None, ""),
        ("a<nav>b<NAV class='x'>c</nav>d</nav>e", "a e"), ("a<nav>b<header>c</nav>d</header>e", "a d e"), ("a</nav>b<nav/>c", "a b"),
        ("a<header>b<header>c</header>d", "a"), ("<nav>x<script>'</nav>'</script>y</nav>z", "z"), ("a<object><embed src='x'></object>b<embed>c", "a b c"),
        ("a<navy>b</navy><headers>c", "a b c"), ("<style>a<style>b</style>c", "c"), ("&#38;lt; &unknown; &amp;amp; & x; &frac34;", "&lt; &unknown; &amp; & x; ¾"), ("", ""),
    ],
)
def test_technical_text(spark, html, want):
    assert one(spark, web.technical_text(F.lit(html).cast("string"))) == want


def test_late_content_of_an_upload_is_seen(spark):
    content = F.encode(F.lit("a,b" + " " * 20000 + "<SCRIPT"), "UTF-8")
    assert one(spark, web.upload_verdict(F.lit("x.csv"), content)) == "ACTIVE_CONTENT"

"""The article of a page by a fold over its tags, against a parser with a stack."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from semblance.functions import html as H
from semblance.functions.text import normalize_ws


def _texts(spark, pages, of=H.page_text):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r.t for r in df.select("i", of(F.col("html")).alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>one</p></article><aside>ad</aside><article>two</article>", "one\ntwo"),
        ("<article>a<aside>x</article>b<article>c</article>", "a\nc"),
        ("<aside><article>other</article></aside><article>own</article>", "own"),
        ("<article>a<article>b</article>c</article>", "a\nb\nc"),
        ("<header>site</header><article><header><h1>head</h1></header><p>text</p><footer>by</footer></article>", "head\ntext"),
        ("<header>site</header><nav>menu</nav><div>one</div><p>two<footer>foot</footer>", "one\ntwo"),
        ("</article></nav><ARTICLE CLASS=x>a</Article >b", "a"),
        ("<article> <img src=x> </article><p>rest</p>", "rest"),
        ('<article><a title="x > y" href=z>link</a> 1 < 2 <b>bold</b></article>', "link 1 < 2 bold"),
        ("<article>a<script>var x='</article>'</script><style>p{}</style><!-- <aside> -->b</article>", "ab"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table>e<br/>f</article>", "a\nb\nc d\ne\nf"),
        ("<articles>all</articles><navy>x</navy>", "allx"),
        ("", None), (None, None), ("<nav>only</nav>", None),
    ],
)
def test_page_text(spark, page, text):
    assert _texts(spark, [page]) == [text]


def test_fields_in_any_form(spark):
    pages = [
        "<meta content='Ann' name=author><META NAME='Author' CONTENT=\"Bo &amp; Co\"><meta property='article:author' content='https://e.org/u'>",
        '<meta content="name=author" name="description"><meta name=author content="">',
        "<!-- <meta name=author content=x> --><meta itemprop=author content=C><meta name=author content=C>",
    ]
    assert _texts(spark, pages, H.page_authors) == ["Ann, Bo & Co", None, "C"]
    dates = ["<meta content=2024-01-02 property=article:published_time>", "<meta itemprop='datePublished' content='2023'>", ""]
    assert _texts(spark, dates, H.page_date) == ["2024-01-02", "2023", None]
    titles = ["<title>a < b</title><h1>c</h1>", "<meta property=og:title content='o'><h1>c</h1>", "<h1 class=x><b>c</b> d</h1>", ""]
    assert _texts(spark, titles, H.page_title) == ["a < b", "o", "c d", None]


class _Plain(HTMLParser):
    """Words with the elements open around them."""

    def __init__(self):
        super().__init__()
        self.stack, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag in H.HOMES:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        stack = self.stack
        silent = {t for t in stack if t not in ("article", "header")}
        early = "header" in stack and "article" not in stack[: stack.index("header")]
        self.words += [("s" if silent or early else "i" if "article" in stack else "o", w) for w in data.split()]


def test_generated_pages(spark):
    rng = random.Random(5)
    tags = ["article", "header", "aside", "nav", "footer", "p", "div", "b"]
    pages = []
    for _ in range(300):
        parts = []
        for n in range(rng.randrange(1, 40)):
            tag = rng.choice(tags)
            parts.append(rng.choice([f"<{tag}>", f"</{tag}>", f' w{n} ', f'<{tag} class="a">']))
        pages.append("".join(parts))
    for page, text in zip(pages, _texts(spark, pages)):
        parser = _Plain()
        parser.feed(page)
        inside = [w for home, w in parser.words if home == "i"]
        outside = [w for home, w in parser.words if home == "o"]
        assert (text or "").split() == (inside or outside), page


def test_long_pages(spark):
    n = 5_000
    pages = ["<article>" + "<aside>x</aside>y" * n + "</article>", "<aside>" * n + "x", "<article " + "a=b " * n + ">x", "<p a=\"" * n]
    start = time.time()
    texts = _texts(spark, pages)
    assert texts[0] == "\n".join(["y"] * n) and texts[1:3] == [None, "x"]
    assert time.time() - start < 60

"""Page operators over node rows give what the tree gives, page by page; markup of all kinds, whole, broken, empty and null."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagequarry.functions.urls import resolve_url
from pagequarry.operators import dom
from pagequarry.operators import nodes as N

BASE = "https://ex.org/d/e/f.html?k=v"
P80 = "<p> " + "x" * 79 + "<b> y</b> </p>"
MARKUP = [
    None,
    "",
    "plain & text",
    "<title></title><svg><title>S</title></svg><body><title> Two  words </title><h1>H<script>x</script> one</h1>",
    '<html lang=""><html lang="de"><meta property="og:title" content=" "><meta name="OG:Title" content=" T "><link rel="x Canonical" href="c"><h1><template>no</template></h1>',
    '<form>f</form><div class="my Cookies"><p>x</div><input type=checkbox checked>a<input type="checkbox"> b<input readonly value="a&<b"><input value=1><img alt="0a0a0a0a-0000-0000-0000-00000000000a" src=x><img width=1 height=0><p class="ad x">y<p class="adx">z',
    '<time>now</time><time datetime="">2024-02-03</time><meta name=date content="bad"><span itemprop="datePublished"><b>2024-05-</b><i>06</i></span>',
    '<meta property="article:published_time" content="2024-01-02T03:04:05Z"><time datetime="2023-01-01">x</time>',
    '<a href=" ../x?y#z ">1</a><a href="#f">2</a><a href="?q">3</a><a href="//h/p">4</a><a href="mailto:a@b">5</a><img src="./a/../b.png" srcset="a.png 1x,  b.png   2x, c.png"><a href="">e</a><a href="https://o.org/a/./b">6</a><video poster=/p src=..></video><source srcset="x, ,y 3w">',
    "<div>" * 3000 + "deep" + "<p>x" * 50,
    "<script>a<b&&c</script><style>p>q{}</style><pre>a\n b</pre><br/><foo bar='\"&'>t</foo>",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>",
    '<p class="a paywall  b" aria-hidden=true hidden id=q>x</p><p aria-hidden>y</p>',
    '<div class="share-box  Widget text">' + P80 * 5 + "<div class='sidebar'>" + P80 * 4 + "<p>" + "z" * 79 + " </p></div></div>",
    '<div class="w-embed x"><p><table></table></div><div class="w-embed"></div><div class="w-embed related">' + ("<p>" + "q" * 60 + "<script>" + "s" * 50 + "</script></p>") * 6 + '</div><template><div class="related k">' + ("<p>" + "q" * 90 + "</p>") * 5 + "<p> " + "r" * 80 + "</div></template>",
    "<div class='share'><p>" + "a" * 40 + "<li><div class='share'>" + ("<p>" + "b" * 90) * 5 + "</div>" + "c" * 40 + ("<p>" + "d" * 90) * 3,
    "<article><p>" + "long text " * 60_000 + "</article>",
]


@pytest.fixture(scope="module")
def pages(spark):
    given = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    return spark.createDataFrame([(i, BASE, h) for i, h in enumerate(MARKUP + given)], "page_id long, url string, html string").repartition(4)


@pytest.fixture(scope="module")
def nodes(pages):
    return N.page_nodes(pages)


def held(df, value, of):
    """of each page's markup equals what the rows say; one row a page."""
    rows = df.collect()
    got = {r.page_id: value(r) for r in rows}
    assert len(got) == len(rows)
    return rows and {k: v for k, v in got.items() if v != of(k)} == {}


@pytest.fixture(scope="module")
def markup(pages):
    return {r.page_id: r.html for r in pages.collect()}


def test_markup_written_again(nodes, markup):
    assert held(N.write_html(nodes), lambda r: r.html, lambda k: dom.to_html(dom.parse(markup[k])))


def test_preclean(nodes, markup):
    assert held(N.write_html(N.preclean(nodes)), lambda r: r.html, lambda k: dom.to_html(dom.preclean(dom.parse(markup[k]))))


@pytest.mark.parametrize("extra", [(), ("td", "div > p", "not a [selector")])
def test_clean(nodes, markup, extra):
    assert held(N.write_html(N.clean(nodes, extra)), lambda r: r.html, lambda k: dom.to_html(dom.clean(dom.parse(markup[k]), extra)))


def test_absolutify(nodes, pages, markup):
    assert held(N.write_html(N.absolutify(nodes, pages)), lambda r: r.html, lambda k: dom.to_html(dom.absolutify(dom.parse(markup[k]), BASE)))
    nowhere = N.absolutify(nodes, pages.withColumn("url", F.lit(None).cast("string")))
    assert held(N.write_html(nowhere), lambda r: r.html, lambda k: dom.to_html(dom.parse(markup[k])))


def test_metadata(nodes, markup):
    assert held(N.metadata(nodes), lambda r: {k: r[k] for k in dom.METADATA}, lambda k: dom.metadata(dom.parse(markup[k])))


def test_published_is_the_first_place_that_reads_as_a_date(nodes):
    got = {r.page_id: r.published and r.published.isoformat() for r in N.published(nodes).collect()}
    assert got[6] == "2024-02-03T00:00:00" and got[7] == "2024-01-02T03:04:05" and got[0] is None and got[2] is None


def test_stats(nodes, markup):
    def of(k):
        found = list(dom.parse(markup[k]).elements())
        depth = {id(found[0]): 0}
        for n in found[1:]:
            depth[id(n)] = depth[id(n.parent)] + 1
        depths, sizes = [depth[id(n)] for n in found[1:]], [len(n.attrs) for n in found[1:]]
        return (max(depths, default=0), len(depths), sum(depths), sum(isinstance(c, str) for n in found for c in n.children), max(len(n.children) for n in found), sum(sizes), max(sizes, default=0))

    assert held(N.stats(nodes), lambda r: tuple(r)[1:], of)


@pytest.mark.parametrize("selector", ["li", "ul li", "div > p", "article p b", "div div > p, td", "[class~='x' ]", "[class*=EMBED i] p", "#q", ".paywall.b", "bad [", "table > td"])
def test_selectors(nodes, markup, selector):
    rows = N.mark(nodes, selector, "hit").where("hit").groupBy("page_id").agg(F.count("*").alias("n")).collect()
    want = {k: len(dom.select(dom.parse(h), selector)) for k, h in markup.items()}
    assert {r.page_id: r.n for r in rows} == {k: n for k, n in want.items() if n}


def test_no_pages(spark):
    none = N.page_nodes(spark.createDataFrame([], "page_id long, html string"))
    assert N.write_html(N.clean(none)).collect() == [] and N.metadata(none).collect() == []


def test_addresses_resolve_as_the_standard_says(spark):
    bases = [BASE, "http://h", "http://h/", "http://h/a/b/?x#y", "https://u@h:8/a/b/c/d;p?q"]
    refs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "g#s", "g?y#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g?y/../x", "g#s/../x", " g ", "ftp://x/y"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string").select("base", "ref", resolve_url(F.col("ref"), F.col("base")).alias("got")).collect()
    assert [(r.base, r.ref, r.got) for r in rows if r.got != urljoin(r.base, r.ref.strip())] == []
    assert spark.range(1).select(resolve_url(F.lit("#a"), F.lit(BASE))).first()[0] == "#a"

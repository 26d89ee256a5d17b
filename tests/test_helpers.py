"""The plain functions behind the helpers: documents, blocks, the greedy choice, limits, formats."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators import dom, markdown_blocks, pages, recipes, sections, timed
from pagequarry.sources import formats
from pagequarry.sources.pages import read_pages

PAGE = """<html lang=en><head><title> A  page </title><meta property="og:title" content="Other"><link rel=canonical href=/c></head>
<body><nav><a href=/x>menu</a></nav><article><h1>Head</h1><p>First <b>bold</b> and <a href="y?z=1">link</a><p>Second, with * star
<ul><li>one<li>two<ol><li>deep</ol></ul><table><tr><th>k<th>v<tr><td>a|b<td>1</table><pre>code ` here</pre><blockquote>said</blockquote></article>
<script>var x = "<p>no</p>"</script><footer>end</footer></body></html>"""


def test_page_to_markdown():
    root = dom.parse(PAGE)
    meta = dom.metadata(root)
    assert meta["title"] == "A page" and meta["canonical"] == "/c" and meta["language"] == "en" and meta["og_title"] == "Other"
    md = dom.to_markdown(dom.main_content(dom.clean(dom.absolutify(root, "https://s.org/d/e"))))
    assert md.startswith("# Head\n\nFirst **bold** and [link](https://s.org/d/y?z=1)\n\nSecond, with \\* star\n\n- one\n- two\n  1. deep")
    assert "| a\\|b | 1 |" in md and "```\ncode ` here\n```" in md and "> said" in md and "menu" not in md and "no" not in md.split()


def test_titles_in_order():
    assert dom.metadata(dom.parse("<svg><title>no</title></svg><h1>H</h1>"))["title"] == "H"
    assert dom.metadata(dom.parse('<meta property="og:title" content="O"><h1>H</h1>'))["title"] == "O"


@pytest.mark.parametrize(
    ("selector", "n"),
    [("p", 3), ("#a", 1), (".x.y", 1), ("div > p", 1), ("div p", 2), ('[data-k="V" i]', 1), ("[data-k^=v], span", 2), ("p,", 0), ("[", 0), ("*", 5)],
)
def test_selectors(selector, n):
    root = dom.parse('<div class="x y"><p id=a>1</p><span><p data-k=v>2</p></span></div><p>3</p>')
    assert len(dom.select(root, selector)) == n


def test_hostile_markup_is_counted_not_parsed():
    stats = dom.markup_stats("<div>" * 20_000)
    assert stats["depth"] == 20_000
    assert dom.markup_stats(None)["elements"] == 0
    assert dom.to_html(dom.parse("<i>" * 5_000)).count("<i>") == 5_000


def test_actions():
    root = dom.parse("<div class='a b'><p hidden>x</p><u>y</u><i>z</i></div><section data-columns=2><p>1</p><p>2</p><p>3</p></section>")
    act = lambda **a: recipes.apply_actions(root, [a])
    act(action="remove-attr", selector="p", value="hidden")
    act(action="remove-class", selector="div", value="a")
    act(action="remove-element", selector="u")
    act(action="unwrap", selector="i")
    act(action="prepend-text", selector="div > p", value="> ")
    act(action="grid-to-table", selector="section")
    act(action="remove-element", selector="[[bad")
    html = dom.to_html(root)
    assert "hidden" not in html and 'class="b"' in html and "y" not in dom.squeezed(root.text()) and "<i>" not in html and "&gt; x" in html and html.count("<tr>") == 2


MD = "# A\n\ntext\nmore\n\n```\n# no\n```\n\n- one\n  two\n- three\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> q\n\n## B ##\n    code\n<div>x</div>\n\nend"


def test_blocks_cover_the_lines():
    blocks = markdown_blocks.parse_blocks(MD)
    assert [b[0] for b in blocks] == ["heading", "paragraph", "code", "list", "table", "blockquote", "heading", "code", "html", "paragraph"]
    lines = MD.split("\n")
    covered = {k for b in blocks for k in range(b[2], b[3] + 1)}
    assert all(k in covered or not line.strip() for k, line in enumerate(lines))
    assert all(b[4] == "\n".join(lines[b[2] : b[3] + 1]) for b in blocks)
    assert markdown_blocks.parse_blocks(None) == [] and markdown_blocks.parse_blocks("\n \n") == []


def test_random_blocks_are_ordered():
    random.seed(4)
    for _ in range(300):
        md = "\n".join(random.choices(["", "# h", "text", "```", "~~~", "- i", "> q", "| a |", "|---|", "    c", "<b>", "  x"], k=random.randrange(25)))
        blocks = markdown_blocks.parse_blocks(md)
        assert all(a[3] < b[2] for a, b in zip(blocks, blocks[1:])) and all(b[2] <= b[3] for b in blocks)


def test_limiter():
    allowed, wait, live = timed.verdicts([0, 1, 2, 10, 11, 12.5], 10, 2, [])
    assert allowed == [True, True, False, False, True, True] and wait[2] == 8 and live == [11, 12.5]


def test_stream_limiter_equals_batch(spark):
    from pagequarry.plans import all_queries

    queries = all_queries()[0]
    rows = lambda name: sorted(map(tuple, queries[name](spark, "/root/testdata/sf0.001").select("user_id", "event_id", "allowed").collect()))
    assert rows("rate_limit") == rows("stream_rate_limit")


def test_formats():
    assert formats.sniff("a;b\n1;2") == ";" and formats.sniff("sep=|\na|b") == "|" and formats.sniff('"x,y"\tz\n1\t2') == "\t"
    assert formats.to_table('a,b\n"x\ny|",2\n3') == "| a | b |\n| --- | --- |\n| x y\\| | 2 |\n| 3 |  |"
    assert formats.decode(b"\xef\xbb\xbfhi", None, False) == ("utf-8", "hi") and formats.decode(b"caf\xe9", None, False) == ("windows-1252", "café")
    assert formats.decode(b'<meta charset="iso-8859-1">\xe9', None, True)[1].endswith("é")
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="/s"/><link href="/l"/><updated>u</updated></entry></feed>'
    assert formats.entries(atom) == [("T", "/l", "u", None, None)] and formats.entries("<rss") == [] and formats.entries(None) == []


def test_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("# A #\n\nx",), ("0: yes",)], "t string")
    rows = df.select(T.markdown_metrics(F.col("t")).alias("m"), T.markdown_title(F.col("t"), F.lit("f")).alias("title"), T.quality_score(F.col("t")).alias("q"), T.slugify(F.col("t")).alias("s"), T.fence(F.col("t")).alias("fence"), T.compact_tables(F.col("t")).alias("c")).collect()
    assert rows[0]["m"]["len"] == 0 and [r["title"] for r in rows] == ["f", "f", "A", "f"] and rows[0]["q"] == 0 and rows[1]["s"] == ""


def test_convert_pages_sets_aside_what_it_must_not_parse(spark):
    rows = [(1, "https://a.org/x", PAGE), (2, None, None), (3, "u", "<div>" * 3000), (4, "u", "<title>Just a moment...</title> cf-chl"), (5, "", "")]
    got = {r["page_id"]: r for r in pages.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["extractor_reason"] == "markup beyond limits" and got[4]["extractor_reason"] == "bot challenge: Cloudflare"
    assert got[1]["title"] == "A page" and got[1]["source"] != "rejected" and got[2]["quality"] == 0 and len(got) == 5


def test_hostile_rows_give_null(spark):
    """Deep markup, long fields and odd delimiters cost their own row, not the job."""
    df = spark.createDataFrame([("<div>" * 3000,), ("<b>" * 3000 + "x",), ("<p>fine</p>",), (None,)], "t string")
    assert [r[0] for r in df.select(pages.html_to_markdown(F.col("t"))).collect()] == [None, None, "fine", ""]
    assert formats.to_table('a,b\n1,"' + "x" * 200_000 + '"').count("x") == 200_000
    assert formats.to_table('sep="\na"b') is None and formats.to_table(None) == ""


def test_search_takes_all_terms_of_a_query(spark):
    docs = spark.createDataFrame([(1, "word99 other"), (2, "nothing")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, " ".join(f"word{k}" for k in range(100)))], "query_id long, query string")
    assert [(r["query_id"], r["id"]) for r in sections.bm25_search(docs, queries).collect()] == [(7, 1)]


def test_subtitles_and_notebooks(spark):
    df = spark.createDataFrame([(1, "1\r00:00:01,000 --> 00:00:02,000\r{\\an8}Hel<i>lo</i>\r")], "id long, t string")
    assert [(r["line"], r["start"]) for r in formats.parse_cues(df, "id", "t").collect()] == [("Hello", 1.0)]
    book = '{"metadata":{"kernelspec":{"language":"python"},"language_info":{"name":"R"}},"cells":[{"cell_type":"code","source":"x","outputs":[]}]}'
    assert formats.notebook_to_markdown(spark.createDataFrame([(1, book)], "id long, t string"), "id", "t").first()["markdown"] == "# Notebook\n\n```r\nx\n```\n"


def test_notebooks_of_all_kinds(spark):
    md, code, raw = (lambda kind: lambda source, **o: {"cell_type": kind, "source": source, **o})("markdown"), lambda source, *outputs: {"cell_type": "code", "source": source, "outputs": list(outputs)}, lambda source: {"cell_type": "raw", "source": source}
    out = lambda **data: {"output_type": "display_data", "data": {k.replace("_", "/"): v for k, v in data.items()}}
    books = [
        ({"cells": [md("\n# T #\nmore\n"), md("# Other"), raw("r "), raw(" ")]}, "T", None, "# T\n\nmore\n\n# Other\n\n```\nr\n```\n"),
        ({"cells": [md("text"), md(["a\n", "# T"]), None, {"cell_type": "odd", "source": "x"}]}, "T", None, "# T\n\ntext\n\na\n# T\n"),
        ({"cells": [md("")], "metadata": {"title": 5, "authors": [{"name": " A "}]}}, "file.v1", "A", "# file.v1\n\n"),
        ({"cells": [code("", out(text_markdown=" **x** ", image_png="y"), out(image_png="y"), out(text_plain=["a", "`" * 3]), {"output_type": "error"}, {"output_type": "stream", "text": " \n"}, {"output_type": "error", "ename": "E", "traceback": "t\r\nu "})], "metadata": {"title": " Own ", "authors": ["B"]}},
         "Own", "B", "# Own\n\n**x**\n\n*[image output]*\n\n````text\na```\n````\n\n```text\nE\nt\nu\n```\n"),
        ({"cells": []}, None, None, None), ({"nbformat": 3, "cells": [md("x")]}, None, None, None), ({"worksheets": [], "cells": [md("x")]}, None, None, None), ([1], None, None, None), (None, None, None, None),
    ]
    rows = [(i, None if b is None else json.dumps(b), "d/file.v1.ipynb") for i, (b, *_) in enumerate(books)]
    df = spark.createDataFrame([*rows, (99, "{bad", None)], "id long, t string, f string")
    got = {r["id"]: (r["title"], r["author"], r["markdown"]) for r in formats.notebook_to_markdown(df, "id", "t", "f", "en").collect()}
    assert got == {i: tuple(want) for i, (_, *want) in enumerate(books) if want[0]}


def test_files_in_their_own_charset(spark, tmp_path):
    pages = {"a.html": '<meta charset="windows-1252"><p>größe €'.encode("cp1252"), "b.html": "<p>größe".encode(), "c.html": b"\xff\xfe" + "<p>größe".encode("utf-16-le")}
    for name, content in pages.items():
        (tmp_path / name).write_bytes(content)
    got = {r["url"].rpartition("/")[2]: r["html"] for r in read_pages(spark, str(tmp_path), "binaryFile").collect()}
    assert got == {"a.html": '<meta charset="windows-1252"><p>größe €', "b.html": "<p>größe", "c.html": "<p>größe"}


DEEP = ["<div>" * 3000 + "x" * 24_000, "<b>" * 3000 + "y", "<ul><li>" * 1500 + "z", "<blockquote>" * 900 + "q", "<table><tr><td>" * 400 + "t", "<div>" * 450 + "<b>" * 50 + "w"]


def test_depth_crashes_nothing(spark):
    """The writer needs no call stack, and operators set markup beyond the limits aside."""
    assert dom.to_markdown(dom.parse(DEEP[0])) == "x" * 24_000 and dom.to_markdown(dom.parse(DEEP[1])).count("y") == 1
    assert dom.to_markdown(dom.parse(DEEP[2])).endswith("z") and dom.to_markdown(dom.parse(DEEP[3])).endswith("q") and "t" in dom.to_markdown(dom.parse(DEEP[4]))
    df = spark.createDataFrame([(k, "https://a.org/x", h, "", 24_000) for k, h in enumerate([*DEEP, None])], "page_id long, url string, html string, markdown string, body_len long")
    guarded = {r["page_id"]: r for r in pages.coverage_guard(df).collect()}
    assert len(guarded) == 7 and guarded[0]["recovered_md"] is None
    rules = spark.createDataFrame([(1, "all", ["*"], None, None, ["i"], ["td"], None, None)], recipes.RULE)
    merged = recipes.match_recipes(df, rules)
    applied = {r["page_id"]: r["html"] for r in recipes.apply_recipes(df, merged).collect()}
    assert len(applied) == 7 and applied[0] is None and applied[6] is None and "w" in applied[5]
    assert pages.convert_pages(df, merged).count() == 7


def test_many_rules(spark):
    """With 50 000 rules each page has exactly the rules whose globs fit its host and path."""
    from fnmatch import fnmatchcase

    rows = [(k, f"r{k}", [g], None, None, None, None, None, None) for k, g in enumerate([*(f"h{n}.example.org" for n in range(25_000)), *(f"*.h{n}.example.org" for n in range(25_000))])]
    odd = ["*", "blog.*", "*.ORG", "*ample.org", "h3.*.org", "h[0].example.org", "*.h3.*", "org", "*.*", "h*.example.org", ""]
    rows += [(len(rows) + k, f"o{k}", [g, None], "/**" if k % 2 else "/a/*", None, None, None, None, None) for k, g in enumerate(odd)]
    urls = ["https://h3.example.org/a/b", "https://x.y.h3.example.org/", "https://H24999.example.org/a", "https://blog.net/a/c", "http://org/", "no url", None, "https://h0.example.org"]
    got = recipes.match_recipes(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rows, recipes.RULE))
    got = {r["page_id"]: r["names"] for r in got.collect()}
    for k, url in enumerate(urls):
        host, _, path = (url or "").lower().partition("://")[2].partition("/")
        fits = lambda g: fnmatchcase(host, g.lower().replace("[", "[[]"))
        on_path = lambda p: p != "/a/*" or (("/" + path).startswith("/a/") and path.count("/") == 1 and len(path) > 2)
        want = [r[1] for r in rows if host and fits(r[2][0]) and on_path(r[3])]
        assert got.get(k, []) == want, url


def test_address_bits_against_the_standard_library(spark):
    """Random addresses in every way of writing them, and strings that are none."""
    import ipaddress

    from pagequarry.operators import hosts

    rng = random.Random(8)
    forms = ["::", "::1", "1::", "[::1]", "fe80::1%eth0", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1::2::3", "1:2:3", ":1:2:3:4:5:6:7:8", "12345::", "g::", "1.2.3", "256.1.1.1", "a.b", "", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", None]
    for _ in range(200):
        six = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([2**128 - 1, 2**64 - 1, (2**64 - 1) << 64, 2**32 - 1, 0xFFFF << 48]))
        forms += [str(six), six.exploded.upper(), str(ipaddress.IPv4Address(rng.getrandbits(32)))]
    got = spark.createDataFrame(list(enumerate(forms)), "k long, host string").select("k", hosts.address_bits(F.col("host")).alias("bits")).collect()
    for k, bits in got:
        try:
            bare = ipaddress.ip_address((forms[k] or "").strip("[]").partition("%")[0])
            want = format(int(bare), f"0{bare.max_prefixlen}b")
        except ValueError:
            want = None
        assert bits == want, forms[k]


def test_blocked_networks(spark):
    from pagequarry.operators import hosts

    bad = ["10.1.2.3", "::1", "::", "fd00:ec2::254", "fe80::1", "ff02::1", "2001:db8::1", "::ffff:127.0.0.1", "64:ff9b::10.0.0.1", "64:ff9b:1::10.0.0.1", "::127.0.0.1", "2002:7f00:1::", "::ffff:0:169.254.169.254", "255.255.255.255", "[::1]"]
    good = ["8.8.8.8", "2606:4700::1111", "::ffff:8.8.8.8", "64:ff9b::8.8.8.8", "2002:808:808::", "example.org", "", None, "172.32.0.1"]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(bad + good + bad)], "k long, host string")
    kept, blocked = hosts.filter_blocked_hosts(df, "host")
    assert sorted(r["k"] for r in blocked.collect()) == [k for k, h in enumerate(bad + good + bad) if h in bad] and kept.count() == len(good)
    kept, _ = hosts.filter_blocked_hosts(df, "host", ["10.0.0.0/8", "fd00::/8", "::1", "FE80::1", "10.0.0.0/99", " example.org "])
    assert {r["host"] for r in kept.collect()} == {*good, "10.1.2.3", "fd00:ec2::254", "::1", "[::1]", "fe80::1"}


MARKDOWN = [
    (r"\*a\* *b* \[x\](y) \\*c\\*", "*a* b [x](y) \\c\\"), ("`\\*` and ```\n\\_\n``` \\_", "`\\*` and ```\n\\_\n``` _"), ("_x_ __y__ ~~z~~ **b** snake_case", "x y z b snake_case"),
    ("* one\n+ two\n- three\n> q\n-----\n# H", "- one\n- two\n- three\nq\n---\nH"), ("[a](b) ![c](d) ![](e) [f]() [](g)", "a (b) d e f () [](g)"), ("[a\n](b) [c](d\n)", "[a\n](b) [c](d\n)"),
    ("[a [b](c)](d)", "a [b (c)](d)"), ("[![i](u)](v)", "[u](v)"), (None, ""), ("", ""), ("  \n x \n", "x"), ("#\n\nx", "x"), ("a ``` b", "a ``` b"),
]


def test_plain_text(spark):
    rows = [(k, md) for k, (md, _) in enumerate(MARKDOWN)]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, "k long, md string").select("k", T.strip_markdown(F.col("md")).alias("t")).collect()}
    assert [got[k] for k in range(len(rows))] == [want.replace("[u](v)", "u (v)") for _, want in MARKDOWN]
    hostile = "[a](" * 100_000 + "\n" + "![" * 100_000 + ")](x" * 50_000
    assert T.links_written_out(hostile) is not None


def test_fences_close_on_their_own_mark(spark):
    md = "```\n| a  |\n~~~\n| b  |\n```\n| c  |\n~~~\n| d  |\n```\n| e  |"
    assert spark.createDataFrame([(md,)], "md string").select(T.compact_tables(F.col("md"))).first()[0] == md.replace("| c  |", "| c |")

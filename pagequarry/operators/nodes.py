"""Pages as rows of nodes numbered in document order, and page operators as filters, windows and groups over them.

A node's subtree holds the numbers `pre` to `last`, so "inside" is a comparison of numbers and dropping, finding and
writing need no tree. Nodes of a page meet in one shuffle by page; a page's nodes are bounded by its markup.
"""

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pagequarry.functions.urls import resolve_url
from pagequarry.operators import dom

NODE = "page_id long, pre int, last int, parent int, depth int, up string, tag string, attrs map<string,string>, text string, veil int"
ARROW = pa.schema([("page_id", pa.int64()), *((n, pa.int32()) for n in ("pre", "last", "parent", "depth")), ("up", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("veil", pa.int32())])
#: Most rows sent to Spark at once.
ROWS = 8192
SPACE = r"[\s\x1c-\x1f]"
SPACES = f"(?U){SPACE}+"
ENDS = f"(?U)^{SPACE}+|{SPACE}+$"


def _numbered(page_id: int | None, html: str | None) -> Iterator[list]:
    """Rows of a page's nodes in document order; the first is the document, so every page has one."""
    rows, todo = [], [(dom.parse(html), -1, 0, None, None)]
    while todo:
        node, parent, depth, up, veil = todo.pop()
        if isinstance(node, int):
            rows[node][2] = len(rows) - 1
            continue
        pre = len(rows)
        if isinstance(node, str):
            rows.append([page_id, pre, pre, parent, depth, up, "#text", None, node, veil])
            continue
        rows.append([page_id, pre, pre, parent, depth, up, node.tag, list(node.attrs.items()), None, veil])
        todo.append((pre, 0, 0, None, None))
        below = pre if node.tag in dom.HIDDEN else veil
        todo.extend((c, pre, depth + 1, node.tag, below) for c in reversed(node.children))
    return iter(rows)


def page_nodes(pages: DataFrame) -> DataFrame:
    """Rows (page_id, pre, last, parent, depth, up, tag, attrs, text, veil) of pages (page_id, html); page_id names a page.

    up: the parent's tag. veil: number of the innermost element around the node that is not shown. Text has the tag
    `#text`, the document `#document`; a null page is an empty one.
    """

    def sent(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(column), type=field.type) for column, field in zip(zip(*rows), ARROW)], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for batch in batches:
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in _numbered(page_id, html.as_py()):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield sent(rows)
                        rows = []
        if rows:
            yield sent(rows)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, NODE)


def _of_page(first: int | None = None, last: int | None = None) -> WindowSpec:
    """A page's nodes, or those between two distances of a node; W's bounds stand for all before or after."""
    whole = W.partitionBy("page_id")
    return whole if first is None else whole.orderBy("pre").rowsBetween(first, last)


def inside(which: Column) -> Column:
    """Whether a node lies in the subtree of one that the condition holds for."""
    return F.coalesce(F.max(F.when(which, F.col("last"))).over(_of_page(W.unboundedPreceding, -1)) >= F.col("pre"), F.lit(False))


def _value(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def words(value: Column) -> Column:
    return F.filter(F.split(value, SPACES), lambda w: w != "")


def _fits(tag: str, tests: Sequence[tuple]) -> Column:
    out = F.lit(True) if tag in ("", "*") else F.col("tag") == tag
    for ident, cls, attr, op, value, flag in tests:
        if ident:
            out = out & (_value("id") == ident)
        if cls:
            out = out & F.array_contains(words(_value("class")), cls)
        if attr:
            have, want = _value(attr.lower()), (value or "").strip("\"'")
            out = out & F.map_contains_key("attrs", F.lit(attr.lower()))
            if flag:
                have, want = F.lower(have), want.lower()
            if op:
                out = out & {"=": have == want, "*=": F.contains(have, F.lit(want)), "^=": F.startswith(have, F.lit(want)), "$=": F.endswith(have, F.lit(want)), "~=": F.array_contains(words(have), want)}[op]
    return F.coalesce(out & ~F.col("tag").startswith("#"), F.lit(False))


def mark(nodes: DataFrame, selector: str, into: str) -> DataFrame:
    """nodes with a boolean column: whether the selector picks the node; a selector that is not valid picks none."""
    found, helpers = [], []
    for n, steps in enumerate(dom.compile_selector(selector) or ()):
        met = None
        for k, (child, tag, tests) in enumerate(steps):
            name = f"{into}_{n}_{k}"
            fits = _fits(tag, tests)
            if met is not None and child:
                parents = nodes.where(met).select("page_id", F.col("pre").alias("parent"), F.lit(True).alias(name + "_up"))
                nodes = nodes.join(parents, ["page_id", "parent"], "left")
                fits = fits & F.coalesce(name + "_up", F.lit(False))
                helpers.append(name + "_up")
            elif met is not None:
                fits = fits & inside(F.col(met))
            nodes, met = nodes.withColumn(name, fits), name
            helpers.append(name)
        found.append(F.col(met))
    return nodes.withColumn(into, reduce(lambda a, b: a | b, found, F.lit(False))).drop(*helpers)


def stats(nodes: DataFrame) -> DataFrame:
    """(page_id, depth, elements, depth_sum, texts, most_children, attributes, most_attributes) of each page's tree."""
    element = ~F.col("tag").startswith("#")
    deep, size = F.when(element, F.col("depth").cast("long")), F.when(element, F.size("attrs").cast("long"))
    families = nodes.groupBy("page_id", "parent").agg(
        F.max(deep).alias("depth"), F.count_if(element).alias("elements"), F.sum(deep).alias("depth_sum"), F.count_if(F.col("tag") == "#text").alias("texts"),
        F.count_if(F.col("tag") != "#document").alias("children"), F.sum(size).alias("attributes"), F.max(size).alias("most_attributes"),
    )
    kinds = {"depth": F.max, "elements": F.sum, "depth_sum": F.sum, "texts": F.sum, "most_children": F.max, "attributes": F.sum, "most_attributes": F.max}
    return families.groupBy("page_id").agg(*(F.coalesce(how("children" if name == "most_children" else name), F.lit(0)).alias(name) for name, how in kinds.items()))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def write_html(nodes: DataFrame) -> DataFrame:
    """(page_id, html): the markup of each page's nodes. An element's own text, where it has one, comes first in it."""
    attr = lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    tag, text = F.col("tag"), F.coalesce("text", F.lit(""))
    attrs = F.array_join(F.transform(F.coalesce(F.map_entries("attrs"), F.expr("array()").cast("array<struct<key:string,value:string>>")), attr), "")
    opening = F.when(tag == "#document", "").when(tag == "#text", F.when(F.col("up").isin("script", "style"), text).otherwise(_escaped(text))).otherwise(F.concat(F.lit("<"), tag, attrs, F.lit(">"), _escaped(text)))
    closing = F.when(tag.startswith("#") | tag.isin(*dom.VOID), "").otherwise(F.concat(F.lit("</"), tag, F.lit(">")))
    piece = lambda at, nth, order, s: F.struct(at.alias("at"), F.lit(nth).alias("nth"), order.alias("order"), s.alias("s"))
    both = F.array(piece(F.col("pre"), 0, F.lit(0), opening), piece(F.col("last"), 1, -F.col("pre"), closing))
    pieces = F.filter(F.array_sort(F.flatten(F.collect_list(both))), lambda p: p["s"] != "")
    return nodes.groupBy("page_id").agg(F.array_join(F.transform(pieces, lambda p: p["s"]), "").alias("html"))


def clean(nodes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Without boilerplate and pixel images; read-only inputs become code, leading checkboxes `[x]` or `[ ]`."""
    nodes = mark(nodes, ",".join(s for s in (*dom.BOILERPLATE, *extra) if dom.compile_selector(s)), "dropped")
    pixel = (F.col("tag") == "img") & _value("width").isin("0", "1") & _value("height").isin("0", "1")
    kept = nodes.withColumn("gone", inside(F.col("dropped"))).where(~F.col("dropped") & ~F.col("gone") & ~pixel).drop("dropped", "gone")
    field = F.col("tag") == "input"
    box = field & (F.lower(_value("type")) == "checkbox")
    code = field & ~box & F.map_contains_key("attrs", F.lit("readonly"))
    ident = (F.col("tag") == "img") & _value("alt").rlike("(?i)" + dom.UUID.pattern)
    none = F.expr("cast(map() as map<string,string>)")
    return kept.select(
        "page_id", "pre", "last", "parent", "depth", "up",
        F.when(box, "#text").when(code, "code").otherwise(F.col("tag")).alias("tag"),
        F.when(code, none).when(ident, F.transform_values("attrs", lambda k, v: F.when(k == "alt", "").otherwise(v))).otherwise(F.col("attrs")).alias("attrs"),
        F.when(box, F.when(F.map_contains_key("attrs", F.lit("checked")), "[x] ").otherwise("[ ] ")).when(code, _value("value")).otherwise(F.col("text")).alias("text"),
        "veil",
    )


def absolutify(nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """nodes with the addresses of images, links and media made absolute by bases (page_id, url)."""
    linked = F.map_from_arrays(F.array(*map(F.lit, dom.URL_ATTRS)), F.array(*(F.array(*map(F.lit, a)) for a in dom.URL_ATTRS.values())))
    base = F.col("base_url")

    def choice(part: Column) -> Column:
        return F.concat(resolve_url(F.regexp_extract(part, r"^(\S+)", 1), base), F.regexp_replace(F.regexp_replace(part, r"^\S+", ""), r"^\s+(?=\S)|^\s+$", " "))

    def value(k: Column, v: Column) -> Column:
        parts = F.filter(F.transform(F.split(v, ","), lambda p: F.regexp_replace(p, r"^\s+", "")), lambda p: p != "")
        return F.when(~F.array_contains(linked[F.col("tag")], k), v).when(k == "srcset", F.array_join(F.transform(parts, choice), ", ")).otherwise(resolve_url(v, base))

    known = bases.where(F.coalesce("url", F.lit("")) != "").select("page_id", F.col("url").alias("base_url"))
    moved = F.when(F.col("tag").isin(*dom.URL_ATTRS) & base.isNotNull(), F.transform_values("attrs", value)).otherwise(F.col("attrs"))
    return nodes.join(known, "page_id", "left").withColumn("attrs", moved).drop("base_url")


def _text(name: str, hidden: bool = False) -> Column:
    """Aggregate over a page's nodes: squeezed text of the element that the struct column (pre, last) tells; hidden: that is not shown too."""
    there = (F.col("tag") == "#text") & F.col("pre").between(F.col(name)["pre"], F.col(name)["last"])
    if not hidden:
        there = there & (F.coalesce("veil", F.lit(-1)) <= F.col(name)["pre"])
    ordered = F.array_sort(F.collect_list(F.when(there, F.struct("pre", "text"))))
    return F.nullif(F.trim(F.regexp_replace(F.array_join(F.transform(ordered, lambda t: t["text"]), ""), SPACES, " ")), F.lit(""))


def metadata(nodes: DataFrame) -> DataFrame:
    """(page_id, title, canonical, language, named meta tags): title of the head, else any outside svg, else og:title, else the first h1."""
    tag, at, span = F.col("tag"), F.col("pre"), F.struct("pre", "last")
    key = F.lower(F.coalesce(F.nullif(_value("property"), F.lit("")), _value("name")))
    names = F.create_map(*(F.lit(x) for kv in dom.META_NAMES.items() for x in kv))
    says = F.when((tag == "#text") & F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"), at)
    rows = nodes.where(tag.isin("#document", "#text", "head", "svg", "title", "h1", "html", "link", "meta"))
    rows = rows.withColumns({"in_svg": inside(tag == "svg"), "in_head": inside(tag == "head"), "next": F.first(says, ignorenulls=True).over(_of_page(1, W.unboundedFollowing))})
    titled = (tag == "title") & ~F.col("in_svg") & (F.col("next") <= F.col("last"))
    rows = rows.withColumns({"head_title": F.min_by(span, F.when(titled, F.struct(~F.col("in_head"), at))).over(_of_page()), "heading": F.min_by(span, F.when(tag == "h1", at)).over(_of_page())})

    def found(value: Column, when: Column) -> Column:
        return F.min_by(value, F.when(when & (value != ""), at))

    content = F.regexp_replace(_value("content"), ENDS, "")
    page = rows.groupBy("page_id").agg(
        _text("head_title", hidden=True).alias("title"),
        _text("heading").alias("heading"),
        found(_value("lang"), tag == "html").alias("language"),
        found(_value("href"), (tag == "link") & F.array_contains(words(F.lower(_value("rel"))), "canonical")).alias("canonical"),
        *(found(content, (tag == "meta") & (names[key] == name)).alias(name) for name in dom.META_NAMES.values()),
    )
    return page.select("page_id", F.coalesce("title", "og_title", "heading").alias("title"), *dom.METADATA[1:])


def published(nodes: DataFrame) -> DataFrame:
    """(page_id, published): the first of the usual places whose first element reads as a date."""
    value = F.coalesce(F.nullif(_value("content"), F.lit("")), F.nullif(_value("datetime"), F.lit("")))
    places = {}
    for n, selector in enumerate(dom.DATES):
        _, tag, tests = dom.compile_selector(selector)[0][0]
        places[f"place_{n}"] = F.min_by(F.struct("pre", "last", value.alias("value")), F.when(_fits(tag, tests), F.col("pre"))).over(_of_page())
    rows = nodes.withColumns(places)
    dates = [F.try_to_timestamp(F.coalesce(F.first(F.col(n)["value"]), _text(n))) for n in places]
    return rows.groupBy("page_id").agg(F.coalesce(*dates).alias("published"))


def _long_paragraphs(nodes: DataFrame, least: int = 80) -> DataFrame:
    """nodes with `long`: how many of a node's children are paragraphs of at least so many shown characters, blank ends left out.

    A paragraph's text begins at the first mark after it opens and ends at the last before it closes, so rows for its
    opening and closing stand among the texts of the same veil.
    """
    paragraph, said = (F.col("tag") == "p") & (F.col("up") == "div"), F.coalesce("text", F.lit(""))
    closing = F.struct(F.col("last").alias("at"), F.lit(1).alias("nth"))
    itself = F.struct(F.col("pre").alias("at"), F.lit(0).alias("nth"))
    rows = nodes.repartition("page_id").withColumn("row", F.explode(F.when(paragraph, F.array(itself, closing)).otherwise(F.array(itself))))
    shown = W.partitionBy("page_id", "veil").orderBy("row")
    end = F.sum(F.when(F.col("tag") == "#text", F.length(said)).otherwise(0)).over(shown.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", end)
    some = (F.col("tag") == "#text") & (F.regexp_replace(said, SPACES, "") != "")
    first = F.when(some, F.col("end") - F.length(F.regexp_replace(said, rf"(?U)^{SPACE}+", "")))
    last = F.when(some, F.col("end") - F.length(said) + F.length(F.regexp_replace(said, rf"(?U){SPACE}+$", "")))
    rows = rows.withColumns({"from": F.first(first, ignorenulls=True).over(shown.rowsBetween(0, W.unboundedFollowing)), "to": F.last(last, ignorenulls=True).over(shown.rowsBetween(W.unboundedPreceding, 0))})
    own = W.partitionBy("page_id", "pre")
    size = F.max(F.when(F.col("row.nth") == 1, F.col("to"))).over(own) - F.max(F.when(F.col("row.nth") == 0, F.col("from"))).over(own)
    rows = rows.withColumn("is_long", F.coalesce(paragraph & (size >= least), F.lit(False))).where("row.nth = 0")
    kin = F.when(F.col("is_long"), F.array(F.struct(F.col("pre").alias("of"), F.lit(0).alias("n")), F.struct(F.col("parent").alias("of"), F.lit(1).alias("n")))).otherwise(F.array(F.struct(F.col("pre").alias("of"), F.lit(0).alias("n"))))
    rows = rows.withColumn("kin", F.explode(kin)).withColumn("long", F.sum("kin.n").over(W.partitionBy("page_id", "kin.of")))
    return rows.where("kin.n = 0").drop("row", "end", "from", "to", "is_long", "kin")


def preclean(nodes: DataFrame) -> DataFrame:
    """Hidden paragraphs are shown, widget classes on divs that hold an article's paragraphs are taken off."""
    tag, classes = F.col("tag"), words(_value("class"))
    rows = _long_paragraphs(nodes).withColumn("next_table", F.first(F.when(tag == "table", F.col("pre")), ignorenulls=True).over(_of_page(1, W.unboundedFollowing)))
    hidden = (tag == "p") & (F.array_contains(classes, "paywall") | F.map_contains_key("attrs", F.lit("aria-hidden")))
    article = (tag == "div") & (F.col("long") >= 5)
    embed = (tag == "div") & F.array_contains(classes, "w-embed") & F.coalesce(F.col("next_table") <= F.col("last"), F.lit(False))
    left = F.filter(classes, lambda c: ~(hidden & (c == "paywall")) & ~(article & c.rlike("(?i)widget|sidebar|share|related")) & ~(embed & (c == "w-embed")))
    joined = F.array_join(left, " ")
    shown = F.map_filter("attrs", lambda k, v: ~(hidden & k.isin("aria-hidden", "hidden")))
    named = F.when(F.map_contains_key("attrs", F.lit("class")), F.transform_values(shown, lambda k, v: F.when(k == "class", joined).otherwise(v))).otherwise(F.map_concat(shown, F.create_map(F.lit("class"), F.lit(""))))
    changed = hidden | (article & (F.size(classes) > 0)) | embed
    return rows.withColumn("attrs", F.when(changed, named).otherwise(F.col("attrs"))).drop("long", "next_table")

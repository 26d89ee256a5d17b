"""Pages to Markdown: one pass of the document helper for each page, then column expressions."""

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators import dom

#: Limits on the markup of one page: beyond them it is set aside, not parsed.
LIMITS = {"depth": 512, "elements": 200_000, "attributes": 200_000, "most_attributes": 5_000}
SHORT = 200
METADATA = "map<string,string>"


def _each(kind: str, function: Callable):
    """A pandas UDF that applies a function of the given columns' values row by row."""

    def of(*columns: Column) -> Column:
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([function(*values) for values in zip(*series)], dtype=object)

        if len(columns) == 1:

            def one(a: pd.Series) -> pd.Series:
                return run(a)

            return F.pandas_udf(one, kind)(*columns)

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

        return F.pandas_udf(two, kind)(*columns)

    return of


def beyond(html: str | None, limits: dict[str, int] = LIMITS) -> bool:
    """Whether markup is beyond the limits; one count for all of them."""
    stats = dom.markup_stats(html)
    return any(stats[k] > most for k, most in limits.items())


def within_budget(stats: DataFrame, limits: dict[str, int] = LIMITS) -> Column:
    out = F.lit(True)
    for name, most in limits.items():
        out = out & (stats[name] <= most)
    return out


def html_to_markdown(html: Column) -> Column:
    """Markdown of a fragment; null where the markup is beyond the limits."""

    def run(h: str | None) -> str | None:
        return None if beyond(h) else dom.to_markdown(dom.parse(h))

    return _each("string", run)(html)


LINK = r"""(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""


def extract_links(df: DataFrame) -> DataFrame:
    """(page_id, pos, href, text): plain links in order."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("text"))
    return df.select("page_id", F.posexplode(pairs).alias("pos", "l")).select("page_id", "pos", "l.href", T.strip_tags(F.col("l.text")).alias("text"))


LD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def _members(v: Column) -> Column:
    """A JSON list's elements; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _step(v: Column, part: str | int) -> Column:
    """An object's value for a key, or a list's for a number; null where there is none."""
    if isinstance(part, int):
        return F.try_variant_get(v, f"$[{part}]", "variant")
    if re.fullmatch(r"[\w@ .:/-]+", part):
        return F.try_variant_get(v, f"$['{part}']", "variant")
    return F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(part))  # paths have no way to write quotes and question marks


def jsonld_candidates(parsed: Column, brackets: Column) -> Column:
    """All nodes of a JSON-LD value in order: lists are opened however deep, an object comes before the entries of its @graph.

    brackets: a bound on how deep lists lie, such as the number of `[`; rounds after the last opened list do nothing.
    """

    def node(v: Column, new: Column) -> Column:
        return F.struct(v.alias("v"), new.alias("new"))

    def opened(x: Column) -> Column:
        graph = F.coalesce(_members(_step(x["v"], "@graph")), F.array().cast("array<variant>"))
        inside = F.transform(F.coalesce(_members(x["v"]), graph), lambda v: node(v, F.lit(True)))
        own = F.when(_is_object(x["v"]), F.array(node(x["v"], F.lit(False)))).otherwise(F.array().cast("array<struct<v:variant,new:boolean>>"))
        return F.when(x["new"], F.concat(own, inside)).otherwise(F.array(x))

    def step(s: Column, _: Column) -> Column:
        more = F.exists(s["nodes"], lambda x: x["new"])
        return F.when(s["more"], F.struct(more.alias("more"), F.flatten(F.transform(s["nodes"], opened)).alias("nodes"))).otherwise(s)

    begin = F.struct(F.lit(True).alias("more"), F.array(node(parsed, F.lit(True))).alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), 2 * brackets + 2), begin, step, lambda s: F.transform(s["nodes"], lambda x: x["v"]))


def jsonld_nodes(df: DataFrame) -> DataFrame:
    """(page_id, pos, type, types, node): the JSON-LD nodes of a page in order; what doesn't parse (a key twice in one object included) is left out. type is the first of the types."""
    scripts = df.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LD), F.lit(1))).alias("script", "json"))
    parsed = scripts.select("page_id", "script", F.try_parse_json(F.trim("json")).alias("v"), (F.length("json") - F.length(F.replace("json", F.lit("[")))).alias("brackets"))
    nodes = parsed.where(F.col("v").isNotNull()).select("page_id", "script", F.posexplode(jsonld_candidates(F.col("v"), F.col("brackets"))).alias("at", "node"))
    order = W.partitionBy("page_id").orderBy("script", "at")
    kind = _step(F.col("node"), "@type")
    types = F.coalesce(F.transform(_members(kind), lambda v: F.try_variant_get(v, "$", "string")), F.when(kind.isNotNull(), F.array(F.try_variant_get(kind, "$", "string"))))
    return nodes.select("page_id", (F.row_number().over(order) - 1).alias("pos"), types.getItem(0).alias("type"), types.alias("types"), F.to_json("node").alias("node"))


def jsonld_path(node: Column, path: str) -> Column:
    """The primitive at a dotted path as a string: a list on the way, or at its end, gives its first element, once."""

    def first(v: Column) -> Column:
        return F.coalesce(_step(v, 0), v)

    at = node
    for part in path.split("."):
        at = _step(first(at), part)
    at = first(at)
    return F.when(~_is_object(at) & _members(at).isNull(), F.try_variant_get(at, "$", "string"))


def jsonld_field(nodes: DataFrame, kind: str, path: str) -> DataFrame:
    """(page_id, value): a dotted path in each page's first node that has a type among its own; null where it leads to no primitive."""
    firsts = nodes.where(F.array_contains("types", kind)).groupBy("page_id").agg(F.min_by("node", "pos").alias("node"))
    return firsts.select("page_id", F.try_parse_json("node").alias("v")).select("page_id", jsonld_path(F.col("v"), path).alias("value"))


@dataclass(frozen=True)
class AppendBlock:
    """A list or object inside a page's JSON script, shown at the end of its text.

    script: `script`, `#id` and `[name="value"]` in any number, as in script#state[type="application/json"]. path and the paths of
    fields: keys and list places, one by one. fields: names and where they lie in a row; None gives rows whole.
    """

    title: str
    script: str
    path: tuple[str | int, ...]
    fields: dict[str, tuple[str | int, ...]] | None = None
    limit: int = 200


#: Fixed values of the output format: bytes of a block and of all blocks, the least bytes worth a block, and the words of notes.
BLOCK_BYTES, DOCUMENT_BYTES, LEAST_BYTES = 64 * 1024, 128 * 1024, 1024
CUT, SPENT, TOO_LARGE, ONE, MANY = "Gekürzt: {} von {} {} ausgegeben.", " (übersprungen, Budget erschöpft)", " (übersprungen, einzelner Datensatz zu groß)", "Zeile", "Zeilen"


def _script_pattern(selector: str) -> str:
    """The pattern of the first script that a simple selector picks; its text is the only group."""
    if not re.fullmatch(r"""(script)?(#[\w-]+|\[[\w-]+=(["'])[^"'\]]*\3\])*""", selector) or not selector:
        raise ValueError(f"not a simple script selector: {selector}")
    wanted = [("id", x) for x in re.findall(r"#([\w-]+)(?![^\[]*\])", selector)] + re.findall(r"""\[([\w-]+)=["']([^"'\]]*)""", selector)
    has = "".join(rf"""(?=[^>]*\s(?i:{re.escape(n)})=(?:["']{re.escape(v)}["']|{re.escape(v)}[\s>]))""" for n, v in wanted)
    return rf"(?s)<(?i:script)\b{has}[^>]*>(.*?)</(?i:script)>"


def _block_rows(script: Column, spec: AppendBlock) -> Column:
    """The JSON text of each row of a block; null or empty where there is none."""
    at = script
    for part in spec.path:
        at = _step(at, part)
    listed = F.coalesce(_members(at), F.when(F.to_json(at) != "null", F.array(at)))
    if spec.fields is None:
        return F.transform(F.slice(listed, 1, spec.limit), lambda x: F.to_json(x))

    def row(x: Column) -> Column:
        cells = []
        for name, path in spec.fields.items():
            cell = x
            for part in path:
                cell = _step(cell, part)
            cells.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), F.to_json(cell)))
        return F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))

    return F.transform(F.slice(F.filter(listed, _is_object), 1, spec.limit), row)


def append_blocks(df: DataFrame, specs: list[AppendBlock]) -> DataFrame:
    """(page_id, markdown, notes): the blocks of a page in the order of specs, a row of JSON each line, and what was shown, cut or left out.

    Whole rows go from the end until a block has at most BLOCK_BYTES and all of a page's at most DOCUMENT_BYTES, headings and notes
    included. Scripts that are missing or no JSON, and paths that lead nowhere, give nothing. Keys of rows without fields, and of
    nested objects, come in the order of their bytes, as VARIANT keeps them. Nothing is shuffled: a page's scripts lie in its row.
    """
    scripts = {s: f"__script{i}" for i, s in enumerate(dict.fromkeys(x.script for x in specs))}
    read = df.select("page_id", *(F.try_parse_json(F.nullif(F.trim(F.regexp_extract("html", _script_pattern(s), 1)), F.lit(""))).alias(c) for s, c in scripts.items()))
    blocks = F.array(*(F.struct(F.lit(x.title).alias("title"), _block_rows(F.col(scripts[x.script]), x).alias("rows")) for x in specs)) if specs else F.array().cast("array<struct<title:string,rows:array<string>>>")
    some = read.select("page_id", F.filter(blocks, lambda b: F.size(b["rows"]) > 0).alias("blocks"))

    def noun(n: Column) -> Column:
        return F.when(n == 1, ONE).otherwise(MANY)

    def counted(kept: Column, total: Column) -> Column:
        return F.when(kept < total, F.concat_ws(" ", kept.cast("string"), F.lit("von"), total.cast("string"), noun(total))).otherwise(F.concat_ws(" ", kept.cast("string"), noun(kept)))

    def kept_rows(rows: Column, budget: Column) -> Column:
        begin = F.struct(F.lit(2).cast("long").alias("bytes"), F.lit(0).alias("kept"))

        def step(s: Column, line: Column) -> Column:
            bytes_ = s["bytes"] + F.octet_length(line) + 2
            return F.struct(bytes_.alias("bytes"), (s["kept"] + (bytes_ <= budget).cast("int")).alias("kept"))

        return F.aggregate(rows, begin, step, lambda s: s["kept"])

    def add(s: Column, b: Column) -> Column:
        total = F.size(b["rows"])
        opening = F.concat(F.lit("\n\n## "), b["title"], F.lit("\n\n```json\n"))
        longest = F.format_string("\n\n" + CUT.format("%s", "%s", MANY), total, total)
        budget = F.least(F.lit(BLOCK_BYTES).cast("long"), DOCUMENT_BYTES - s["spent"]) - F.octet_length(opening) - F.octet_length(longest) - F.octet_length(F.lit("\n```"))

        def shown(kept: Column) -> Column:
            note = F.when(kept < total, F.format_string("\n\n" + CUT.format("%s", "%s", "%s"), kept, total, noun(total))).otherwise("")
            text = F.concat(opening, F.lit("[\n"), F.array_join(F.slice(b["rows"], F.lit(1), kept), ",\n"), F.lit("\n]\n```"), note)
            return F.when(kept == 0, state(s["spent"], s["parts"], b, F.lit(TOO_LARGE))).otherwise(T.let(text, lambda t: state(s["spent"] + F.octet_length(t), F.array_append(s["parts"], t), b, F.concat(F.lit(" ("), counted(kept, total), F.lit(")")))))

        def state(spent: Column, parts: Column, block: Column, note: Column) -> Column:
            return F.struct(spent.cast("long").alias("spent"), parts.alias("parts"), F.array_append(s["notes"], F.concat(block["title"], note)).alias("notes"))

        return T.let(budget, lambda left: F.when(left < LEAST_BYTES, state(s["spent"], s["parts"], b, F.lit(SPENT))).otherwise(T.let(kept_rows(b["rows"], left), shown)))

    empty = F.array().cast("array<string>")
    begin = F.struct(F.lit(0).cast("long").alias("spent"), empty.alias("parts"), empty.alias("notes"))
    done = some.select("page_id", F.aggregate("blocks", begin, add).alias("d"))
    return done.select("page_id", F.array_join("d.parts", "").alias("markdown"), F.col("d.notes").alias("notes"))


def article_series(rows: DataFrame, group: str, lead: str, text: str, order: str) -> DataFrame:
    """(group, blocks, duplicates, text_len, markdown): where a group has two or more different texts with its most frequent lead, these in order, the last of equal texts kept."""
    norm = F.trim(F.regexp_replace(text, r"\s+", " "))
    hashed = rows.select(group, F.col(lead).alias("lead"), F.col(order).alias("o"), F.col(text).alias("text"), F.sha2(norm, 256).alias("h"))
    unique = hashed.groupBy(group, "lead", "h").agg(F.count("*").alias("n"), F.max("o").alias("o"), F.max_by("text", "o").alias("text"))
    each = unique.groupBy(group, "lead").agg(F.sum("n").alias("rows"), F.count("*").alias("blocks"), F.sort_array(F.collect_list(F.struct("o", "text"))).alias("x"))
    best = each.where((F.col("blocks") >= 2) & F.col("lead").isNotNull()).groupBy(group).agg(F.max_by(F.struct("rows", "blocks", "x"), F.struct("rows", "lead")).alias("b"))
    joined = F.array_join("b.x.text", "\n\n---\n\n")
    return best.select(group, "b.blocks", (F.col("b.rows") - F.col("b.blocks")).alias("duplicates"), F.length(joined).alias("text_len"), joined.alias("markdown"))


BODY_LEAST, COVERED, LARGER, PARAGRAPHS = 20_000, 0.1, 3, 5


def _recover(html: str, url: str) -> str | None:
    if beyond(html):
        return None
    root = dom.absolutify(dom.clean(dom.preclean(dom.parse(html))), url)
    return _dominant(dom.body_of(root))


def _dominant(body: dom.Node) -> str | None:
    """Markdown of the one container that holds nearly all of a body's text; None where the text lies in several, as in listings."""
    node = dom.dominant(body)
    return None if node is body else dom.to_markdown(node)


def _better(recovered: Column, markdown: Column) -> Column:
    """Whether a recovered text is so much larger than the extract, and so much prose, that it takes its place."""
    much = (F.length(recovered) >= LARGER * F.length(markdown)) & (T.markdown_metrics(recovered)["paragraphs"] >= PARAGRAPHS)
    return F.coalesce(much, F.lit(False))


def coverage_guard(df: DataFrame) -> DataFrame:
    """df (url, html, markdown, body_len) with recovered_md and guard_reason where an extract covers too little of a large body.

    Only the few suspect pages reach the helper; markup beyond the limits is not recovered.
    """
    suspect = (F.col("body_len") >= BODY_LEAST) & (T.empty(F.col("markdown")).eqNullSafe("") | (F.length("markdown") < COVERED * F.col("body_len")))
    found = F.when(suspect, _each("string", lambda h, u: _recover(h, u) if h is not None else None)(F.when(suspect, F.col("html")), F.col("url")))
    out = df.withColumn("recovered_md", found)
    accepted = _better(F.col("recovered_md"), T.empty(F.col("markdown")))
    return out.withColumn("guard_reason", F.when(accepted, F.concat(F.lit("coverage guard: extract "), F.length(T.empty(F.col("markdown"))).cast("string"), F.lit(" of "), F.col("body_len").cast("string")))).withColumn("recovered_md", F.when(accepted, F.col("recovered_md")))


PASS = "page_id bigint, url string, main_md string, body_md string, recovered_md string, fell_back boolean, body_len bigint, metadata map<string,string>, html_len bigint, has_article boolean"


def convert_one(html: str | None, url: str | None, rule: dict | None) -> dict:
    """Both candidates of a page and its metadata, from one parse."""
    from pagequarry.operators.recipes import apply_actions, content_of

    root = dom.preclean(dom.parse(html))
    meta = {k: v for k, v in dom.metadata(root).items() if v}
    if rule:
        apply_actions(root, rule.get("preprocess") or ())
        for key, selector in (rule.get("fields") or {}).items():
            node = dom.first(root, selector)
            if node is not None:
                meta[key] = dom.squeezed(node.text())
    dom.clean(dom.absolutify(root, url), tuple((rule or {}).get("remove") or ()))
    body = dom.body_of(root)
    body_md = dom.to_markdown(body)
    chosen = content_of(root, (rule or {}).get("content") or ())
    main = "\n\n".join(map(dom.to_markdown, chosen)) if chosen else ""
    if not main:
        node = dom.main_content(root)
        main = dom.to_markdown(node) if node is not None else ""
    fell_back = len(main) < SHORT
    body_len = len(dom.squeezed(body.text()))
    recovered = _dominant(body) if body_len >= BODY_LEAST and len(main) < COVERED * body_len else None
    return {"main_md": body_md if fell_back else main, "body_md": body_md, "recovered_md": recovered, "fell_back": fell_back, "body_len": body_len, "metadata": meta}


def convert_pages(df: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(page_id, url, title, source, markdown, metadata, quality, extractor_reason, render): pages to Markdown.

    df: page_id, url, html. rules: one row for each page with a merged rule (see recipes.match_recipes). Challenge
    pages and pages beyond the markup limits come out with a reason and no markdown. One pass of Python, no shuffle
    without rules.
    """
    pages = df.select("page_id", "url", "html")
    if rules is not None:
        pages = pages.join(rules.select("page_id", F.to_json(F.struct("preprocess", "remove", "content", "fields")).alias("rule")), "page_id", "left")
    else:
        pages = pages.withColumn("rule", F.lit(None).cast("string"))
    pages = pages.withColumn("vendor", T.challenge_vendor(F.col("html")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, html, rule, vendor in batch.itertuples(index=False):
                row = {"page_id": page_id, "url": url, "html_len": len(html or ""), "has_article": bool(re.search(r"<(article|main)\b", html or "", re.I)), "metadata": {}}
                if vendor:
                    row["reason"] = f"bot challenge: {vendor}"
                elif beyond(html):
                    row["reason"] = "markup beyond limits"
                else:
                    row |= convert_one(html, url, json.loads(rule) if rule else None)
                out.append(row)
            names = [c.split()[0] for c in (PASS + ", reason string").split(", ")]
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda d: d.notna(), None)

    passed = pages.mapInPandas(run, PASS + ", reason string")
    chosen = passed.withColumn("p", T.pick_best(T.markdown_metrics(F.col("main_md")), T.markdown_metrics(F.col("body_md")), F.coalesce("fell_back", F.lit(False))))
    guarded = _better(F.col("recovered_md"), F.col("main_md"))
    md = F.when(guarded, F.col("recovered_md")).when(F.col("p.winner") == "main", F.col("main_md")).otherwise(F.col("body_md"))
    title = F.element_at("metadata", "title")
    titled = F.when(F.col("reason").isNull(), F.when(title.isNotNull() & ~md.rlike(r"\A# "), F.concat(F.lit("# "), title, F.lit("\n\n"), md)).otherwise(md))
    reason = F.coalesce("reason", F.when(guarded, F.lit("coverage guard")), F.when(F.col("fell_back"), F.lit("main fell back to body")), F.col("p.reason"))
    out = chosen.select("page_id", "url", title.alias("title"), F.when(F.col("reason").isNotNull(), "rejected").when(guarded, "guard").otherwise(F.col("p.winner")).alias("source"), titled.alias("markdown"), "metadata", reason.alias("extractor_reason"), "html_len", "has_article")
    out = out.withColumn("m", T.markdown_metrics(F.col("markdown")))
    m = F.col("m")
    quality = F.when(m["len"] > 500, 0.3).otherwise(0.0) + F.when(m["len"] / F.col("html_len") > 0.02, 0.2).otherwise(0.0) + F.when(F.col("has_article"), 0.2).otherwise(0.0) + F.when(m["headings"] >= 1, 0.15).otherwise(0.0) + F.when(m["paragraphs"] >= 3, 0.15).otherwise(0.0)
    out = out.withColumn("quality", F.when(m["len"] == 0, 0.0).otherwise(T.half_up(quality, 2)))
    render = T.render_decision(m, F.col("extractor_reason"), F.col("quality"), F.lit(None).cast("string"))
    return out.select("page_id", "url", "title", "source", "markdown", "metadata", "quality", "extractor_reason", render["yes"].alias("render"))

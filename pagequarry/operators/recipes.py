"""Rules for sites: which pages they match, how they merge, what they do to a document."""

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import urls as U
from pagequarry.operators import dom

RULE = "rule_no int, name string, host array<string>, path string, preprocess array<string>, remove array<string>, content array<string>, extractor string, fields map<string,string>"


def host_pattern(glob: Column) -> Column:
    """A host glob as a pattern of the whole host: * stands for anything."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(F.lower(glob), r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))


def path_pattern(glob: Column) -> Column:
    """A path glob: ** stands for anything, * for one or more characters but slashes; null is every path."""
    quoted = F.regexp_replace(F.coalesce(glob, F.lit("/**")), r"([.+?^${}()|\[\]\\])", r"\\$1")
    starred = F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]+")), F.lit("\u0001"), F.lit(".*"))
    return F.concat(F.lit("^"), starred, F.lit("$"))


#: A host has so many labels at most that can be looked up: names have 253 characters.
LABELS = 127
#: Bytes of rules without a fixed label that are sent to every executor.
SENT_BYTES = 1 << 25


def _ends(host: Column) -> Column:
    """A host and what is left of it after each dot."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(LABELS))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def match_recipes(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, names, preprocess, remove, content, extractor, fields): each page's matching rules merged in rule order.

    Lists are joined, of scalars and of each field the last that is not null wins.

    The rules are an index by what their host globs end in after the last star, cut to whole labels (`*.news.example.org` under `news.example.org`). A host meets the
    rules under itself and under each of its ends by equal keys, so any number of rules will do, and patterns are only tried on these. Globs that end in a
    star or within a label's middle have no key; they are sent to every executor while they are small, and else meet all hosts in a join of their own. Hosts are looked up once each, however many pages they have.
    """
    globs = rules.select("rule_no", F.explode("host").alias("glob")).where("glob is not null").select("rule_no", F.lower("glob").alias("glob")).distinct()
    after = F.regexp_extract("glob", r"([^*]*)$", 1)
    key = F.when(~F.contains(F.col("glob"), F.lit("*")), F.col("glob")).otherwise(F.nullif(F.regexp_extract(after, r"^[^.]*\.(.*)$", 1), F.lit("")))
    keyed = globs.select("rule_no", host_pattern(F.col("glob")).alias("pattern"), key.alias("key"))
    at = pages.select("page_id", U.url_domain(F.col("url")).alias("host"), F.when(U.url_path(F.col("url")) == "", "/").otherwise(U.url_path(F.col("url"))).alias("at"))
    hosts = at.where("host is not null").select("host").distinct()
    by_end = hosts.select("host", F.explode(_ends(F.col("host"))).alias("key")).join(keyed.where("key is not null"), "key")
    free = keyed.where("key is null").drop("key")
    size = free.agg(F.sum(F.length("pattern") + 16)).first()[0] or 0
    others = hosts.join(F.broadcast(free) if size <= SENT_BYTES else free, F.rlike(F.col("host"), F.col("pattern")))
    on_host = by_end.where(F.rlike(F.col("host"), F.col("pattern"))).select("host", "rule_no").unionByName(others.select("host", "rule_no")).distinct()
    ready = rules.select("*", path_pattern(F.col("path")).alias("paths")).drop("host", "path")
    found = at.join(on_host.join(ready, "rule_no"), "host").where(F.rlike(F.col("at"), F.col("paths")))
    ordered = found.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("rule_no", "name", "preprocess", "remove", "content", "extractor", F.map_entries("fields").alias("fields")))).alias("r"))
    flat = lambda c: F.flatten(F.filter(F.col(f"r.{c}"), lambda x: x.isNotNull()))
    last = lambda entries: F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return ordered.select("page_id", F.col("r.name").alias("names"), flat("preprocess").alias("preprocess"), flat("remove").alias("remove"), flat("content").alias("content"), F.get(F.reverse(F.filter("r.extractor", lambda x: x.isNotNull())), F.lit(0)).alias("extractor"), F.map_from_entries(last(flat("fields"))).alias("fields"))


ACTIONS = ("remove-attr", "remove-class", "remove-element", "unwrap", "replace-with-text", "prepend-text", "grid-to-table")


def load_recipes(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rules of JSON files, default first: a later rule of a file with the same name wins; rule_no follows file and place; rejected rows carry a reason."""
    schema = "name string, host string, path string, preprocess array<struct<action:string,selector:string,value:string>>, select struct<remove:array<string>,content:array<string>>, extractor string, frontmatter struct<fields:map<string,string>>"
    parts = []
    for k, p in enumerate(paths):
        raw = spark.read.text(p, wholetext=True).select(F.from_json("value", "array<string>").alias("all"))
        parts.append(raw.select(F.lit(k).alias("file"), F.posexplode("all").alias("at", "json")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("file", "at", "json", F.from_json("json", schema).alias("r"))
    hosts = F.coalesce(F.from_json(F.get_json_object("json", "$.host"), "array<string>"), F.array(F.col("r.host")))
    bad_action = F.exists(F.coalesce("r.preprocess", F.expr("cast(array() as array<struct<action:string,selector:string,value:string>>)")), lambda a: ~F.coalesce(a["action"].isin(*ACTIONS), F.lit(False)))
    reason = F.when(F.col("r.name").isNull() | (F.col("r.name") == ""), "no name").when(F.col("r.host").isNull(), "no host").when(F.col("r.path").isNotNull() & ~F.col("r.path").startswith("/"), "path without a slash").when(bad_action, "unknown action")
    judged = rows.withColumn("hosts", hosts).withColumn("reason", reason)
    good = judged.where("reason IS NULL").withColumn("again", F.row_number().over(W.partitionBy("file", "r.name").orderBy(F.desc("at")))).where("again = 1")
    number = F.row_number().over(W.orderBy("file", "at"))
    accepted = good.select(number.alias("rule_no"), "r.name", F.col("hosts").alias("host"), "r.path", F.transform("r.preprocess", lambda a: F.to_json(a)).alias("preprocess"), F.col("r.select.remove").alias("remove"), F.col("r.select.content").alias("content"), "r.extractor", F.col("r.frontmatter.fields").alias("fields"))
    return accepted, judged.where("reason IS NOT NULL").select("file", "at", F.col("r.name").alias("name"), "reason")


def _grid_to_table(node: dom.Node) -> None:
    cells = [c for c in node.children if isinstance(c, dom.Node)]
    width = int(node.attrs.get("data-columns") or 0) or 2
    table = dom.Node("table", {}, node)
    for k in range(0, len(cells), width):
        row = dom.Node("tr", {}, table)
        table.children.append(row)
        for c in cells[k : k + width]:
            cell = dom.Node("td", {}, row)
            cell.children = c.children
            row.children.append(cell)
    node.children = [table]


def apply_actions(root: dom.Node, actions: Sequence[str | dict]) -> None:
    """The seven actions on a document; one with an invalid selector does nothing."""
    for action in actions:
        a = json.loads(action) if isinstance(action, str) else action
        kind, value = a.get("action"), a.get("value") or ""
        for node in dom.select(root, a.get("selector") or ""):
            if node.parent is None:
                continue
            if kind == "remove-attr":
                node.attrs.pop(value, None)
            elif kind == "remove-class":
                node.attrs["class"] = " ".join(c for c in node.classes if c != value)
            elif kind == "remove-element":
                node.drop()
            elif kind == "unwrap":
                node.replace(*node.children)
            elif kind == "replace-with-text":
                node.replace(value or node.text())
            elif kind == "prepend-text":
                node.children.insert(0, value)
            elif kind == "grid-to-table":
                _grid_to_table(node)


def content_of(root: dom.Node, selectors: Sequence[str], least: int = 200) -> list[dom.Node]:
    """The outermost matches of the selectors, in order, if they hold enough text."""
    found = [n for s in selectors for n in dom.select(root, s)]
    ids = set(map(id, found))
    outer = []
    for n in root.elements():
        if id(n) in ids:
            up = n.parent
            while up is not None and id(up) not in ids:
                up = up.parent
            if up is None:
                outer.append(n)
    return outer if sum(len(n.text().strip()) for n in outer) >= least else []


def apply_recipes(pages: DataFrame, merged: DataFrame) -> DataFrame:
    """(page_id, html): the pages that have a merged rule, after its actions and removals; of the content selectors the outermost matches if they suffice. Null where there is no markup, or where it is beyond the limits."""
    from pagequarry.operators.pages import _each, beyond

    def run(html: str | None, rule: str) -> str | None:
        if html is None or beyond(html):
            return None
        r, root = json.loads(rule), dom.parse(html)
        apply_actions(root, r.get("preprocess") or ())
        for s in r.get("remove") or ():
            for n in dom.select(root, s):
                n.drop()
        chosen = content_of(root, r.get("content") or ())
        return "".join(map(dom.to_html, chosen)) if chosen else dom.to_html(root)

    joined = pages.join(merged.select("page_id", F.to_json(F.struct("preprocess", "remove", "content")).alias("rule")), "page_id")
    return joined.select("page_id", _each("string", run)(F.col("html"), F.col("rule")).alias("html"))


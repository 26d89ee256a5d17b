"""Documents of other formats held in a column: text files, tables, JSON, feeds, notebooks, subtitles."""

import codecs
import csv
import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as T

META_CHARSET = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([\w-]+)""", re.I)
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decode(content: bytes | None, header: str | None, html: bool) -> tuple[str, str]:
    """(charset, text): the header's charset, else a byte-order mark, else a page's meta tag in its first 2048 bytes, else UTF-8; a text file that isn't UTF-8 is Windows-1252."""
    raw = content or b""
    charset = (m[1] if (m := re.search(r"charset=[\"']?([\w-]+)", header or "", re.I)) else None) or next((name for mark, name in BOMS if raw.startswith(mark)), None)
    if not charset and html and (m := META_CHARSET.search(raw[:2048])):
        charset = m[1].decode("ascii")
    try:
        charset = codecs.lookup(charset).name if charset else None
    except LookupError:
        charset = None
    if not charset:
        try:
            return "utf-8", raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            return ("utf-8", raw.decode("utf-8", "replace")) if html else ("windows-1252", raw.decode("cp1252", "replace"))
    return charset, raw.decode(charset, "replace").removeprefix("﻿")


def decode_bytes(df: DataFrame, content: str = "content", header: str | None = None, html: bool = True) -> DataFrame:
    """df with columns charset and text."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(x, y, html) for x, y in zip(a, b)], columns=["charset", "text"])

    got = F.pandas_udf(run, "struct<charset:string,text:string>")(F.col(content), F.col(header) if header else F.lit(None).cast("string"))
    return df.withColumn("__d", got).withColumns({"charset": F.col("__d.charset"), "text": F.col("__d.text")}).drop("__d")


DELIMITERS = (",", ";", "\t", "|")


def sniff(text: str) -> str:
    """The delimiter that the first ten lines use most evenly outside quotes; a `sep=` line decides."""
    if m := re.match(r"sep=(.)\r?\n", text):
        return m[1]
    lines = [re.sub(r'"(?:[^"]|"")*"', "", x) for x in text.splitlines()[:10] if x.strip()]
    best, rank = ",", (False, 0)
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        if counts and min(counts) > 0 and (len(set(counts)) == 1, min(counts)) > rank:
            best, rank = d, (len(set(counts)) == 1, min(counts))
    return best


def to_table(text: str | None, delimiter: str | None = None) -> str | None:
    """A Markdown table of delimited text; null where its delimiter is a quote or a line end, or it doesn't read."""
    text = text or ""
    delimiter = delimiter or sniff(text)
    if delimiter in ('"', "\r", "\n"):
        return None
    text = re.sub(r"\Asep=.\r?\n", "", text)
    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))
    try:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
    except csv.Error:
        return None
    if not rows:
        return ""
    wide = max(map(len, rows))
    line = lambda r: "| " + " | ".join(re.sub(r"\s*[\r\n]+\s*", " ", c).replace("|", "\\|").strip() for c in r + [""] * (wide - len(r))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * wide, *map(line, rows[1:])])


def _text_udf(function, text: Column) -> Column:
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([function(x) for x in a], dtype=object)

    return F.pandas_udf(run, "string")(text)


def sniff_delimiter(text: Column) -> Column:
    return _text_udf(lambda x: sniff(x or ""), text)


def delimited_to_markdown(text: Column) -> Column:
    return _text_udf(to_table, text)


def table_to_markdown(df: DataFrame, cols: list[str], by: list[str], order_by: list[str]) -> DataFrame:
    """(by, markdown): the rows of each group as one Markdown table, in order."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cols)), F.lit(" |"))
    listed = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order_by, row.alias("row")))).alias("x"))
    head = "| " + " | ".join(cols) + " |\n|" + " --- |" * len(cols) + "\n"
    return listed.select(*by, F.concat(F.lit(head), F.array_join("x.row", "\n")).alias("markdown"))


def json_documents(df: DataFrame, text: str) -> DataFrame:
    """df with valid, title (of title or name, 300 characters at most) and body, the document in a fence. JSON Lines are valid if each line is."""
    lines = F.filter(F.split(F.trim(F.col(text)), "\n"), lambda x: F.trim(x) != "")
    whole = F.try_parse_json(F.col(text))
    valid = whole.isNotNull() | (F.size(lines) > 0) & F.forall(lines, lambda x: F.try_parse_json(x).isNotNull())
    field = lambda k: F.nullif(F.try_variant_get(whole, f"$.{k}", "string"), F.lit(""))
    return df.withColumns({"valid": F.coalesce(valid, F.lit(False)), "title": F.substring(F.coalesce(field("title"), field("name")), 1, 300), "body": T.fence(F.col(text), "json")})


def entries(text: str | None) -> list[tuple]:
    """(title, link, date, author, body) of each item of an RSS, RDF or Atom feed; none if it doesn't parse or declares entities."""
    if not text or "<!ENTITY" in text:
        return []
    try:
        root = ET.fromstring(text.strip())
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    out = []
    for item in root.iter():
        if local(item) not in ("item", "entry"):
            continue
        parts = {}
        for c in item:
            parts.setdefault(local(c), c)
        said = lambda *names: next((v for n in names if n in parts and (v := " ".join("".join(parts[n].itertext()).split()))), None)
        links = [c.get("href") for c in item if local(c) == "link" and c.get("href") and c.get("rel", "alternate") == "alternate"]
        out.append((said("title"), links[0] if links else said("link"), said("pubDate", "published", "updated", "date"), said("author", "creator"), said("encoded", "content", "description", "summary")))
    return out


def feed_entries(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(feed_id, pos, title, link, date, author, body): one row for each entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, *e) for i, text in batch.itertuples(index=False) for k, e in enumerate(entries(text))]
            yield pd.DataFrame(rows, columns=["feed_id", "pos", "title", "link", "date", "author", "body"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInPandas(run, f"feed_id {kind}, pos bigint, title string, link string, date string, author string, body string")


NOTEBOOK = (
    "struct<nbformat:double,worksheets:variant,metadata:struct<title:variant,authors:variant,kernelspec:struct<language:string>,language_info:struct<name:string>>,"
    "cells:array<struct<cell_type:string,source:variant,outputs:array<struct<output_type:string,text:variant,data:map<string,variant>,ename:string,evalue:string,traceback:variant>>>>>"
)
#: Terminal sequences that go, and what stands for an image, by language.
TERMINAL = r"\x{1B}\[[0-9;?]*[ -/]*[@-~]|\x{1B}\][^\x{07}\x{1B}]*(?:\x{07}|\x{1B}\\)|\x{1B}[@-Z\\-_]"
IMAGE_NOTES = {"de": "*[Bildausgabe]*", "en": "*[image output]*"}


def _joined(v: Column, between: str = "") -> Column:
    return F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), between), F.try_variant_get(v, "$", "string"), F.lit(""))


def _end_trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"{T.BLANKS}+\z", "")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(_end_trimmed(c), rf"\A{T.BLANKS}+", "")


def _said(c: Column) -> Column:
    """Text without terminal sequences, lines ended by line feeds, blanks at its end gone."""
    return _end_trimmed(F.regexp_replace(F.regexp_replace(c, TERMINAL, ""), r"\r\n?", "\n"))


def _output(o: Column, image: str) -> Column:
    """The block of a cell's output; empty where it says nothing."""

    def block(text: Column) -> Column:
        return T.let(F.regexp_replace(text, r"\n+\z", ""), lambda x: F.when(x == "", "").otherwise(T.fence(x, "text")))

    def of(kind: str) -> Column:
        return _joined(F.element_at(o["data"], F.lit(kind)))

    def both(a: Column, b: Column, between: str) -> Column:
        return F.array_join(F.filter(F.array(a, b), lambda x: x != ""), between)

    markdown = of("text/markdown")
    shown = F.when(F.rlike(markdown, F.lit(r"\S")), F.regexp_replace(_trimmed(markdown), TERMINAL, "")).when(F.exists(F.map_keys(o["data"]), lambda k: k.startswith("image/")), image).otherwise(block(_said(of("text/plain"))))
    failed = block(_said(both(both(o["ename"], o["evalue"], ": "), _said(_joined(o["traceback"], "\n")), "\n")))
    kind = o["output_type"]
    return F.when(kind == "stream", block(_said(_joined(o["text"])))).when(kind.isin("execute_result", "display_data"), shown).when(kind == "error", failed).otherwise("")


HEADING = r"(?m)^#[ \t]+(.+)$"


def notebook_to_markdown(df: DataFrame, id_col: str, text_col: str, name_col: str | None = None, lang: str = "de") -> DataFrame:
    """(id, title, author, markdown): the title, then the cells in order: code in fences of the kernel's language, outputs and errors in fences of text, a note for an image.

    The title is the notebook's own, else the first heading of its Markdown cells (which goes from the first cell if it begins it), else
    the file's name. What is no notebook of format 4 or has no cells gives no row. A notebook is read, cell by cell, in its own row.
    """
    name = F.col(name_col) if name_col else F.lit(None).cast("string")
    read = df.select(F.col(id_col).alias("id"), name.alias("name"), F.from_json(text_col, NOTEBOOK).alias("n"))
    old = (F.coalesce("n.nbformat", F.lit(0.0)) != 0) & (F.col("n.nbformat") < 4) | F.try_variant_get("n.worksheets", "$", "array<variant>").isNotNull()
    read = read.where((F.size("n.cells") > 0) & ~F.coalesce(old, F.lit(False)))
    kept = F.filter("n.cells", lambda c: c.isNotNull())
    cells = F.transform(kept, lambda c: F.struct(c["cell_type"].alias("kind"), F.regexp_replace(_joined(c["source"]), r"\r\n?", "\n").alias("source"), c["outputs"].alias("outputs")))
    meta = F.col("n.metadata")
    language = F.lower(F.coalesce(F.nullif(meta["language_info"]["name"], F.lit("")), F.nullif(meta["kernelspec"]["language"], F.lit("")), F.lit("python")))
    author = F.coalesce(F.try_variant_get(meta["authors"], "$[0].name", "string"), F.when(F.try_variant_get(meta["authors"], "$[0]", "map<string,variant>").isNull(), F.try_variant_get(meta["authors"], "$[0]", "string")))
    own = F.when(F.schema_of_variant(meta["title"]) == "STRING", F.nullif(_trimmed(F.try_variant_get(meta["title"], "$", "string")), F.lit("")))
    read = read.select("id", "name", cells.alias("cells"), language.alias("language"), F.nullif(_trimmed(author), F.lit("")).alias("author"), own.alias("own"))

    def heading(text: Column) -> Column:
        line = F.regexp_extract(text, HEADING, 1)
        return _trimmed(F.coalesce(F.nullif(F.regexp_replace(line, r"[ \t#]+\z", ""), F.lit("")), F.substring(line, 1, 1)))

    headed = F.get(F.filter("cells", lambda c: (c["kind"] == "markdown") & F.rlike(c["source"], F.lit(HEADING))), F.lit(0))
    stem = F.element_at(F.split("name", r"[\\/]"), -1)
    stem = F.coalesce(F.nullif(F.regexp_replace(stem, r"\.[^.]+$", ""), F.lit("")), F.nullif(stem, F.lit("")), F.lit("Notebook"))
    first = F.regexp_replace(F.get("cells", F.lit(0))["source"], r"\A\s*\n", "")
    read = read.withColumn("said", F.nullif(heading(headed["source"]), F.lit(""))).withColumn("title", F.coalesce("own", "said", stem))
    begins = F.col("own").isNull() & (F.get("cells", F.lit(0))["kind"] == "markdown") & F.rlike(first, F.lit(r"\A#[ \t]+.")) & (heading(first) == F.col("title"))
    read = read.withColumn("begins", F.coalesce(begins, F.lit(False)))

    def blocks(c: Column, i: Column) -> Column:
        text = F.when((i == 0) & F.col("begins"), F.regexp_replace(F.regexp_replace(c["source"], r"\A\s*\n", ""), r"\A[^\n]*\n?", "")).otherwise(c["source"])
        tag = F.when(c["kind"] == "code", F.col("language")).otherwise("")
        fenced = T.let(_end_trimmed(c["source"]), lambda x: F.when(x == "", "").otherwise(T.fence(x, tag)))
        outputs = F.coalesce(F.transform(c["outputs"], lambda o: _output(o, IMAGE_NOTES[lang])), F.array().cast("array<string>"))
        return F.when(c["kind"] == "markdown", F.array(_trimmed(text))).when(c["kind"] == "code", F.concat(F.array(fenced), outputs)).when(c["kind"] == "raw", F.array(fenced))

    parts = F.filter(F.flatten(F.filter(F.transform("cells", blocks), lambda b: b.isNotNull())), lambda b: b != "")
    read = read.withColumn("body", F.array_join(parts, "\n\n"))
    return read.select("id", "title", "author", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.when(F.col("body") == "", "").otherwise(F.concat("body", F.lit("\n")))).alias("markdown"))


TIMING = r"((?:[0-9]+:)?[0-9]{1,2}:[0-9]{2}[.,][0-9]{1,3})\s+-->\s+((?:[0-9]+:)?[0-9]{1,2}:[0-9]{2}[.,][0-9]{1,3})"


def seconds(code: Column) -> Column:
    parts = F.split(F.replace(code, F.lit(","), F.lit(".")), ":")
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p.cast("double"))


def parse_cues(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, cue_no, start, stop, line_no, line): the lines of SRT or WebVTT cues without tags; blocks without a timing are left out."""
    blocks = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), r"\n[ \t]*\n+")).alias("cue_no", "block"))
    timed = blocks.where(F.col("block").rlike(TIMING)).select("id", "cue_no", seconds(F.regexp_extract("block", TIMING, 1)).alias("start"), seconds(F.regexp_extract("block", TIMING, 2)).alias("stop"), F.regexp_extract("block", r"(?s)-->[^\n]*\n?(.*)", 1).alias("body"))
    lines = timed.select("id", "cue_no", "start", "stop", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    # tags and position marks go without a trace
    return lines.withColumn("line", T.strip_tags(F.regexp_replace("line", r"<[^>]*>|\{\\[^}]*\}", ""))).where("line <> ''")

"""Markdown documents as rows of blocks: one linear pass over the lines of each."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
LIST = re.compile(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$)")
HTML = re.compile(r"^ {0,3}<(?:[A-Za-z/!?])")
ROW, RULER = re.compile(r"\|"), re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def parse_blocks(markdown: str | None) -> list[tuple[str, int | None, int, int, str]]:
    """(type, level, first line, last line, text) of heading, paragraph, code, table, list, blockquote and html blocks."""
    lines, out, at = (markdown or "").split("\n"), [], 0

    def kind_at(k: int) -> str:
        line = lines[k]
        if not line.strip():
            return "blank"
        if FENCE.match(line):
            return "code"
        if HEADING.match(line):
            return "heading"
        if line.startswith(("    ", "\t")):
            return "indented"
        if ROW.search(line) and k + 1 < len(lines) and "|" in lines[k + 1] and RULER.match(lines[k + 1]):
            return "table"
        if re.match(r"^ {0,3}>", line):
            return "blockquote"
        if LIST.match(line):
            return "list"
        return "html" if HTML.match(line) else "paragraph"

    while at < len(lines):
        kind, level, end = kind_at(at), None, at + 1
        if kind == "blank":
            at += 1
            continue
        if kind == "heading":
            level = len(HEADING.match(lines[at])[1])
        elif kind == "code":
            mark = FENCE.match(lines[at])[1]
            while end < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[end]):
                end += 1
            end = min(end + 1, len(lines))
        elif kind == "indented":
            kind = "code"
            while end < len(lines) and (not lines[end].strip() or lines[end].startswith(("    ", "\t"))):
                end += 1
        elif kind == "table":
            while end < len(lines) and "|" in lines[end] and lines[end].strip():
                end += 1
        elif kind == "list":
            while end < len(lines):
                if not lines[end].strip():
                    if end + 1 < len(lines) and (LIST.match(lines[end + 1]) or lines[end + 1].startswith(("  ", "\t"))):
                        end += 1
                        continue
                    break
                if kind_at(end) in ("heading", "code", "blockquote", "table") and not lines[end].startswith("  "):
                    break
                end += 1
        else:
            stop = {"paragraph": ("blank", "heading", "code", "table", "blockquote", "list"), "blockquote": ("blank", "heading", "code", "table", "list"), "html": ("blank",)}[kind]
            while end < len(lines) and kind_at(end) not in stop:
                end += 1
        while end > at + 1 and not lines[end - 1].strip() and kind != "code":
            end -= 1
        out.append((kind, level, at, end - 1, "\n".join(lines[at:end])))
        at = end
    return out


def markdown_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, type, level, start_line, end_line, text): one row for each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, *b) for i, text in batch.itertuples(index=False) for k, b in enumerate(parse_blocks(text))]
            out = pd.DataFrame(rows, columns=["id", "idx", "type", "level", "start_line", "end_line", "text"])
            out["level"] = out["level"].astype("Int64")
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, idx bigint, type string, level bigint, start_line bigint, end_line bigint, text string")

"""Scalar functions over Markdown and plain text, as column expressions."""

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING, TABLE_LINE, FENCE = r"(?m)^#{1,6} ", r"(?m)^\|.+\|$", r"(?m)^```"
PARAGRAPH = r"(?:^|\n\n)[A-Za-zÀ-ÿ0-9][^\n]{40}"
TOKEN = r"[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*"


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def half_up(c: Column, digits: int) -> Column:
    """Rounds halves up as binary fractions fall, unlike round()."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def markdown_metrics(md: Column) -> Column:
    """struct(len, headings, tables, code_blocks, paragraphs); null counts as empty."""
    md = empty(md)
    return F.struct(
        F.length(md).alias("len"),
        F.regexp_count(md, F.lit(HEADING)).alias("headings"),
        F.regexp_count(md, F.lit(TABLE_LINE)).alias("tables"),
        F.floor(F.regexp_count(md, F.lit(FENCE)) / 2).cast("int").alias("code_blocks"),
        F.regexp_count(md, F.lit(PARAGRAPH)).alias("paragraphs"),
    )


def extract_score(m: Column) -> Column:
    """How much a conversion has, 0 to 1: six parts length up to 5000, four parts structure (half headings, a quarter tables, a quarter code)."""
    some = lambda c, share: F.when(c >= 1, share).otherwise(0.0)
    structure = some(m["headings"], 0.5) + some(m["tables"], 0.25) + some(m["code_blocks"], 0.25)
    return F.when(m["len"] == 0, 0.0).otherwise(half_up(F.least(m["len"] / 5000.0, F.lit(1.0)) * 0.6 + structure * 0.4, 2))


def quality_score(md: Column, html: Column | None = None) -> Column:
    """0 to 1 by length, share of the raw page, an article or main element, headings and paragraphs; without a page its two shares are granted."""
    m = markdown_metrics(md)
    bonus = F.lit(0.4)
    if html is not None:
        page = empty(html)
        of_page = F.when(m["len"] / F.length(page) > 0.02, 0.2).otherwise(0.0) + F.when(page.rlike(r"(?i)<(article|main)\b"), 0.2).otherwise(0.0)
        bonus = F.when(page == "", 0.4).otherwise(of_page)
    total = F.when(m["len"] > 500, 0.3).otherwise(0.0) + bonus + F.when(m["headings"] >= 1, 0.15).otherwise(0.0) + F.when(m["paragraphs"] >= 3, 0.15).otherwise(0.0)
    return F.when(empty(md) == "", 0.0).otherwise(F.least(half_up(total, 2), F.lit(1.0)))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(empty(text)) / 4)


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits, with points and hyphens inside them."""
    return F.regexp_extract_all(F.lower(empty(text)), F.lit(TOKEN), F.lit(0))


def markdown_title(md: Column, fallback: Column) -> Column:
    """The first level-one heading without closing marks, else the fallback."""
    found = F.rtrim(F.regexp_replace(F.regexp_extract(empty(md), r"(?m)^#[ \t]+(.+)$", 1), r"[ \t]+#+[ \t]*$", ""))
    return F.when(found != "", found).otherwise(fallback)


def strip_comments(md: Column) -> Column:
    """Without the last comments section and what follows it."""
    return F.regexp_replace(md, r"(?s)^(.*)\n---\n+## Comments \([0-9]+ of [0-9]+\).*$", "$1")


#: What a backslash escapes, and code, in which it doesn't.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CODE = r"(?s)(?<!\\)```.*?```|(?<!\\)`[^`\n]*`"
#: Where escaped marks wait while others are taken off: code points of no character.
PARKED = "".join(chr(0xE000 + ord(c)) for c in PUNCTUATION)
LINE_ENDS = re.compile("([\n\r\u2028\u2029])")
BLANKS = r"[\s\x{00A0}\x{FEFF}\x{2028}\x{2029}]"
#: Marks that are taken off, in this order.
MARKS = (rf"(?m)^#{{1,6}}{BLANKS}+", ""), *((rf"{m}([^\n\r\x{{2028}}\x{{2029}}]+?){m}", "$1") for m in (r"\*\*", r"\*", "__", "_", "~~"))
LAST_MARKS = (rf"(?m)^>{BLANKS}?", ""), (rf"(?m)^[-*+]{BLANKS}+", "- "), (r"(?m)^---+$", "---")
OUTER = {"both": rf"\A{BLANKS}+|{BLANKS}+\z", "start": rf"\A{BLANKS}+", "end": rf"{BLANKS}+\z"}


def links_written_out(text: str | None) -> str | None:
    """Images become their address, then links `text (address)`; a link ends on its line. Every search goes forward only."""
    if text is None or "](" not in text:
        return text
    for opener in ("![", "["):
        lines = LINE_ENDS.split(text)
        for n, line in enumerate(lines):
            out, at = [], 0
            while (i := line.find(opener, at)) >= 0 and (j := line.find("](", i + 2)) >= 0 and (k := line.find(")", j + 3)) >= 0:
                address = line[j + 2 : k]
                out += [line[at:i], address if opener == "![" else f"{line[i + 1 : j]} ({address})"]
                at = k + 1
            lines[n] = "".join(out) + line[at:]
        text = "".join(lines)
    return text


def _links_written_out(texts: pa.Array) -> pa.Array:
    return pa.array([links_written_out(t) for t in texts.to_pylist()], pa.string())


def strip_markdown(md: Column, trimmed: str = "both") -> Column:
    """Plain text of Markdown: headings, emphasis and quotes go, list marks become hyphens, images their address, links `text (address)`; escaped marks stay as they are, and code keeps its marks and backslashes.

    Escapes outside code are parked first: the text is cut into code, escapes and the rest, and what an escape holds is put out of the way.
    trimmed: blanks go at both ends, or at the "start" or "end" only, for the first and the last part of a text.
    """
    text = empty(md)
    escape = rf"\\[{re.escape(PUNCTUATION)}]"
    cut = F.regexp_extract_all(text, F.lit(rf"{CODE}|{escape}|[^\\`]+|."), F.lit(0))
    parked = F.transform(cut, lambda t: F.when((F.length(t) == 2) & t.startswith("\\"), F.translate(F.substring(t, 2, 1), PUNCTUATION, PARKED)).otherwise(t))
    out = F.when(F.contains(text, F.lit("\\")), F.array_join(parked, "")).otherwise(text)
    for pattern, by in MARKS:
        out = F.regexp_replace(out, pattern, by)
    out = F.when(F.contains(out, F.lit("](")), F.arrow_udf(_links_written_out, "string")(out)).otherwise(out)
    for pattern, by in (*LAST_MARKS, (OUTER[trimmed], "")):
        out = F.regexp_replace(out, pattern, by)
    return F.translate(out, PARKED, PUNCTUATION)


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value) with the value worked out once; inside higher-order functions nothing else shares it."""
    return F.transform(F.array(value), function)[0]


def fence(text: Column, lang: Column | str = "") -> Column:
    """The text between fences of one backtick more than its longest run of them, three at least."""
    runs = F.transform(F.regexp_extract_all(empty(text), F.lit("`+"), F.lit(0)), F.length)
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(mark, lang if isinstance(lang, Column) else F.lit(lang), F.lit("\n"), empty(text), F.lit("\n"), mark)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.substr(F.regexp_replace(F.regexp_replace(F.lower(empty(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(1), F.lit(60)), "-+$", "")


def url_basename(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.regexp_extract(empty(url), r"^([^?#]*)", 1))
    base = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.regexp_replace(F.coalesce(F.try_url_decode(base), base), r"\.[A-Za-z0-9]{1,8}$", "")


FILE_SOURCES = ("image-caption", "audio-transcript", "markitdown", "pdf-ocr")


def suggest_filename(source: Column, title: Column, url: Column, share: Column, video: Column, prefix: str = "", as_of: Column | None = None) -> Column:
    """A name for the converted file, by source, with a chain of fallbacks; prefix is a date template."""
    some = lambda c: F.nullif(c, F.lit(""))
    slug, base = some(slugify(title)), some(slugify(url_basename(url)))
    of_video = some(F.concat_ws("-", slug, some(video)))
    name = F.when((source == "youtube") & of_video.isNotNull(), F.concat(F.lit("YT-"), of_video)).when(source.isin(*FILE_SOURCES) & base.isNotNull(), base)
    name = F.coalesce(name, slug, base, some(slugify(share)), F.lit("document"))
    if prefix and as_of is not None:
        name = F.concat(F.date_format(as_of, prefix), name)
    return F.concat(name, F.lit(".md"))


def relative_time(ts: Column, as_of: Column) -> Column:
    age = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    out = F.when(age < 60, F.lit("just now"))
    for least, unit, name in ((3600, 60, "m"), (86400, 3600, "h"), (2592000, 86400, "d"), (31536000, 2592000, "mo")):
        out = out.when(age < least, F.concat(F.floor(age / unit).cast("string"), F.lit(f"{name} ago")))
    return out.otherwise(F.concat(F.floor(age / 31536000).cast("string"), F.lit("y ago")))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_tags(html: Column) -> Column:
    """Without tags, five entities decoded, white space collapsed."""
    out = F.regexp_replace(empty(html), "<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def clean_text(text: Column) -> Column:
    """Without lines that hold nothing but a zero-width space, and without terminal colour codes."""
    mark = r"[ \t]*(?:&#x200[bB];|&#8203;|\x{200B})[ \t]*"
    out = F.regexp_replace(empty(text), rf"(?m)^{mark}(?:\n|\z)\n?", "")
    return F.regexp_replace(out, r"\x{1B}\[[0-9;]*m", "")


def parse_caption(reply: Column) -> Column:
    """struct(description, transcript): a reply cut at its first line of three hyphens."""
    lines = F.split(empty(reply), "\n")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x)), F.lit("---")).cast("int")
    head = F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(lines)
    tail = F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.trim(F.array_join(head, "\n")).alias("description"), F.trim(F.array_join(tail, "\n")).alias("transcript"))


def render_caption(caption: Column) -> Column:
    """A quoted block of the description, and of the transcript if there is one."""
    quoted = lambda c: F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    more = F.when(caption["transcript"] != "", F.concat(F.lit("\n>\n"), quoted(caption["transcript"]))).otherwise("")
    return F.concat(quoted(caption["description"]), more)


QUOTED = r"(?i): |\t| #|[\r\n]|\"|'|\\|^[\s>|!&*?{}\[\]@`%-]|^(true|false|null|yes|no|on|off|~)$"


def quote_yaml(c: Column) -> Column:
    escaped = F.regexp_replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), r"[\r\n]+", " ")
    return F.when(c.rlike(QUOTED), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(c)


def build_frontmatter(fields: Sequence[tuple[str, Column]], more: Column | None = None, reserved: Sequence[str] = (), allow: Sequence[str] | None = None) -> Column:
    """A block of `key: value` lines, nulls and empty strings left out. more: a map whose fields win over the listed ones and come last."""
    taken = F.map_keys(more) if more is not None else F.array().cast("array<string>")
    lines = [F.when((empty(v.cast("string")) != "") & ~F.array_contains(taken, F.lit(k)), F.concat(F.lit(f"{k}: "), quote_yaml(v.cast("string")))) for k, v in fields if allow is None or k in allow]
    if more is not None:
        usable = F.map_filter(more, lambda k, v: (empty(v) != "") & ~k.isin(*reserved) & (k.isin(*allow) if allow is not None else F.lit(True)))
        lines.append(F.nullif(F.array_join(F.transform(F.map_entries(usable), lambda e: F.concat(e["key"], F.lit(": "), quote_yaml(e["value"]))), "\n"), F.lit("")))
    body = F.concat_ws("\n", *lines)
    return F.when(body == "", "").otherwise(F.concat(F.lit("---\n"), body, F.lit("\n---\n\n")))


OWN_BLOCK = r"(?s)\A---\n(.*?)\n---\n"


def parse_frontmatter(md: Column) -> Column:
    """struct(block, title, body) of a document that may open with a frontmatter block."""
    block = F.regexp_extract(empty(md), OWN_BLOCK, 1)
    title = F.regexp_extract(block, r'(?m)^title: "?(.*?)"?$', 1)
    return F.struct(F.nullif(block, F.lit("")).alias("block"), F.nullif(title, F.lit("")).alias("title"), F.regexp_replace(empty(md), OWN_BLOCK + r"\n?", "").alias("body"))


def merge_frontmatter(md: Column, fields: Sequence[tuple[str, Column]]) -> Column:
    """md with the fields added to its block unless it has them; without a block it gets one."""
    block = F.regexp_extract(empty(md), OWN_BLOCK, 1)
    have = lambda k: block.rlike(rf"(?m)^{k}:")
    new = F.concat_ws("\n", *(F.when((empty(v.cast("string")) != "") & ~have(k), F.concat(F.lit(f"{k}: "), quote_yaml(v.cast("string")))) for k, v in fields))
    body = F.regexp_replace(empty(md), OWN_BLOCK + r"\n?", "")
    lines = F.concat_ws("\n", F.nullif(block, F.lit("")), F.nullif(new, F.lit("")))
    return F.when(lines == "", empty(md)).otherwise(F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"), body))


def term_coverage(terms: Column, tokens: Column) -> Column:
    """Share of the different terms that the tokens hold."""
    asked = F.array_distinct(terms)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, tokens)) / F.size(asked))


def filter_fields(requested: Column, known: Sequence[str]) -> Column:
    """struct(kept, dropped) of the requested field names."""
    names = F.array(*map(F.lit, known))
    return F.struct(F.array_intersect(requested, names).alias("kept"), F.array_except(requested, names).alias("dropped"))


def compact_table_line(line: Column) -> Column:
    """A table line without padding, a separator row with three hyphens to a cell; other lines as they are."""
    tight = F.regexp_replace(F.regexp_replace(line, r"[ \t]*\|[ \t]*", "|"), r"-{3,}", "---")
    padded = F.regexp_replace(F.regexp_replace(line, r"[ \t]+\|", " |"), r"\|[ \t]+", "| ")
    return F.when(line.rlike(r"^\|[\s:|-]+\|$"), tight).when(line.rlike(r"^\|.*\|$"), padded).otherwise(line)


def compact_tables(md: Column) -> Column:
    """compact_table_line for each line outside fences; a fence is closed by its own kind of mark only."""
    lines = F.split(empty(md), "\n")
    start = F.struct(F.lit("").alias("open"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(state: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, "^\\s*(```|~~~)", 1)
        new = F.when((state["open"] != "") | (mark != ""), line).otherwise(compact_table_line(line))
        now = F.when(mark == "", state["open"]).when(state["open"] == "", mark).when(state["open"] == mark, "").otherwise(state["open"])
        return F.struct(now.alias("open"), F.concat(state["out"], F.array(new)).alias("out"))

    return F.aggregate(lines, start, step, lambda s: F.array_join(s["out"], "\n"))


def pick_best(main: Column, other: Column, fell_back: Column) -> Column:
    """struct(winner, reason, score) of two metrics structs: the main extract unless a rule favours the other."""
    # The thresholds of the rules, in order.
    rules = [
        (other["len"] == 0, "main", "other is empty"),
        (fell_back & (other["len"] >= 500), "other", "main fell back"),
        ((main["len"] < 500) & (other["len"] > 1000), "other", "main is thin"),
        ((main["tables"] >= 3) & (other["tables"] < main["tables"] - 2), "main", "other lost tables"),
        ((other["len"] > main["len"] * 1.2) & (other["headings"] > 0), "other", "other is longer, with headings"),
        ((main["len"] > other["len"] * 1.2) & (main["headings"] > 0), "main", "main is longer, with headings"),
    ]
    winner = reason = None
    for when, who, why in rules:
        winner = F.when(when, who) if winner is None else winner.when(when, who)
        reason = F.when(when, why) if reason is None else reason.when(when, why)
    winner, reason = winner.otherwise("main"), reason.otherwise("no rule")
    score = F.when(winner == "main", extract_score(main)).otherwise(extract_score(other))
    return F.struct(winner.alias("winner"), reason.alias("reason"), score.alias("score"))


def render_decision(m: Column, reason: Column, quality: Column, override: Column) -> Column:
    """struct(yes, reason): whether a page needs a second pass in a browser."""
    # The thresholds of the two kinds of poor extracts, and the least quality.
    soup = (m["headings"] >= 5) & (m["paragraphs"] > 0) & (m["headings"] > m["paragraphs"] * 3) & (m["len"] < 5000)
    thin = F.contains(empty(reason), F.lit("fell back")) & (m["len"] < 500)
    why = F.when(override == "force", "forced").when(override == "skip", "skipped").when(thin, "thin fallback").when(soup, "body soup").when(quality < 0.5, "low quality").otherwise("static is fine")
    return F.struct((~why.isin("skipped", "static is fine")).alias("yes"), why.alias("reason"))


def challenge_vendor(html: Column) -> Column:
    """The vendor of a bot challenge that stands in for the page, else null."""
    # How far a page is read, and the marks of two vendors.
    head = F.substr(empty(html), F.lit(1), F.lit(8192))
    first = head.rlike(r"(?i)<title>\s*Just a moment\.\.\.\s*</title>") & head.rlike(r"(?i)cdn-cgi/challenge-platform|cf-chl|_cf_chl_opt")
    second = head.rlike(r"(?i)/\.bunny-shield/") & head.rlike(r"(?i)data-pow=|shield-challenge\.js")
    return F.when(first, "Cloudflare").when(second, "Bunny Shield")


def is_binary(text: Column) -> Column:
    """Whether the start of a text holds a NUL."""
    return F.instr(F.substr(empty(text), F.lit(1), F.lit(8192)), "\0") > 0


def classify_file(filename: Column, content_type: Column) -> Column:
    """Kind of a file by its extension, else by its content type."""
    extension = F.lower(F.regexp_extract(empty(filename), r"\.([A-Za-z0-9]+)$", 1))
    kinds = (("delimited", ("csv", "tsv", "tab"), "text/(csv|tab-separated-values)"), ("json", ("json", "jsonl", "ndjson", "geojson"), "json"), ("feed", ("rss", "atom", "rdf"), "(rss|atom|rdf)"), ("notebook", ("ipynb",), "ipynb"), ("subtitles", ("srt", "vtt"), "(vtt|subrip)"), ("html", ("html", "htm", "xhtml"), "html"), ("xml", ("xml",), "(text|application)/xml"), ("image", ("png", "jpg", "jpeg", "webp", "gif"), "^image/"), ("audio", ("mp3", "wav", "m4a", "ogg"), "^audio/"), ("text", ("txt", "md", "log"), "^text/"))
    out = None
    for kind, names, _ in kinds:
        out = F.when(extension.isin(*names), kind) if out is None else out.when(extension.isin(*names), kind)
    for kind, _, pattern in kinds:
        out = out.when(F.lower(empty(content_type)).rlike(pattern), kind)
    return out.otherwise("unknown")

"""Data inside pages: JSON-LD nodes and paths, append blocks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import pages as P


def ld(*values):
    return "".join(f'<script type="application/ld+json">{v if isinstance(v, str) else json.dumps(v)}</script>' for v in values)


def candidates(v, out):
    """All nodes of a value, plainly."""
    if isinstance(v, list):
        for x in v:
            candidates(x, out)
    elif isinstance(v, dict):
        out.append(v)
        if isinstance(v.get("@graph"), list):
            candidates(v["@graph"], out)
    return out


def test_nodes_however_deep(spark):
    rng = random.Random(5)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            return rng.choice([1, "s[[", None, True, {"n": rng.randrange(9)}])
        if kind < 0.6:
            return [made(depth - 1) for _ in range(rng.randrange(3))]
        return {"@type": rng.choice(["A", ["B", "A"]]), "@graph": made(depth - 1), "n": rng.randrange(9)}

    values = [[made(6), made(3)] for _ in range(40)] + [[[[[[[{"@type": "A"}]]]]]], [], ["broken {", {"@type": "A", "x": 1}]]
    df = spark.createDataFrame([(i, ld(*v)) for i, v in enumerate(values)], "page_id long, html string")
    got = {}
    for r in P.jsonld_nodes(df).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append((r["types"], json.loads(r["node"])))
    for i, v in enumerate(values):
        nodes = [n for x in v if x != "broken {" for n in candidates(x, [])]
        types = [None if "@type" not in n else n["@type"] if isinstance(n["@type"], list) else [n["@type"]] for n in nodes]
        assert got.get(i, []) == list(zip(types, nodes))


PATHS = [
    ({"a": {"b": "x"}}, "a.b", "x"), ({"a": [{"b": ["x", "y"]}]}, "a.b", "x"), ({"a": [[{"b": 1}]]}, "a.b", None), ({"a": []}, "a", None), ({"a": {}}, "a", None),
    ({"a": None}, "a", None), ({"a": 3}, "a", "3"), ({"a": 2.5}, "a", "2.5"), ({"a": True}, "a", "true"), ({"a": "x"}, "a.b", None), ({"a": [None, "x"]}, "a", None), ({"a?'\"": {"b": ""}}, "a?'\".b", ""), ({"a": [["x"]]}, "a", None),
]


@pytest.mark.parametrize(("node", "path", "want"), PATHS)
def test_paths(spark, node, path, want):
    df = spark.createDataFrame([(json.dumps(node),)], "node string").select(F.try_parse_json("node").alias("v"))
    assert df.select(P.jsonld_path(F.col("v"), path).alias("x")).first()["x"] == want


def test_field_is_of_the_first_node_that_has_the_type(spark):
    df = spark.createDataFrame([(1, ld({"@type": ["B", "A"], "x": 1}, {"@type": "A", "x": 2})), (2, ld({"@type": "a", "x": 1})), (3, None)], "page_id long, html string")
    found = P.jsonld_field(P.jsonld_nodes(df), "A", "x")
    assert [tuple(r) for r in found.collect()] == [(1, "1")]
    assert "Python" not in found._jdf.queryExecution().toString()


def plain_blocks(data, specs):
    """The blocks of one page, one after another."""

    def walk(v, path):
        for part in path:
            if isinstance(part, int):
                if not isinstance(v, list) or part >= len(v):
                    return None, False
            elif not isinstance(v, dict) or part not in v:
                return None, False
            v = v[part]
        return v, True

    text = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    parts, notes, spent = [], [], 0
    for s in specs:
        at, there = walk(data, s.path)
        if not there or at is None:
            continue
        if s.fields is None:
            lines = [text(x) for x in (at[: s.limit] if isinstance(at, list) else [at])]
        else:
            rows = [r for r in (at if isinstance(at, list) else [at]) if isinstance(r, dict)][: s.limit]
            lines = ["{" + ",".join(f'"{n}":{text(walk(r, p)[0])}' for n, p in s.fields.items() if walk(r, p)[1]) + "}" for r in rows]
        if not lines:
            continue
        n = len(lines)
        noun = lambda k: "Zeile" if k == 1 else "Zeilen"
        head, size = f"\n\n## {s.title}\n\n```json\n", lambda x: len(x.encode())
        budget = min(65536, 131072 - spent) - size(head) - 4 - size(f"\n\nGekürzt: {n} von {n} Zeilen ausgegeben.")
        if budget < 1024:
            notes.append(f"{s.title} (übersprungen, Budget erschöpft)")
            continue
        kept = max(k for k in range(n + 1) if k == 0 or size("[\n" + ",\n".join(lines[:k]) + "\n]") <= budget)
        if not kept:
            notes.append(f"{s.title} (übersprungen, einzelner Datensatz zu groß)")
            continue
        block = head + "[\n" + ",\n".join(lines[:kept]) + "\n]\n```" + (f"\n\nGekürzt: {kept} von {n} {noun(n)} ausgegeben." if kept < n else "")
        parts.append(block)
        spent += size(block)
        notes.append(f"{s.title} ({kept} von {n} {noun(n)})" if kept < n else f"{s.title} ({kept} {noun(kept)})")
    return "".join(parts), notes


def test_blocks_at_their_limits(spark):
    rng = random.Random(6)
    B = P.AppendBlock
    specs = [
        B("Grün", "script#a", ("l",), None), B("Fields", "#a", ("l",), {"ä": ("x",), "deep": ("y", 0, "z"), "no": ("no",)}, 7), B("One", "#a", ("o",), {"x": ("x",)}),
        B("Scalar", "#a", ("l", 0, "x")), B("No", "#a", ("l", "length")), B("Null", "#a", ("n",)), B("Odd", "#a", ("k.'?\"",), None, 3), B("Last", "#a", ("l",), {"x": ("x",)}, 1000),
    ]
    pages = []
    for i in range(30):
        rows = [rng.choice([{"x": "ü" * rng.choice([1, 300, 9000, 20000]), "y": [{"z": None}]}, {"x": j}, 5, {"y": []}]) for j in range(rng.randrange(12))]
        pages.append({"l": rows, "o": {"x": [1, {"b": 1, "a": "]"}]}, "n": None, "k.'?\"": [1, "a", None, 2]})
    exact = 65536 - len("\n\n## Grün\n\n```json\n".encode()) - 4 - len("\n\nGekürzt: 1 von 1 Zeilen ausgegeben.".encode())
    pages += [{"l": ["x" * (exact - 6 + d)]} for d in (0, 1)]  # a row that just fits and one that just doesn't
    html = [f'<script id=b>{{}}</script><SCRIPT type="application/json" id="a">{json.dumps(p, ensure_ascii=False)}</SCRIPT><script id=a>[]</script>' for p in pages]
    df = spark.createDataFrame(list(enumerate([*html, None, "", '<script id="a">{bad</script>', '<script id="a"> </script>'])), "page_id long, html string")
    got = {r["page_id"]: (r["markdown"], r["notes"]) for r in P.append_blocks(df, specs).collect()}
    assert len(got) == len(html) + 4
    for i, p in enumerate(pages):
        assert got[i] == plain_blocks(p, specs), i
    assert got[30][1] == ["Grün (1 Zeile)"] and got[31][1] == ["Grün (übersprungen, einzelner Datensatz zu groß)"]
    for i in range(len(pages), len(pages) + 4):
        assert got[i] == ("", [])
    assert P.append_blocks(df, []).first()["markdown"] == ""
    assert "Exchange" not in P.append_blocks(df, specs)._jdf.queryExecution().executedPlan().toString()


def test_selectors_of_scripts():
    with pytest.raises(ValueError):
        P._script_pattern("div script")


def test_guard_takes_prose_of_one_container_only(spark):
    prose = [f"{'word ' * 40}number {i}." for i in range(150)]
    flat = "".join(f"<section><p>{x}</p></section>" for x in prose)
    short = "<article><p>" + "lead " * 60 + "</p></article>"
    listing = "".join(f"<div><p>{x}</p></div>" for x in prose)
    nav = "<div>" + "".join(f"<p>{'x' * 8000}</p>" for _ in range(4)) + "</div>"
    pages = [f"<html><body><div id=all>{short}{flat}</div></body></html>", f"<html><body>{short}{listing}</body></html>", f"<html><body>{nav}</body></html>"]
    df = spark.createDataFrame([(i, f"https://a.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    thin = df.withColumns({"markdown": F.when(F.col("page_id") != 2, F.lit("lead " * 60)), "body_len": F.lit(30_000)})
    got = {r["page_id"]: r["recovered_md"] for r in P.coverage_guard(thin).collect()}
    assert "number 149" in got[0] and got[1] is None and got[2] is None  # one wrapper; many siblings; four paragraphs
    whole = {r["page_id"]: r for r in P.convert_pages(df).collect()}
    assert "number 149" in whole[0]["markdown"] and whole[1]["source"] != "guard" and whole[2]["source"] != "guard"

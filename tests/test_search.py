"""Search and extracts against plain loops over all documents and queries."""

import math
import random
import re
from collections import Counter

import pytest

from pagequarry.operators import extracts, sections
from pagequarry.operators.markdown_blocks import parse_blocks

TOKEN = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def bm25(terms: list[str], units: list[list[str]]) -> list[float]:
    average = sum(map(len, units)) / len(units) if units else 0
    if not average:
        return [0.0] * len(units)
    counts, out = [Counter(u) for u in units], [0.0] * len(units)
    for t in terms:
        df = sum(t in c for c in counts)
        for k, c in enumerate(counts):
            out[k] += math.log(1 + (len(units) - df + 0.5) / (df + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(units[k]) / average)) if c[t] else 0
    return [round(x, 9) for x in out]


def cost(text: str) -> int:
    return math.ceil(len(text) / 4)


class Section:
    def __init__(self, heading, level, parent, order):
        self.heading, self.level, self.parent, self.order, self.blocks, self.children = heading, level, parent, order, [], []

    def own(self):
        return ([self.heading] if self.heading is not None else []) + self.blocks

    def all(self):
        return self.own() + [b for c in self.children for b in c.all()]

    def over(self):
        return [] if self.parent is None else self.parent.over() + ([self.parent.heading] if self.parent.heading is not None else [])


def window(texts, pool, scores, budget):
    best = max(range(len(pool)), key=lambda k: (scores[k], -k))
    got, left, right, spent = [best], best, best, cost(texts[pool[best]])
    while True:
        before = len(got)
        if right + 1 < len(pool) and spent + cost(texts[pool[right + 1]]) <= budget:
            right += 1
            got.append(right)
            spent += cost(texts[pool[right]])
        if left > 0 and spent + cost(texts[pool[left - 1]]) <= budget:
            left -= 1
            got.append(left)
            spent += cost(texts[pool[left]])
        if len(got) == before:
            break
    for k in sorted((k for k in range(len(pool)) if k not in got and scores[k] > 0 and scores[k] >= 0.1 * scores[best]), key=lambda k: (-scores[k], k)):
        if spent + cost(texts[pool[k]]) <= budget:
            got.append(k)
            spent += cost(texts[pool[k]])
    return {pool[k] for k in got}, pool[best]


def plain(md: str, query: str, budget: int, marker: str):
    """(markdown, confidence, sections) or None where no term occurs."""
    terms = list(dict.fromkeys(tokens(query)))[:64]
    blocks = parse_blocks(md)
    texts = [b[4] for b in blocks]
    root = now = Section(None, 0, None, 0)
    listed = [root]
    for k, (kind, level, *_) in enumerate(blocks):
        if kind == "heading":
            up = now
            while up.level >= level and up is not root:
                up = up.parent
            now = Section(k, level, up, len(listed))
            up.children.append(now)
            listed.append(now)
        else:
            now.blocks.append(k)
    words = lambda ks: [t for k in ks for t in tokens(texts[k])]
    regions = lambda got: sum(k - 1 not in got for k in got)
    if len(listed) - 1 < 2:
        scores = bm25(terms, [tokens(t) for t in texts])
        if max(scores, default=0) <= 0:
            return None
        got, best = window(texts, range(len(texts)), scores, budget)
        count, unit = regions(got), tokens(texts[best])
    else:
        listed = [s for s in listed if s.own()]
        scores = bm25(terms, [words(s.own()) for s in listed])
        if max(scores) <= 0:
            return None
        order = sorted((k for k, x in enumerate(scores) if x > 0 and x >= 0.1 * max(scores)), key=lambda k: (-scores[k], listed[k].order))
        top = listed[order[0]]
        if cost("\n\n".join(texts[k] for k in top.own())) > budget:
            pool = top.all()
            inner = bm25(terms, [tokens(texts[k]) for k in pool])
            got, best = window(texts, pool, inner, budget) if max(inner) > 0 else (set(), pool[0])
            got |= set(top.over()) | ({top.heading} if top.heading is not None else set())
            count, unit = regions(got), tokens(texts[best])
        else:
            got, used, spent, unit = set(), set(), 0, words(top.own())
            for n, k in enumerate(order):
                s = listed[k]
                new = set(s.over() + s.own()) - got
                if n and spent + sum(cost(texts[b]) for b in new) > budget:
                    break
                got |= new
                spent += sum(cost(texts[b]) for b in new)
                used.add(s.order)
                if cost("\n\n".join(texts[b] for b in s.blocks)) < 40:
                    for c in s.children:
                        new = set(c.all()) - got
                        if spent + sum(cost(texts[b]) for b in new) > budget:
                            break
                        got |= new
                        spent += sum(cost(texts[b]) for b in new)
                        used.add(c.order)
            count = len(used)
    out = ""
    for k in sorted(got):
        out += ("" if not out else "\n\n" if k - 1 in got else f"\n\n{marker}\n\n") + texts[k]
    return out, "high" if sum(t in unit for t in terms) / len(terms) >= 0.5 else "medium", count


def made(rng: random.Random, headings: float) -> str:
    parts = []
    for _ in range(rng.randrange(1, 40)):
        if rng.random() < headings:
            parts.append("#" * rng.randrange(1, 5) + " " + " ".join(rng.choices("alpha beta gamma head".split(), k=rng.randrange(1, 4))))
        else:
            parts.append(" ".join(rng.choices("alpha beta gamma delta x y z filler filler other-word 1.5".split(), k=rng.choice((2, 5, 30, 150, 400)))))
    return "\n\n".join(parts)


@pytest.mark.parametrize("budget", [64, 300, 900])
def test_extracts_against_loops(spark, budget):
    rng = random.Random(budget)
    docs = [(i, made(rng, (0.0, 0.05, 0.3, 0.7)[i % 4])) for i in range(60)] + [(60, None), (61, ""), (62, "alpha " * 20_000), (63, "# a\n\n## b\n\nalpha " * 900)]
    queries = [(1, "alpha beta"), (2, "Delta gamma nowhere"), (3, "filler"), (4, "nowhere"), (5, None), (6, " ".join(f"w{k}" for k in range(70)) + " alpha"), (7, "1.5 other-word head")]
    found = extracts.query_extract(spark.createDataFrame(docs, "doc_id long, markdown string"), spark.createDataFrame(queries, "query_id long, query string"), max_tokens=budget)
    got = {(r["id"], r["query_id"]): r for r in found.collect()}
    assert len(got) == found.count()
    small = max(800, int(budget * 1.25))
    for i, md in docs:
        whole = got.pop((i, None))
        assert whole["markdown"] == (md or "") and whole["confidence"] == (None if cost(md or "") <= small else "low") and not whole["extracted"]
        for q, query in queries:
            want = plain(md, query, budget, sections.ELISION) if cost(md or "") > small else None
            row = got.pop((i, q), None)
            assert (row and (row["markdown"], row["confidence"], row["sections_selected"])) == want, (i, q)
            assert row is None or row["extracted"] and row["returned_tokens"] == cost(row["markdown"]) and row["original_tokens"] == cost(md)
    assert not got


def test_queries_are_asked_block_by_block(spark, monkeypatch):
    rng = random.Random(0)
    docs = spark.createDataFrame([(i, made(rng, 0.3)) for i in range(20)], "doc_id long, markdown string")
    queries = spark.createDataFrame([(k, w) for k, w in enumerate("alpha beta gamma delta x y z".split())], "query_id long, query string")
    every = sorted(map(str, extracts.query_extract(docs, queries).collect()))
    monkeypatch.setattr(extracts, "AT_ONCE", 3)
    assert sorted(map(str, extracts.query_extract(docs, queries).collect())) == every


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_against_loops(spark, k):
    rng = random.Random(k)
    words = [f"w{n}" for n in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (n + 1) for n in range(60)], k=rng.randrange(0, 60)))) for i in range(300)] + [(300, None), (301, ""), (302, "w59"), (303, "w59")]
    queries = [(q, " ".join(rng.sample(words, rng.randrange(1, 20)))) for q in range(25)] + [(97, "nowhere"), (98, None), (99, "w0")]
    found = sections.bm25_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"), k)
    got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in found.collect())
    units = [tokens(t) for _, t in docs]
    want = []
    for q, query in queries:
        scores = bm25(list(dict.fromkeys(tokens(query))), units)
        best = sorted((n for n, x in enumerate(scores) if x > 0), key=lambda n: (-scores[n], docs[n][0]))[:k]
        want += [(q, r, docs[n][0], round(scores[n], 6)) for r, n in enumerate(best, 1)]
    assert got == sorted(want)


def test_pairs_are_not_shuffled(spark):
    """Scores of documents and queries are summed without an exchange of their own; only each part's best are."""
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "b"), (2, "a c")], "query_id long, query string")
    plan = sections.bm25_search(docs, queries)._jdf.queryExecution().optimizedPlan().toString() + sections.bm25_search(docs, queries)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in exchanges if "query_id" in line and "id#" in line.replace("query_id#", "")] and "WindowGroupLimit" in plan


def test_large_sides_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "b"), (2, "a c")], "query_id long, query string")
    few = sections.bm25_search(docs, queries).collect()
    monkeypatch.setattr(sections, "SENT_BYTES", 0)
    assert sorted(few) == sorted(sections.bm25_search(docs, queries).collect())

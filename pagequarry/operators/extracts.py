"""The part of a document that answers a query, within a budget of tokens.

Blocks, sections and their tokens are DataFrame work; each document, with its blocks held once, then meets every query in one small fold that
adds BM25 weights up for all queries together and chooses greedily for those that hit. No row for each document and query is ever shuffled.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators.markdown_blocks import markdown_blocks
from pagequarry.operators.sections import ELISION, section_tree

#: A section below so many tokens brings its children; candidates have this share of the best score; covered terms that make a hit certain;
#: terms of a query that count; tokens up to which a document comes back whole, and the share of the budget that does, too.
THIN, RATIO, CERTAIN, TERMS, SMALL, SMALL_SHARE = 40, 0.1, 0.5, 64, 800, 1.25
LEAST_BUDGET, MOST_BUDGET, BUDGET = 64, 20_000, 600
#: Queries that are sent to the workers at once; more are asked block by block.
AT_ONCE = 20_000
#: Queries that a document's weights are added up for at once, and characters of a batch of results.
STEP, OUT_CHARS = 512, 1 << 22
EXTRACT = "query_id bigint, markdown string, extracted boolean, confidence string, sections_selected bigint, original_tokens bigint, returned_tokens bigint"


def tokens_of(chars: int) -> int:
    return -(-chars // 4)


def weights(tf: np.ndarray, lengths: np.ndarray, k1: float = 1.5, b: float = 0.75) -> np.ndarray:
    """BM25 weight of each term (row) in each unit (column)."""
    n, average = len(lengths), lengths.mean() if len(lengths) else 0.0
    if not average:
        return np.zeros(tf.shape)
    df = (tf > 0).sum(axis=1)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf[:, None] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths / average))


class Page:
    """A document's blocks, the sections over them, and where the queries' terms stand."""

    def __init__(self, blocks: Sequence[dict], vocabulary: dict[str, int]):
        self.texts = [b["text"] for b in blocks]
        self.cost = [tokens_of(len(t)) for t in self.texts]
        self.headings = sum(b["type"] == "heading" for b in blocks)
        self.lengths = np.array([len(b["tokens"]) for b in blocks], float)
        rows: dict[int, int] = {}
        at: list[tuple[int, int]] = []
        for k, b in enumerate(blocks):
            for token in b["tokens"]:
                term = vocabulary.get(token)
                if term is not None:
                    at.append((rows.setdefault(term, len(rows)), k))
        self.rows = rows
        self.tf = np.zeros((len(rows), len(blocks)))
        if at:
            np.add.at(self.tf, tuple(np.array(at).T), 1)
        self.own: dict[int, list[int]] = {}
        self.up: dict[int, int | None] = {}
        for k, b in enumerate(blocks):
            self.own.setdefault(b["section"], []).append(k)
            self.up.setdefault(b["section"], b["parent"])
        self.sections = sorted(self.own)
        self.place = {s: k for k, s in enumerate(self.sections)}
        self.children: dict[int, list[int]] = {}
        for s in self.sections:
            if self.up[s] is not None:
                self.children.setdefault(self.up[s], []).append(s)

    def chars(self, blocks: Sequence[int]) -> int:
        return sum(len(self.texts[k]) for k in blocks) + 2 * max(0, len(blocks) - 1)

    def above(self, section: int) -> list[int]:
        """The headings over a section."""
        out, up = [], self.up[section]
        while up:
            out.append(self.own[up][0])
            up = self.up[up]
        return out

    def below(self, section: int) -> list[int]:
        """All blocks of a section and its subsections, in order."""
        out, todo = [], [section]
        while todo:
            s = todo.pop()
            out += self.own.get(s, [])
            todo += self.children.get(s, [])
        return sorted(out)

    def unit_tf(self) -> np.ndarray:
        return np.stack([self.tf[:, self.own[s]].sum(axis=1) for s in self.sections], axis=1)

    def unit_lengths(self) -> np.ndarray:
        return np.array([self.lengths[self.own[s]].sum() for s in self.sections])

    def around(self, pool: Sequence[int], scores: np.ndarray, budget: int) -> tuple[set[int], int]:
        """Blocks of a pool round its best one, the following before the preceding in turn while they fit, then further ones by score that fit; and the best."""
        best = int(scores.argmax())
        taken, spent, low, high = {best}, self.cost[pool[best]], best, best
        grown = True
        while grown:
            grown = False
            for step in (1, -1):
                k = high + 1 if step > 0 else low - 1
                if 0 <= k < len(pool) and spent + self.cost[pool[k]] <= budget:
                    taken.add(k)
                    spent += self.cost[pool[k]]
                    low, high, grown = min(low, k), max(high, k), True
        for k in sorted(np.flatnonzero((scores > 0) & (scores >= RATIO * scores[best])).tolist(), key=lambda k: (-scores[k], k)):
            if k not in taken and spent + self.cost[pool[k]] <= budget:
                taken.add(k)
                spent += self.cost[pool[k]]
        return {pool[k] for k in taken}, pool[best]

    def by_sections(self, scores: np.ndarray, terms: np.ndarray, budget: int) -> tuple[set[int], int | None, np.ndarray]:
        """Blocks, how many sections they are of (None: count regions), and the columns of the unit that fits best."""
        fit = np.flatnonzero((scores > 0) & (scores >= RATIO * scores.max())).tolist()
        ranked = [self.sections[k] for k in sorted(fit, key=lambda k: (-scores[k], k))]
        top = ranked[0]
        if tokens_of(self.chars(self.own[top])) > budget:
            pool = self.below(top)
            inner = np.round(weights(self.tf[:, pool], self.lengths[pool])[terms].sum(axis=0), 9)
            taken, best = self.around(pool, inner, budget) if inner.max() > 0 else (set(), pool[0])
            return taken | set(self.above(top)) | ({self.own[top][0]} if top else set()), None, self.tf[:, best]
        taken, spent, used = set(), 0, set()
        for n, s in enumerate(ranked):
            new = set(self.above(s)) | set(self.own[s])
            more = sum(self.cost[k] for k in new - taken)
            if n and spent + more > budget:
                break
            taken, spent, used = taken | new, spent + more, used | {s}
            if tokens_of(self.chars(self.own[s][1:] if s else self.own[s])) < THIN:
                for child in self.children.get(s, []):
                    new = set(self.below(child))
                    more = sum(self.cost[k] for k in new - taken)
                    if spent + more > budget:
                        break
                    taken, spent, used = taken | new, spent + more, used | {child}
        return taken, len(used), self.tf[:, self.own[top]].sum(axis=1)


def answers(blocks: Sequence[dict], asked: Sequence[tuple[int, Sequence[int]]], vocabulary: dict[str, int], budget: int, marker: str) -> Iterator[tuple]:
    """(query, markdown, confidence, sections) for each query (id, terms) that has a term in the blocks."""
    page = Page(blocks, vocabulary)
    if not page.rows:
        return
    sectioned = page.headings >= 2
    each = weights(page.unit_tf(), page.unit_lengths()) if sectioned else weights(page.tf, page.lengths)
    own = [np.array([page.rows[t] for t in terms if t in page.rows], np.int64) for _, terms in asked]
    for first in range(0, len(asked), STEP):
        held = np.zeros((min(STEP, len(asked) - first), len(page.rows)))
        for k in range(len(held)):
            held[k, own[first + k]] = 1
        for k, scores in enumerate(np.round(held @ each, 9)):
            if scores.max(initial=0.0) <= 0:
                continue
            (query, terms), rows = asked[first + k], own[first + k]
            if sectioned:
                taken, count, unit = page.by_sections(scores, rows, budget)
            else:
                taken, best = page.around(range(len(blocks)), scores, budget)
                count, unit = None, page.tf[:, best]
            parts, regions, last = [], 0, None
            for b in sorted(taken):
                if last is not None:
                    parts.append("\n\n" if b == last + 1 else f"\n\n{marker}\n\n")
                regions += last is None or b != last + 1
                parts.append(page.texts[b])
                last = b
            sure = (unit[rows] > 0).sum() >= CERTAIN * len(terms)
            yield query, "".join(parts), "high" if sure else "medium", regions if count is None else count


def _blocks_of_queries(queries: DataFrame) -> Iterator[tuple[list[tuple[int, list[int]]], dict[str, int]]]:
    """Up to AT_ONCE queries (id, terms) and the numbers of the terms, again and again."""
    terms = F.slice(F.array_distinct(T.tokenize(F.col("query"))), 1, TERMS)
    asked, vocabulary = [], {}
    for row in queries.select(F.col("query_id").cast("long"), terms.alias("terms")).toLocalIterator(prefetchPartitions=True):
        if row["terms"]:
            asked.append((row["query_id"], [vocabulary.setdefault(t, len(vocabulary)) for t in row["terms"]]))
        if len(asked) == AT_ONCE:
            yield asked, vocabulary
            asked, vocabulary = [], {}
    if asked:
        yield asked, vocabulary


def query_extract(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "markdown", max_tokens: int = BUDGET, marker: str = ELISION) -> DataFrame:
    """(id, query_id, markdown, extracted, confidence, sections_selected, original_tokens, returned_tokens): what of each document answers each query.

    Every query is asked of every document. A document has a row for each query of which it holds a term, and one row without a query: what any other
    query gets, the document whole (with low confidence, or none where it is too small to be cut for any query). Ids of documents are unique.
    """
    spark, budget = docs.sparkSession, max(LEAST_BUDGET, min(MOST_BUDGET, max_tokens))
    whole = docs.select(F.col(id_col).alias("id"), T.empty(F.col(text_col)).alias("markdown"))
    tokens = F.ceil(F.length("markdown") / 4)
    large = tokens > max(SMALL, int(budget * SMALL_SHARE))
    rest = whole.select("id", F.lit(None).cast("long").alias("query_id"), "markdown", F.lit(False).alias("extracted"), F.when(large, "low").alias("confidence"), F.lit(0).cast("long").alias("sections_selected"), tokens.alias("original_tokens"), tokens.alias("returned_tokens"))

    tree = section_tree(markdown_blocks(whole.where(large), "id", "markdown"))
    block = F.struct("idx", "section", "parent", "type", "text", T.tokenize(F.col("text")).alias("tokens"))
    pages = tree.groupBy("id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    pages = pages.join(whole.where(large).select("id", tokens.alias("tokens")), "id")
    schema = f"id {whole.schema['id'].dataType.simpleString()}, {EXTRACT}"
    names = [c.split()[0] for c in schema.split(", ")]

    def asking(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out, size = [], 0
                for i, blocks, original in batch.itertuples(index=False):
                    for query, text, sure, count in answers(blocks, *shared.value, budget, marker):
                        out.append((i, query, text, True, sure, count, original, tokens_of(len(text))))
                        size += len(text)
                        if size > OUT_CHARS:
                            yield pd.DataFrame(out, columns=names)
                            out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

        return run

    for asked in _blocks_of_queries(queries):
        rest = rest.unionByName(pages.mapInPandas(asking(spark.sparkContext.broadcast(asked)), schema))
    return rest

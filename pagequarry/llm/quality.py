"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers about its bytes, words and lines. Every number is cut into bins at quantiles; boosting
visits the features in turn, over and over, and each time fits a tree of at most three leaves to what is left to explain,
whose values go into that feature's lookup table. Then the pairs of features that explain most of the rest get
tables over both bins, boosted likewise by trees that split one and then the other. A score is the logistic
of the sum of the tables' entries, so scoring adds bins and reads tables, vectorised over the texts.

Training reads a bounded sample of the labelled rows (`max_rows`, chosen by a hash of the id); scoring reads whole texts of all rows.

Defined results: null and empty texts have all features zero and get the score of that; repeated rows agree; labels that are
null or whose text is missing are not used, several labels of an id count by their mean; without labels every score is 0.5.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import arrow, range_hashes, slices, small_batches, sums, word_ranges

#: Labelled rows that training reads, about.
MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 6, 150, 0.1

FEATURES = (
    "bytes", "words", "mean_word", "letters", "upper", "digits", "symbols", "stops", "commas", "lines",
    "different_words", "different_lines", "short_words", "long_words", "bare_words", "symbol_ends", "word_spread",
)


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


LETTER = _members(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
UPPER, DIGIT = _members(bytes(range(65, 91))), _members(b"0123456789")
SYMBOL, STOP, COMMA, BREAK = _members(b"#$%&*+<=>@[\\]^_`{|}~/"), _members(b".!?"), _members(b",;:"), _members(b"\n")


def _different(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((hashes, text))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    return np.bincount(text[order][new], minlength=len(before) - 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[text, feature] of concatenated texts."""
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, before = word_ranges(data, offsets)
    lengths, words = ends - starts, np.diff(before)
    some = np.maximum(words, 1)
    per_byte = [sums(x[data], offsets) / size for x in (LETTER, UPPER, DIGIT, SYMBOL)]
    marks = [sums(x[data], offsets) / some for x in (STOP, COMMA)]
    breaks = np.flatnonzero(BREAK[data])
    line_edges = np.unique(np.concatenate([offsets, breaks + 1]))
    line_edges = line_edges[line_edges <= len(data)]
    line_start, line_end = line_edges[:-1], line_edges[1:]
    lines_before = np.searchsorted(line_start, offsets)
    lines = np.maximum(np.diff(lines_before), 1)
    has_letter = np.concatenate([[0], np.cumsum(LETTER[data])])
    bare = (has_letter[ends] == has_letter[starts]).astype(np.float64)
    end_symbol = SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    mean = sums(lengths.astype(np.float64), before) / some
    spread = np.sqrt(np.maximum(sums(lengths.astype(np.float64) ** 2, before) / some - mean**2, 0))
    columns = [
        np.log1p(np.diff(offsets)), np.log1p(words), mean, *per_byte, *marks, lines / some,
        _different(range_hashes(data, starts, ends), before) / some, _different(range_hashes(data, line_start, line_end), lines_before) / lines,
        sums((lengths <= 3).astype(np.float64), before) / some, sums((lengths >= 12).astype(np.float64), before) / some,
        sums(bare, before) / some, sums(end_symbol.astype(np.float64), before) / some, spread,
    ]
    return np.stack(columns, axis=1)


def batch_features(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(FEATURES))), *(features(data, offsets) for _, data, offsets in slices(texts))])


def _best_cut(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    g, h = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    if not len(g):
        return 0.0, 0
    gain = g**2 / (h + 1) + (gradient.sum() - g) ** 2 / (weight.sum() - h + 1) - gradient.sum() ** 2 / (weight.sum() + 1)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values by bin of a tree that cuts the bins greedily."""
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(gradient[a:b], weight[a:b]), a, b) for a, b in parts]
        gain, k, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values over a grid of bins of a tree that cuts one feature and then the other in each half, and its gain."""
    best, gain = np.zeros_like(gradient), -1.0
    for turned in (False, True):
        g, h = (gradient.T, weight.T) if turned else (gradient, weight)
        for k in range(1, len(g)):
            out, total = np.zeros_like(g), 0.0
            for rows in (slice(0, k), slice(k, None)):
                a, b = g[rows].sum(axis=0), h[rows].sum(axis=0)
                leaves = _tree(a, b, 2)
                out[rows] = leaves
                total += float((leaves * (2 * a - leaves * b)).sum())
            if total > gain:
                best, gain = (out.T if turned else out), total
    return best, gain


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Edges of the bins, a table for each feature, pairs of features with a table for each, and the intercept."""
    if not len(y):
        return {"edges": [np.zeros(0)] * len(FEATURES), "tables": [np.zeros(1)] * len(FEATURES), "pairs": [], "intercept": 0.0}
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    intercept = float(np.log(share / (1 - share)))
    total = np.full(len(y), intercept)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(bins):
            g, h = rest()
            step = RATE * _tree(np.bincount(b, g, len(tables[f])), np.bincount(b, h, len(tables[f])))
            tables[f] += step
            total += step[b]
    coarse = [b * PAIR_BINS // len(t) for b, t in zip(bins, tables)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * PAIR_BINS + coarse[b], values, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = rest()
    gains = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(len(bins)) for b in range(a)), reverse=True)
    pairs = [[a, b, np.zeros((PAIR_BINS, PAIR_BINS))] for _, a, b in gains[:PAIRS]]
    for _ in range(rounds // 5):
        for pair in pairs:
            g, h = rest()
            step = RATE * _pair_tree(grid(pair[0], pair[1], g), grid(pair[0], pair[1], h))[0]
            pair[2] += step
            total += step[coarse[pair[0]], coarse[pair[1]]]
    return {"edges": edges, "tables": tables, "pairs": pairs, "intercept": intercept}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    bins = [np.searchsorted(e, c, "right") for e, c in zip(model["edges"], x.T)]
    total = np.full(len(x), model["intercept"])
    for b, t in zip(bins, model["tables"]):
        total += t[b]
    coarse = [b * PAIR_BINS // len(t) for b, t in zip(bins, model["tables"])]
    for a, b, t in model["pairs"]:
        total += t[coarse[a], coarse[b]]
    return 1 / (1 + np.exp(-total))


@arrow("array<double>")
def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        x = batch_features(texts)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> dict:
    """The model, from about max_rows rows of `labels` that have a text."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    share = int(1e6 * min(1.0, max_rows / max(1, known.count()))) + 1
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    got = rows.select("id", "y", _features("text").alias("x")).toPandas().sort_values("id")
    return fit(np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES))), got["y"].to_numpy())


def scorer(spark, model: dict):
    """A function of a text column that gives the score."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @arrow("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(score(shared.value, batch_features(texts)))

    return lambda text: of(text.cast("string"))


def classify(docs: DataFrame, model: dict, text_col: str = "text", into: str = "quality_score") -> DataFrame:
    """docs with a column `into`: the score from 0 to 1; a column of that name in docs is replaced."""
    return docs.withColumn(into, scorer(docs.sparkSession, model)(F.col(text_col)))

"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words and the beginnings of longer words, lower-case, hashed to 64 bits; each counts once. A term has a
weight and a short vector, and a text's score is the logistic of an intercept, the weights, and the dot products of the
vectors of all pairs of its terms, which a square of sums gives without listing the pairs. So an insult beside the mention of a
group can weigh more than the two alone, which sums of weights can't say.

Training reads a bounded sample of the labelled rows (`max_rows`, chosen by a hash of the id). Terms that differ between
toxic and other texts of the sample (G-test) get a place in the model, at most `max_terms`; their weights are fitted by
AdaGrad on the log loss. Scoring reads whole texts of all rows.

Defined results: null and empty texts have no terms and get the intercept's score; repeated rows agree; several labels of an id count
by their mean, several texts of an id count once, exact copies of a text count once for each label; labels that are null or whose
text is missing are not used; without labels every score is 0.5; a column named like `into` is replaced, as withColumn does.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import BLANKS, arrow, range_hashes, release, slices, small_batches

MAX_ROWS, MAX_TERMS = 20_000, 50_000
#: Bytes of a word's beginning that are terms, too.
STEMS = (4, 5, 6)
#: Texts that a term of the model is in at least, and the least G of its table of texts.
LEAST_TEXTS, LEAST_G = 3, 12.0
FACTORS, EPOCHS, BATCH, RATE, SHRINK, SEED = 8, 12, 128, 0.1, 1e-4, 7
#: Different terms that a task adds up before it hands them on.
HELD = 2_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BETWEEN = BLANKS.copy()
BETWEEN[list(b".,;:!?\"'()[]{}<>*_#|/\\")] = True


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of all terms of concatenated texts, with repeats."""
    low = LOWER[data]
    inside = ~BETWEEN[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & ~(np.concatenate([[False], inside[:-1]]) & ~edge[:-1]))
    ends = np.flatnonzero(inside & ~(np.concatenate([inside[1:], [False]]) & ~edge[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    texts, terms = [text], [range_hashes(low, starts, ends)]
    for size in STEMS:
        longer = ends - starts > size
        texts.append(text[longer])
        terms.append(range_hashes(low, starts[longer], starts[longer] + size) * np.uint64(2 * size + 1))
    return np.concatenate(texts), np.concatenate(terms).view(np.int64)


def distinct(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, texts, terms): each text's different terms."""
    for first, data, offsets in slices(texts):
        text, term = hashed(data, offsets)
        order = np.lexsort((term, text))
        text, term = text[order], term[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
        yield first, text[new], term[new]


def _known(terms: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Each term's place in the sorted vocabulary, or -1."""
    at = np.searchsorted(vocabulary, terms)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == terms, at, -1) if len(vocabulary) else np.full(len(terms), -1)


def active(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, places): the places in the vocabulary of each text's different terms."""
    counts, places = np.zeros(len(texts) + 1, np.int64), [np.zeros(0, np.int64)]
    for first, data, offsets in slices(texts):
        text, term = hashed(data, offsets)
        at = _known(term, vocabulary)
        both = np.unique(text[at >= 0] * max(1, len(vocabulary)) + at[at >= 0])
        text, at = both // max(1, len(vocabulary)), both % max(1, len(vocabulary))
        counts[first + 1 : first + len(offsets)] = np.bincount(text, minlength=len(offsets) - 1)
        places.append(at)
    return np.cumsum(counts), np.concatenate(places)


def _added(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def margin(model: dict, offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Intercept, weights and pairs of each text: half of (sum of vectors)^2 less the sum of their squares."""
    v = model["vectors"][places]
    return model["intercept"] + _added(model["weights"][places], offsets) + 0.5 * (_added(v, offsets) ** 2 - _added(v**2, offsets)).sum(axis=1)


def fit(offsets: np.ndarray, places: np.ndarray, y: np.ndarray, vocabulary: np.ndarray, epochs: int = EPOCHS) -> dict:
    """The model of texts given by the places of their terms, and their labels from 0 to 1."""
    rng, size = np.random.default_rng(SEED), len(vocabulary)
    model = {"vocabulary": vocabulary, "intercept": 0.0, "weights": np.zeros(size), "vectors": rng.normal(0, 0.05, (size, FACTORS))}
    if not len(y):
        return model | {"vectors": np.zeros((size, FACTORS))}
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model["intercept"] = float(np.log(share / (1 - share)))
    seen = {"intercept": 1e-8, "weights": np.full(size, 1e-8), "vectors": np.full((size, FACTORS), 1e-8)}
    lengths = np.diff(offsets)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for rows in np.array_split(order, max(1, len(y) // BATCH)):
            n = lengths[rows]
            own = np.concatenate([[0], np.cumsum(n)])
            at = places[np.repeat(offsets[rows] - own[:-1], n) + np.arange(own[-1])]
            error = 1 / (1 + np.exp(-np.clip(margin(model, own, at), -30, 30))) - y[rows]
            terms, where = np.unique(at, return_inverse=True)
            each, text = np.repeat(error, n), np.repeat(np.arange(len(rows)), n)
            v = model["vectors"][at]
            gradient = {"weights": np.bincount(where, each, len(terms)), "vectors": np.zeros((len(terms), FACTORS))}
            np.add.at(gradient["vectors"], where, each[:, None] * (_added(v, own)[text] - v))
            for name, g in gradient.items():
                g = g + SHRINK * len(rows) * model[name][terms]
                seen[name][terms] += g**2
                model[name][terms] -= RATE * g / np.sqrt(seen[name][terms])
            seen["intercept"] += error.sum() ** 2
            model["intercept"] -= RATE * error.sum() / np.sqrt(seen["intercept"])
    return model


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, texts, toxic) of a task's texts: in how many a term is, and the sum of their labels."""
    terms, texts, toxic = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def added(*parts: tuple) -> tuple:
        t, n, y = (np.concatenate(p) for p in zip(*parts))
        u, where = np.unique(t, return_inverse=True)
        return u, np.bincount(where, n, len(u)).astype(np.int64), np.bincount(where, y, len(u))

    def batch_of() -> pa.RecordBatch:
        return pa.record_batch({"term": pa.array(terms), "texts": pa.array(texts), "toxic": pa.array(toxic)})

    for batch in batches:
        label = batch.column("y").to_numpy(zero_copy_only=False)
        for first, text, term in distinct(batch.column("text")):
            terms, texts, toxic = added((terms, texts, toxic), (term, np.ones(len(term), np.int64), label[first + text]))
            if len(terms) > HELD:
                yield batch_of()
                terms, texts, toxic = terms[:0], texts[:0], toxic[:0]
    yield batch_of()
    release()


def telling(terms: DataFrame, texts: int, toxic: float, max_terms: int = MAX_TERMS) -> np.ndarray:
    """The terms with the largest G of the table (has the term, is toxic), sorted."""
    n, k, rest = F.col("texts"), F.col("toxic"), F.lit(float(texts))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    bad, good = F.lit(float(toxic)), F.lit(float(texts - toxic))
    g = 2 * (part(k, n * bad / rest) + part(n - k, n * good / rest) + part(bad - k, (rest - n) * bad / rest) + part(good - n + k, (rest - n) * good / rest))
    summed = terms.groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic")).where(F.col("texts") >= LEAST_TEXTS)
    best = summed.select("term", g.alias("g")).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "term").limit(max_terms)
    return np.sort(np.array([r["term"] for r in best.collect()], np.int64))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> dict:
    """The model, from about max_rows rows of `labels` that have a text."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    share = int(1e6 * min(1.0, max_rows / max(1, known.count()))) + 1
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "id")
    one = rows.select("id", "y", F.xxhash64("text").alias("copy")).groupBy("id").agg(F.min("copy").alias("copy"), F.min("y").alias("y")).groupBy("copy", "y").agg(F.min("id").alias("id"))
    one = one.agg(F.count("*").alias("n"), F.sum("y").alias("toxic"), F.collect_list(F.struct("id", "copy")).alias("ids")).first()
    if not one["n"]:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    chosen = spark.createDataFrame([(r["id"], r["copy"]) for r in one["ids"]], rows.select("id", F.xxhash64("text").alias("copy")).schema)
    rows = rows.withColumn("copy", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "copy"]).dropDuplicates(["id", "copy"])
    vocabulary = telling(rows.select("text", "y").mapInArrow(_terms, "term long, texts long, toxic double"), one["n"], one["toxic"], max_terms)
    shared = spark.sparkContext.broadcast(vocabulary)

    @arrow("array<int>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            offsets, at = active(texts, shared.value)
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at.astype(np.int32)))

    got = rows.select("id", "y", places("text").alias("at")).groupBy("id").agg(F.min("y").alias("y"), F.min("at").alias("at")).toPandas().sort_values("id")
    lengths = [len(x) for x in got["at"]]
    at = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in got["at"])])
    return fit(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), at, got["y"].to_numpy(), vocabulary)


def scorer(spark, model: dict):
    """A function of a text column that gives the score."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @arrow("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(1 / (1 + np.exp(-np.clip(margin(shared.value, *active(texts, shared.value["vocabulary"])), -30, 30))))

    return lambda text: of(text.cast("string"))


def classify(docs: DataFrame, model: dict, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a column `into`: the score from 0 to 1."""
    return docs.withColumn(into, scorer(docs.sparkSession, model)(F.col(text_col)))

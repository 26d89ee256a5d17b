"""Language identification by prediction by partial matching.

For every language a tree of byte contexts, up to three bytes deep, holds how often each byte followed. A byte costs
-log2 of its share in the longest context that has seen it, after the escape probabilities of the longer ones
that have not (escapes count as often as different bytes were seen: method C). Statistics are frozen after training,
so the cost of any byte after any context is a number in a table; a text's code length in a language is the sum
over its bytes, and the shortest code wins.

Training reads a bounded sample: about `per_language` whole documents of each language, chosen by a hash of the
row. Prediction reads whole texts of all rows.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the language that
sorts first; rows are independent, so repeated rows agree; an empty training table makes every row `und`.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import arrow, fold, release, slices, small_batches, sums

#: Bytes of context.
ORDER = 3
#: Documents of a language that training reads, about.
PER_LANGUAGE = 3000
UNDETERMINED = "und"
RESULT = "struct<lang:string,score:double,bits:double>"
PAD = 32


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with three blanks before each text, where the texts' own bytes lie, and the texts' offsets among these."""
    lengths = np.diff(offsets)
    out = np.full(len(data) + ORDER * len(lengths), PAD, np.uint8)
    at = np.arange(len(data)) + ORDER * (np.repeat(np.arange(len(lengths)), lengths) + 1)
    out[at] = data
    return out, at, offsets


def count_grams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n): how often each run of ORDER + 1 bytes, as a number, ends at a byte of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in slices(batch.column(1)):
                padded, at, offsets = _padded(data, offsets)
                gram = np.zeros(len(at), np.int64)
                for k in range(ORDER, -1, -1):
                    gram = gram << 8 | padded[at - k]
                lang = np.repeat(langs[first : first + len(offsets) - 1], np.diff(offsets))
                for one in sorted(set(lang)):
                    found, n = np.unique(gram[lang == one], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(found)), pa.array(found), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE) -> dict:
    """Frozen counts: languages, their documents, and (language, gram, n) as arrays. Its size is bounded by the sample."""
    small_batches(docs.sparkSession)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    have = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(have)
    if not langs:
        return {"langs": [], "docs": [], "lang": [], "gram": [], "n": []}
    share = F.lit(0)
    for x in langs:
        share = F.when(F.col("lang") == x, F.lit(int(1e6 * min(1, per_language / have[x])) + 1)).otherwise(share)
    sample = usable.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share)
    counted = count_grams(sample, "lang", "text").toPandas()
    return {"langs": langs, "docs": [have[x] for x in langs], "lang": counted["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int16), "gram": counted["gram"].to_numpy(np.int64), "n": counted["n"].to_numpy(np.int64)}


class Costs:
    """Code lengths in bits of each byte after each context in each language, as one table.

    symbol: byte -> dense symbol, 0 for bytes that training did not see. row: number of the last ORDER symbols -> row of
    their longest known context. bits: [row * symbols + symbol, language].
    """

    def __init__(self, model: dict):
        lang, gram, n = (np.asarray(model[k], np.int64) for k in ("lang", "gram", "n"))
        used = np.unique(np.concatenate([gram >> 8 * k & 255 for k in range(ORDER + 1)]))
        self.symbol = np.zeros(256, np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.symbols = a = len(used) + 1
        dense = np.zeros(len(gram), np.int64)
        for k in range(ORDER, -1, -1):
            dense = dense * a + self.symbol[gram >> 8 * k & 255]
        langs = len(model["langs"])
        self.prior = -np.log2(np.asarray(model["docs"], np.float64) / sum(model["docs"]))
        rows = [np.full((1, a, langs), 8.0, np.float32)]
        row = np.zeros(a**ORDER, np.int32)
        for order in range(ORDER + 1):
            size = a ** (order + 1)
            key, where = np.unique(lang * size + dense % size, return_inverse=True)
            count = np.bincount(where, n)
            of_lang, context, byte = key // size, key % size // a, key % a
            contexts, at = np.unique(context, return_inverse=True)
            if order:
                below = row[contexts % a ** (order - 1)] if order > 1 else np.ones(len(contexts), np.int32)
            else:
                below = np.zeros(1, np.int32)
            base = np.concatenate(rows)[below]
            total, kinds = np.zeros((len(contexts), langs)), np.zeros((len(contexts), langs))
            np.add.at(total, (at, of_lang), count)
            np.add.at(kinds, (at, of_lang), 1)
            seen = kinds > 0
            escape = np.where(seen, -np.log2(np.where(seen, kinds, 1) / np.where(seen, total + kinds, 1)), 0)
            new = (base + escape[:, None, :]).astype(np.float32)
            new[at, byte, of_lang] = -np.log2(count / (total + kinds)[at, of_lang])
            first = sum(len(x) for x in rows)
            rows.append(new)
            if not order:
                row[:] = first
            else:
                row.reshape(-1, a**order)[:, contexts] = first + np.arange(len(contexts), dtype=np.int32)
        self.row, self.bits = row, np.ascontiguousarray(np.concatenate(rows).reshape(-1, langs))

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in bits, [text, language]."""
        padded, at, offsets = _padded(data, offsets)
        dense = self.symbol[padded]
        context = np.zeros(len(at), np.int64)
        for k in range(ORDER, 0, -1):
            context = context * self.symbols + dense[at - k]
        return sums(self.bits[self.row[context].astype(np.int64) * self.symbols + dense[at]], offsets)


def predictor(spark, model: dict):
    """A function of a text column that gives struct(lang, score, bits): score is the best language's share of 2^-bits, bits the code length by byte."""
    small_batches(spark)
    langs = np.array(model["langs"], object)
    if not len(langs):
        return lambda text: F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    shared = spark.sparkContext.broadcast(model)

    @arrow(RESULT)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        costs = Costs(shared.value)
        for batch in texts:
            best, score, bits = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
            for _, data, offsets in slices(batch):
                total = costs.lengths(data, offsets)
                whole = total + costs.prior
                k = whole.argmin(axis=1)
                best.append(k)
                score.append(1 / np.exp2(np.clip(whole.min(axis=1, keepdims=True) - whole, -1000, 0)).sum(axis=1))
                bits.append(total[np.arange(len(k)), k] / np.maximum(np.diff(offsets), 1))
            yield pa.StructArray.from_arrays([pa.array(langs[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(bits))], names=["lang", "score", "bits"])
        del costs
        release()

    def of(text: Column) -> Column:
        text = text.cast("string")
        nothing = F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
        return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), predict(text)).otherwise(nothing)

    return of


def identify(docs: DataFrame, training: DataFrame, text_col: str = "text", lang_col: str = "lang", into: str = "language", per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs with a column `into`: struct(lang, score, bits). Learns from `training`."""
    return docs.withColumn(into, predictor(docs.sparkSession, train(training, lang_col, text_col, per_language))(F.col(text_col)))


def training_rows(docs: DataFrame, id_col: str = "doc_id", parts: int = 5) -> DataFrame:
    """The rows that may be learnt from: those outside the held-out fold."""
    return docs.where(fold(F.col(id_col), parts) != 0)

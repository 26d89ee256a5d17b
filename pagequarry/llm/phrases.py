"""Phrase collocation mining by top-order marginalisation.

Each word is read together with the three that follow it in its piece: four columns, each the words one place on, padded
with empty words where the piece ends. Only these longest windows are counted. One ROLLUP over the four columns then sums them up over
shorter and shorter prefixes, which gives how often every phrase of one to four words occurs, and the words of a language.

Most windows of a corpus occur once or twice and can't matter. So a first pass adds each window's prefixes up in a sketch:
counters that a hash picks, each at least as large as the count of every prefix that shares it. A prefix whose counter
stays below the least count, or that has such an end, is padded away from the windows of the second pass; what is left are exact counts of
all phrases that occur often enough. The sketch has a fixed size bound; where it is too full to rule anything out, the windows just shuffle
unpadded, with the same results.

A candidate is cut after each of its words; the cut with the lowest score counts. Candidates that a longer one mostly
accounts for are dropped, and each language's best are kept.

Defined results: null texts are empty, null languages are `und`; repeated rows count each time; an empty table gives no rows. Windows of
a stretch of text are told apart by 64-bit hashes, and compared as words from there on.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import range_hashes, release, slices, small_batches, written

#: Words of the longest phrase.
ORDER = 4
LEAST, PER_LANG, COVERED = 30, 2000, 80
#: Counters of the sketch: about so many for each character, within bounds. A counter is a byte; a block is what one row holds.
COUNTERS_PER_CHAR, LEAST_BITS, MOST_BITS, BLOCK_BITS = 0.25, 20, 27, 16
#: Bytes of text that are looked at in one go.
STRETCH = 1 << 20

WORDS = [f"w{k + 1}" for k in range(ORDER)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
BETWEEN = ENDS.copy()
BETWEEN[[9, 32]] = True
MIX = np.uint64(0x9E3779B97F4A7C15)


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Starts, ends and texts of the words of concatenated lower-case texts, and for each order the prefixes' hashes and which exist.

    langs holds a hash for each text.
    """
    inside = ~BETWEEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(np.concatenate([[0], ENDS[data]]))[starts] + text
    word = range_hashes(data, starts, ends)
    prefix, there = [_stirred(word + langs[text] * MIX)], [np.ones(len(starts), bool)]
    for k in range(1, ORDER):
        lead, same = np.zeros_like(word), np.zeros(len(word), bool)
        lead[:-k], same[:-k] = word[k:], piece[k:] == piece[:-k]
        prefix.append(_stirred(prefix[-1] * MIX + lead))
        there.append(same)
    return starts, ends, text, prefix, there


def _stretches(batch: pa.RecordBatch):
    """(language names, languages of the texts, windows of the texts) of runs of a batch's texts."""
    coded = pc.fill_null(batch.column("lang").cast(pa.string()), "und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    raw = np.frombuffer("".join(names).encode(), np.uint8)
    at = np.cumsum([0, *(len(n.encode()) for n in names)])
    hashes, codes = range_hashes(raw, at[:-1], at[1:]), coded.indices.to_numpy()
    for first, data, offsets in slices(batch.column("text"), STRETCH):
        own, low = codes[first : first + len(offsets) - 1], LOWER[data]
        yield names, own, low, windows(low, offsets, hashes[own])


def _held(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - bits)
    return bitmap[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def depths(prefix: list[np.ndarray], there: list[np.ndarray], bitmap: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each order, which windows' prefixes may occur often: no phrase does so more than its beginning or its end, which the next window begins with."""
    going = np.ones(len(prefix[0]), bool)
    for k, (h, ok) in enumerate(zip(prefix, there)):
        end = np.append(going[1:], False) if k else True
        going = going & ok & end & _held(bitmap, bits, h)
        yield going


def _counters(bits: int):
    """What a task's prefixes add to the counters: (block, added), blocks that get nothing left out; counters stop at 255."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for _, _, _, (_, _, _, prefix, there) in _stretches(batch):
                for h, ok in zip(prefix, there):
                    at, n = np.unique(h[ok] >> np.uint64(64 - bits), return_counts=True)
                    counters[at] = np.minimum(counters[at] + n, 255)
        for block, part in enumerate(counters.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "added": pa.array([pa.compress(part, "zstd", asbytes=True)], pa.binary())})
        del counters
        release()

    return of


def _often(least: int):
    """(block, bitmap): which counters of a block reach `least` when all tasks' are added up."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, added in zip(batch.column("block").to_pylist(), batch.column("added")):
                part = np.frombuffer(pa.decompress(added.as_buffer(), 1 << BLOCK_BITS, "zstd"), np.uint8)
                have = sums.get(block)
                sums[block] = part.astype(np.uint16) if have is None else np.minimum(have + part, 255)
        if sums:
            yield pa.record_batch({"block": pa.array(list(sums), pa.int32()), "bitmap": pa.array([np.packbits(s >= least).tobytes() for s in sums.values()], pa.binary())})

    return of


def sketch(texts: DataFrame, least: int, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits: those of all prefixes that occur `least` times are set."""
    parts = texts.mapInArrow(_counters(bits), "block int, added binary")
    found = parts.repartition("block").mapInArrow(_often(min(least, 255)), "block int, bitmap binary")
    bitmap = np.zeros((1 << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for row in found.toLocalIterator():
        bitmap[row["block"]] = np.frombuffer(row["bitmap"], np.uint8)
    return bitmap.ravel()


def _spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """data[start : start + size] as strings."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    edges = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _counts(shared, bits: int):
    """A stretch's padded windows, their words joined by blanks, and how often each occurs there."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, own, data, (starts, ends, text, prefix, there) in _stretches(batch):
                depth, key = np.zeros(len(starts), np.int64), own[text].astype(np.uint64)
                for h, going in zip(prefix, depths(prefix, there, shared.value, bits)):
                    depth += going
                    key = np.where(going, h, key)
                _, where, n = np.unique(_stirred(key * MIX + depth.astype(np.uint64)), return_index=True, return_counts=True)
                # all words with one blank after each, so that a window is a stretch of this
                sizes = ends - starts
                begins = np.cumsum(sizes + 1) - sizes - 1
                spaced = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
                spaced[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = data[~BETWEEN[data]]
                last = where + np.maximum(depth[where], 1) - 1
                long = np.where(depth[where] > 0, begins[last] + sizes[last] - begins[where], 0)
                langs = pa.array(names, pa.string()).take(pa.array(own[text[where]]))
                yield pa.record_batch([langs, _spans(spaced, begins[where], long), pa.array(n, pa.int64())], names=["lang", "said", "n"])
        release()

    return of


def sketch_bits(texts: DataFrame) -> int:
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(chars * COUNTERS_PER_CHAR).bit_length()))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, bits: int | None = None) -> DataFrame:
    """(lang, words, phrase, f): how often each phrase of one to four words occurs that does so `least` times; words 0 and no phrase: all words of the language."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    bits = bits or sketch_bits(texts)
    shared = spark.sparkContext.broadcast(sketch(texts, least, bits))
    counted = texts.mapInArrow(_counts(shared, bits), "lang string, said string, n long").groupBy("lang", "said").agg(F.sum("n").alias("n"))
    counted = counted.select("lang", *(F.coalesce(F.get(F.split("said", " "), F.lit(k)), F.lit("")).alias(w) for k, w in enumerate(WORDS)), "n")
    rolled = counted.rollup("lang", *WORDS).agg(F.grouping_id().alias("level"), F.sum("n").alias("f"))
    n_words = (F.lit(ORDER) - F.bit_count("level")).cast("int")
    rows = rolled.withColumn("words", n_words).where("words >= 0")  # without the sum over all languages
    deepest = F.coalesce(*(F.when(F.col("words") == k + 1, F.col(WORDS[k])) for k in range(ORDER)), F.lit("-"))
    phrase = F.when(F.col("words") > 0, F.concat_ws(" ", *WORDS))
    return rows.where((deepest != "") & ((F.col("words") == 0) | (F.col("f") >= least))).select("lang", "words", phrase.alias("phrase"), "f")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, per_lang: int = PER_LANG, covered: int = COVERED, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `per_lang` phrases of two to four words."""
    counts = written(phrase_counts(docs, text_col, lang_col, least, bits))
    phrases = counts.where("words > 0").select("lang", "phrase", "words", "f")
    found = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.split("phrase", " ")

    def wide(c: Column) -> Column:
        return c.cast("decimal(20,0)")

    cuts = found.select("lang", "phrase", "a", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("p", F.lit(1), F.col("k"))).alias("left"), F.concat_ws(" ", F.slice("p", F.col("k") + 1, F.size("p"))).alias("right"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    both = wide(F.col("l")) + wide(F.col("r"))
    cuts = cuts.withColumn("above", wide(F.col("a")) * F.lit(2_000_000).cast("decimal(8,0)")).withColumn("below", both).withColumn("score", F.expr("above div below"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = found.where("words > 2").select("lang", F.col("a").alias("f"), parts.alias("p"), "words")
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.select("lang", F.concat_ws(" ", F.slice("p", F.col("at"), F.col("size"))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (wide(F.col("longer")) * 100 < wide(F.col("a")) * covered))

    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    best = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= per_lang)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= per_lang)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))

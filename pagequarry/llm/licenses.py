"""Licence scans by MinHash bands over overlapping windows.

Notices are sorted into classes by size: class c holds those of more than c/2 and at most c words. A class has windows of 3c/2 words,
one every c/2 words, so a notice lies whole in one of them, and makes up a seventh of its shingles or more. Each of
BANDS bands is the least of one hash of the window's shingles; a window that holds a notice agrees with it on one band with
probability 1 - (1 - J)^BANDS, above 0.9999 for J = 1/7. Agreeing pairs are verified exactly: the share of the notice's
shingles that the window contains must be `least` or more.

Only texts with one of a few words, and of these only windows with a shingle of some notice, are hashed. Both tests lose
nothing: the words are chosen so that shingles with one of them make up more than 1 - least of each notice.
All of it is built-in column expressions and joins. Notices are sent to every executor while their shingles and bands have at most
SENT bytes, which their lengths bound; beyond that windows are hashed without the second test and joins shuffle.

Defined results: null and empty texts match nothing; a notice of fewer than five words is found at its first place, whole, as
such texts have one shingle only; a notice without words is found nowhere; repeated rows give one result, rows of one id with
different texts one each; ties between windows go to the first; an empty table gives no rows.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.license_texts import NOTICES
from pagequarry.llm.shingles import WORDS, own_shingles, words

BANDS, LEAST = 128, 0.8
SMALLEST = 8
#: Most bytes of notices that are sent to every executor.
SENT = 64 << 20


def split_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def telling_words(notices: dict[str, str], least: float) -> list[str]:
    """Words such that more than 1 - least of each notice's shingles hold one, rarest among the notices first."""
    split = {k: split_words(t) for k, t in notices.items()}
    uses = {w: sum(w in x for x in split.values()) for x in split.values() for w in x}
    chosen: list[str] = []
    for found in split.values():
        shingles = [set(found[i : i + WORDS]) for i in range(max(1, len(found) - WORDS + 1))]
        for w in sorted(set(found), key=lambda w: (-uses[w] * (w.startswith("licen")), -len(w), w)):
            if sum(bool(s & set(chosen)) for s in shingles) > (1 - least) * len(shingles) + 1e-9:
                break
            chosen.append(w)
    return sorted(set(chosen))


def size_class(n: Column) -> Column:
    return F.greatest(F.lit(SMALLEST), F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int"))


def bands(hashes: Column, number: int) -> Column:
    """(band, least hash) of an array of hashes, band by band."""
    return F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda k: F.struct(k.alias("band"), F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))).alias("low")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES, least: float = LEAST, number: int = BANDS) -> DataFrame:
    """(id, notice, start, containment): the first best window (its first word) of each text for each notice that it holds."""
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(notices.items()), "notice string, text string").select("notice", words(F.col("text")).alias("w"))
    known = known.where(F.size("w") > 0).select("notice", F.size("w").alias("n"), size_class(F.size("w")).alias("class"), F.array_distinct(own_shingles("w")).alias("theirs"))
    sizes = [r["class"] for r in known.select("class").distinct().orderBy("class").collect()]
    # a text has at most half as many words as characters, and a word for the last; eight bytes a shingle, two dozen a band
    small = sum((len(t) // 2 + 1) * 8 for t in notices.values()) <= SENT and len(notices) * number * 24 <= SENT

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    low = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    may = F.lit(False)
    for w in telling_words(notices, least):
        may = may | F.contains(low, F.lit(w))
    texts = docs.where(may).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), words(F.col(text_col)).alias("w"))
    hashed = texts.select("id", "text", own_shingles("w").alias("hashes"))
    if small:
        vocabulary = known.select(F.explode("theirs").alias("h")).distinct().agg(F.collect_list("h").alias("every"))
        hashed = hashed.join(F.broadcast(vocabulary), F.lit(True))

    def of_class(c: int) -> Column:
        last = F.greatest(F.lit(0), F.size("hashes") - 1)
        return F.transform(F.sequence(F.lit(0), last, F.lit(c // 2)), lambda s: F.struct(F.lit(c).alias("class"), s.alias("start")))

    laid = F.flatten(F.array(*map(of_class, sizes))) if sizes else F.array().cast("array<struct<class:int,start:int>>")
    windows = hashed.withColumn("w", F.explode(laid))
    own = F.slice("hashes", F.col("w.start") + 1, F.greatest(F.lit(1), F.col("w.class") * 3 / 2 - WORDS + 1).cast("int"))
    windows = windows.select("id", "text", "w.class", "w.start", F.array_distinct(own).alias("own"), *(["every"] if small else []))
    if small:
        windows = windows.where(F.arrays_overlap("own", "every")).drop("every")

    signed = windows.select("*", F.explode(bands(F.col("own"), number)).alias("b"))
    asked = known.where(F.col("n") >= WORDS).select("notice", "class", F.explode(bands(F.col("theirs"), number)).alias("b"))
    met = signed.join(sent(asked), ["class", "b"]).drop("b").join(sent(known.select("notice", "theirs")), "notice")
    share = F.size(F.array_intersect("own", "theirs")) / F.size("theirs")
    found = met.select("id", "text", "notice", "start", share.alias("containment")).where(F.col("containment") >= least)
    best = F.max_by(F.struct("start", "containment"), F.struct("containment", -F.col("start")))
    whole = found.groupBy("id", "text", "notice").agg(best.alias("x")).select("id", "notice", "x.start", "x.containment")
    short = {k: w for k, t in sorted(notices.items()) if 0 < len(w := split_words(t)) < WORDS}
    return whole.unionByName(_short(texts, short)) if short else whole


def _short(texts: DataFrame, short: dict[str, list[str]]) -> DataFrame:
    """(id, notice, start, containment): the first place of each notice of fewer words than a shingle has."""

    def first(name: str, wanted: list[str]) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - len(wanted)))
        theirs = F.array(*map(F.lit, wanted))
        at = F.array_min(F.filter(places, lambda i: F.slice("w", i + 1, len(wanted)) == theirs))
        return F.struct(F.lit(name).alias("notice"), at.alias("start"))

    listed = F.array(*(first(k, w) for k, w in short.items()))
    found = texts.select("id", "text", F.explode(F.filter(listed, lambda x: x["start"].isNotNull())).alias("x")).distinct()
    return found.select("id", "x.notice", "x.start", F.lit(1.0).alias("containment"))

"""Benchmark decontamination by SimHash over item-sized windows.

An item of n words is looked for in every window of n words (or the whole text, where it is shorter). A window whose similarity to
an item of its size is `least` must have a certain share of its shingles from items of that size (8/9 for 0.8), so windows are
laid wherever a running count of such shingles reaches this, and only there. The window's 64-bit SimHash (shingles weighted by how often they occur) is
looked up among the items of that size by Hamming blocks: the bits are dealt to RADIUS + 1 blocks, so fingerprints within
the radius agree on one block for certain. What is within the radius is verified exactly: the weighted Jaccard similarity of the shingles (sum of
lesser by sum of greater counts) must be `least` or more.

All of it is built-in column expressions and joins.

Defined results: null and empty texts and items match nothing; an item of fewer than five words is one shingle of all its words
and is found wherever these stand in a row; repeated rows give one result; ties between windows go to the first; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import sketch, with_sketch, written
from pagequarry.llm.shingles import WORDS, own_shingles, sent_if_small, shingles, words

RADIUS, LEAST = 24, 0.8


def fingerprint(hashes: Column) -> Column:
    """SimHash of an array of hashes, each counted as often as it occurs."""

    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int") * 2 - 1)
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda fp, b: fp.bitwiseOR(bit(b)))


def blocks(fp: Column, radius: int) -> Column:
    """The fingerprint's bits in each of radius + 1 blocks, as structs (block, bits)."""
    edges = [k * 64 // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.shiftleft(fp, 64 - b), 64 - b + a).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:]))))


def similarity(one: Column, two: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of hashes: by sets where no hash repeats, else by counts."""
    plain = (F.size(F.array_distinct(one)) == F.size(one)) & (F.size(F.array_distinct(two)) == F.size(two))
    times = lambda hashes, h: F.size(F.filter(hashes, lambda x: x == h))
    counted = F.aggregate(F.array_intersect(one, two), F.lit(0), lambda s, h: s + F.least(times(one, h), times(two, h)))
    common = F.when(plain, F.size(F.array_intersect(one, two))).otherwise(counted)
    return common / (F.size(one) + F.size(two) - common)


def items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, n, k, hashes): items with words; n words, in shingles of k."""
    listed = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    dealt = listed.repartition(benchmark.sparkSession.sparkContext.defaultParallelism, "item", "w")
    return dealt.select("item", F.size("w").alias("n"), F.least(F.size("w"), F.lit(WORDS)).alias("k"), own_shingles("w").alias("hashes"))


def starts(least: float) -> Column:
    """Where windows begin that may be similar enough, from columns size (shingles of the text), n, k and hit (places of shingles of items of n words, in order)."""
    wide, size, hit = F.col("n") - F.col("k") + 1, F.col("size"), F.col("hit")
    own = F.least(wide, size)
    need = F.ceil(least * (own + wide) / (1 + least) - 1e-9).cast("int")
    first = lambda i: F.greatest(F.lit(0), F.get(hit, i + need - 1) - own + 1)
    last = lambda i: F.least(F.get(hit, i), size - own)
    laid = F.transform(F.sequence(F.lit(0), F.size(hit) - need), lambda i: F.when(first(i) <= last(i), F.sequence(first(i), last(i))).otherwise(F.expr("cast(array() as array<int>)")))
    return F.when(F.size(hit) >= need, F.array_distinct(F.flatten(laid))).otherwise(F.expr("cast(array() as array<int>)"))


def _key() -> Column:
    return F.xxhash64("id", "text_hash")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """(id, text_hash, item, start, n, distance, similarity): the most similar window of each text for each item that it holds."""
    known = written(items(benchmark, item_col, item_text_col).withColumn("item_fp", fingerprint(F.col("hashes"))))
    sizes = sorted(r["k"] for r in known.select("k").distinct().collect())
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).alias("text"))

    def hashed(rows: DataFrame, k: int, *more: str) -> DataFrame:
        return rows.select("id", "text_hash", *more, words(F.col("text")).alias("w")).select("id", "text_hash", *more, shingles("w", k).alias("hashes"))

    found = None
    for k in sizes:
        places = known.where(F.col("k") == k).select("n", "k", F.explode("hashes").alias("h")).distinct()
        seen = hashed(texts, k).select("id", "text_hash", F.size("hashes").alias("size"), F.posexplode_outer("hashes").alias("pos", "h"))
        hits = seen.join(sent_if_small(places), "h").groupBy("id", "text_hash", "size", "n", "k").agg(F.sort_array(F.collect_set("pos")).alias("hit"))
        laid = hits.select("id", "text_hash", "k", "n", starts(least).alias("starts")).where(F.size("starts") > 0)
        found = laid if found is None else found.unionByName(laid)
    if found is None:
        found = texts.limit(0).select("id", "text_hash", F.lit(1).alias("k"), F.lit(1).alias("n"), F.expr("cast(array() as array<int>)").alias("starts"))
    found = written(found.groupBy("id", "text_hash", "k").agg(F.collect_list(F.struct("n", "starts")).alias("laid")))

    # the few texts with windows are fetched as texts, which are smaller than their hashes; the sketch keeps the others where they are
    near = with_sketch(texts, _key(), sketch(found, _key()), "held").where("held").drop("held")
    same = near["id"].eqNullSafe(found["id"]) & (near["text_hash"] == found["text_hash"])
    held = near.join(found, same).select(near["id"], near["text_hash"], "k", "laid", "text")
    windows = None
    for k in sizes:
        one = hashed(held.where(F.col("k") == k), k, "k", "laid").select("id", "text_hash", "hashes", "k", F.explode("laid").alias("l"))
        one = one.select("id", "text_hash", "hashes", "k", "l.n", F.explode("l.starts").alias("start"))
        one = one.select("id", "text_hash", "start", "n", F.slice("hashes", F.col("start") + 1, F.col("n") - F.col("k") + 1).alias("own"))
        windows = one if windows is None else windows.unionByName(one)
    if windows is None:
        windows = found.select("id", "text_hash", F.lit(0).alias("start"), F.lit(1).alias("n"), F.expr("cast(array() as array<bigint>)").alias("own"))
    windows = windows.withColumn("fp", fingerprint(F.col("own"))).withColumn("b", F.explode(blocks(F.col("fp"), radius)))

    asked = known.select("item", F.col("n").alias("item_n"), "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("item_b"))
    met = windows.join(sent_if_small(asked), (F.col("n") == F.col("item_n")) & (F.col("b.block") == F.col("item_b.block")) & (F.col("b.bits") == F.col("item_b.bits")))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    close = met.withColumn("distance", F.bit_count(differ)).where(F.col("distance") <= radius)
    first = F.array_position(F.transform(blocks(differ, radius), lambda b: b["bits"]), F.lit(0).cast("long")) - 1
    close = close.where(first == F.col("b.block")).select("id", "text_hash", "start", "n", "own", "item", "distance")
    checked = close.join(known.select("item", F.col("n").alias("item_n"), F.col("hashes").alias("theirs")), "item").where("n = item_n")
    checked = checked.withColumn("similarity", similarity(F.col("own"), F.col("theirs"))).where(F.col("similarity") >= least)
    best = F.max_by(F.struct("start", "n", "distance", "similarity"), F.struct("similarity", -F.col("start")))
    return checked.groupBy("id", "text_hash", "item").agg(best.alias("x")).select("id", "text_hash", "item", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of docs that hold no item."""
    found = written(find(docs, benchmark, id_col, text_col, **limits).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    text_hash = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(sent_if_small(found), docs[id_col].eqNullSafe(found["__id"]) & (text_hash == found["__hash"]), "left_anti")

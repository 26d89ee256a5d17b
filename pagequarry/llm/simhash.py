"""SimHash near-duplicates by bit-sliced comparison.

Each text becomes one 64-bit fingerprint. Only different fingerprints are compared: nine masks of 35 or
so bits (one of three blocks, and one of three blocks of what is left) are such that fingerprints
within two bits agree on one mask at least. Fingerprints that agree on a mask are compared as vertical
bit planes of 64 fingerprints each: one XOR per plane gives one bit of 64 distances, carry-save counters add
it up, and a block is abandoned once all its distances exceed the radius.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; a null id
takes part with its text but never names a component; repeated rows get the same answer each.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import arrow, checkpointed, release, small_batches
from pagequarry.llm.graph import components

RADIUS = 2
#: Fingerprints of one bucket that are compared with each other in one go; larger buckets are cut into pairs of such tiles.
TILE = 1024
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALL = (1 << 64) - 1


def hash_counts(text: bytes, words: int) -> tuple[np.ndarray, int]:
    """How often each of the 64 bits is set in the shingles' hashes, and the number of shingles."""
    found = text.translate(LOWER).split()
    if not found:
        return np.zeros(64, np.int64), 0
    joined = b" ".join(found)
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    if len(found) < words:
        hashes = [digest(joined)]
    else:
        hashes = [digest(joined[a:b]) for a, b in zip(starts, ends[words - 1 :])]
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(raw), 4096):
        counts += np.unpackbits(raw[k : k + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts, len(raw)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of a text's word shingles."""
    counts, n = hash_counts(text or b"", words)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, text_hash, fp) for every row."""

    small_batches(docs.sparkSession)
    @arrow("bigint")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, words) for t in batch.cast(pa.binary())], pa.int64())
        release()

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), of(F.col(text_col).cast("string")).alias("fp"))


def masks(radius: int = RADIUS) -> list[int]:
    """Masks such that values within `radius` bits agree on one at least: a block of the bits, and a block of the rest."""

    def blocks(bits: list[int]) -> list[list[int]]:
        return [bits[i * len(bits) // (radius + 1) : (i + 1) * len(bits) // (radius + 1)] for i in range(radius + 1)]

    everything = list(range(64))
    return [sum(1 << b for b in [*one, *two]) for one in blocks(everything) for two in blocks([b for b in everything if b not in one])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(values: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of one group whose values differ in `radius` (at most 2) bits or fewer.

    values: uint64, grouped; starts: where each group begins, and the length at the end.
    """
    sizes = np.diff(starts)
    per_group = -(-sizes // 64)
    first_block = np.concatenate([[0], np.cumsum(per_group)])
    group = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(values)) - starts[group]
    block, lane = first_block[group] + inside // 64, inside % 64
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((first_block[-1], 64, 64), np.uint8)
    lanes[block, :, lane] = bits
    planes = np.ascontiguousarray(np.packbits(lanes, axis=2, bitorder="little").view(np.uint64)[:, :, 0].T)
    filled = np.zeros((first_block[-1], 64), np.uint8)
    filled[block, lane] = 1
    filled = np.packbits(filled, axis=1, bitorder="little").view(np.uint64)[:, 0]
    row_of = np.zeros((first_block[-1], 64), np.int64)
    row_of[block, lane] = np.arange(len(values))
    query = np.repeat(np.arange(len(values)), per_group[group])
    against = np.arange(len(query)) - np.repeat(np.concatenate([[0], np.cumsum(per_group[group])[:-1]]), per_group[group]) + first_block[group][query]
    later = against >= block[query]
    query, against = query[later], against[later]
    ones, twos, over = (np.zeros(len(query), np.uint64) for _ in range(3))
    beyond = (lambda: over | (ones & twos)) if radius == 2 else (lambda: over | twos) if radius == 1 else (lambda: over | twos | ones)
    for b in range(64):
        asked = np.where(bits[query, b] > 0, np.uint64(ALL), np.uint64(0))
        differs = planes[b][against] ^ asked
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if b % 4 == 3:
            open_ = (~beyond() & filled[against]) != 0
            if not open_.all():
                query, against, ones, twos, over = (x[open_] for x in (query, against, ones, twos, over))
    near = np.unpackbits((~beyond() & filled[against]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, where = np.nonzero(near)
    i, j = query[k], row_of[against[k], where]
    return i[i < j], j[i < j]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that the pairs (i, j) connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, to): edges that connect all fingerprints of `fps` (one distinct column fp) within `radius` bits, as a spanning forest of each bucket."""
    keyed = fps.select(
        "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)))).alias("mask", "key")
    )
    shared = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        keyed.join(shared, ["mask", "key"])
        .withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("mask", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )
    keys = ["mask", "key", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, "fp"]], axis=1)
                held = new if held is None else np.concatenate([held, new])
                changes = np.flatnonzero((held[1:, :4] != held[:-1, :4]).any(axis=1)) + 1
                if not len(changes):
                    continue
                done, held = held[: changes[-1]], held[changes[-1] :]
            else:
                if held is None:
                    return
                done = held
            starts = np.concatenate([[0], np.flatnonzero((done[1:, :4] != done[:-1, :4]).any(axis=1)) + 1, [len(done)]])
            values = np.ascontiguousarray(done[:, 4]).view(np.uint64)
            root = np.arange(len(done))
            for k in _spans(starts):
                i, j = close_pairs(values[starts[k[0]] : starts[k[-1] + 1]], starts[k[0] : k[-1] + 2] - starts[k[0]], radius)
                n = starts[k[-1] + 1] - starts[k[0]]
                root[starts[k[0]] : starts[k[-1] + 1]] = spanning(n, i, j) + starts[k[0]]
            moved = root != np.arange(len(done))
            yield pa.RecordBatch.from_arrays([pa.array(done[moved, 4]), pa.array(done[root[moved], 4])], names=["fp", "to"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "fp bigint, to bigint")


def _with_end(batches):
    yield from batches
    yield None


def _spans(starts: np.ndarray, rows: int = 4096):
    """Runs of whole groups with about `rows` rows each."""
    first = 0
    while first < len(starts) - 1:
        last = max(first, int(np.searchsorted(starts, starts[first] + rows, "right")) - 2)
        yield range(first, last + 1)
        first = last + 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, text_hash, fp, root, component) for every row: root names the group, component is the smallest id in it. Links are fingerprints at most `radius` bits apart."""
    every = checkpointed(fingerprints(docs, id_col, text_col, words))
    classes = every.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(classes.select("fp"), radius, tile), "fp", "to")
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select(classes["fp"], "least", F.coalesce("root", classes["fp"]).alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component"))
    return every.join(named.join(of_root, "root").select("fp", "root", "component"), "fp").select("id", "text_hash", "fp", "root", "component")

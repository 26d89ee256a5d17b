"""Packing by power-of-two decomposition.

A document's token ids, closed by an end id, are cut into pieces whose lengths are powers of two: as many of
the longest as fit, then the binary digits of the rest. Every piece is a sequence of its own, so no
sequence crosses documents and none needs padding; sequences of one length form a bucket that a trainer
batches together.

Defined results: null and empty texts are one piece that holds the end id alone; rows are independent, so
repeated rows and ids give their pieces each; a very long text has more pieces, none longer than the limit.
"""

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import arrow, range_hashes, release, slices, small_batches, word_ranges

MAX_LENGTH = 2048
END_ID = 1
#: Different words whose ids a worker keeps; beyond it the worker starts afresh.
KEPT_WORDS = 1 << 20

PIECES = "array<struct<start:bigint,length:bigint,ids:binary,doc_tokens:bigint>>"
PIECE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file to use: the given one, or the public word vocabulary."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of plain letters, perhaps with a closing point or comma: lower-casing is all that normalising does to them.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """Token ids of whole texts. The vocabulary drops white space and never joins across it, so the ids of a text are
    those of its words one after another; a worker encodes each different word once and then looks it up by its hash.

    The tokenizer is loaded once for a worker and stays: one that has been used leaves memory behind when it is dropped, which adds
    up if every task loads its own. It runs in the task's thread, as Spark has tasks on the other cores."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.letters, self.tokenizer = byte_letters(), Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.marks = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ("", ".", ",")}
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        other = []
        for k, w in enumerate(words):
            if found := PLAIN.fullmatch(w):
                core = "".join([self.letters[b] for b in found[1].lower().encode()])
                out[k] = [t.id for t in self.model.tokenize(core)] + self.marks[found[2]]
            else:
                other.append(k)
        for k, e in zip(other, self.tokenizer.encode_batch([words[k] for k in other], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of concatenated texts, and where each text's ids begin."""
        starts, ends, before = word_ranges(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        found, first, of = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > KEPT_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, found)
        new = np.ones(len(found), bool)
        new[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] != found[at < len(self.hashes)]
        if new.any():
            raw = data.tobytes()
            ids = self._ids([raw[a:b].decode() for a, b in zip(starts[first[new]], ends[first[new]])])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            number = len(self.start) - 1 + np.arange(len(ids))
            self.hashes, self.number = np.insert(self.hashes, at[new], found[new]), np.insert(self.number, at[new], number)
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))])
            at = np.searchsorted(self.hashes, found)
        number = self.number[at][of]
        begin, lengths = self.start[number], self.start[number + 1] - self.start[number]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])], total[before]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(tokens: int, longest: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces, longest first; lengths are powers of two."""
    out = [(k * longest, longest) for k in range(tokens // longest)]
    at, rest = tokens - tokens % longest, tokens % longest
    for bit in reversed(range(longest.bit_length())):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece, ids as little-endian unsigned 32-bit numbers.

    length is also the bucket; write_buckets() lays pieces out by it. No shuffle: pieces stay where their document was.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    small_batches(docs.sparkSession)
    @arrow(PIECES)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of, end = encoder(vocabulary(tokenizer)), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            number, start, length, ids, tokens = [0], [], [], [], []
            for _, data, offsets in slices(batch):
                flat, begin = of.encode(data, offsets)
                raw = flat.astype("<u4").tobytes()
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                    own = raw[4 * a : 4 * b] + end
                    parts = cuts(b - a + 1, longest)
                    number.append(number[-1] + len(parts))
                    for s, n in parts:
                        start.append(s)
                        length.append(n)
                        ids.append(own[4 * s : 4 * (s + n)])
                        tokens.append(b - a + 1)
            values = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64())], fields=list(PIECE))
            yield pa.ListArray.from_arrays(pa.array(number, pa.int32()), values)
            del values, start, length, ids, tokens
        release()

    cut = docs.select(F.col(id_col), F.explode(pieces(F.col(text_col).cast("string"))).alias("piece"))
    return cut.select(id_col, "piece.start", "piece.length", "piece.ids", "piece.doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, so that a reader batches equal lengths without padding."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)

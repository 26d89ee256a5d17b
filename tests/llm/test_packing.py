import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import packing

SCHEMA = "doc_id long, text string, ids string, start int, piece string"


@given(st.integers(1, 20_000))
@settings(max_examples=300, deadline=None)
def test_cuts_are_powers_of_two_without_gaps(n):
    cuts = packing.cuts(n)
    at = 0
    for start, length in cuts:
        assert start == at and length & (length - 1) == 0 and length <= 2048
        at += length
    assert at == n and len(cuts) <= n // 2048 + 11


def test_round_trip_with_odd_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    texts = ["Hello, World. hello world", None, "", "  \n\t ", "<|endoftext|> it's 12½ é é İ Σς 한글 😀", "word " * 30_000, "Hello, World. hello world", "straße,naïve.don't_x", "ab<|endoftext|>cd"]
    docs = spark.createDataFrame([(k, x, "c", 1, "d") for k, x in enumerate(texts)], SCHEMA)
    rows = packing.pack(docs).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    for k, x in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist()
        assert ids == t.encode(x or "", add_special_tokens=False).ids + [1]
        assert all(r["doc_tokens"] == len(ids) and r["length"] == len(r["ids"]) // 4 for r in own)
        assert zlib.crc32(own[0]["ids"]) >= 0


def test_a_worker_loads_its_tokenizer_once(spark, monkeypatch):
    import pyarrow as pa
    import tokenizers

    kept, loads, arrow = [], [], packing.arrow

    class Counted:
        @staticmethod
        def from_file(path, load=tokenizers.Tokenizer.from_file):
            loads.append(path)
            return load(path)

    monkeypatch.setattr(packing, "arrow", lambda kind: lambda f: (kept.append(f), arrow(kind)(f))[1])
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    packing.encoder.cache_clear()
    packing.pack(spark.createDataFrame([(1, "a", "", 0, "")], SCHEMA))
    tasks = [[p["length"] for b in kept[0](iter([pa.array(["one two three", None])])) for d in b.to_pylist() for p in d] for _ in range(3)]
    packing.encoder.cache_clear()
    assert tasks[0] == tasks[1] == tasks[2] and len(loads) == 1


def test_empty_table_and_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e", "", 0, "")], SCHEMA)
    assert packing.pack(docs.limit(0)).count() == 0
    packing.write_buckets(packing.pack(docs), f"{tmp_path}/b")
    got = spark.read.parquet(f"{tmp_path}/b")
    assert got.where("bucket <> length").count() == 0 and got.count() == packing.pack(docs).count()
    with pytest.raises(ValueError):
        packing.pack(docs, longest=1000)

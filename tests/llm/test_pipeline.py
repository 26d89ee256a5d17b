import inspect
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pagequarry.llm.packing import vocabulary
from tests.llm.test_lines import covered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").toPandas(), SCHEMA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.8 * sizes[0]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_decisions_take_effect(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    from tests.llm.test_lines import words

    passage = " ".join(words(80, 5))
    texts = {1: " ".join(words(100, 1)), 2: " ".join(words(100, 1)), 3: None, 4: "1 2 3", 5: f"{' '.join(words(60, 2))} {bench} {' '.join(words(60, 3))}", 6: f"{' '.join(words(30, 6))} {passage}", 7: f"{passage} {' '.join(words(30, 7))}"}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 5, 6, 7}
    lined = {r["doc_id"]: r["text"] for r in stages["lines"](spark, docs, "").collect()}
    assert 2 not in lined and passage in lined[6] and passage not in lined[7] and lined[1] == texts[1]
    near = {r["doc_id"] for r in stages["near_duplicates"](spark, docs.unionByName(docs), "").collect()}
    assert near == {1, 3, 4, 5, 6, 7} and stages["near_duplicates"](spark, docs.unionByName(docs), "").count() == 6
    assert 5 not in {r["doc_id"] for r in stages["contamination"](spark, docs, "/root/testdata/sf0.001").collect()}


CLASHING = SCHEMA + ", row string, clean string, key string, hash string, id string, root string, ids binary, length long, item long, words string, n long"


def test_empty_tables_and_columns_of_any_name(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long), (1, long), (2, long), (3, None), (4, ""), (5, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (6, "\u00e9" * 200_000)]
    more = tuple("x" if "string" in c else b"x" if "binary" in c else 7 for c in CLASHING[len(SCHEMA) + 2 :].split(", "))
    full = spark.createDataFrame([(i, t, "en", None, None, *more) for i, t in rows], CLASHING)
    want = {"language": {(1, 2), (2, 1), (5, 1), (None, 1), (6, 1)}, "lines": {(1, 2), (3, 1), (4, 1), (5, 1), (None, 1), (6, 1)}, "near_duplicates": {(1, 1), (3, 1), (5, 1), (None, 1), (6, 1)}, "contamination": {(1, 2), (2, 1), (3, 1), (4, 1), (5, 1), (None, 1), (6, 1)}}
    for name, stage in corpus_pipeline.STAGES:
        for docs in (full, full.limit(0)):
            out = stage(spark, docs, "/root/testdata/sf0.001").cache()
            got = {(r[0], r[1]) for r in out.groupBy("doc_id").count().collect()}
            if name == "packing":
                assert {i for i, _ in got} == ({r[0] for r in rows} if docs is full else set())
                continue
            assert out.columns == full.columns
            if docs is full:
                assert all(tuple(r)[5:] == tuple(x if not isinstance(x, bytes) else bytearray(x) for x in more) for r in out.collect())
            assert got == (want[name] if docs is full else set()), name


def test_run_gives_the_pieces_of_what_is_left(spark):
    from tokenizers import Tokenizer

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    t = Tokenizer.from_file(vocabulary())
    kept = sorted(i for i, x in texts.items() if any(c.isalpha() for c in x or ""))
    repeats = dict(zip(kept, covered([texts[i] for i in kept])))
    left = {r["doc_id"] for r in rows}
    for i in left:
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist()
        # texts without repeats come through whole, the others without them
        whole = t.encode(texts[i], add_special_tokens=False).ids + [1]
        assert len(ids) < len(whole) if repeats[i] else ids == whole
    assert len(left) >= 0.8 * len(texts) and out.where(F.col("length") > 2048).count() == 0


def test_no_stage_runs_a_python_function_twice_for_a_row(spark, capsys):
    docs, found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        capsys.readouterr()
        stage(spark, docs, "/root/testdata/sf0.001").explain()
        found[name] = re.findall(r"ArrowEvalPython \[(\w+)\(", capsys.readouterr().out)
    assert found == {"language": ["predict"], "lines": ["_delete"], "near_duplicates": [], "contamination": [], "packing": ["pieces"]}


def test_no_stage_swallows_import_errors():
    assert "ImportError" not in inspect.getsource(corpus_pipeline) and "ModuleNotFoundError" not in inspect.getsource(corpus_pipeline)

import random

import numpy as np
import pytest

import corpus_pipeline
from pagequarry.llm import lines, queries

SCHEMA = "doc_id long, text string, row string, th string, clean string, runs int, held string, id string"


def dedup(spark, texts, ids=None, **limits):
    ids = ids or list(range(len(texts)))
    docs = spark.createDataFrame([(i, t, "a", "b", "c", 1, "d", "e") for i, t in zip(ids, texts)], SCHEMA)
    return [(r["row"]["doc_id"], r["clean"]["text"], [(x["start"], x["end"]) for x in r["clean"]["runs"]], r["row"]["runs"]) for r in lines.dedup(docs, **limits).collect()]


def words(n, seed):
    random.seed(seed)
    return [f"{random.getrandbits(40):x}" for _ in range(n)]


def covered(texts, least=50, line=10):
    """The words that go, by brute force: of runs of `least` words and of written lines with an earlier place; a first place keeps its words."""
    runs, own_lines, out = {}, set(), []
    for k, text in enumerate(texts):
        w, gone, at = (text or "").encode().split(), set(), 0
        for s in range(len(w) - least + 1):
            text_of_first, first = runs.setdefault(tuple(w[s : s + least]), (k, s))
            if (text_of_first, first) != (k, s):
                gone |= set(range(max(s, first + least) if text_of_first == k else s, s + least))
        for own in (text or "").encode().split(b"\n"):
            n = len(own.split())
            if line <= n < least:
                gone |= set(range(at, at + n)) if tuple(own.split()) in own_lines else set()
                own_lines.add(tuple(own.split()))
            at += n
        out.append(gone)
    return out


def gone(found):
    return [{p for s, e in runs for p in range(s, e)} for _, _, runs, _ in sorted(found, key=lambda r: r[0])]


def test_passages_anywhere_are_found(spark):
    """Every shared run of 50 words or more is deleted from all but the first, to the word; shorter ones stay."""
    texts, want = [], []
    for length in (49, 50, 51, 80, 500):
        passage = words(length, length)
        for k, n in enumerate((0, 37, 80, 120)):
            texts.append(" ".join(words(n, 1000 * length + k) + passage + words(120 - n, 2000 * length + k)))
            want.append([(n, n + length)] if length >= 50 and k else [])
    got = sorted(dedup(spark, texts))
    assert [runs for _, _, runs, _ in got] == want and all(clash == 1 for *_, clash in got)
    assert all(text == t if not runs else len(text.split()) == 120 for (_, text, runs, _), t in zip(got, texts))


def test_repeats_inside_one_text_keep_the_first_place(spark):
    p = words(60, 3)
    (_, text, runs, _), = dedup(spark, [" ".join(p + ["x"] + p)])
    assert runs == [(61, 121)] and text.split() == p + ["x"]
    (_, text, runs, _), = dedup(spark, ["same " * 300])
    assert text == "same " * 50 and runs == [(50, 300)]
    texts = [" ".join(words(7, 9) * 30), " ".join((words(7, 9) * 20)[3:] + words(80, 2))]
    assert gone(dedup(spark, texts)) == covered(texts)


def test_written_lines(spark):
    """A line of 15 words at the head of 50 texts stays in the first alone; one of 9 words stays everywhere."""
    head, short = " ".join(words(15, 1)), " ".join(words(9, 2))
    texts = [f"{head}\n{short}\n{' '.join(words(30, 10 + k))}\n" for k in range(50)]
    got = sorted(dedup(spark, texts))
    assert got[0][1] == texts[0] and all(text == t.removeprefix(f"{head}\n") and runs == [(0, 15)] for (_, text, runs, _), t in zip(got[1:], texts[1:]))
    (_, text, runs, _), = dedup(spark, [f"{head}\n{head}\n{short}"])
    assert text == f"{head}\n{short}" and runs == [(15, 30)]


def test_copies_and_odd_rows(spark):
    long, short = " ".join(words(90, 1)), "a few words"
    got = dedup(spark, [long, long, long, short, short, None, "", "\n \n", long], [5, 3, 3, 1, 2, 8, 9, 10, None])
    by_id = {}
    for i, text, *_ in got:
        by_id.setdefault(i, []).append(text)
    assert by_id == {5: [""], 3: [long, long], 1: [short], 2: [short], 8: [None], 9: [""], 10: ["\n \n"], None: [""]}


def test_empty_table_and_limits(spark):
    assert dedup(spark, []) == []
    with pytest.raises(ValueError):
        dedup(spark, [], least=15)


def test_a_very_long_text(spark):
    w = words(120_000, 4)
    texts = [" ".join(w[50_000:50_070]), " ".join(w), " ".join(words(30, 5) + w[100_000:])]
    assert gone(dedup(spark, texts)) == [set(), set(range(50_000, 50_070)), set(range(30, 20_030))]


def test_a_passage_whose_halves_stand_apart_earlier(spark):
    """40 later texts lose all of a passage of 90 words, though other texts show its halves first."""
    texts = []
    for k in range(40):
        p = words(90, 50 + k)
        texts += [" ".join(words(20, 100 + k) + p[:48] + words(30, 200 + k)), " ".join(words(9, 300 + k) + p[42:] + words(5, 400 + k)), " ".join(words(15, 500 + k) + p + words(40, 600 + k)), " ".join(words(33, 700 + k) + p + words(9, 800 + k))]
    got = gone(dedup(spark, texts))
    assert got == covered(texts) and all(got[4 * k + 3] == set(range(33, 123)) for k in range(40))


def test_a_repeat_is_found_whichever_place_has_it(spark):
    """An earlier text that shares only part of a passage, and the same fingerprint, doesn't hide the text that has all of it."""
    for least in (50, 120):
        texts = []
        for k in range(8):
            p = words(least + 10, 50 + k)
            texts += [words(20, 100 + k) + p[k * 4 : k * 4 + 30] + words(30, 200 + k), words(15, 300 + k) + p + words(40, 400 + k), words(33, 500 + k) + p + words(9, 600 + k)]
            texts.append(words(5, 700 + k) + p[3 : 3 + least] + words(50, 800 + k) + p[10:] + words(2, 900 + k))
        texts = [" ".join(t) for t in texts]
        assert gone(dedup(spark, texts, least=least)) == covered(texts, least)


def test_random_edits_against_brute_force(spark):
    """Texts pasted from few passages with edits, over a small vocabulary so that lines repeat by chance."""
    random.seed(8)
    pool = [[random.choice("ab cd ef gh ij kl mn".split()) for _ in range(150)] for _ in range(5)]
    texts = []
    for _ in range(60):
        w = [x for p in random.choices(pool, k=3) for x in p[random.randrange(70) : random.randrange(80, 150)]]
        for _ in range(random.randrange(4)):
            w[random.randrange(len(w))] = random.choice(["zz", "yy", "\nnew"])
        texts.append(" ".join(w))
    assert gone(dedup(spark, texts)) == covered(texts)


def test_common_keys_are_joined_alike(spark, monkeypatch):
    """With a low bound for common keys all joins of the operator take both ways; nothing changes."""
    monkeypatch.setattr("pagequarry.llm.common.COMMON", 3)
    p = words(70, 1)
    texts = [" ".join(words(20, 10 + k) + p[: 50 + k % 21] + words(20, 100 + k)) for k in range(40)]
    assert gone(dedup(spark, texts)) == covered(texts)


def test_all_repeats_of_documents_against_brute_force(spark):
    """What is deleted is what has an earlier place, word for word, in every text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    found = {r["row"]["doc_id"]: {p for x in r["clean"]["runs"] for p in range(x["start"], x["end"])} for r in lines.dedup(docs).collect()}
    want = covered([t for _, t in texts])
    assert any(want) and [(i, found[i]) for i, _ in texts] == [(i, x) for (i, _), x in zip(texts, want)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_by_bytes_and_only_where_asked_for(spark, tmp_path):
    """The query matches no pattern on any text; the pipeline, which asks for no count, sends only changed texts to Python."""
    p = " ".join(words(60, 1))
    texts = [None, "", " \n", "one", "\ta\u00a0b  c\n\n d\x0b", p, f"x {p}\r\ny", "\u4e2d \u6587 " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_lines(spark, str(tmp_path))
    assert {r["doc_id"]: r["n_words"] for r in found.collect()} == {k: len((t or "").encode().split()) for k, t in enumerate(texts)}
    assert "regexp" not in plan(found).lower() and "_words(" in plan(found)
    of_pipeline = plan(corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)))
    assert "_delete(" in of_pipeline and "_words(" not in of_pipeline


def test_texts_side_by_side_lose_their_own_words_only():
    """Deletion in concatenated texts is deletion in each: runs that touch at the border of two texts, texts without words, rests of odd blanks."""
    random.seed(3)
    texts = [b"", b"a b c", b"d e f", b"  \n", b" g\t h ", "\u00a0 i j".encode(), b"k", b"", b"l m n o p q r s "] * 20
    spans = []
    for t in texts:
        n = len(t.split())
        spans.append([(s, random.randrange(s + 1, n + 1)) for s in (random.randrange(n) for _ in range(random.randrange(4)))] if n else [])
    spans[1:3], spans[5] = [[(0, 3)], [(0, 2), (1, 3)]], [(1, 3)]
    number, flat = np.cumsum([0, *(len(x) for x in spans)]), np.array([x for s in spans for x in s]).T
    offsets = np.cumsum([0, *(len(t) for t in texts[2:])])
    left, sizes, (runs, start, end, counts) = lines.without(2, np.frombuffer(b"".join(texts[2:]), np.uint8), offsets, number, list(flat))
    at, runs_at = np.cumsum([0, *sizes]), np.cumsum([0, *runs])
    for k, (text, of) in enumerate(zip(texts[2:], spans[2:])):
        gone, w = {p for s, e in of for p in range(s, e)}, text.split()
        got = left[at[k] : at[k + 1]].tobytes()
        found = list(zip(start[runs_at[k] : runs_at[k + 1]].tolist(), end[runs_at[k] : runs_at[k + 1]].tolist()))
        assert counts[k] == len(w) and {p for s, e in found for p in range(s, e)} == gone
        assert all(e < s for (_, e), (s, _) in zip(found, found[1:]))
        assert got.split() == ([x for p, x in enumerate(w) if p not in gone] if got else []) and (got != b"" or not text or not b" ".join(x for p, x in enumerate(w) if p not in gone).decode().strip())
        assert of or got == text


def test_rows_of_one_id_and_text_count_as_one(spark):
    """Every row is there twice; runs are looked up alike."""
    texts = []
    for k in range(8):
        p = words(60, 50 + k)
        texts += [words(20, 100 + k) + p[k * 4 : k * 4 + 30] + words(30, 200 + k), words(15, 300 + k) + p + words(40, 400 + k), words(5, 700 + k) + p[3:53] + words(50, 800 + k) + p[10:] + words(2, 900 + k)]
    texts = [" ".join(t) for t in texts]
    got = gone(dedup(spark, [t for t in texts for _ in range(2)], [k for k in range(len(texts)) for _ in range(2)]))
    assert got == [x for x in covered(texts) for _ in range(2)] and any(got)

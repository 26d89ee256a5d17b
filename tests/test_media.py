"""Transcripts in blocks, and the images of posts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import store, timed


def plainly(snippets, chunk):
    blocks, start, texts = [], None, []
    for at, text in snippets:
        if start is not None and (chunk <= 0 or at - start >= chunk):
            blocks.append((start, texts))
            start, texts = None, []
        if start is None:
            start = at
        texts.append(text or "")
    blocks.append((start, texts))
    joined = [(at, " ".join(" ".join(t).split())) for at, t in blocks]
    return [(at, t) for at, t in joined if t]


@pytest.mark.parametrize("chunk", [0.0, 2.5, 1e9])
def test_blocks_of_transcripts(spark, chunk):
    rng = random.Random(7)
    rows = [(None if i % 11 == 0 else f"v{i % 3 if i % 2 else 9}", rng.randrange(80) / 2, i, rng.choice(["a  b", "", None, " c\n", "d"])) for i in range(400)]
    df = spark.createDataFrame(rows, "v string, at double, n long, line string")
    want = {}
    for v in {r[0] for r in rows}:
        for i, (at, text) in enumerate(plainly([(r[1], r[3]) for r in sorted((r for r in rows if r[0] == v), key=lambda r: r[1:3])], chunk)):
            want[v, i] = (at, text)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys and blocks go on over batches
    try:
        found = {(r["v"], r["block"]): (r["at"], r["text"]) for r in timed.transcript_blocks(df, "v", "at", "line", chunk, "n").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == want


def test_times_and_odd_transcripts(spark):
    df = spark.createDataFrame([(1, 5.9, "x"), (1, 3725.0, " y "), (2, None, "z"), (3, 1.0, " ")], "v long, at double, line string")
    show = lambda **o: [tuple(r) for r in timed.chunk_transcript(df, "v", "at", "line", 60, **o).collect()]
    assert show() == [(1, 2, "[00:05] x\n\n[1:02:05] y")]
    assert show(style="links") == [(1, 2, "[00:05](https://www.youtube.com/watch?v=1&t=5s) x\n\n[1:02:05](https://www.youtube.com/watch?v=1&t=3725s) y")]
    assert show(style="none") == [(1, 2, "x\n\ny")]
    assert timed.chunk_transcript(df.limit(0), "v", "at", "line", 60).count() == 0
    with pytest.raises(ValueError):
        show(style="other")


def picture(url, kind="Image"):
    return {"e": kind, "s": {"u": url}}


POSTS = [
    (None, []), ("{bad", []), ({}, []),
    ({"is_video": True, "media": {"reddit_video": {"fallback_url": "v"}}, "url": "https://i.redd.it/a.png"}, []),
    ({"is_video": True, "url": "https://i.redd.it/a.png"}, [("https://i.redd.it/a.png", "a", "single")]),
    ({"gallery_data": {"items": [{"media_id": "b"}, {"media_id": "a"}, {"media_id": "b"}, {"media_id": "x"}, {}]}, "media_metadata": {"a": picture("https://preview.redd.it/a?x&amp;y"), "b": picture("http://u@I.REDD.it:80/b"), "c": picture("https://i.redd.it/c")}},
     [("http://u@I.REDD.it:80/b", "b", "gallery"), ("https://preview.redd.it/a?x&y", "a", "gallery")]),
    ({"gallery_data": {"items": None}, "media_metadata": {"a": picture("https://i.redd.it/a")}, "url": "https://i.redd.it/a.png"}, []),
    ({"gallery_data": {"items": [{"media_id": "a"}, {"media_id": "b"}]}, "media_metadata": {"a": picture("https://i.redd.it.evil.org/a"), "b": picture("https://i.redd.it/b", "AnimatedImage")}}, []),
    ({"url": "https://i.redd.it/d/k.JPEG?s=1#f", "post_hint": "image"}, [("https://i.redd.it/d/k.JPEG?s=1#f", "k", "single")]),
    ({"url": "https://i.redd.it/k.gif"}, []), ({"url": "https://i.redd.it/.png"}, []), ({"url": "https://evil.org/k.png"}, []), ({"url": "k.png"}, []), ({"url": "https://i.redd.it/k.png?x"}, []),
    ({"is_self": True, "selftext": "see bb and aa", "media_metadata": {"aa": picture("https://i.redd.it/1"), "bb": picture("https://i.redd.it/2"), "cc": picture("https://i.redd.it/3"), "see": picture("https://other.org/4")}},
     [("https://i.redd.it/2", "bb", "inline"), ("https://i.redd.it/1", "aa", "inline")]),
    ({"is_self": False, "selftext": "aa", "media_metadata": {"aa": picture("https://i.redd.it/1")}}, []),
]


def test_images_of_posts(spark):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, (p, _) in enumerate(POSTS)]
    found = store.post_images(spark.createDataFrame(rows, "id long, post string"), "id", "post")
    got = {}
    for r in found.orderBy("page_key", "pos").collect():
        assert r["pos"] == len(got.setdefault(r["page_key"], []))
        got[r["page_key"]].append((r["url"], r["key"], r["kind"]))
    for i, (post, want) in enumerate(POSTS):
        assert got.get(i, []) == want, post


def test_a_page_without_its_transcripts_is_incomplete(spark):
    images = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a")], "page_key long, key string")
    kept = spark.sql("SELECT 'a' AS key, TIMESTAMP '2024-01-30 00:00:00' AS created_at UNION ALL SELECT 'b', TIMESTAMP '2023-01-01 00:00:00'")
    rows = store.join_transcripts(images, kept, F.expr("TIMESTAMP '2024-01-31 00:00:00'"), 5, 12).orderBy("page_key").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 1, True), (2, 1, 1, False)]

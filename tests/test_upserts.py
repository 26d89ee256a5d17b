"""Streaming upserts as a log: any order of writes, batches that come twice, runs merged and deleted."""

import random

from pyspark.sql import functions as F

from pagequarry.operators import store
from pagequarry.streaming import upserts as U

SCHEMA = "url string, seq long, title string, share_id string, user_id long"


def writes(seed, n, urls=40):
    rng = random.Random(seed)
    rows = [(f"u{rng.randrange(urls)}", i, rng.choice([None, f"t{i}"]), rng.choice([None, f"s{i}"]), rng.choice([None, i])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def stream(spark, tmp_path, batches, **options):
    """One file, and so one micro-batch, for each list of rows."""
    source = str(tmp_path / "source")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    path = str(tmp_path / "table")
    U.stream_upsert(events, path, str(tmp_path / "state"), **options).trigger(availableNow=True).start().awaitTermination()
    return path


def plainly(rows):
    """A dictionary that takes the writes in order."""
    out = {}
    for url, seq, title, share, user in sorted(rows, key=lambda r: r[1]):
        old = out.get(url, (None,) * 4)
        out[url] = (seq, old[1] if old[1] is not None else share, old[2] if old[2] is not None else user, title)
    return out


def got(df):
    return {r["url"]: (r["seq"], r["share_id"], r["user_id"], r["title"]) for r in df.collect()}


def test_late_writes_give_what_a_dictionary_gives(spark, tmp_path):
    rows = writes(1, 300)
    path = stream(spark, tmp_path, [rows[i : i + 60] for i in range(0, 300, 60)], fan=2, unit=1 << 40)
    assert got(U.upserted(spark, path)) == plainly(rows)
    live, old = U.runs(spark, path)
    assert live == [(0, 4)] and old == [(0, 3), (4, 4)]  # what the last merge took is there until the next one
    assert got(store.upsert_conversions(spark.createDataFrame(rows, SCHEMA))) == plainly(rows)


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    big, small = writes(2, 2000, 2000), [[("u1", 5000, "new", "late", 1)], [("only", 1, None, None, None)]]
    path = stream(spark, tmp_path, [big, *small], fan=3, unit=4096)
    assert U.runs(spark, path) == ([(0, 0), (1, 1), (2, 2)], [])
    assert [spark.read.parquet(f"{path}/run-{i}-{i}").count() for i in (1, 2)] == [1, 1]
    assert got(U.upserted(spark, path)) == plainly(big + [r for b in small for r in b])


def test_runs_that_are_there_twice_change_nothing(spark, tmp_path):
    rows = writes(3, 90)
    path = str(tmp_path / "table")
    parts = [spark.createDataFrame(rows[i : i + 30], SCHEMA) for i in range(0, 90, 30)]
    for i, part in enumerate(parts):
        U.CONVERSIONS.state(part).write.parquet(f"{path}/run-{i}-{i}")
    states = [U.CONVERSIONS.state(p) for p in (*parts, parts[0])]
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    assert got(U.CONVERSIONS.rows(U.CONVERSIONS.merged(union))) == plainly(rows)
    U.CONVERSIONS.state(parts[0]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/run-0-2")
    assert U.runs(spark, path)[0] == [(0, 0), (1, 1), (2, 2)]  # a merge that was lost on its way counts for nothing
    U.compact(spark, path, U.CONVERSIONS, fan=3)
    assert U.runs(spark, path) == ([(0, 2)], [(0, 0), (1, 1), (2, 2)])
    assert got(U.upserted(spark, path)) == plainly(rows)


def test_few_runs_and_little_rewriting():
    """With equal batches each byte is rewritten once a size class, and runs stay below fan for each."""
    runs, written = [], 0
    for _ in range(1000):
        runs.append(100)
        n = U._due(runs, 8, 100)
        if n:
            merged = sum(runs[-n:])
            runs, written = [*runs[:-n], merged], written + merged
        assert len(runs) <= 7 * 5
    assert sum(runs) == 100_000 and written <= 4 * 100_000


def test_runs_of_any_size_stay_few():
    rng, runs = random.Random(4), []
    for _ in range(500):
        runs.append(rng.choice([1, 50, 100, 900, 5000, 70_000]))
        n = U._due(runs, 4, 100)
        if n:
            runs = [*runs[:-n], sum(runs[-n:])]
        assert len(runs) <= 4 * 10


def test_fetches(spark, tmp_path):
    rows = [(u % 3, c % 4, u * 7 + c) for u in range(9) for c in range(5)] + [(None, 1, 5)]
    source, path = str(tmp_path / "s"), str(tmp_path / "t")
    spark.createDataFrame(rows, "user_id long, cache_id long, fetched_at long").repartition(6).write.parquet(source)
    events = spark.readStream.schema("user_id long, cache_id long, fetched_at long").option("maxFilesPerTrigger", 2).parquet(source)
    U.stream_upsert(events, path, str(tmp_path / "c"), U.FETCHES, fan=2).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for u, c, t in rows:
        want[u, c] = max(t, want.get((u, c), t))
    found = U.upserted(spark, path, U.FETCHES)
    assert {(r["user_id"], r["cache_id"]): r["fetched_at"] for r in found.collect()} == want and found.columns == ["user_id", "cache_id", "fetched_at"]


def test_nothing_written(spark, tmp_path):
    assert U.upserted(spark, str(tmp_path / "none")) is None
    path = stream(spark, tmp_path, [[]])
    table = U.upserted(spark, path)
    assert table is None or table.where(F.lit(True)).count() == 0

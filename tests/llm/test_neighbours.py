import numpy as np
from pyspark.sql import functions as F

from pagequarry.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, key string, vec string, ids string"


def exact(rows, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        out[int(q)] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def search(spark, rows, **more):
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    out = {}
    for r in N.search(df, F.col("id") % 100 == 0, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"], r["rank"]))
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = {}
    for r in N.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["score"]
    hits = sum(i in got[q] for q, near in want.items() for i, _ in near)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(abs(got[q][i] - d) < 1e-9 for q, near in want.items() for i, d in near if i in got[q])


def test_equal_vectors_ties_and_odd_rows(spark):
    random = np.random.default_rng(1)
    same = [1.0, 0.0, 2.0]
    rows = [(k, same) for k in range(90, 160)] + [(k, random.normal(size=3).tolist()) for k in range(200, 260)]
    odd = [(300, None), (400, []), (500, [0.0, 0.0, 0.0]), (600, [1.0, None, 2.0]), (700, [float("nan"), 1.0, 1.0]), (800, [float("inf"), 1.0, 1.0]), (900, [1.0, 2.0]), (None, same)]
    got = search(spark, rows + rows[:5] + odd)
    assert set(got) == {100, 200}
    assert [(i, s) for i, s, _ in got[100]] == [(i, 0.0) for i in (90, 91, 92, 93, 94, 95, 96, 97, 98, 99)]
    assert [(i, round(s, 9)) for i, s, _ in got[200]] == [(i, round(d, 9)) for i, d in exact(rows)[200]]
    assert [r for _, _, r in got[200]] == list(range(1, 11))


def test_few_and_none(spark):
    assert search(spark, [(0, [1.0, 2.0]), (3, [1.0, 3.0])]) == {0: [(3, 1.0, 1)]}
    assert search(spark, [(0, [1.0, 2.0])]) == {} and search(spark, []) == {}

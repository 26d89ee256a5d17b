import random
from collections import Counter

from pagequarry.llm import contamination as C

SCHEMA = "doc_id long, text string, w string, hashes string, item string"


def words(n, seed):
    random.seed(seed)
    return [f"{random.getrandbits(30):x}" for _ in range(n)]


def find(spark, docs, items):
    d = spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(docs)], SCHEMA)
    b = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, w string")
    return {(r["id"], r["item"]): r for r in C.find(d, b).collect()}, C.clean(d, b)


def test_whole_and_near_items_are_found(spark):
    item = words(60, 1)
    near = item[:30] + ["changed"] + item[31:]
    far = item[:20] + words(20, 2) + item[40:]
    moved = item[:30] + ["new"] + item[30:]
    docs = [" ".join(words(40, 3) + x + words(40, 4)) for x in (item, near, far, moved)] + [" ".join(x.upper() + "," for x in item)]
    found, kept = find(spark, docs, [" ".join(item), " ".join(words(60, 9))])
    assert {k[0] for k in found} == {0, 1, 3, 4} and {k[1] for k in found} == {0}
    assert found[0, 0]["start"] == 40 and found[0, 0]["similarity"] == 1 and found[0, 0]["distance"] == 0
    assert abs(found[1, 0]["similarity"] - 51 / 61) < 1e-9
    assert [r["doc_id"] for r in kept.collect()] == [2] and kept.columns == ["doc_id", "text", "w", "hashes", "item"]


def test_odd_rows(spark):
    found, kept = find(spark, [None, "", "short item", "xx Short item yy", "short item", "z " * 30_000, "a b c d e f"], ["short item", None, "", "a b c d e"])
    assert set(found) == {(2, 0), (3, 0), (4, 0), (6, 3)} and found[3, 0]["start"] == 1 and found[6, 3]["n"] == 5
    assert kept.count() == 7 - len(found)
    d = spark.createDataFrame([], SCHEMA)
    b = spark.createDataFrame([], "item_id long, text string")
    assert C.find(d, b).count() == 0 and C.clean(d, b).count() == 0


def test_against_brute_force_on_documents(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    texts, items = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}, {r[0]: r[1] for r in bench.select("item_id", "text").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert want and {(r["id"], r["item"]) for r in C.find(docs, bench).collect()} == want


def brute(docs, items, least=0.8, words=5):
    """(doc, item) -> (start, similarity) of the most similar of all windows of the item's size."""
    out = {}
    for i, x in enumerate(items):
        k = min(words, len(x))
        theirs = Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
        for d, w in enumerate(docs):
            every = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            own = min(len(x) - k + 1, len(every))
            for start in range(len(every) - own + 1) if every else ():
                mine = Counter(every[start : start + own])
                common = sum((mine & theirs).values())
                value = common / (own + theirs.total() - common)
                if value >= least and value > out.get((d, i), (0, 0))[1]:
                    out[d, i] = (start, value)
    return out


def test_every_window_against_brute_force(spark):
    """Items in pieces, in another order, short ones, repeated shingles, texts shorter than the item."""
    items = [words(48, 1), words(9, 2), words(3, 3), words(1, 4), words(6, 5) * 7, words(30, 6)]
    q, a = items[0][:24], items[0][24:]
    docs = [words(20, 10) + a + q + words(20, 11), a + q, items[1][:4] + ["x"] + items[1][5:], words(5, 12) + items[2] + words(2, 13) + items[3], items[4][3:] + words(9, 14), items[5][:28], words(3, 15) + items[5][1:] + ["x", "y"], items[2][:2], []]
    random.seed(3)
    for k in range(40):
        base = list(random.choice(items[:1] + items[4:]))
        for _ in range(random.randrange(4)):
            base[random.randrange(len(base))] = f"e{random.randrange(99)}"
        docs.append(words(random.randrange(9), 100 + k) + base[random.randrange(3) :] + words(random.randrange(9), 200 + k))
    found, _ = find(spark, [" ".join(d) for d in docs], [" ".join(x) for x in items])
    assert {k: (r["start"], round(r["similarity"], 9)) for k, r in found.items()} == {k: (s, round(v, 9)) for k, (s, v) in brute(docs, items).items()}


def test_blocks_guarantee_the_radius(spark):
    random.seed(2)
    rows = []
    for _ in range(200):
        a = random.getrandbits(64)
        b = a ^ sum(1 << x for x in random.sample(range(64), C.RADIUS))
        rows.append((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "a long, b long").select(F.size(F.array_intersect(C.blocks(F.col("a"), C.RADIUS), C.blocks(F.col("b"), C.RADIUS))).alias("n"))
    assert df.where("n = 0").count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "", "", "")], SCHEMA)
    plan = C.find(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan

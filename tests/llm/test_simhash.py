import random
from itertools import combinations

import numpy as np
import xxhash

from pagequarry.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component string"


def brute_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def test_masks_guarantee_the_radius():
    masks = simhash.masks()
    assert all(any((1 << a | 1 << b) & m == 0 for m in masks) for a in range(64) for b in range(64))


def test_bit_sliced_pairs_match_brute_force():
    random.seed(5)
    for sizes in ([1, 2, 3], [70, 1, 130], [5] * 40):
        values = []
        for size in sizes:
            base = random.getrandbits(64)
            values += [base ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) & (1 << 64) - 1 for _ in range(size)]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        i, j = simhash.close_pairs(np.array(values, np.uint64), starts)
        want = {(a, b) for s, e in zip(starts[:-1], starts[1:]) for a, b in combinations(range(s, e), 2) if bin(values[a] ^ values[b]).count("1") <= 2}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_groups_match_brute_force_with_odd_rows(spark):
    random.seed(1)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(random.choices(words, k=random.choice([1, 2, 3, 40, 300]))) for _ in range(60)]
    texts += [t + " x" for t in texts[:20]] + [t.upper() for t in texts[20:30]] + ["", None, "   ", texts[0], "é ß\t\n"] + ["long " * 50_000]
    ids = list(range(len(texts), 0, -1))
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in zip(ids, texts)] * 2, SCHEMA)
    fps = [brute_fingerprint(t) for t in texts]
    want = {(i, f, c) for i, f, c in zip(ids, fps, brute_components(ids, fps))}
    for tile in (1024, 4):
        rows = simhash.near_duplicates(docs, tile=tile).collect()
        assert len(rows) == 2 * len(texts)
        assert {(r["id"], r["fp"] & (1 << 64) - 1, r["component"]) for r in rows} == want


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c", "", ""), (7, "a b c", "", ""), (None, "q r s t", "", "")], SCHEMA)
    assert sorted(str(r["component"]) for r in simhash.near_duplicates(docs).collect()) == ["7", "7", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0

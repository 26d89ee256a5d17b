import random

import pytest

from pagequarry.llm import licenses as L
from pagequarry.llm.license_texts import NOTICES

SCHEMA = "doc_id long, text string, h string, every string, class string"


def scan(spark, texts):
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(texts)], SCHEMA)
    return {(r["id"], r["notice"]): r["containment"] for r in L.scan(docs).collect()}


def test_every_notice_is_found_at_every_place(spark):
    names = sorted(NOTICES)
    texts = [f"{'pad ' * at}{NOTICES[n]} {'end ' * 70}" for n in names for at in (0, 1, 7, 33, 100)]
    found = scan(spark, texts)
    for k in range(len(texts)):
        assert found.get((k, names[k // 5])) == 1.0, texts[k][:80]


def test_near_and_far_notices_and_odd_rows(spark):
    mit = NOTICES["MIT"].split()
    near, far = " ".join(mit[:20] + ["xx"] + mit[21:]), " ".join(mit[: len(mit) // 2])
    found = scan(spark, [near, far, None, "", "licensed", "word " * 30_000 + NOTICES["GPL"], near, "RELEASED under, the MIT license!"])
    assert found[0, "MIT"] == found[6, "MIT"] > 0.8 and (1, "MIT") not in found
    assert {k for k in found if k[0] in (2, 3, 4)} == set() and (5, "GPL") in found and (7, "MIT-notice") in found
    assert scan(spark, []) == {}


def test_telling_words_lose_nothing():
    chosen = set(L.telling_words(NOTICES, 0.8))
    for text in NOTICES.values():
        words = [w for w in __import__("re").split(r"[^\w]|_", text.lower()) if w]
        shingles = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
        assert sum(bool(chosen & set(s)) for s in shingles) > 0.2 * len(shingles)


SHORT = {"A": "MIT licensed", "B": "GPL", "C": "licensed under the MIT", "none": "--", "long": NOTICES["MIT"]}


def plainly(texts, notices):
    """Every window of every class, the exact share of each notice's shingles in it, the first best kept."""
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    own = {k: L.split_words(t) for k, t in notices.items()}
    size = lambda w: max(8, 1 << (len(w) - 1).bit_length())
    out = {}
    for k, text in enumerate(texts):
        w = L.split_words(text or "")
        for name, theirs in own.items():
            if 0 < len(theirs) < 5:
                places = [i for i in range(len(w) - len(theirs) + 1) if w[i : i + len(theirs)] == theirs]
                if places:
                    out[k, name] = (places[0], 1.0)
            elif theirs and w:
                c, mine, want = size(theirs), shingles(w), set(shingles(theirs))
                best = max(((len(want & set(mine[s : s + max(1, c * 3 // 2 - 4)])) / len(want), -s) for s in range(0, len(mine), c // 2)))
                if best[0] >= 0.8:
                    out[k, name] = (-best[1], best[0])
    return out


@pytest.mark.parametrize("notices", [NOTICES, SHORT])
@pytest.mark.parametrize("sent", [L.SENT, 0])
def test_against_every_window(spark, monkeypatch, notices, sent):
    monkeypatch.setattr(L, "SENT", sent)
    rng, texts = random.Random(9), ["gpl", "MIT licensed", None, "", "x " * 500]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(list(notices.values())).split()
            at = rng.randrange(len(w)) if rng.random() < 0.5 else None
            parts += ["pad"] * rng.randrange(60) + (w if at is None else w[:at] + ["Xx"] + w[at + 1 :])
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["id"], r["notice"]): (r["start"], r["containment"]) for r in L.scan(docs, notices=notices).collect()} == plainly(texts, notices)


def test_rows_of_one_id(spark):
    a, b = f"pad {NOTICES['MIT']}", f"{'pad ' * 90}{NOTICES['MIT']}"
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (None, a), (None, a)], "doc_id long, text string")
    found = [(r["id"], r["start"] > 40) for r in L.scan(docs).where("notice = 'MIT'").collect()]
    assert sorted(found, key=str) == [(1, False), (1, True), (None, False)]

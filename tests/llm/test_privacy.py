import re

from pagequarry.llm import privacy as P

SCHEMA = "doc_id long, text string, spans string, base string, terms string"


def luhn(d):
    return sum(x if k % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


KINDS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(KINDS) for m in re.finditer(p, text or "") if ok(m[0]))


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f, x@y, @z.q u.v+w%x-y@host-1.example.co.uk. 😀 é@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 010.001.0.255 1.2.3 0000255.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 49927398716 4111  1111 1111 1111 0 4111111111111111",
    "+1 (555) 123-4567 +1-2 +44 20 7946 0958. +123456789012345678 +1.2.3.4.5.6.7.8.9.0", "a.b@c..d a@b.c.d..e a@-.- .@.a@b.c a@b.c@d.e", "\u0001@b.c 1\u00012 a\u0001b@c\u0001d.e",
    "1 " * 20_000, "a@b" + ".c" * 20_000, "9" * 30_000, "@" * 1000 + ".a" * 1000,
]


def test_base_spans_match_the_patterns(spark):
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(TEXTS)] * 2, SCHEMA)
    rows = P.find(docs).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == brute(TEXTS[r["id"]]), TEXTS[r["id"]][:60]


def test_terms_that_give_an_entity_away(spark):
    from pyspark.sql import functions as F

    texts = [f"report {k}: agent Zanzibar wrote to spy@mi.example.org about the harvest" for k in ("north", "south", "west")]
    texts += [f"the harvest about north and south was good, number {k}" for k in range(30)] + ["mail other@x.example.org once, Quokka"]
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(texts)], SCHEMA)
    found = {r["id"]: [texts[r["id"]][s["start"] : s["end"]] for s in r["terms"]] for r in P.find(docs).collect()}
    assert "Zanzibar" in found[0] and "agent" in found[1] and "harvest" not in found[0] and "about" not in found[2]
    assert found[33] == [] and found[5] == []
    spans = P.find(docs).select("id", F.concat("base", "terms").alias("s")).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    clean = {r["id"]: r["c"] for r in spans.select("id", P.sanitise(F.col("text"), F.col("s")).alias("c")).collect()}
    assert "[EMAIL]" in clean[0] and "spy@" not in clean[0] and "Zanzibar" not in clean[0] and clean[5] == texts[5]


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert P.find(docs).count() == 0
    plan = P.find(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_terms_far_from_a_mention_and_without_it(spark):
    """A term of the whole text is weighed, and every place of it gets a span, also where the entity is not in the text."""
    far = " ".join(f"filler{'abcdefghij'[k % 10]}" for k in range(60))
    texts = [f"Zanzibar heads the office. {far} Number {'xyz'[k]}, signed spy@mi.example.org again ZANZIBAR." for k in range(3)]
    texts += ["A word of Zanzibar alone, zanzibar@other.example.org and Zanzibar"] + [f"{far} number {k}" for k in range(300)]
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(texts)] * 1, SCHEMA)
    found = {r["id"]: [(s["start"], s["end"]) for s in r["terms"]] for r in P.find(docs).collect()}
    for k in range(3):
        at = [m.span() for m in re.finditer("zanzibar", texts[k], re.I)]
        assert len(at) == 2 and set(at) <= set(found[k]) and not any(texts[k][s:e].startswith("filler") for s, e in found[k])
    assert found[3] == [m.span() for m in re.finditer("Zanzibar", texts[3])] and len(found[3]) == 2 and found[9] == []


def test_terms_against_brute_force(spark):
    """The terms that disclose an entity, from counts over whole texts, and all their places."""
    import math
    import random

    random.seed(6)
    names = "alpha bravo carol delta echos foxes golfs hotel india".split()
    people = [f"p{k}@x{k}.org" for k in range(5)]
    texts = []
    for k in range(120):
        w = [random.choice(names[5:]) for _ in range(6)]
        if k % 4 == 0:
            who = random.randrange(5)
            w += [people[who], names[who] if random.random() < 0.9 else "other"] + [people[(who + 1) % 5]] * (k % 8 == 0)
        w += [random.choice(names)] * (random.random() < 0.02)
        random.shuffle(w)
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(texts)], SCHEMA)
    bare = [re.sub(KINDS[0][0], "@", t) for t in texts]
    has = lambda t: set(re.findall("[a-z]{3,}", t))
    telling = set()
    for e in people:
        own = [k for k, t in enumerate(texts) if e in [m[0] for m in re.finditer(KINDS[0][0], t)]]
        for w in set().union(*(has(bare[k]) for k in own)):
            both, n_w = [k for k in own if w in has(bare[k])], sum(w in has(t) for t in bare)
            pmi = math.log2(len(both) * len(texts) / (n_w * len(own)))
            if len({texts[k] for k in both}) >= P.SUPPORT and pmi >= P.DISCLOSURE * math.log2(len(texts) / len(own)) - 1e-9:
                telling.add(w)
    want = {k: [m.span() for m in re.finditer("[a-z]{3,}", re.sub(KINDS[0][0], lambda m: "@" * len(m[0]), t)) if m[0] in telling] for k, t in enumerate(texts)}
    assert telling and {r["id"]: [(s["start"], s["end"]) for s in r["terms"]] for r in P.find(docs).collect()} == want


def test_many_matches_in_one_text(spark):
    """5000 addresses in one text: places are right, and the work stays near linear."""
    text = "".join(f"mail u{k}@h{k}.org x, " for k in range(5000))
    (r,) = P.find(spark.createDataFrame([(1, text, "", "", "")], SCHEMA)).collect()
    assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == brute(text)

"""The automaton against a search over all edits, and whole conversations against a plain function."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import repair
from pagequarry.llm.queries import damaged, op11_repair

BLANK = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str, list[str]]:
    """Cost, audit and repaired rows (role, text, fault) by Dijkstra over (cost, audit), with the grammar tested on the whole."""
    heap, limit = [(0, "", 0, ())], 4 * len(rows) + 4
    done = set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in out)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, [f"{r}:{t}" for r, t in out]
        key = at, initials[-1:] if initials else "", audit
        if key in done or cost > limit or not re.fullmatch("s?(ua)*u?", initials):
            continue
        done.add(key)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, (*out, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*out, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, (*out, (other, text))))
    raise AssertionError


def faults(rows: list[tuple[str, str]]) -> list[str]:
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows: list[tuple]) -> dict:
    """What op11 says of one conversation's (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    said = [(r, t) for _, r, t in rows]
    wrong = faults(said)
    cost, audit, out = cheapest([(r, t, f) for (r, t), f in zip(said, wrong)])
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": wrong.count("blank"), "duplicate": wrong.count("duplicate"), "truncated": wrong.count("truncated"),
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def harmed(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_every_short_signature():
    """Costs and audits of all signatures of up to four rows."""
    signs = "sSuUaAoOx"
    every = [""]
    for _ in range(4):
        every += [s + c for s in every if len(s) == max(map(len, every)) for c in signs]
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    chosen = sorted(set(every[:900]) | set(random.Random(3).sample(every, 400)), key=lambda s: s[::-1])
    for signature, cost, audit in repair.audited(iter(chosen)):
        rows = [(roles[c.lower()], "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in signature]
        assert (cost, audit) == cheapest(rows)[:2], signature


def test_nodes_are_shared():
    """A long tail of different signatures needs few nodes, and each is worked out once."""
    automaton, rng = repair.Automaton(), random.Random(1)
    many = sorted({"".join(rng.choice("suaUAx") for _ in range(60)) for _ in range(300)}, key=lambda s: s[::-1])
    assert len(list(repair.audited(iter(many), automaton))) == len(many)
    assert len(automaton.nodes) < 200 and len(automaton.steps) <= 9 * len(automaton.nodes)


def made(n: int) -> list[tuple]:
    rng, rows = random.Random(5), []
    for conv in [None, *range(n)]:
        turns = list(range(rng.randrange(0, 7))) + [None] * rng.choice((0, 0, 0, 1))
        for turn in turns:
            if rng.random() < 0.1:
                continue
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No!", "so", " \n", "Är det? ", None, "x" * 40 + "."])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_against_plain_functions(spark, tmp_path):
    rows = made(120) + [(7, 3, "user", "Twice."), (7, 3, "user", "Twice."), (7, 3, "assistant", "Tie.")]
    spark.createDataFrame(rows, SCHEMA).withColumn("signature", F.lit(1)).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in op11_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    after = harmed(rows)
    for conv, row in got.items():
        assert {k: v for k, v in row.items() if k != "conv_id"} == plain([r[1:] for r in after if r[0] == conv]), conv


def test_repaired_rows_follow_the_grammar(spark):
    rows = spark.createDataFrame(made(60), SCHEMA)
    audits, ordered = repair.diagnose(rows)
    out = repaired = {}
    for r in repair.repaired(audits, ordered).orderBy("conv", "position").collect():
        repaired.setdefault(r["conv"], []).append(r)
    for conv, said in out.items():
        assert GRAMMAR.fullmatch("".join(r["role"][:1] for r in said)) and [r["position"] for r in said] == list(range(1, len(said) + 1)), conv
    digest = {r["conv"]: r["repaired_sha256"] for r in repair.digests(audits, ordered).collect()}
    assert digest == {r["conv"]: hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in out.get(r["conv"], [])).encode()).hexdigest() for r in audits.collect()}


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.diagnose(empty)[0].count() == 0 and damaged(empty).count() == 0
    long = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"))
    one = repair.diagnose(long)[0].first()
    assert one["cost"] == 0 and one["audit"] == "K" * 20_000 and one["gaps"] == 0
    huge = spark.createDataFrame([(1, 0, "user", "word " * 400_000 + "!")], SCHEMA)
    assert repair.diagnose(huge)[0].first()["audit"] == "KI"


@pytest.mark.parametrize("text, fault", [("a.\n", ""), ("a", "truncated"), ("\xa0", "truncated"), ("\t\x0b", "blank"), (None, "blank")])
def test_faults(spark, text, fault):
    row = repair.diagnose(spark.createDataFrame([(1, 1, "user", text)], SCHEMA))[0].first()
    assert [f for f in ("blank", "duplicate", "truncated") if row[f]] == ([fault] if fault else [])

"""Conversation structure repair on a suffix-shared automaton.

A conversation becomes a signature: a letter for each row, in order, that says the role's initial and the row's fault. The cheapest edits that
make its roles follow `(s?(ua)+)?` depend on what comes after a row, not before it, so signatures are read from their ends.
The different signatures of all conversations are sorted by their reversals; neighbours share their endings, and
each row of an ending is a node of an automaton that is made once: it holds, for each state of the grammar,
the cost to the end and the first letter of the best audit (the edits' initials). Nodes with equal choices and equal cost differences are one node; its
successor under a letter is worked out once. Reading an audit is then a walk from node to node.

Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (all there is for blank and duplicate rows), Insert an empty user or assistant row 2;
a truncated row that stays adds 1. Of the cheapest edits the audit that is least in ASCII counts.

Faults, the first that holds: blank (nothing but blanks), duplicate (role and text occur earlier in the conversation), truncated (the last
character that isn't blank is none of `.!?`).

A conversation's rows stream through one task in order (a digest of its text can be had in no other way) and none is held; a byte for each row
makes its signature. Rows are compared by 128-bit hashes of role and text where duplicates are looked for.

Defined results: null roles and texts are one space; an empty role has no initial and fits nowhere; a null conversation id is one conversation; rows are in order of turn (nulls first), then
role, then text; equal rows of a turn are duplicates but for one; an empty table gives no rows; other columns are ignored.
"""

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import small_batches, written

BLANK = " \t\n\x0b\x0c\r"
#: States of the grammar: nothing yet, after system, after user, after assistant; the role that must come next, and where one may end.
NEXT = ("user", "user", "assistant", "user")
AFTER = {"s": 1, "u": 2, "a": 3}
MAY_END = (True, False, False, True)
ENDLESS = 1 << 40
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of an output batch.
OUT_ROWS = 500


def _inserting(costs: list[int], letters: list[str]) -> None:
    """Weighs, in place, what inserting a row first would cost; two inserted rows lead back, so two rounds do."""
    for _ in range(2):
        for state in range(4):
            other = INSERT + costs[AFTER[NEXT[state][0]]]
            if (other, "I") < (costs[state], letters[state]):
                costs[state], letters[state] = other, "I"


class Automaton:
    """Nodes by their number: (cost differences, letters); node 0 is the end of all conversations."""

    def __init__(self) -> None:
        costs, letters = [0 if end else ENDLESS for end in MAY_END], ["" if end else "~" for end in MAY_END]
        _inserting(costs, letters)
        self.nodes: list[tuple[tuple[int, ...], str]] = []
        self.numbers: dict[tuple[tuple[int, ...], str], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.end, self.end_cost = self._number(costs, letters)

    def _number(self, costs: list[int], letters: list[str]) -> tuple[int, int]:
        least = min(costs)
        node = tuple(c - least for c in costs), "".join(x or "." for x in letters)
        if node not in self.numbers:
            self.numbers[node] = len(self.nodes)
            self.nodes.append(node)
        return self.numbers[node], least

    def before(self, node: int, sign: str) -> tuple[int, int]:
        """The node of a row with this sign in front of what `node` stands for, and what it adds to the cost."""
        known = self.steps.get((node, sign))
        if known is None:
            rest, role, late = self.nodes[node][0], sign.lower(), TRUNCATED * sign.isupper()
            costs, letters = [DELETE + c for c in rest], ["D"] * 4
            for state in range(4):
                want = NEXT[state][0]
                ways = [] if sign == "x" else [(REROLE + late + rest[AFTER[want]], "R")]
                if role == want or role == "s" and state == 0:
                    ways.append((KEEP + late + rest[AFTER[role]], "K"))
                costs[state], letters[state] = min([(costs[state], letters[state]), *ways])
            _inserting(costs, letters)
            known = self.steps[node, sign] = self._number(costs, letters)
        return known


def audited(signatures: Iterator[str], automaton: Automaton | None = None) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit), for signatures sorted by their reversals."""
    automaton = automaton or Automaton()
    nodes, costs, last = array("L", [automaton.end]), array("q", [automaton.end_cost]), ""
    for signature in signatures:
        ending, shared = signature[::-1], 0
        while shared < min(len(ending), len(last)) and ending[shared] == last[shared]:
            shared += 1
        del nodes[shared + 1 :], costs[shared + 1 :]
        for sign in ending[shared:]:
            node, more = automaton.before(nodes[-1], sign)
            nodes.append(node)
            costs.append(costs[-1] + more)
        last = ending
        audit, state, at = bytearray(), 0, len(signature)
        while True:
            letter = automaton.nodes[nodes[at]][1][state]
            if letter == ".":
                break
            audit += letter.encode()
            if letter != "D":
                role = signature[len(signature) - at].lower() if letter == "K" else NEXT[state][0]
                state = AFTER[role]
            at -= letter != "I"
        yield signature, costs[-1] + automaton.nodes[nodes[-1]][0][0], audit.decode()


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton, out = Automaton(), []

    def batch_of() -> pa.RecordBatch:
        columns = zip(*out)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["signature", "cost", "audit"])

    for row in audited((s for batch in batches for s in batch.column("signature").to_pylist()), automaton):
        out.append(row)
        if len(out) == OUT_ROWS or len(row[0]) > 1 << 20:
            yield batch_of()
            out = []
    if out:
        yield batch_of()


PROFILE = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _profiles(kind: pa.DataType):
    """The signature and the counts of each conversation, of rows in order."""
    fields = pa.schema([("conv", kind), ("signature", pa.string()), *((name, pa.int64()) for name in PROFILE)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, begun = [], None, False

        def told() -> tuple:
            return now["conv"], now["signs"].decode(), now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0, *(now[name] for name in PROFILE[1:])

        for batch in batches:
            names = ("conv", "turn", "initial", "key", "blank", "late", "open")
            for conv, turn, initial, key, blank, late, cut in zip(*(batch.column(c).to_pylist() for c in names)):
                if not begun or conv != now["conv"]:
                    if begun:
                        out.append(told())
                    begun = True
                    now = {"conv": conv, "signs": bytearray(), "low": 0, "high": 0, "turns": 0, "turn": None, "key": None, "initial": None, "seen": None} | dict.fromkeys(PROFILE[1:], 0)
                if turn is not None and (not now["turns"] or turn != now["turn"]):
                    now["low"] = now["low"] if now["turns"] else turn
                    now["high"], now["turns"] = turn, now["turns"] + 1
                again = late or (key, turn) == (now["key"], now["turn"])
                fault = "blank" if blank else "duplicate" if again else "truncated" if cut else ""
                if fault:
                    now[fault] += 1
                if now["initial"] is not None and now["initial"] + initial not in ("su", "ua", "au"):
                    now["illegal"] += 1
                role = initial if initial in AFTER else "o"
                now["signs"] += b"x" if fault in ("blank", "duplicate") else (role.upper() if fault else role).encode()
                now["turn"], now["key"], now["initial"] = turn, key, initial
            if len(out) >= OUT_ROWS:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)
                out = []
        if begun:
            out.append(told())
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return of


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, key, late): key tells role and text within the conversation, late rows have them in an earlier turn."""

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    owner = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-"))
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws(":", owner, F.length("role"), "role", "text"))))
    spread = rows.groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")).where("first < last").select("key", "first")
    return rows.join(spread, "key", "left").withColumn("late", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))).drop("first")


def _of(df: DataFrame, name: str) -> tuple[str, pa.DataType]:
    """Type of a column for Spark, and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[name].dataType
    return kind.simpleString(), to_arrow_type(kind)


def diagnose(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Audits (conv, signature, cost, audit, gaps, blank, duplicate, truncated, illegal) of all conversations, and their rows; both written."""
    small_batches(conversations.sparkSession)
    rows = written(_rows(conversations, conv, turn, role, text))
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    marked = rows.select("conv", "turn", "role", "text", "key", "late", F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    ordered = marked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "turn", "initial", "key", "blank", "late", "open")
    spark_type, arrow_type = _of(rows, "conv")
    profiles = written(ordered.mapInArrow(_profiles(arrow_type), f"conv {spark_type}, signature string, " + ", ".join(f"{p} long" for p in PROFILE)))
    signatures = profiles.select("signature").distinct().orderBy(F.reverse("signature"))
    audits = signatures.mapInArrow(_audits, "signature string, cost long, audit string")
    return written(profiles.join(audits, "signature").select("conv", "signature", "cost", "audit", *PROFILE)), rows


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("begin", conv) for each conversation, then ("row", position, turn, edit, role, text) for each row that it has after the edits; `conv` heads carry the audit."""
    audit, at, state, place = "", 0, 0, 0
    for batch in batches:
        for conv, head, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "head", "turn", "role", "text"))):
            if head is not None:
                for _ in audit[at:]:
                    place, state, said = place + 1, AFTER[NEXT[state][0]], NEXT[state]
                    yield "row", place, None, "I", said, ""
                audit, at, state, place = head, 0, 0, 0
                yield "begin", conv
                continue
            while audit[at] == "I":
                place, at, state, said = place + 1, at + 1, AFTER[NEXT[state][0]], NEXT[state]
                yield "row", place, None, "I", said, ""
            letter, at = audit[at], at + 1
            if letter != "D":
                said = role if letter == "K" else NEXT[state]
                place, state = place + 1, AFTER[said[0]]
                yield "row", place, turn, letter, said, text
    for _ in audit[at:]:
        place, state, said = place + 1, AFTER[NEXT[state][0]], NEXT[state]
        yield "row", place, None, "I", said, ""


def _repaired(kind: pa.DataType):
    fields = pa.schema([("conv", kind), ("position", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, size = [], None, 0
        for what, *x in _edited(batches):
            if what == "begin":
                conv = x[0]
                continue
            out.append((conv, *x))
            size += len(x[-1])
            if len(out) >= OUT_ROWS or size > 1 << 20:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)
                out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return of


def _digested(kind: pa.DataType):
    fields = pa.schema([("conv", kind), ("repaired_sha256", pa.string())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, digest = [], None, None
        for what, *x in _edited(batches):
            if what == "begin":
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = x[0], hashlib.sha256()
                if len(out) >= OUT_ROWS:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)
                    out = []
            else:
                digest.update(f"{chr(10) if x[0] > 1 else ''}{x[3]}:{x[4]}".encode())
        if digest is not None:
            out.append((conv, digest.hexdigest()))
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return of


def _headed(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order, in one partition."""
    heads = audits.select("conv", F.lit(0).alias("kind"), F.col("audit").alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = heads.unionByName(rows.select("conv", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("head"), "turn", "role", "text"))
    return both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "text").drop("kind")


def repaired(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, position, turn, edit, role, text): the conversations after the edits; inserted rows have no turn."""
    spark_type, arrow_type = _of(rows, "conv")
    return _headed(audits, rows).mapInArrow(_repaired(arrow_type), f"conv {spark_type}, position long, turn long, edit string, role string, text string")


def digests(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of each conversation after the edits, `role:text` joined by line breaks."""
    spark_type, arrow_type = _of(rows, "conv")
    return _headed(audits, rows).mapInArrow(_digested(arrow_type), f"conv {spark_type}, repaired_sha256 string")

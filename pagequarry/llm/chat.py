"""Chat formatting as a prefix tree.

Conversations that share initial turns are merged: a node is a turn after exactly the turns before it. Different
conversations are put in the order of their paths, which is depth-first, and each writes only the nodes that no earlier
one has written: its branch. A branch has a place in its tree's sequence (start, end), the position id of its first token (what
stands before it on its path; ids go on by one), the intervals of the sequence that its tokens may attend to besides
their own branch (its ancestors), and the spans under the loss (the assistant's texts). Tokens are code points here.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`; in roles and texts a backslash is doubled, `<|` becomes `<\\|`, and in roles a
line break becomes `\\n`, so no text can close or open a turn and all of it reads back.

Defined results: null roles and texts are empty; rows of a conversation are ordered by turn (nulls first), then role and text, and
repeated rows are turns of their own; a null conversation id is one conversation; an empty table gives no rows.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import arrow, checkpointed

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def formatted(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turns): each conversation's turns in order, formatted."""
    name = F.replace(escaped(F.coalesce(F.col(role).cast("string"), F.lit(""))), F.lit("\n"), F.lit("\\n"))
    said = escaped(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("said"), F.concat(F.lit(START), name, F.lit("\n"), said, F.lit(END)).alias("turn_text"))
    listed = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "said", "turn_text"))).alias("turns"))
    return listed.select("conv", F.col("turns.turn_text").alias("turns"))


@arrow("array<struct<a:bigint,b:bigint>>")
def _prefix_keys(turns: pa.Array) -> pa.Array:
    """For each turn a 128-bit name of the turns up to it."""
    offsets = turns.offsets.to_numpy() - turns.offsets[0].as_py()
    keys = np.zeros((int(offsets[-1]), 2), np.int64)
    words = turns.flatten().to_pylist()
    for a, b in zip(offsets[:-1], offsets[1:]):
        state = b""
        for k in range(a, b):
            state = hashlib.blake2b(state + words[k].encode(), digest_size=16).digest()
            keys[k] = np.frombuffer(state, np.int64)
    values = pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["a", "b"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def build(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Branches (tree, branch, start, end, position, ancestors, text, loss) and members (conv, branch).

    tree and branch are numbers in depth-first order; ancestors are spans of the tree's sequence; loss are spans of the branch.
    """
    listed = formatted(conversations, conv, turn, role, text).withColumn("keys", _prefix_keys("turns"))
    listed = checkpointed(listed.withColumn("path", F.element_at("keys", -1)))
    paths = listed.groupBy("path").agg(F.first(F.struct("keys", "turns")).alias("x")).select("path", "x.keys", "x.turns")
    paths = checkpointed(paths.orderBy("keys").withColumn("branch", F.monotonically_increasing_id()))

    nodes = paths.select("branch", F.posexplode(F.zip_with("keys", "turns", lambda k, t: F.struct(k.alias("key"), F.length(t).alias("size")))).alias("depth", "n"))
    nodes = nodes.select("branch", "depth", "n.key", "n.size")
    owners = nodes.groupBy("key").agg(F.min("branch").alias("owner"))
    parts = nodes.join(owners, "key").groupBy("branch", "owner").agg(F.min("depth").alias("depth"), F.sum("size").alias("size"))
    parts = checkpointed(parts)

    own = parts.where("branch = owner").select("branch", "depth", "size")
    above = parts.groupBy("branch").agg(F.min("owner").alias("tree"), F.sum(F.when(F.col("owner") != F.col("branch"), F.col("size")).otherwise(0)).alias("position"))
    placed = own.join(above, "branch").withColumn("stretch", F.shiftright("branch", 33))
    order = Window.partitionBy("tree", "stretch").orderBy("branch").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    stretches = placed.groupBy("tree", "stretch").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("tree").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("tree", "stretch", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    placed = inside.join(stretches, ["tree", "stretch"]).withColumn("start", F.col("before") + F.col("inside"))
    placed = checkpointed(placed.select("tree", "branch", "depth", "start", (F.col("start") + F.col("size")).alias("end"), "position"))

    spans = parts.where("branch != owner").join(placed.select(F.col("branch").alias("owner"), "start"), "owner")
    spans = spans.groupBy("branch").agg(F.sort_array(F.collect_list(F.struct("depth", "start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    spans = spans.select("branch", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("ancestors"))
    texts = paths.join(placed, "branch").join(spans, "branch", "left")
    branches = texts.select(
        "tree", "branch", "start", "end", "position",
        F.coalesce("ancestors", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("ancestors"),
        _write(F.slice("turns", F.col("depth") + 1, F.size("turns"))).alias("x"),
    ).select("tree", "branch", "start", "end", "position", "ancestors", "x.text", "x.loss")
    return branches, listed.join(paths.select("path", "branch"), "path").select("conv", "branch")


@arrow("struct<text:string,loss:array<struct<start:bigint,end:bigint>>>")
def _write(turns: pa.Array) -> pa.Array:
    """The branch's text, and the spans of the texts that a model learns to say."""
    opening = f"{START}{LOSS_ROLE}\n"
    out = []
    for own in turns.to_pylist():
        at, loss = 0, []
        for t in own:
            if t.startswith(opening):
                loss.append({"start": at + len(opening), "end": at + len(t) - len(END)})
            at += len(t)
        out.append({"text": "".join(own), "loss": loss})
    return pa.array(out, pa.struct([("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))


READ = "struct<n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint>"


@arrow(READ)
def _digest(pieces: pa.Array) -> pa.Array:
    """What the pieces of a path, in order, say when read back."""
    out = []
    for path in pieces.to_pylist():
        whole = "".join(p["text"] for p in path)
        turns = [(unescaped(r), unescaped(t)) for r, t in TURN.findall(whole)]
        loss = "".join(unescaped(p["text"][s["start"] : s["end"]]) for p in path for s in p["loss"] if s["end"] <= len(p["text"]))
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(5)], names=names)


def read_back(branches: DataFrame, members: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the written branches alone: ancestors are read through their spans."""
    asked = branches.select("tree", "branch", F.posexplode("ancestors").alias("k", "span"))
    asked = asked.select("tree", "branch", "k", F.col("span.start").alias("start"), (F.col("span.end") - F.col("span.start")).cast("int").alias("size"))
    shared = asked.join(branches.select("tree", "start", "text", "loss"), ["tree", "start"]).select("branch", "k", F.substr("text", F.lit(1), F.col("size")).alias("text"), "loss")
    pieces = shared.unionByName(branches.select("branch", F.size("ancestors").alias("k"), "text", "loss"))
    pieces = pieces.groupBy("branch").agg(F.sort_array(F.collect_list(F.struct("k", "text", "loss"))).alias("pieces"))
    digests = pieces.select("branch", _digest("pieces").alias("x")).select("branch", "x.*")
    return members.join(digests, "branch").drop("branch")

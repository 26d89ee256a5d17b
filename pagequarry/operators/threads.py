"""Trees of comments: rows (root_id, id, parent_id, pos, author, score, text); parent_id is null at the top."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.session import checkpointed


def alive() -> Column:
    return F.col("author").isNotNull() & F.col("text").isNotNull()


def walked(tree: DataFrame, keep_dead: bool, depth: int | None = None) -> DataFrame:
    """tree with depth, order (positions from the root) and up (ids of its ancestors), level by level, each level one equi-join.

    Stops at `depth` levels or where no rows are left. Without keep_dead, dead nodes go with all below them.
    """
    nodes = tree if keep_dead else tree.where(alive())
    step = lambda d, order, up: [*(F.col(f"n.{c}") for c in tree.columns), F.lit(d).alias("depth"), order.alias("order"), up.alias("up")]
    here = F.struct(F.col("n.pos").alias("pos"), F.col("n.id").alias("id"))
    level = checkpointed(nodes.alias("n").where("n.parent_id IS NULL").select(*step(0, F.array(here), F.expr("cast(array() as array<bigint>)"))))
    levels, d = [level], 0
    while (depth is None or d + 1 < depth) and not level.isEmpty():
        d += 1
        up = level.select(F.col("root_id").alias("r"), F.col("id").alias("p"), F.col("order").alias("o"), F.col("up").alias("u"))
        joined = nodes.alias("n").join(up, (F.col("n.root_id") == F.col("r")) & (F.col("n.parent_id") == F.col("p")))
        level = checkpointed(joined.select(*step(d, F.concat("o", F.array(here)), F.concat("u", F.array("p")))))
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def count_comments(tree: DataFrame) -> DataFrame:
    """(root_id, comments): nodes that are alive and below none that is dead."""
    return walked(tree, False).groupBy("root_id").agg(F.count("*").alias("comments"))


def prune_deleted(tree: DataFrame) -> DataFrame:
    """(root_id, id, parent_id, depth, placeholder): nodes that are alive, and dead ones above one that is."""
    nodes = walked(tree, True)
    needed = nodes.where(alive()).select("root_id", F.explode("up").alias("id")).distinct().withColumn("needed", F.lit(True))
    joined = nodes.join(needed, ["root_id", "id"], "left")
    return joined.where(alive() | F.col("needed")).select("root_id", "id", "parent_id", "depth", (~alive()).alias("placeholder"))


def render_thread(tree: DataFrame, depth: int = 3, limit: int | None = None) -> DataFrame:
    """(root_id, markdown): comments depth-first under a heading with how many are shown of all; `limit` top-level ones, `depth` levels."""
    total = count_comments(tree)
    shown = walked(tree, False, depth)
    if limit is not None:
        tops = shown.where("depth = 0").withColumn("k", F.row_number().over(W.partitionBy("root_id").orderBy("order"))).where(F.col("k") <= limit)
        shown = shown.join(tops.select("root_id", F.col("id").alias("top")), "root_id").where(F.get("order", F.lit(0))["id"] == F.col("top"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- **"), F.col("author"), F.lit("** ("), F.col("score").cast("string"), F.lit("): "), F.regexp_replace("text", r"\s+", " "))
    listed = shown.groupBy("root_id").agg(F.sort_array(F.collect_list(F.struct("order", line.alias("line")))).alias("x"), F.count("*").alias("shown"))
    heading = F.concat(F.lit("## Comments ("), F.col("shown").cast("string"), F.lit(" of "), F.col("comments").cast("string"), F.lit(")\n\n"))
    return listed.join(total, "root_id").select("root_id", F.concat(heading, F.array_join("x.line", "\n")).alias("markdown"))


def render_listing(df: DataFrame, by: list[str], order_by: list[Column], k: int, line: Column) -> DataFrame:
    """(by, markdown): the first k rows of each group as numbered lines."""
    ranked = df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order_by))).where(F.col("__k") <= k)
    listed = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__k", line.alias("line")))).alias("x"))
    return listed.select(*by, F.array_join(F.transform("x", lambda r: F.concat(r["__k"].cast("string"), F.lit(". "), r["line"])), "\n").alias("markdown"))

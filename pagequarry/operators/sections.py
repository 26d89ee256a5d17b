"""Sections of documents, and search within and across them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.session import checkpointed

ELISION = "[…]"


def section_tree(blocks: DataFrame) -> DataFrame:
    """(id, idx, section, level, heading, parent, type, text): each block with its section. Section 0 is the root; a section's parent is the nearest earlier heading of a smaller level.

    One window by document: a running count of headings, and for each level the last heading of it; what is open
    at a heading are those later than any heading of a smaller level.
    """
    order = W.partitionBy("id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    is_heading = F.col("type") == "heading"
    counted = blocks.withColumn("section", F.sum(is_heading.cast("long")).over(order))
    for k in range(1, 7):
        counted = counted.withColumn(f"l{k}", F.last(F.when(is_heading & (F.col("level") == k), F.col("section")), True).over(order))
    own = F.max(F.when(is_heading, F.col("level"))).over(W.partitionBy("id", "section"))
    counted = counted.withColumn("own", F.coalesce(own, F.lit(0)))
    below = [F.when(F.col("own") > k, F.col(f"l{k}")) for k in range(1, 7)]
    parent = F.when(F.col("section") > 0, F.coalesce(F.greatest(*below), F.lit(0)))
    heading = F.first(F.when(is_heading, F.trim(F.regexp_replace("text", r"^ {0,3}#{1,6}[ \t]*|[ \t]+#+[ \t]*$", ""))), True).over(W.partitionBy("id", "section"))
    return counted.select("id", "idx", "section", F.col("own").alias("level"), heading.alias("heading"), parent.alias("parent"), "type", "text")


def sections(tree: DataFrame) -> DataFrame:
    """(id, section, level, heading, parent, text, n_blocks): one row for each section; text is its heading line and blocks."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n")
    keys = ["id", "section", "level", "heading", "parent"]
    return tree.groupBy(*keys).agg(body.alias("text"), F.count("*").alias("n_blocks"))


def section_path(listed: DataFrame) -> DataFrame:
    """listed (id, section, level, heading, parent) with path: the headings of its ancestors, outermost first, joined by ` > `."""
    order = W.partitionBy("id").orderBy("section").rowsBetween(W.unboundedPreceding, -1)
    marked = listed
    for k in range(1, 7):
        marked = marked.withColumn(f"a{k}", F.last(F.when(F.col("level") == k, F.struct("section", "heading")), True).over(order))
    open_ = []
    for k in range(1, 7):
        hidden = F.coalesce(F.greatest(*(F.coalesce(F.col(f"a{j}.section"), F.lit(-1)) for j in range(1, k)), F.lit(-1)), F.lit(-1)) if k > 1 else F.lit(-1)
        open_.append(F.when((F.col("level") > k) & (F.col(f"a{k}.section") > hidden), F.col(f"a{k}.heading")))
    return marked.select(*listed.columns, F.concat_ws(" > ", *open_).alias("path"))


def subtree_blocks(listed: DataFrame) -> DataFrame:
    """(id, section, member): every section with all sections of its subtree, itself included: those up to the next heading of its level or a smaller one.

    The range join is by document.
    """
    later = W.partitionBy("id").orderBy("section").rowsBetween(1, W.unboundedFollowing)
    ends = listed
    for k in range(1, 7):
        ends = ends.withColumn(f"e{k}", F.min(F.when((F.col("level") <= k) & (F.col("level") > 0), F.col("section"))).over(later))
    end = F.when(F.col("level") == 0, F.lit(None).cast("long"))
    for k in range(1, 7):
        end = end.when(F.col("level") == k, F.col(f"e{k}"))
    ranges = ends.select("id", "section", F.coalesce(end, F.lit(1 << 40)).alias("stop"))
    members = listed.select("id", F.col("section").alias("member"))
    return ranges.join(members, "id").where("member >= section AND member < stop").select("id", "section", "member")


def _weights(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.sum("w").alias("score"))


def bm25_term(tf: Column, df: Column, n: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


#: Bytes of a side that is sent to every executor; beyond them the join shuffles.
SENT_BYTES = 1 << 25


def _sent(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its values are small enough in all."""
    size = df.select(F.sum(F.octet_length(F.concat_ws(",", *(F.col(c).cast("string") for c in df.columns))) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= SENT_BYTES else df


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, term): different terms of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("query")))).alias("term"))


def bm25_sections(listed: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, section, query_id, score): sections scored against the sections of their own document, for every query; a root without blocks is no section.

    Only the queries' terms are kept before anything is grouped; document lengths need no explode.
    """
    asked = _asked(queries)
    terms = _sent(asked.select("term").distinct())
    sized = listed.select("id", "section", T.tokenize(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens"))
    of_doc = W.partitionBy("id")
    sized = sized.withColumn("n", F.count("*").over(of_doc)).withColumn("average", F.avg("length").over(of_doc))
    tf = sized.select("id", "section", "length", "n", "average", F.explode("tokens").alias("term")).join(terms, "term", "left_semi").groupBy("id", "section", "length", "n", "average", "term").agg(F.count("*").alias("tf"))
    tf = tf.withColumn("df", F.count("*").over(W.partitionBy("id", "term")))
    scored = tf.withColumn("w", bm25_term(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("average"), k1, b))
    return _weights(scored.join(_sent(asked), "term"), ["id", "section", "query_id"])


def impacts(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, k1: float, b: float) -> DataFrame:
    """(term, id, w): what each term of the queries adds to the score of each document that holds it: an index that all queries share."""
    terms = _sent(asked.select("term").distinct())
    sized = docs.select(F.col(id_col).alias("id"), T.tokenize(F.col(text_col)).alias("tokens"))
    held = sized.select("id", F.size("tokens").alias("length"), F.explode_outer("tokens").alias("term"))
    # documents without a term stay as a row of their own, for the average; a document's rows lie together, so it shuffles no more than its different terms
    tf = held.join(terms.withColumn("asked", F.lit(True)), "term", "left").groupBy("id", "length", F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.count("*").alias("tf"))
    tf = checkpointed(tf)
    totals = tf.groupBy("id").agg(F.first("length").alias("length")).agg(F.count("*").alias("n"), F.avg(F.greatest("length", F.lit(0))).alias("average"))
    tf = tf.where("term is not null")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").join(F.broadcast(totals), F.lit(True))
    return scored.select("term", "id", bm25_term(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("average"), k1, b).alias("w"))


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, rank, id, score): the k best documents for each query over the whole table; ties to the smaller id.

    The index is dealt out by document, and each document's scores for all queries are added up where it lies: what shuffles is the index, which has a row
    for each different term of a document however many queries ask for it, and each part's best k for a query, never a row for each document and query.
    """
    asked = _asked(queries)
    index = impacts(docs, asked, id_col, text_col, k1, b).repartition("id")
    scored = _weights(index.join(_sent(asked), "term"), ["id", "query_id"])
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def query_coverage(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, query_id, coverage): the share of each query's different terms that each document holds, 0 for a query without terms; ids are unique.

    Documents meet queries by the terms they share; only ids are paired to give the zeros their rows.
    """
    asked = _asked(queries)
    held = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(T.tokenize(F.col(text_col)))).alias("term"))
    hits = held.join(_sent(asked), "term").groupBy("id", "query_id").agg(F.count("*").alias("hits"))
    sizes = queries.select("query_id", F.size(F.array_distinct(T.tokenize(F.col("query")))).alias("size"))
    every = docs.select(F.col(id_col).alias("id")).join(_sent(sizes), F.lit(True)).join(hits, ["id", "query_id"], "left")
    return every.select("id", "query_id", F.when(F.col("hits").isNull(), 0.0).otherwise(F.col("hits") / F.col("size")).alias("coverage"))


def assemble_regions(selected: DataFrame, keys: list[str], marker: str = ELISION) -> DataFrame:
    """(keys, regions, markdown): selected blocks (idx, text); neighbours are joined by a blank line, regions by the marker."""
    order = W.partitionBy(*keys).orderBy("idx")
    islands = selected.withColumn("island", F.col("idx") - F.row_number().over(order))
    joined = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["text"])
    regions = islands.groupBy(*keys, "island").agg(F.array_join(joined(F.struct("idx", "text")), "\n\n").alias("text"))
    return regions.groupBy(*keys).agg(F.count("*").alias("regions"), F.array_join(joined(F.struct("island", "text")), f"\n\n{marker}\n\n").alias("markdown"))

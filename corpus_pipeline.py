"""The corpus pipeline: five stages over `documents`, each of which reads what the one before has written.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs, whatever
their names. An empty table stays empty. A null or empty text goes in the first stage.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import contamination, language, lines, packing, simhash
from pagequarry.llm.common import table
from pagequarry.session import shared_folder


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: texts without a letter, and null texts, go."""
    found = language.predictor(spark, language.train(language.training_rows(docs)))(F.col("text"))
    return docs.where(found["lang"] != language.UNDETERMINED)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occur earlier are deleted from the texts; a document of which nothing is left goes. n_chars follows the text."""
    found = lines.dedup(docs)
    kept = found.where((F.size("clean.runs") == 0) | (F.trim("clean.text") != ""))
    changed = {"text": F.col("clean.text"), "n_chars": F.when(F.size("clean.runs") == 0, F.col("row.n_chars")).otherwise(F.length("clean.text").cast("long"))}
    return kept.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id, of several rows with this id that with the smallest text hash, once."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    kept = simhash.near_duplicates(docs).groupBy("root").agg(first.alias("one"))
    kept = kept.select(F.xxhash64("one.id", "one.text_hash").alias("key"), F.col("one.text_hash").alias("hash"))
    keyed = docs.select(F.xxhash64(F.col("text").cast("string")).alias("hash"), F.struct("*").alias("row")).withColumn("key", F.xxhash64(F.col("row.doc_id"), F.col("hash")))
    return keyed.join(kept, ["key", "hash"], "left_semi").dropDuplicates(["key", "hash"]).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("language", keep_identified),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("contamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: winnowed passages, SimHash components and token ids have no SQL form. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between two stages the rows are written to the shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Statistics of the extraction log and of the store."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions.text import half_up


def recent(log: DataFrame, as_of: Column, window: str) -> DataFrame:
    return log.where(F.col("created_at") > as_of - F.expr(f"INTERVAL {window}"))


def unless_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def stats_by_source(log: DataFrame, as_of: Column, window: str) -> DataFrame:
    """(source, count, pct, avg_quality, avg_len, avg_ms): averages of zero are null."""
    grouped = recent(log, as_of, window).groupBy("source").agg(F.count("*").alias("count"), F.avg("quality").alias("q"), F.avg("markdown_len").alias("l"), F.avg("duration_ms").alias("d"))
    total = F.sum("count").over(W.partitionBy())
    return grouped.select("source", "count", half_up(F.col("count") / total * 100, 1).alias("pct"), unless_zero(half_up(F.col("q"), 2)).alias("avg_quality"), unless_zero(half_up(F.col("l"), 0)).alias("avg_len"), unless_zero(half_up(F.col("d"), 0)).alias("avg_ms"))


def top_domains(rows: DataFrame, k: int) -> DataFrame:
    grouped = rows.groupBy("domain").agg(F.count("*").alias("count"), F.avg("quality").alias("q"))
    return grouped.orderBy(F.desc("count"), F.asc_nulls_first("domain")).limit(k).select("domain", "count", half_up(F.col("q"), 2).alias("avg_quality"))


def low_quality_domains(log: DataFrame, as_of: Column, window: str, k: int = 20) -> DataFrame:
    return top_domains(recent(log, as_of, window).where((F.col("quality") < 0.4) & ~F.col("cached")), k)


def fallback_domains(log: DataFrame, as_of: Column, window: str, k: int = 20) -> DataFrame:
    """Domains whose pages fell back, by source or reason, in any letter case."""
    return top_domains(recent(log, as_of, window).where(F.col("source").ilike("%fallback%") | F.col("extractor_reason").ilike("%fell back%")), k).drop("avg_quality")


def storage_stats(conversions: DataFrame, log: DataFrame, as_of: Column, retention_days: int) -> DataFrame:
    """One row: rows, those that expire soon, the oldest, and requests and cache hits of seven days."""
    soon = as_of - F.expr(f"INTERVAL {max(retention_days - 10, 0)} DAYS")
    rows = conversions.agg(F.count("*").alias("total"), F.count_if(F.col("created_at") <= soon).alias("expiring"), F.min("created_at").alias("oldest"))
    week = recent(log, as_of, "7 DAYS").agg(F.count("*").alias("requests"), F.count_if("cached").alias("hits"))
    return rows.join(F.broadcast(week), F.lit(True))


def stats_rollup(log: DataFrame, as_of: Column, window: str) -> DataFrame:
    """The total (source null, is_total) and each source in one pass."""
    return recent(log, as_of, window).rollup("source").agg((F.grouping_id() == 1).alias("is_total"), F.count("*").alias("count"), half_up(F.avg("quality"), 2).alias("avg_quality"))


def usage_totals(df: DataFrame) -> DataFrame:
    fields = ("prompt_tokens", "completion_tokens", "total_tokens")
    return df.groupBy("model").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in fields))


def distinct_blocks(df: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """(group, blocks, distinct_blocks, duplicates, last_order): blocks of a group by their text with white space collapsed; texts are compared by hash and length."""
    norm = F.trim(F.regexp_replace(text, r"\s+", " "))
    hashed = df.select(group, F.col(order).alias("o"), F.sha2(norm, 256).alias("h"), F.length(norm).alias("n"))
    each = hashed.groupBy(group, "h", "n").agg(F.count("*").alias("c"), F.max("o").alias("last"))
    return each.groupBy(group).agg(F.sum("c").alias("blocks"), F.count("*").alias("distinct_blocks"), (F.sum("c") - F.count("*")).alias("duplicates"), F.max("last").alias("last_order"))


def token_savings(df: DataFrame, by: str) -> DataFrame:
    """(by, pages, original, returned, ratio) of columns original_tokens and returned_tokens."""
    return df.groupBy(by).agg(F.count("*").alias("pages"), F.sum("original_tokens").alias("original"), F.sum("returned_tokens").alias("returned"), (F.sum("returned_tokens") / F.sum("original_tokens")).alias("ratio"))

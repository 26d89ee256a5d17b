"""Work on rows in time order: paragraphs by gaps, chunks by an anchor, sliding-window limits."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_paragraphs(df: DataFrame, key: str, start: str, stop: str, line: str, gap: float, tie: str) -> DataFrame:
    """(key, paragraph, start, stop, text): lines in time order; a line equal to the one before is dropped, a new paragraph begins where a line starts `gap` or more after all ends so far. Empty paragraphs vanish."""
    order = W.partitionBy(key).orderBy(start, tie)
    ends = F.max(stop).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.coalesce((F.col(start) - ends >= gap).cast("int"), F.lit(0))).withColumn("__again", F.lag(line).over(order).eqNullSafe(F.col(line)))
    marked = marked.withColumn("__p", F.sum("__new").over(order))
    kept = marked.where(~F.col("__again"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(tie).alias("t"), F.col(line).alias("line")))), lambda x: x["line"]), " ")
    return kept.groupBy(key, F.col("__p").alias("paragraph")).agg(F.min(start).alias("start"), F.max(stop).alias("stop"), text.alias("text"))


def timecode(seconds: Column) -> Column:
    """h:mm:ss, or mm:ss below an hour."""
    whole = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes = F.floor(whole / 60)
    return F.when(whole >= 3600, F.concat_ws(":", F.floor(whole / 3600).cast("string"), two(minutes % 60), two(whole % 60))).otherwise(F.concat_ws(":", two(minutes), two(whole % 60)))


def transcript_blocks(df: DataFrame, key: str, start: str, text: str, chunk: float, tie: str | None = None) -> DataFrame:
    """(key, block, at, text): snippets in time order; a block ends before the first snippet that starts `chunk` or more after the block's first one. chunk 0 or less: each snippet is a block.

    Where a block ends depends on where the one before did, so a key's snippets pass one task in order; it holds an Arrow batch and
    the open block, however many snippets a key has. Rows without a start are left out; a null text is an empty one. Runs of white
    space are one space; blocks without any text vanish and have no number.
    """
    kinds = dict(df.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, number, anchor, texts = None, 0, 0.0, []

        def close(done: list) -> None:
            nonlocal number, texts
            joined = " ".join(" ".join(texts).split())
            if joined:
                done.append((last[0], number, anchor, joined))
                number += 1
            texts = []

        def frame(done: list) -> pd.DataFrame:
            out = pd.DataFrame(done, columns=[key, "block", "at", "text"])
            return out.astype({key: kept.dtype}) if kept is not None else out

        kept = None
        for batch in batches:
            kept, done = batch[key], []
            for k, at, words in zip(batch[key], batch["at"], batch["text"]):
                same = last is not None and (k == last[0] or pd.isna(k) and pd.isna(last[0]))
                if not same or at - anchor >= chunk or chunk <= 0:
                    if last is not None:
                        close(done)
                    number, anchor = number if same else 0, at
                last = (k,)
                texts.append(words)
            yield frame(done)
        if last is not None:
            done = []
            close(done)
            yield frame(done)

    ready = df.select(F.col(key), F.col(start).cast("double").alias("at"), F.col(tie or start).alias("__tie"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("at").isNotNull())
    ordered = ready.repartition(key).sortWithinPartitions(key, "at", "__tie", "text").select(key, "at", "text")
    return ordered.mapInPandas(fold, f"{key} {kinds[key]}, block long, at double, text string")


def chunk_transcript(df: DataFrame, key: str, start: str, text: str, chunk: float, style: str = "plain", tie: str | None = None, link: str = "https://www.youtube.com/watch?v={key}&t={at}s") -> DataFrame:
    """(key, chunks, markdown): a transcript's blocks as paragraphs. style: plain times, links to the second, or none. A key without text has no row.

    The Markdown of a key is one value; transcript_blocks() gives the blocks as rows where a transcript is too long for that.
    """
    if style not in ("plain", "links", "none"):
        raise ValueError(f"unknown style: {style}")
    blocks = transcript_blocks(df, key, start, text, chunk, tie)
    to = F.replace(F.replace(F.lit(link), F.lit("{key}"), F.col(key).cast("string")), F.lit("{at}"), F.floor("at").cast("string"))
    mark = {"none": F.lit(""), "plain": F.concat(F.lit("["), timecode(F.col("at")), F.lit("] ")), "links": F.concat(F.lit("["), timecode(F.col("at")), F.lit("]("), F.coalesce(to, F.lit("")), F.lit(") "))}[style]
    listed = F.sort_array(F.collect_list(F.struct("block", F.concat(mark, "text").alias("line"))))
    return blocks.groupBy(key).agg(F.count("*").cast("int").alias("chunks"), F.array_join(F.transform(listed, lambda b: b["line"]), "\n\n").alias("markdown"))


def verdicts(times: list[float], window: float, most: int, live: list[float]) -> tuple[list[bool], list[float], list[float]]:
    """For each time whether it is accepted, the seconds to wait if not, and the accepted times that still count."""
    allowed, wait = [], []
    for t in times:
        live = [x for x in live if x >= t - window]
        if len(live) < most:
            live.append(t)
            allowed.append(True)
            wait.append(0.0)
        else:
            allowed.append(False)
            wait.append(max(0.0, live[0] + window - t))
    return allowed, wait, live


def rate_limit(df: DataFrame, key: str, ts: str, window: float, most: int, tie: str) -> DataFrame:
    """(key, tie, ts, allowed, retry_after): an event is accepted if fewer than `most` accepted ones lie in the last `window` seconds; rejected ones don't count.

    A verdict depends on earlier ones, so a key's events pass one task in order; it holds a batch and the accepted times that still count, however many events a key has.
    """
    kinds = dict(df.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, live = None, []
        for batch in batches:
            parts = []
            for k, rows in batch.groupby(key, sort=False, dropna=False):
                live = live if last is not None and (k == last[0] or pd.isna(k) and pd.isna(last[0])) else []
                last = (k,)
                allowed, wait, live = verdicts(rows["at"].tolist(), window, most, live)
                parts.append(rows.assign(allowed=allowed, retry_after=wait))
            yield pd.concat(parts)[[key, tie, "at", "allowed", "retry_after"]] if parts else batch.assign(allowed=False, retry_after=0.0)

    timed = df.select(key, tie, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))
    return timed.repartition(key).sortWithinPartitions(key, "at", tie).mapInPandas(fold, f"{key} {kinds[key]}, {tie} {kinds[tie]}, at double, allowed boolean, retry_after double")


def rate_bound(df: DataFrame, key: str, ts: str, window: int, tie: str) -> DataFrame:
    """(key, tie, in_window): how many events lie in the last `window` seconds, accepted or not: a bound on the limiter's count."""
    timed = df.select(key, tie, (F.unix_micros(F.col(ts).cast("timestamp"))).alias("at"))
    over = W.partitionBy(key).orderBy("at").rangeBetween(-window * 1_000_000, 0)
    return timed.select(key, tie, F.count("*").over(over).alias("in_window"))

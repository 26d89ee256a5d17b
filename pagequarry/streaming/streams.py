"""The time-based operators as Structured Streaming: each takes a streaming DataFrame."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagequarry.operators import pages, timed


def stream_stats(log: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, source, count, avg_quality) of tumbling or sliding windows; rows later than the watermark are dropped."""
    when = F.window("created_at", window, slide or window)
    grouped = log.withWatermark("created_at", late).groupBy(when.alias("w"), "source").agg(F.count("*").alias("count"), F.avg("quality").alias("avg_quality"))
    return grouped.select(F.col("w.start").alias("window_start"), "source", "count", "avg_quality")


def stream_sessions(df: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, stop, events): sessions that a pause of `gap` ends."""
    grouped = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def stream_rate_limit(df: DataFrame, key: str, ts: str, window: float, most: int, tie: str) -> DataFrame:
    """(key, tie, at, allowed, retry_after) with the accepted times of each key as state: `most` numbers at most, dropped once they are past the window in event time."""
    kinds = dict(df.dtypes)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", tie])
        live = list(state.get[0]) if state.exists else []
        allowed, wait, live = timed.verdicts(rows["at"].tolist(), window, most, live)
        state.update((live,))
        if live and (live[-1] + window) * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int((live[-1] + window) * 1000) + 1)
        yield rows.assign(allowed=allowed, retry_after=wait)[[key, tie, "at", "allowed", "retry_after"]]

    ready = df.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", f"{int(window)} seconds").select(key, tie, "__ts", (F.unix_micros("__ts") / 1e6).alias("at"))
    out = f"{key} {kinds[key]}, {tie} {kinds[tie]}, at double, allowed boolean, retry_after double"
    return ready.groupBy(key).applyInPandasWithState(fold, out, "live array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_convert(raw: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """convert_pages of each url's first page within the watermark."""
    return pages.convert_pages(raw.withWatermark(ts, late).dropDuplicatesWithinWatermark(["url"]))


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for what is there now, as a table written in the checkpoint folder."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{checkpoint}/{name}/rows").option("checkpointLocation", f"{checkpoint}/{name}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{checkpoint}/{name}/rows")

"""Streaming upserts as a log: a micro-batch appends a run of its own, runs are merged by size, readers fold what is there."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import store


@dataclass(frozen=True)
class Fold:
    """One row per key: the latest values by `order`, of the columns `first` the first value that is not null."""

    key: tuple[str, ...]
    order: str
    first: tuple[str, ...] = ()

    def state(self, events: DataFrame) -> DataFrame:
        """Key, order, latest as a struct and first values with their place in the order."""
        latest = [c for c in events.columns if c not in (*self.key, self.order, *self.first)]
        newest = F.struct(*latest) if latest else F.lit(None).cast("struct<__none:string>")
        firsts = [F.when(F.col(c).isNotNull(), F.struct(F.col(self.order).alias("at"), F.col(c).alias("value"))).alias(c) for c in self.first]
        return self.merged(events.select(*self.key, self.order, newest.alias("latest"), *firsts))

    def merged(self, states: DataFrame) -> DataFrame:
        """States of the same keys as one; neither the order of states nor one that is there twice matters."""
        firsts = [F.min_by(c, F.col(c)["at"]).alias(c) for c in self.first]
        return states.groupBy(*self.key).agg(F.max(self.order).alias(self.order), F.max_by("latest", self.order).alias("latest"), *firsts)

    def rows(self, states: DataFrame) -> DataFrame:
        firsts: list[Column] = [F.col(c)["value"].alias(c) for c in self.first]
        latest = [] if "__none" in states.select("latest.*").columns else ["latest.*"]
        return states.select(*self.key, self.order, *firsts, *latest)


CONVERSIONS = Fold(("url",), "seq", store.KEEP_FIRST)
FETCHES = Fold(("user_id", "cache_id"), "fetched_at")

#: Runs of a size class that are merged, and the bytes of the smallest class.
FAN, UNIT = 8, 32 << 20


def _files(spark: SparkSession, path: str):
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    return home.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")


def runs(spark: SparkSession, path: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(live, superseded): the batches (from, to) of complete runs, in order. A run inside another one's batches is superseded."""
    files, at = _files(spark, path)
    found = files.globStatus(at("run-*-*/_SUCCESS")) or []
    spans = sorted((tuple(int(n) for n in x.getPath().getParent().getName().split("-")[1:]) for x in found), key=lambda s: (s[0], -s[1]))
    live, old = [], []
    for span in spans:
        (old if live and span[1] <= live[-1][1] else live).append(span)
    return live, old


def _name(span: tuple[int, int]) -> str:
    return f"run-{span[0]}-{span[1]}"


def _due(sizes: list[int], fan: int, unit: int) -> int:
    """How many of the newest runs to merge: where the newest is of a larger class than some before it, these with it; else the first class with `fan` runs.

    Classes never rise towards the newest run, so those of a class lie together and a merge takes no run of a larger class.
    """

    def level(size: int) -> int:
        at = 0
        while size > unit * fan**at:
            at += 1
        return at

    def stretch(most: int) -> list[int]:
        n = next((i for i, x in enumerate(reversed(levels)) if x > most), len(levels))
        return levels[len(levels) - n :]

    levels = [level(s) for s in sizes]
    if levels and min(stretch(levels[-1])) < levels[-1]:
        return len(stretch(levels[-1]))
    return next((len(stretch(x)) for x in sorted(set(levels)) if levels.count(x) >= fan), 0)


def compact(spark: SparkSession, path: str, fold: Fold, fan: int = FAN, unit: int = UNIT) -> None:
    """Merge the newest runs where `fan` of a size class are there; what an earlier merge has superseded is deleted, so a reader has until the next merge to finish."""
    live, old = runs(spark, path)
    files, at = _files(spark, path)
    n = _due([files.getContentSummary(at(_name(s))).getLength() for s in live], fan, unit)
    if not n:
        return
    for span in old:
        files.delete(at(_name(span)), True)
    newest = live[-n:]
    states = spark.read.parquet(*(f"{path}/{_name(s)}" for s in newest))
    fold.merged(states).write.mode("overwrite").parquet(f"{path}/{_name((newest[0][0], newest[-1][1]))}")


def stream_upsert(events: DataFrame, path: str, checkpoint: str, fold: Fold = CONVERSIONS, fan: int = FAN, unit: int = UNIT):
    """A writer that adds each micro-batch to the table under path; upserted() reads it. One stream writes a table.

    A batch writes its own folded rows and no others. Each row is written once more for each size class that it passes, and a reader
    meets fewer than `fan` runs of each class. Merging is the same in any order and for runs that are there twice, so late writes, a
    repeated batch and a writer that was lost between merging and deleting all give the same table.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        live, _ = runs(spark, path)
        if not any(a <= number <= b for a, b in live):
            fold.state(batch).write.mode("overwrite").parquet(f"{path}/{_name((number, number))}")
        compact(spark, path, fold, fan, unit)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def upserted(spark: SparkSession, path: str, fold: Fold = CONVERSIONS) -> DataFrame | None:
    """The rows of an upserted table, None where nothing is written. A table of one run is read as it is, without a shuffle."""
    live, _ = runs(spark, path)
    if not live:
        return None
    states = spark.read.parquet(*(f"{path}/{_name(s)}" for s in live))
    return fold.rows(states if len(live) == 1 else fold.merged(states))

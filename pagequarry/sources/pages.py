"""Raw pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.sources.formats import decode_bytes


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(page_id, url, html) from a table, or from a folder of files (fmt binaryFile: the path is the url, the content is read in its own charset, see decode_bytes)."""
    if fmt == "binaryFile":
        files = decode_bytes(spark.read.format("binaryFile").load(path).select("path", "content"))
        return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.col("text").alias("html"))
    return spark.read.format(fmt).load(path).select("page_id", "url", "html")

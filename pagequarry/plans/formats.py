"""Queries of the format readers, and of the streams over the events table."""

import uuid

from pyspark.sql import functions as F

from pagequarry.plans.registry import query, table
from pagequarry.plans.views import FETCHES, VERDICTS, WRITES, view
from pagequarry.session import shared_folder
from pagequarry.sources import formats as X
from pagequarry.streaming import streams as G
from pagequarry.streaming import upserts as U


@query("table_to_markdown", "SELECT l_orderkey, '| l_linenumber | l_quantity | l_returnflag |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || CAST(l_quantity AS BIGINT) || ' | ' || l_returnflag || ' |', chr(10) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT), l_returnflag) AS markdown FROM lineitem GROUP BY 1")
def table_to_markdown(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
    return X.table_to_markdown(items, ["l_linenumber", "l_quantity", "l_returnflag"], ["l_orderkey"], ["l_linenumber", "l_quantity", "l_returnflag"])


CSV = "concat('id;name', '\\n', doc_id, ';\"a|', source, '\"', '\\n', doc_id + 1, ';', lang)"


@query("sniff_delimiter", "SELECT doc_id, ';' AS delimiter FROM documents")
def sniff_delimiter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.sniff_delimiter(F.expr(CSV)).alias("delimiter"))


@query("delimited_to_markdown", r"SELECT doc_id, '| id | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | a\|' || source || ' |' || chr(10) || '| ' || (doc_id + 1) || ' | ' || lang || ' |' AS markdown FROM documents")
def delimited_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.delimited_to_markdown(F.expr(CSV)).alias("markdown"))


@query("json_documents", """SELECT event_id, event_id % 4 <> 3 AS valid, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || '!' END AS title FROM events""")
def json_documents(spark, sf_dir):
    text = """CASE event_id % 4 WHEN 0 THEN concat('{"name":"', event_type, '"}') WHEN 1 THEN concat('{"name":"x","title":"', event_type, '!"}') WHEN 2 THEN concat(props, '\\n', props) ELSE '{broken' END AS text"""
    return X.json_documents(table(spark, sf_dir, "events").selectExpr("event_id", text), "text").select("event_id", "valid", "title")


@query("feed_entries", "SELECT doc_id AS feed_id, p AS pos, CASE p WHEN 0 THEN source ELSE lang END AS title, 'https://x.org/' || doc_id AS link, '2024-01-0' || (p + 1) AS date, CASE p WHEN 0 THEN 'me' END AS author, CASE p WHEN 1 THEN 'b & c' END AS body FROM documents, range(2) r(p)")
def feed_entries(spark, sf_dir):
    rss = "concat('<rss><channel><item><title>', source, '</title><link>https://x.org/', doc_id, '</link><pubDate>2024-01-01</pubDate><author>me</author></item><item><title>', lang, '</title><link>https://x.org/', doc_id, '</link><pubDate>2024-01-02</pubDate><description>b &amp; c</description></item></channel></rss>') AS feed"
    return X.feed_entries(table(spark, sf_dir, "documents").selectExpr("doc_id", rss), "doc_id", "feed")


@query("notebook_to_markdown", """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'Own ' || user_id ELSE event_type END AS title, CASE event_id % 5 WHEN 1 THEN 'by ' || user_id WHEN 2 THEN 'an author' END AS author,
 '# ' || CASE WHEN event_id % 3 = 0 THEN 'Own ' || user_id || chr(10) || chr(10) || '# ' || event_type || ' ##' ELSE event_type END || chr(10) || chr(10) || '```python' || chr(10) || 'print(' || user_id || ')' || chr(10) || '```' || chr(10) || chr(10)
 || CASE event_id % 4 WHEN 0 THEN '```text' || chr(10) || user_id || chr(10) || '```' WHEN 1 THEN '```text' || chr(10) || 'E: ' || user_id || chr(10) || 'at' || chr(10) || 'end' || chr(10) || '```' WHEN 2 THEN '*[Bildausgabe]*' ELSE '````text' || chr(10) || '```' || event_type || chr(10) || '````' END || chr(10) AS markdown FROM events""")
def notebook_to_markdown(spark, sf_dir):
    meta = """concat('{"nbformat":4,"metadata":{"language_info":{"name":"Python"}', CASE WHEN event_id % 3 = 0 THEN concat(',"title":" Own ', user_id, '"') ELSE '' END, CASE event_id % 5 WHEN 1 THEN concat(',"authors":[{"name":"by ', user_id, '"}]') WHEN 2 THEN ',"authors":["an author "]' ELSE '' END, '}')"""
    out = """CASE event_id % 4 WHEN 0 THEN concat('{"output_type":"stream","text":["', user_id, '\\\\n"]}') WHEN 1 THEN concat('{"output_type":"error","ename":"E","evalue":"', user_id, '","traceback":["\\\\u001b[31mat\\\\u001b[0m","end"]}')
     WHEN 2 THEN '{"output_type":"display_data","data":{"image/png":"x","text/plain":"<Figure>"}}' ELSE concat('{"output_type":"execute_result","data":{"text/plain":["```","', event_type, '"]}}') END"""
    text = f"""concat({meta}, ',"cells":[{{"cell_type":"markdown","source":["# ","', event_type, ' ##"]}},{{"cell_type":"code","source":"print(', user_id, ')","outputs":[', {out}, ']}}]}}') AS text"""
    return X.notebook_to_markdown(table(spark, sf_dir, "events").selectExpr("event_id", text), "event_id", "text")


@query("parse_cues", "SELECT event_id AS id, p + 1 AS cue_no, CAST(p * 60 + 1.5 AS DOUBLE) AS start, CAST(p * 60 + 3.25 AS DOUBLE) AS stop, 0 AS line_no, CASE p WHEN 0 THEN event_type ELSE 'user ' || user_id END AS line FROM events, range(2) r(p)")
def parse_cues(spark, sf_dir):
    text = "concat('WEBVTT\\n\\n1\\n00:00:01.500 --> 00:00:03.250 align:start\\n<i>', event_type, '</i>\\n\\n2\\n01:01,500 --> 01:03,250\\nuser ', user_id, '\\n') AS text"
    cues = X.parse_cues(table(spark, sf_dir, "events").selectExpr("event_id", text), "event_id", "text")
    return cues.withColumn("cue_no", F.col("cue_no").cast("long"))


@query("decode_bytes", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' ELSE 'iso8859-1' END AS charset, text FROM documents")
def decode_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    raw = docs.selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN encode(text, 'UTF-8') WHEN 1 THEN concat(unhex('FFFE'), encode(text, 'UTF-16LE')) ELSE encode(text, 'ISO-8859-1') END AS content", "CASE WHEN doc_id % 3 = 2 THEN 'text/html; charset=ISO-8859-1' END AS header")
    return X.decode_bytes(raw, "content", "header").select("doc_id", "charset", "text")


def folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def streamed(spark, sf_dir, name):
    """A table as a stream: rows as they lie, in one micro-batch or more."""
    batch = table(spark, sf_dir, name)
    source = f"{folder(spark)}/source"
    batch.write.parquet(source)
    return spark.readStream.schema(batch.schema).parquet(source)


def events(spark, sf_dir):
    return streamed(spark, sf_dir, "events").withColumn("created_at", F.col("ts").cast("timestamp"))


@query("stream_stats", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS source, count(*) AS count, round(avg((event_id % 100) / CAST(100 AS DOUBLE)), 6) AS avg_quality FROM events GROUP BY ALL")
def stream_stats(spark, sf_dir):
    log = events(spark, sf_dir).selectExpr("created_at", "event_type AS source", "(event_id % 100) / 100.0D AS quality")
    # complete mode: the last windows are open and the check wants them too
    return finished(G.stream_stats(log, "1 day"), spark).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "source", "count", F.round("avg_quality", 6).alias("avg_quality"))


def finished(stream, spark):
    """A stream's aggregates over all that is there, open windows included."""
    path = folder(spark)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("stream_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS events FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    out = finished(G.stream_sessions(events(spark, sf_dir), "user_id", "created_at", "6 hours", "1 hour"), spark)
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "stop": F.col("stop").cast("timestamp_ntz")})


@query("stream_rate_limit", VERDICTS.format(most=3, window="CAST(86400 AS DOUBLE)"))
def stream_rate_limit(spark, sf_dir):
    stream = G.stream_rate_limit(events(spark, sf_dir), "user_id", "ts", 86400.0, 3, "event_id")
    return G.drained(stream, "limits", folder(spark))


FOLDED = f"w AS ({WRITES}) SELECT url, max(seq) AS seq, arg_min(share_id, seq) FILTER (share_id IS NOT NULL) AS share_id, arg_max(title, seq) AS title FROM w GROUP BY url"


def upserted(spark, rows, fold):
    """The table that a stream of the rows leaves, a day's files after another's."""
    path, source = folder(spark), folder(spark)
    rows.withColumn("day", F.to_date(rows.columns[-1])).write.partitionBy("day").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16).parquet(f"{source}/day=*")
    U.stream_upsert(stream, path, f"{path}-state", fold, fan=2).trigger(availableNow=True).start().awaitTermination()
    return U.upserted(spark, path, fold)


@query("stream_upsert", f"WITH {FOLDED}")
def stream_upsert(spark, sf_dir):
    return upserted(spark, view(spark, sf_dir, "writes"), U.CONVERSIONS).select("url", "seq", "share_id", "title")


@query("stream_upsert_fetches", f"WITH f AS ({FETCHES}) SELECT user_id, cache_id, max(fetched_at) AS fetched_at FROM f GROUP BY ALL")
def stream_upsert_fetches(spark, sf_dir):
    return upserted(spark, view(spark, sf_dir, "fetches").select("user_id", "cache_id", "fetched_at"), U.FETCHES)


@query("stream_convert")
def stream_convert(spark, sf_dir):
    raw = streamed(spark, sf_dir, "pages").withColumn("seen", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, page_id)"))
    return G.drained(G.stream_convert(raw, "seen"), "pages", folder(spark)).withColumn("metadata", F.to_json("metadata"))


@query("write_conversions", f"WITH w AS ({WRITES}) SELECT source, count(*) AS rows, CAST(sum(length(markdown)) AS BIGINT) AS chars FROM w GROUP BY 1")
def write_conversions(spark, sf_dir):
    from pagequarry.operators.store import write_conversions as write

    path = folder(spark)
    write(view(spark, sf_dir, "writes"), path, "json", "source")
    return spark.read.json(path).groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.length("markdown")).alias("chars"))


@query("load_recipes", "WITH g AS (SELECT event_id % 50 AS k, count(*) AS n FROM events GROUP BY 1), d AS (SELECT 0 AS f, max(k) AS place, 'r' || (k % 20) AS name FROM g WHERE k % 5 <> 3 GROUP BY 3 UNION ALL SELECT 1, k, 'user' || k || '-' || n FROM g) SELECT CAST(row_number() OVER (ORDER BY f, place) AS INTEGER) AS rule_no, name FROM d")
def load_recipes(spark, sf_dir):
    from pagequarry.operators.recipes import load_recipes as load

    groups = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 50).alias("k")).agg(F.count("*").alias("n"))
    base = folder(spark)
    for name, rule in (("default", """concat('{"name":"', CASE WHEN k % 5 = 3 THEN '' ELSE concat('r', k % 20) END, '","host":"*.example.org"}')"""), ("user", """concat('{"name":"user', k, '-', n, '","host":["a.org","b.org"],"path":"/x/**"}')""")):
        listed = groups.agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.expr(rule).alias("r")))), lambda x: x["r"]), ","), F.lit("]")).alias("value"))
        listed.coalesce(1).write.text(f"{base}/{name}")
    return load(spark, [f"{base}/default", f"{base}/user"])[0].select("rule_no", "name")

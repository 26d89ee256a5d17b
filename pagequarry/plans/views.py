"""The tables that operators need, derived from the given ones: the same definition for Spark and, as a common table expression, for SQL."""

from pyspark.sql import DataFrame, SparkSession

from pagequarry.plans.registry import table

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

LOG = """
SELECT event_id, 'http://d' || (user_id % 40) || '.example.org/' || event_id AS url, CASE WHEN user_id % 40 = 7 THEN NULL ELSE 'd' || (user_id % 40) END AS domain, event_type AS source,
  (event_id % 100) / CAST(100.0 AS DOUBLE) AS quality, CAST(value * 100 AS BIGINT) AS markdown_len, event_id % 997 AS duration_ms, event_id % 4 = 0 AS cached,
  CASE event_id % 7 WHEN 0 THEN 'main fell back to body' WHEN 1 THEN 'MAIN FELL BACK' WHEN 2 THEN NULL ELSE 'static' END AS extractor_reason, ts AS created_at
FROM events"""

WRITES = """
SELECT event_id AS seq, 'u' || (event_id % 500) AS url, 'title ' || event_id AS title, 'text ' || (event_id % 17) AS markdown, event_type AS source, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 's' || event_id END AS share_id,
  CASE WHEN event_id % 2 = 0 THEN 'api' ELSE 'browser' END AS client, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id, props AS metadata, ts AS created_at
FROM events"""

FETCHES = "SELECT event_id, user_id, event_id % 520 AS cache_id, ts AS fetched_at FROM events"

THREAD = """
SELECT conv_id AS root_id, turn AS id, CASE WHEN turn = 0 THEN NULL ELSE CAST(floor((turn - 1) / 2.0) AS BIGINT) END AS parent_id, turn AS pos,
  CASE WHEN turn % 7 = 6 THEN NULL ELSE role END AS author, CASE WHEN turn % 7 = 6 THEN NULL ELSE text END AS text, length(text) % 50 AS score
FROM conversations"""

CUES = "SELECT user_id AS key, CAST(epoch(ts) AS DOUBLE) AS start, CAST(epoch(ts) AS DOUBLE) + value AS stop, event_type AS line, event_id FROM events"

#: A limiter's verdicts: walked event by event, with the accepted times that still count as a list.
VERDICTS = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
v AS (SELECT user_id, event_id, "at", k, true AS allowed, CAST(0 AS DOUBLE) AS retry_after, ["at"] AS live FROM o WHERE k = 1 UNION ALL
 SELECT user_id, event_id, "at", k, len(kept) < {most}, CASE WHEN len(kept) < {most} THEN 0 ELSE greatest(0, kept[1] + {window} - "at") END, CASE WHEN len(kept) < {most} THEN list_append(kept, "at") ELSE kept END
 FROM (SELECT o.user_id, o.event_id, o."at", o.k, list_filter(v.live, lambda t: t >= o."at" - {window}) AS kept FROM v JOIN o ON o.user_id = v.user_id AND o.k = v.k + 1))
SELECT user_id, event_id, "at", allowed, retry_after FROM v"""

VIEWS = {"log": LOG, "writes": WRITES, "fetches": FETCHES, "thread": THREAD}

MD_SQL = "array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1) % 15 = 0 THEN '# ' WHEN (i - 1) % 5 = 0 THEN '## ' WHEN (i - 1) % 5 = 3 THEN '### ' ELSE '' END || l), chr(10))"
MD = f"SELECT doc_id, source, {MD_SQL} AS markdown FROM documents"
MD_SPARK = "array_join(transform(split(text, '\\n'), (l, i) -> concat(CASE WHEN i % 15 = 0 THEN '# ' WHEN i % 5 = 0 THEN '## ' WHEN i % 5 = 3 THEN '### ' ELSE '' END, l)), '\\n')"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """log, writes, fetches or thread."""
    base = {"thread": "conversations"}.get(name, "events")
    return spark.sql(VIEWS[name].replace(f"FROM {base}", "FROM {base}"), base=table(spark, sf_dir, base))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS key", "unix_micros(cast(ts AS timestamp)) / 1e6D AS start", "unix_micros(cast(ts AS timestamp)) / 1e6D + value AS stop", "event_type AS line", "event_id")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, markdown): documents with heading lines."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "source", f"{MD_SPARK} AS markdown")

"""Queries of the store and its statistics."""

from pyspark.sql import functions as F

from pagequarry.operators import stats, store
from pagequarry.plans.registry import query, table
from pagequarry.plans.views import AS_OF, FETCHES, LOG, WRITES, view

FOLD = f"""w AS ({WRITES}), conv AS (SELECT url, CAST(substr(url, 2) AS BIGINT) AS id, max(seq) AS seq, arg_min(share_id, seq) FILTER (share_id IS NOT NULL) AS share_id, arg_min(user_id, seq) FILTER (user_id IS NOT NULL) AS user_id,
 arg_max(title, seq) AS title, arg_max(markdown, seq) AS markdown, arg_max(source, seq) AS source, arg_max(client, seq) AS client, arg_max_null(metadata, seq) AS metadata, arg_max(created_at, seq) AS created_at FROM w GROUP BY url)"""
F_SQL = f"f AS ({FETCHES})"


def conversions(spark, sf_dir):
    return store.upsert_conversions(view(spark, sf_dir, "writes")).withColumn("id", F.substr("url", F.lit(2)).cast("long"))


@query("upsert_conversions", f"WITH {FOLD} SELECT url, seq, share_id, user_id, title, markdown, source, client, metadata, created_at FROM conv")
def upsert_conversions(spark, sf_dir):
    return conversions(spark, sf_dir).drop("id")


@query("upsert_incremental", f"WITH {FOLD} SELECT url, seq, share_id, user_id, title, markdown, source, client, metadata, created_at FROM conv")
def upsert_incremental(spark, sf_dir):
    writes = view(spark, sf_dir, "writes")
    old = store.upsert_conversions(writes.where("created_at < TIMESTAMP '2024-01-15 00:00:00'"))
    return store.upsert_conversions(writes.where("created_at >= TIMESTAMP '2024-01-15 00:00:00'"), old)


@query("upsert_fetches", f"WITH {F_SQL} SELECT user_id, cache_id, max(fetched_at) AS fetched_at FROM f GROUP BY ALL")
def upsert_fetches(spark, sf_dir):
    return store.upsert_fetches(view(spark, sf_dir, "fetches"))


LATEST = "u AS (SELECT user_id, cache_id, max(fetched_at) AS fetched_at FROM f GROUP BY ALL)"


@query("history_for_user", f"WITH {FOLD}, {F_SQL}, {LATEST} SELECT c.id, c.url, c.title, u.fetched_at FROM u JOIN conv c ON c.id = u.cache_id WHERE u.user_id = 7 ORDER BY u.fetched_at DESC, c.id DESC LIMIT 20")
def history_for_user(spark, sf_dir):
    found = store.history_for_user(store.upsert_fetches(view(spark, sf_dir, "fetches")), conversions(spark, sf_dir).select("id", "url", "title"), 7)
    return found.select("id", "url", "title", "fetched_at")


@query("orphan_fetches", f"WITH {F_SQL} SELECT event_id, user_id, cache_id, fetched_at FROM f WHERE cache_id >= 500")
def orphan_fetches(spark, sf_dir):
    return store.orphan_fetches(view(spark, sf_dir, "fetches"), conversions(spark, sf_dir)).select("event_id", "user_id", "cache_id", "fetched_at")


@query("history", f"WITH {FOLD} SELECT id, url, created_at FROM conv ORDER BY created_at DESC, id DESC LIMIT 20")
def history(spark, sf_dir):
    return store.history(conversions(spark, sf_dir).select("id", "url", "created_at"))


@query("history_page", f"WITH {FOLD} SELECT id, url, created_at, (SELECT count(*) FROM conv) AS total FROM conv ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50")
def history_page(spark, sf_dir):
    return store.history_page(conversions(spark, sf_dir).select("id", "url", "created_at"), 50, 50)


@query("recent_history", f"WITH {FOLD} SELECT id, url, share_id, created_at FROM conv WHERE share_id IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 30")
def recent_history(spark, sf_dir):
    return store.recent_history(conversions(spark, sf_dir).select("id", "url", "share_id", "created_at"), view(spark, sf_dir, "fetches"), None, limit=30)


@query("prune_retention", f"WITH log AS ({LOG}) SELECT event_id, created_at FROM log WHERE created_at >= {AS_OF} - INTERVAL 20 DAY")
def prune_retention(spark, sf_dir):
    return store.prune_retention(view(spark, sf_dir, "log"), "created_at", 20, F.expr(AS_OF))[0].select("event_id", "created_at")


#: A post for each event: galleries of three with an item that is no image and one that comes twice, single images of three hosts, texts that name two images, videos.
POSTS = """coalesce(to_json(CASE event_id % 4 WHEN 0 THEN named_struct('gallery_data', named_struct('items', array(named_struct('media_id', concat('k', user_id % 50)), named_struct('media_id', 'other'), named_struct('media_id', concat('k', (user_id + 7) % 50)), named_struct('media_id', concat('k', user_id % 50)))),
 'media_metadata', map(concat('k', (user_id + 7) % 50), named_struct('e', 'Image', 's', named_struct('u', concat('https://preview.redd.it/', event_id, '.jpg?a=1&amp;b=2'))), concat('k', user_id % 50), named_struct('e', 'Image', 's', named_struct('u', 'https://I.redd.it/x')), 'other', named_struct('e', 'Video', 's', named_struct('u', 'https://i.redd.it/o'))),
 'url', cast(null as string), 'is_self', false, 'selftext', '', 'is_video', false) END),
 CASE event_id % 4 WHEN 1 THEN concat('{"post_hint":"image","url":"https://', element_at(array('i.redd.it', 'preview.redd.it', 'else.org'), cast(event_id % 3 + 1 as int)), '/a/k', user_id % 50, '.PNG?x"}')
 WHEN 2 THEN concat('{"is_self":true,"selftext":"first kk', (user_id + 1) % 50, 'x then kk', user_id % 50, 'x","media_metadata":{"kk', user_id % 50, 'x":{"e":"Image","s":{"u":"https://i.redd.it/a"}},"kk', (user_id + 1) % 50, 'x":{"e":"Image","s":{"u":"https://i.redd.it/b"}},"absent":{"e":"Image","s":{"u":"https://i.redd.it/c"}}}}')
 WHEN 3 THEN concat('{"is_video":true,"media":{"reddit_video":{"fallback_url":"v', event_id, '"}},"url":"https://i.redd.it/v.png"}') END) AS post"""
IMAGES_SQL = """SELECT event_id, 0 AS pos, 'https://I.redd.it/x' AS url, 'k' || (user_id % 50) AS key, 'gallery' AS kind FROM events WHERE event_id % 4 = 0
 UNION ALL SELECT event_id, 1, 'https://preview.redd.it/' || event_id || '.jpg?a=1&b=2', 'k' || ((user_id + 7) % 50), 'gallery' FROM events WHERE event_id % 4 = 0
 UNION ALL SELECT event_id, 0, 'https://' || ['i.redd.it', 'preview.redd.it'][event_id % 3 + 1] || '/a/k' || (user_id % 50) || '.PNG?x', 'k' || (user_id % 50), 'single' FROM events WHERE event_id % 4 = 1 AND event_id % 3 < 2
 UNION ALL SELECT event_id, 0, 'https://i.redd.it/b', 'kk' || ((user_id + 1) % 50) || 'x', 'inline' FROM events WHERE event_id % 4 = 2
 UNION ALL SELECT event_id, 1, 'https://i.redd.it/a', 'kk' || (user_id % 50) || 'x', 'inline' FROM events WHERE event_id % 4 = 2"""


def images(spark, sf_dir):
    posts = table(spark, sf_dir, "events").selectExpr("event_id", POSTS)
    return store.post_images(posts, "event_id", "post").withColumnRenamed("page_key", "event_id")


@query("post_images", IMAGES_SQL)
def post_images(spark, sf_dir):
    return images(spark, sf_dir)


@query("join_transcripts", f"""WITH m AS ({IMAGES_SQL}), i AS (SELECT DISTINCT event_id % 200 AS page_key, key FROM m), t AS (SELECT 'k' || (user_id % 50) AS key, max(ts) AS created_at FROM events WHERE user_id % 2 = 0 GROUP BY 1),
 o AS (SELECT i.page_key, t.key AS found FROM i LEFT JOIN t ON i.key = t.key AND t.created_at > {AS_OF} - INTERVAL 5 DAY)
SELECT page_key, count(*) AS images, count(found) AS resolved, count(found) < least(count(*), 12) AS incomplete FROM o GROUP BY 1""")
def join_transcripts(spark, sf_dir):
    of_pages = images(spark, sf_dir).select((F.col("event_id") % 200).alias("page_key"), "key")
    transcripts = table(spark, sf_dir, "events").where("user_id % 2 = 0").selectExpr("'k' || (user_id % 50) AS key", "ts").groupBy("key").agg(F.max("ts").alias("created_at"))
    return store.join_transcripts(of_pages, transcripts, F.expr(AS_OF), 5, 12)


W7 = f"l AS (SELECT * FROM log WHERE created_at > {AS_OF} - INTERVAL 7 DAY)"
L = f"WITH log AS ({LOG}), {W7}"
UP = "floor({0} * {1} + CAST(0.5 AS DOUBLE)) / {1}"


@query("stats_by_source", f"{L} SELECT source, count(*) AS count, floor(count(*) / CAST((SELECT count(*) FROM l) AS DOUBLE) * 100 * 10 + CAST(0.5 AS DOUBLE)) / 10 AS pct, nullif({UP.format('avg(quality)', 100)}, 0) AS avg_quality, nullif({UP.format('avg(markdown_len)', 1)}, 0) AS avg_len, nullif({UP.format('avg(duration_ms)', 1)}, 0) AS avg_ms FROM l GROUP BY source")
def stats_by_source(spark, sf_dir):
    return stats.stats_by_source(view(spark, sf_dir, "log"), F.expr(AS_OF), "7 DAYS")


@query("low_quality_domains", f"{L} SELECT domain, count(*) AS count, {UP.format('avg(quality)', 100)} AS avg_quality FROM l WHERE quality < 0.4 AND NOT cached GROUP BY domain ORDER BY 2 DESC, domain NULLS FIRST LIMIT 20")
def low_quality_domains(spark, sf_dir):
    return stats.low_quality_domains(view(spark, sf_dir, "log"), F.expr(AS_OF), "7 DAYS")


@query("fallback_domains", f"{L} SELECT domain, count(*) AS count FROM l WHERE source ILIKE '%fallback%' OR extractor_reason ILIKE '%fell back%' GROUP BY domain ORDER BY 2 DESC, domain NULLS FIRST LIMIT 20")
def fallback_domains(spark, sf_dir):
    return stats.fallback_domains(view(spark, sf_dir, "log"), F.expr(AS_OF), "7 DAYS")


@query("storage_stats", f"WITH log AS ({LOG}), {FOLD}, {W7} SELECT (SELECT count(*) FROM conv) AS total, (SELECT count(*) FROM conv WHERE created_at <= {AS_OF} - INTERVAL 5 DAY) AS expiring, (SELECT min(created_at) FROM conv) AS oldest, count(*) AS requests, count(*) FILTER (cached) AS hits FROM l")
def storage_stats(spark, sf_dir):
    return stats.storage_stats(conversions(spark, sf_dir), view(spark, sf_dir, "log"), F.expr(AS_OF), 15)


@query("stats_rollup", f"{L} SELECT source, grouping(source) = 1 AS is_total, count(*) AS count, {UP.format('avg(quality)', 100)} AS avg_quality FROM l GROUP BY ROLLUP (source)")
def stats_rollup(spark, sf_dir):
    return stats.stats_rollup(view(spark, sf_dir, "log"), F.expr(AS_OF), "7 DAYS")


@query("usage_totals", "SELECT event_type AS model, CAST(sum(CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 1000 END) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 300) AS BIGINT) AS completion_tokens, CAST(sum(CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 1300 END) AS BIGINT) AS total_tokens FROM events GROUP BY 1")
def usage_totals(spark, sf_dir):
    usage = table(spark, sf_dir, "events").selectExpr("event_type AS model", "CASE WHEN event_id % 11 > 0 THEN event_id % 1000 END AS prompt_tokens", "event_id % 300 AS completion_tokens", "CASE WHEN event_id % 11 > 0 THEN event_id % 1300 END AS total_tokens")
    return stats.usage_totals(usage)


@query("distinct_blocks", r"WITH n AS (SELECT role, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations) SELECT role, count(*) AS blocks, count(DISTINCT t) AS distinct_blocks, count(*) - count(DISTINCT t) AS duplicates, max(turn) AS last_order FROM n GROUP BY role")
def distinct_blocks(spark, sf_dir):
    return stats.distinct_blocks(table(spark, sf_dir, "conversations"), "role", "text", "turn")


@query("read_pages", "SELECT page_id, url, html FROM pages")
def read_pages(spark, sf_dir):
    from pagequarry.sources.pages import read_pages as read

    return read(spark, f"{sf_dir}/pages.parquet")

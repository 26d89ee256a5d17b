"""Queries over sections, threads and rows in time order."""

from pyspark.sql import functions as F

from pagequarry.operators import extracts as E
from pagequarry.operators import markdown_blocks as M
from pagequarry.operators import sections as S
from pagequarry.operators import stats, threads, timed
from pagequarry.plans.registry import query, table
from pagequarry.plans.views import MD, THREAD, VERDICTS, cues, markdown, view

LINES = f"""md AS ({MD}), b AS (SELECT doc_id AS id, unnest(range(len(ls))) AS idx, unnest(ls) AS text FROM (SELECT doc_id, string_split(markdown, chr(10)) AS ls FROM md)),
t0 AS (SELECT *, CASE WHEN regexp_matches(text, '^#{{1,6}} ') THEN length(regexp_extract(text, '^(#+) ', 1)) ELSE 0 END AS lv FROM b),
t AS (SELECT id, idx, text, lv, CAST(sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY idx) AS BIGINT) AS section FROM t0),
s AS (SELECT id, section, CAST(max(lv) AS BIGINT) AS level, max(CASE WHEN lv > 0 THEN trim(regexp_replace(regexp_replace(text, '^ {{0,3}}#{{1,6}}[ \\t]*', ''), '[ \\t]+#+[ \\t]*$', '')) END) AS heading, string_agg(text, chr(10) ORDER BY idx) AS text, count(*) AS n_blocks FROM t GROUP BY ALL),
p AS (SELECT s.*, CASE WHEN section > 0 THEN coalesce((SELECT max(q.section) FROM s q WHERE q.id = s.id AND q.section < s.section AND q.section > 0 AND q.level < s.level), 0) END AS parent FROM s)"""


def line_blocks(spark, sf_dir):
    """Every line of the documents with headings as a block."""
    lines = markdown(spark, sf_dir).select(F.col("doc_id").alias("id"), F.posexplode(F.split("markdown", "\n")).alias("idx", "text"))
    level = F.length(F.regexp_extract("text", "^(#{1,6}) ", 1))
    return lines.select("id", F.col("idx").cast("long").alias("idx"), F.when(level > 0, "heading").otherwise("paragraph").alias("type"), level.cast("long").alias("level"), "text")


def listed(spark, sf_dir):
    return S.sections(S.section_tree(line_blocks(spark, sf_dir)))


@query("markdown_blocks")
def markdown_blocks(spark, sf_dir):
    return M.markdown_blocks(markdown(spark, sf_dir), "doc_id", "markdown")


@query("section_tree", f"WITH {LINES} SELECT id, section, level, heading, parent, n_blocks, md5(text) AS text_md5 FROM p")
def section_tree(spark, sf_dir):
    return listed(spark, sf_dir).select("id", "section", "level", "heading", "parent", "n_blocks", F.md5("text").alias("text_md5"))


@query("section_path", f"""WITH RECURSIVE {LINES}, r AS (SELECT id, section, parent AS up, '' AS path FROM p UNION ALL SELECT r.id, r.section, q.parent, CASE WHEN r.path = '' THEN q.heading ELSE q.heading || ' > ' || r.path END FROM r JOIN p q ON q.id = r.id AND q.section = r.up WHERE r.up > 0)
SELECT id, section, path FROM r WHERE up IS NULL OR up = 0""")
def section_path(spark, sf_dir):
    return S.section_path(listed(spark, sf_dir).drop("text")).select("id", "section", "path")


@query("subtree_blocks", f"""WITH {LINES}, e AS (SELECT id, section, coalesce(CASE WHEN level > 0 THEN (SELECT min(q.section) FROM s q WHERE q.id = s.id AND q.section > s.section AND q.level <= s.level AND q.level > 0) END, 1099511627776) AS stop FROM s)
SELECT e.id, e.section, m.section AS member FROM e JOIN s m ON m.id = e.id AND m.section >= e.section AND m.section < e.stop""")
def subtree_blocks(spark, sf_dir):
    return S.subtree_blocks(listed(spark, sf_dir).drop("text"))


#: Every text of the benchmark is a query.
ITEM_SQL = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+(?:[-.][\p{{L}}\p{{N}}]+)*')"


def item_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text AS query")


W_SQL = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / average))"
ASKED = f"a AS (SELECT DISTINCT query_id, unnest({TOKENS.format('query')}) AS term FROM q)"


@query("bm25_sections", f"""WITH {LINES}, {ITEM_SQL}, {ASKED}, k AS (SELECT id, section, {TOKENS.format('text')} AS tokens FROM s), z AS (SELECT id, section, tokens, len(tokens) AS length, count(*) OVER (PARTITION BY id) AS n, avg(len(tokens)) OVER (PARTITION BY id) AS average FROM k),
f AS (SELECT id, section, length, n, average, term, count(*) AS tf FROM (SELECT id, section, length, n, average, unnest(tokens) AS term FROM z) WHERE term IN (SELECT term FROM a) GROUP BY ALL), d AS (SELECT *, count(*) OVER (PARTITION BY id, term) AS df FROM f)
SELECT id, section, query_id, round(sum({W_SQL}), 6) AS score FROM d JOIN a USING (term) GROUP BY ALL""")
def bm25_sections(spark, sf_dir):
    return S.bm25_sections(listed(spark, sf_dir), item_queries(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("bm25_search", f"""WITH {ITEM_SQL}, {ASKED}, k AS (SELECT doc_id AS id, {TOKENS.format('text')} AS tokens FROM documents), z AS (SELECT id, tokens, len(tokens) AS length, count(*) OVER () AS n, avg(len(tokens)) OVER () AS average FROM k),
f AS (SELECT id, length, n, average, term, count(*) AS tf FROM (SELECT id, length, n, average, unnest(tokens) AS term FROM z) WHERE term IN (SELECT term FROM a) GROUP BY ALL), d AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM f),
g AS (SELECT query_id, id, sum({W_SQL}) AS score FROM d JOIN a USING (term) GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM g)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def bm25_search(spark, sf_dir):
    return S.bm25_search(table(spark, sf_dir, "documents"), item_queries(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("query_extract")
def query_extract(spark, sf_dir):
    """Every benchmark text asked of every document; the texts that come back as digests."""
    found = E.query_extract(markdown(spark, sf_dir), item_queries(spark, sf_dir))
    return found.withColumn("markdown", F.md5("markdown")).withColumnRenamed("markdown", "markdown_md5")


@query("token_savings", f"WITH {LINES} SELECT id % 4 AS bucket, count(*) AS pages, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS original, CAST(sum(CAST(ceil(length(heading) / 4.0) AS BIGINT)) AS BIGINT) AS returned, sum(CAST(ceil(length(heading) / 4.0) AS BIGINT)) / CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS DOUBLE) AS ratio FROM s WHERE heading IS NOT NULL GROUP BY 1")
def token_savings(spark, sf_dir):
    rows = listed(spark, sf_dir).where("heading IS NOT NULL").select((F.col("id") % 4).alias("bucket"), F.ceil(F.length("text") / 4).alias("original_tokens"), F.ceil(F.length("heading") / 4).alias("returned_tokens"))
    return stats.token_savings(rows, "bucket")


@query("assemble_regions", f"""WITH {LINES}, k AS (SELECT id, idx, text FROM t WHERE length(text) >= 30), i AS (SELECT *, idx - row_number() OVER (PARTITION BY id ORDER BY idx) AS island FROM k),
r AS (SELECT id, island, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM i GROUP BY ALL) SELECT id, count(*) AS regions, md5(string_agg(text, chr(10) || chr(10) || '[…]' || chr(10) || chr(10) ORDER BY island)) AS markdown_md5 FROM r GROUP BY id""")
def assemble_regions(spark, sf_dir):
    kept = line_blocks(spark, sf_dir).where("length(text) >= 30").select("id", "idx", "text")
    return S.assemble_regions(kept, ["id"]).select("id", "regions", F.md5("markdown").alias("markdown_md5"))


TREE = f"""WITH RECURSIVE n AS ({THREAD}), g AS (SELECT root_id, id, author, score, text, 0 AS depth, lpad(CAST(pos AS VARCHAR), 9, '0') AS path FROM n WHERE parent_id IS NULL AND author IS NOT NULL AND text IS NOT NULL
 UNION ALL SELECT n.root_id, n.id, n.author, n.score, n.text, g.depth + 1, g.path || '.' || lpad(CAST(n.pos AS VARCHAR), 9, '0') FROM g JOIN n ON n.root_id = g.root_id AND n.parent_id = g.id WHERE n.author IS NOT NULL AND n.text IS NOT NULL)"""


@query("count_comments", f"{TREE} SELECT root_id, count(*) AS comments FROM g GROUP BY 1")
def count_comments(spark, sf_dir):
    return threads.count_comments(view(spark, sf_dir, "thread"))


@query("prune_deleted", f"""WITH RECURSIVE n AS ({THREAD}), d AS (SELECT root_id, id, parent_id, author, 0 AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.root_id, n.id, n.parent_id, n.author, d.depth + 1 FROM d JOIN n ON n.root_id = d.root_id AND n.parent_id = d.id),
u AS (SELECT root_id, parent_id AS id FROM d WHERE author IS NOT NULL AND parent_id IS NOT NULL UNION SELECT d.root_id, d.parent_id FROM u JOIN d ON d.root_id = u.root_id AND d.id = u.id WHERE d.parent_id IS NOT NULL)
SELECT root_id, id, parent_id, depth, author IS NULL AS placeholder FROM d WHERE author IS NOT NULL OR EXISTS (SELECT 1 FROM u WHERE u.root_id = d.root_id AND u.id = d.id)""")
def prune_deleted(spark, sf_dir):
    return threads.prune_deleted(view(spark, sf_dir, "thread"))


@query("render_thread", rf"""{TREE}, c AS (SELECT root_id, count(*) AS total FROM g GROUP BY 1), l AS (SELECT root_id, path, repeat('  ', depth) || '- **' || author || '** (' || score || '): ' || regexp_replace(text, '\s+', ' ', 'g') AS line FROM g WHERE depth < 3)
SELECT l.root_id, '## Comments (' || count(*) || ' of ' || any_value(total) || ')' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY path) AS markdown FROM l JOIN c USING (root_id) GROUP BY l.root_id""")
def render_thread(spark, sf_dir):
    return threads.render_thread(view(spark, sf_dir, "thread"), 3)


@query("render_listing", "WITH r AS (SELECT event_type, user_id, count(*) AS n, sum(event_id) AS s FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS k FROM r) SELECT event_type, string_agg(k || '. user ' || user_id || ' (' || n || ' events)', chr(10) ORDER BY k) AS markdown FROM k WHERE k <= 10 GROUP BY 1")
def render_listing(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(" events)"))
    return threads.render_listing(counted, ["event_type"], [F.desc("n"), F.col("user_id")], 10, line)


CUE = "c AS (SELECT user_id AS key, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS start, epoch_us(ts) / CAST(1000000 AS DOUBLE) + value AS stop, event_type AS line, event_id FROM events)"


@query("gap_paragraphs", f"""WITH {CUE}, m AS (SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY key ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3600 THEN 1 ELSE 0 END AS brk, lag(line) OVER (PARTITION BY key ORDER BY start, event_id) IS NOT DISTINCT FROM line AS again FROM c),
p AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY key ORDER BY start, event_id) AS BIGINT) AS paragraph FROM m) SELECT key, paragraph, min(start) AS start, max(stop) AS stop, string_agg(line, ' ' ORDER BY start, event_id) AS text FROM p WHERE NOT again GROUP BY key, paragraph""")
def gap_paragraphs(spark, sf_dir):
    return timed.gap_paragraphs(cues(spark, sf_dir), "key", "start", "stop", "line", 3600.0, "event_id")


CHUNKS = f"""WITH RECURSIVE {CUE}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, event_id) AS k FROM c), r AS (SELECT key, k, start AS anchor, line, start FROM o WHERE k = 1
 UNION ALL SELECT o.key, o.k, CASE WHEN o.start - r.anchor >= 86400 THEN o.start ELSE r.anchor END, o.line, o.start FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1), b AS (SELECT key, anchor, string_agg(line, ' ' ORDER BY k) AS text FROM r GROUP BY ALL)"""
CLOCK = "CAST(floor(anchor) AS BIGINT) // 3600 || ':' || lpad(CAST(CAST(floor(anchor) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(anchor) AS BIGINT) % 60 AS VARCHAR), 2, '0')"


@query("transcript_blocks", f"{CHUNKS} SELECT key, row_number() OVER (PARTITION BY key ORDER BY anchor) - 1 AS block, anchor AS at, text FROM b")
def transcript_blocks(spark, sf_dir):
    return timed.transcript_blocks(cues(spark, sf_dir), "key", "start", "line", 86400.0, "event_id")


@query("chunk_transcript", f"""{CHUNKS} SELECT key, CAST(count(*) AS INTEGER) AS chunks, string_agg('[' || {CLOCK} || '](https://www.youtube.com/watch?v=' || key || '&t=' || CAST(floor(anchor) AS BIGINT) || 's) ' || text, chr(10) || chr(10) ORDER BY anchor) AS markdown FROM b GROUP BY key""")
def chunk_transcript(spark, sf_dir):
    return timed.chunk_transcript(cues(spark, sf_dir), "key", "start", "line", 86400.0, "links", "event_id")


@query("rate_limit", VERDICTS.format(most=3, window="CAST(86400 AS DOUBLE)"))
def rate_limit(spark, sf_dir):
    return timed.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", 3600.0 * 24, 3, "event_id")


@query("rate_bound", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_bound(spark, sf_dir):
    return timed.rate_bound(table(spark, sf_dir, "events"), "user_id", "ts", 86400, "event_id")

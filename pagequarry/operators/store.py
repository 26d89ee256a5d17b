"""The store of conversions and fetches: folds of append-only events, freshness, history, retention."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_FIRST = ("share_id", "user_id")


def upsert_conversions(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """One row per url: the latest title, markdown, source, client and metadata (nulls included), the first share_id and user_id that are not null, created_at of the last write.

    events: those columns, and seq as the order of writes. A snapshot has the same columns; its rows are the oldest. Bodies are
    combined before the shuffle, so a hot url costs a row per task.
    """
    if snapshot is not None:
        events = snapshot.unionByName(events)
    latest = [c for c in events.columns if c not in ("url", "seq", *KEEP_FIRST)]
    newest = F.max_by(F.struct(*latest), "seq").alias("x")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in KEEP_FIRST]
    return events.groupBy("url").agg(F.max("seq").alias("seq"), newest, *first).select("url", "seq", *KEEP_FIRST, "x.*")


def upsert_fetches(events: DataFrame) -> DataFrame:
    """One row per user and conversion with the latest time."""
    return events.groupBy("user_id", "cache_id").agg(F.max("fetched_at").alias("fetched_at"))


def fresh_rows(df: DataFrame, as_of: Column, max_age: str, invalidated_at: Column | None = None, ts: str = "created_at") -> DataFrame:
    """Rows younger than max_age and newer than the last invalidation."""
    young = F.col(ts) > as_of - F.expr(f"INTERVAL {max_age}")
    return df.where(young if invalidated_at is None else young & (F.col(ts) > invalidated_at))


def stale_rows(df: DataFrame, as_of: Column, max_age: str, ts: str = "created_at") -> DataFrame:
    return df.where(F.col(ts) <= as_of - F.expr(f"INTERVAL {max_age}"))


def history_for_user(fetches: DataFrame, conversions: DataFrame, user_id: int, limit: int = 20) -> DataFrame:
    """A user's fetches with what they got, newest first. The user's rows are picked before the join."""
    own = fetches.where(F.col("user_id") == user_id).select("cache_id", "fetched_at")
    joined = own.join(conversions, own["cache_id"] == conversions["id"]).drop("cache_id")
    return joined.orderBy(F.desc("fetched_at"), F.desc("id")).limit(clamp(limit, 1, 100))


def orphan_fetches(fetches: DataFrame, conversions: DataFrame) -> DataFrame:
    """Fetches whose conversion is gone."""
    return fetches.join(conversions.select(F.col("id").alias("cache_id")), "cache_id", "left_anti")


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def history(df: DataFrame, limit: int = 20) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(clamp(limit, 1, 100))


def history_page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the archive with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(clamp(limit, 1, 200))
    return page.join(F.broadcast(total), F.lit(True))


def recent_history(conversions: DataFrame, fetches: DataFrame, user_id: int | None, public: bool = True, limit: int = 20) -> DataFrame:
    """The user's own rows when signed in, else the shared rows, or none where these are not public."""
    if user_id is not None:
        return history_for_user(fetches, conversions, user_id, limit).drop("fetched_at")
    shared = conversions.where(F.col("share_id").isNotNull() if public else F.lit(False))
    return history(shared, limit)


def prune_retention(df: DataFrame, ts: str, days: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): rows older than so many days go; 0 keeps all."""
    days = clamp(days, 0, 36500)
    if not days:
        return df, df.limit(0)
    old = F.col(ts) < as_of - F.expr(f"INTERVAL {days} DAYS")
    return df.where(~F.coalesce(old, F.lit(False))), df.where(old)


#: Hosts whose images count, and endings of addresses that name one image.
IMAGE_HOSTS = ("i.redd.it", "preview.redd.it")
ENDING, ANY_ENDING = r"(?i)\.(jpg|jpeg|png|webp)$", r"(?i)\.(jpg|jpeg|png|gif|webp)$"
POST = "struct<is_video:boolean,media:struct<reddit_video:struct<fallback_url:string>>,gallery_data:struct<items:array<struct<media_id:string>>>,media_metadata:map<string,struct<e:string,s:struct<u:string>>>,post_hint:string,url:string,is_self:boolean,selftext:string>"


def post_images(posts: DataFrame, key: str, post: str, hosts: tuple[str, ...] = IMAGE_HOSTS) -> DataFrame:
    """(page_key, pos, url, key, kind): the images of each post (a column of its JSON) in order, those of listed hosts only.

    A gallery's in the gallery's order, each once; else the one that the post's address names, without its ending; else, for a post
    of text, those that the text names, by where it first does. None for videos, and for posts that don't parse.
    """
    none = F.array().cast("array<struct<url:string,key:string,kind:string>>")
    p = F.col("p")

    def allowed(url: Column) -> Column:
        host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
        return F.coalesce(host.isin(*hosts), F.lit(False))

    def image(name: Column, kind: str) -> Column:
        return F.struct(F.replace(F.element_at(p["media_metadata"], name)["s"]["u"], F.lit("&amp;"), F.lit("&")).alias("url"), name.alias("key"), F.lit(kind).alias("kind"))

    def usable(name: Column) -> Column:
        found = F.element_at(p["media_metadata"], name)
        return (found["e"] == "Image") & (found["s"]["u"] != "")

    def pictures(names: Column, kind: str) -> Column:
        return F.filter(F.transform(F.filter(names, usable), lambda n: image(n, kind)), lambda i: allowed(i["url"]))

    named = F.filter(p["gallery_data"]["items"]["media_id"], lambda n: n.isNotNull())
    gallery = pictures(F.array_distinct(named), "gallery")
    path = F.regexp_extract(p["url"], r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    own = F.regexp_replace(F.element_at(F.split(path, "/"), -1), ENDING, "")
    single = F.when(allowed(p["url"]) & F.rlike(path, F.lit(ENDING)) & (own != ""), F.array(F.struct(p["url"].alias("url"), own.alias("key"), F.lit("single").alias("kind"))))
    places = F.transform(F.map_keys(p["media_metadata"]), lambda n, i: F.struct(F.instr(p["selftext"], n).alias("at"), i.alias("i"), n.alias("n")))
    inline = pictures(F.transform(F.array_sort(F.filter(places, lambda x: x["at"] > 0)), lambda x: x["n"]), "inline")
    is_single = (p["post_hint"] == "image") | F.rlike(p["url"], F.lit(ANY_ENDING))
    chosen = (
        F.when(p["is_video"] & (p["media"]["reddit_video"]["fallback_url"] != ""), none)
        .when(p["gallery_data"].isNotNull() & p["media_metadata"].isNotNull(), gallery)
        .when(is_single, single)
        .when(p["is_self"] & p["media_metadata"].isNotNull() & p["gallery_data"].isNull() & (p["selftext"] != ""), inline)
    )
    read = posts.select(F.col(key).alias("page_key"), F.from_json(post, POST).alias("p"))
    return read.select("page_key", F.posexplode(F.coalesce(chosen, none)).alias("pos", "i")).select("page_key", "pos", "i.*")


def join_transcripts(images: DataFrame, transcripts: DataFrame, as_of: Column, retention_days: int, max_images: int) -> DataFrame:
    """(page_key, images, resolved, incomplete): a page's different images, those with a stored transcript that is not too old, and whether some that are due are missing."""
    usable = transcripts.where(F.col("created_at") > as_of - F.expr(f"INTERVAL {retention_days} DAYS")).select("key", F.lit(1).alias("found"))
    own = images.select("page_key", "key").dropDuplicates(["page_key", "key"]).join(usable.dropDuplicates(["key"]), "key", "left")
    counted = own.groupBy("page_key").agg(F.count("*").alias("images"), F.count("found").alias("resolved"))
    return counted.withColumn("incomplete", F.col("resolved") < F.least("images", F.lit(max_images)))


def write_conversions(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """parquet, json or text (the markdown alone), in folders by a column if asked."""
    out = df.select(*([partition_by] if partition_by else []), F.col("markdown").alias("value")) if fmt == "text" else df
    writer = out.write.format(fmt)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)

"""URL functions as column expressions; what can't be parsed is null."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of two sites that have converters of their own, and the listings of one.
FORUM_HOSTS = ("www.reddit.com", "reddit.com", "old.reddit.com", "new.reddit.com")
NEWS_HOST = "news.ycombinator.com"
NEWS_LISTINGS = ("/", "/news", "/newest", "/best", "/ask", "/show", "/jobs")
VIDEO_HOST = r"^(www\.|m\.|music\.)?youtube\.com$"


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(F.trim(url), F.lit(name))


def url_domain(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def url_path(url: Column) -> Column:
    return F.coalesce(part(url, "PATH"), F.lit(""))


def query_value(url: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(part(url, "QUERY"), F.lit("")), rf"(?:^|&){key}=([^&]*)", 1), F.lit(""))


def url_source(url: Column) -> Column:
    """reddit, hackernews, youtube or web."""
    host, path = url_domain(url), F.regexp_replace(url_path(url), "/+$", "")
    news = (host == NEWS_HOST) & (((path == "/item") & query_value(url, "id").rlike("^[0-9]+$")) | F.when(path == "", "/").otherwise(path).isin(*NEWS_LISTINGS))
    video = ((host == "youtu.be") & (F.length(url_path(url)) > 1)) | (host.rlike(VIDEO_HOST) & (((path == "/watch") & query_value(url, "v").isNotNull()) | url_path(url).startswith("/shorts/")))
    return F.when(host.isin(*FORUM_HOSTS, "redd.it"), "reddit").when(news, "hackernews").when(video, "youtube").otherwise("web")


def canonical_url(url: Column) -> Column:
    """Without query and fragment, the path closed by a slash."""
    path = url_path(url)
    return F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), url_domain(url), F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/"))))


def youtube_id(url: Column) -> Column:
    """The video id of a watch, short, live or embed address, else empty."""
    host, path = F.regexp_replace(url_domain(url), r"^www\.", ""), url_path(url)
    found = F.when(host == "youtu.be", F.regexp_extract(path, "^/+([^/]+)", 1)).otherwise(F.coalesce(query_value(url, "v"), F.regexp_extract(path, "^/(?:shorts|live|embed|v)/([^/]+)", 1)))
    return F.regexp_replace(F.coalesce(found, F.lit("")), "[^A-Za-z0-9_-]", "")


def normalize_url(url: Column) -> Column:
    """One form for each page: forum addresses on the main host, news items and videos by id, others canonical."""
    source, path = url_source(url), url_path(url)
    closed = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    news = F.when(query_value(url, "id").isNotNull(), F.concat(F.lit(f"https://{NEWS_HOST}/item?id="), query_value(url, "id"))).otherwise(F.concat(F.lit(f"https://{NEWS_HOST}"), F.when(path == "", "/").otherwise(path)))
    return F.when(source == "reddit", F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://www.reddit.com"), closed)).when(source == "hackernews", news).when(source == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), youtube_id(url))).otherwise(canonical_url(url))


SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: Addresses that name no place relative to a page.
KEPT_AS_IS = r"(?i)^\s*(?:data:|mailto:|javascript:|tel:|#)"


def _without_dots(path: Column) -> Column:
    """A path whose `.` and `..` segments are worked out; nothing lies above the root."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)

    def step(done: Column, s: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(s == ".", done).when(s == "..", up).otherwise(F.concat(done, F.array(s)))

    done = F.aggregate(segments, F.expr("cast(array() as array<string>)"), step)
    closed = F.when(last.isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(closed, "/")).otherwise(path)


def resolve_url(ref: Column, base: Column) -> Column:
    """ref as an absolute address by RFC 3986; empty references, fragments and data, mail, script and phone addresses as they are."""
    bare = F.trim(ref)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)", 1)
    base_path = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path, rest = F.regexp_extract(bare, r"^([^?#]*)", 1), F.regexp_extract(bare, r"^[^?#]*(.*)$", 1)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_extract(base_path, r"^(.*/)", 1))
    asked = F.when(rest.startswith("?"), rest).otherwise(F.concat(F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1), rest))
    full = F.when(path == "", F.concat(base_path, asked)).when(path.startswith("/"), F.concat(_without_dots(path), rest)).otherwise(F.concat(_without_dots(F.concat(folder, path)), rest))
    return F.when((bare == "") | ref.rlike(KEPT_AS_IS) | bare.rlike(SCHEME), F.when(bare == "", ref).when(ref.rlike(KEPT_AS_IS), ref).otherwise(bare)).when(bare.startswith("//"), F.concat(scheme, bare)).otherwise(F.concat(site, full))


#: Marks of programs in user agents, first match wins.
CLIENTS = (("claude", ("claude", "anthropic")), ("api", ("curl", "wget", "python-requests", "httpie", "node-fetch", "axios")), ("browser", ("mozilla", "chrome", "safari", "firefox", "edge")))


def client_class(agent: Column, mode: Column) -> Column:
    """pwa, claude, api or browser."""
    low = F.lower(F.coalesce(agent, F.lit("")))
    out = F.when(mode == "pwa", "pwa")
    for name, marks in CLIENTS:
        found = F.lit(False)
        for m in marks:
            found = found | F.contains(low, F.lit(m))
        out = out.when(found, name)
    return out.otherwise("api")


#: Networks that a fetch must not reach.
BLOCKED_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32")
BLOCKED_V6 = ("::1/128", "::/128", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32")
#: Networks whose addresses go on with a short one (NAT64, translated, compatible, 6to4), and those that end in one (mapped, local NAT64).
V4_INSIDE_V6 = ("64:ff9b::/96", "::ffff:0:0:0/96", "::/96", "2002::/16")
V4_LAST_IN_V6 = ("::ffff:0:0/96", "64:ff9b:1::/48")

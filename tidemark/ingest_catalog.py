"""Registered queries of ingest and display, over payloads made from pages and conversations, and their DuckDB oracles.

The payloads' raw fields are written once, in SQL that both engines read; what the engine makes of
them is stated anew in each oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import agents, ranges, text
from tidemark.functions.predicates import DASHBOARD, Fields
from tidemark.schema import COLUMNS, DAY_MS, PIXEL
from tidemark.sources import adapter, enrich, store, zones
from tidemark.streaming import ingest

START = 1_704_067_200_000
END = START + 30 * DAY_MS
HALF = START + 15 * DAY_MS

_UA = """CASE i % 8
 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/' || (100 + i % 40) || '.0.' || i || '.0 Safari/537.36'
 WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/' || (15 + i % 4) || '.' || (i % 7) || ' Mobile/15E148 Safari/604.1'
 WHEN 2 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:' || (90 + i % 30) || '.0) Gecko/20100101 Firefox/' || (90 + i % 30) || '.0'
 WHEN 3 THEN 'Shop' || (i % 9) || '/' || (i % 5) || '.' || (i % 11) || '.3 (Android 14; SM-G991B)'
 WHEN 4 THEN 'Mozilla/5.0 (Linux; Android 13; Pixel 7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/' || (100 + i % 40) || '.0.0.0 Mobile Safari/537.36'
 WHEN 5 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.' || (i % 5) || ' Safari/605.1.15'
 WHEN 6 THEN 'Mozilla/5.0 (compatible; Bingbot/2.' || (i % 3) || '; +http://www.bing.com/bingbot.htm)' ELSE '' END"""
_U = """CASE i % 6 WHEN 0 THEN replace(site, '://', '://www.') || path WHEN 1 THEN site || path || '///?utm_source=+news%20' || i || '+&utm_medium=e%2Dmail&utm_medium=&x=1'
 WHEN 2 THEN upper(site) || '/A b/' || i WHEN 3 THEN 'not a url ' || i WHEN 4 THEN site || '/x/../y' || i || '/?utm_campaign=one&utm_campaign=two#frag' ELSE url END"""
_FIELDS = {
    "ua": _UA, "u": _U, "t": "CASE i % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/Berlin' WHEN 2 THEN 'Nowhere/Land' END",
    "lang": "CASE i % 4 WHEN 0 THEN 'en-US,en;q=0.9' WHEN 1 THEN 'de' WHEN 2 THEN ' FR-ca ;q=1' ELSE '*' END", "dnt": "CASE WHEN i % 13 = 0 THEN '1' END", "gpc": "CASE WHEN i % 17 = 0 THEN '1' WHEN i % 2 = 0 THEN '0' END",
    "e": "CASE i % 7 WHEN 0 THEN 'unload' WHEN 1 THEN 'custom' WHEN 3 THEN 'bogus' WHEN 4 THEN 'load' WHEN 5 THEN 'load' WHEN 6 THEN 'load' END", "sid": "CASE i % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' s' || i END",
    "m": "CASE WHEN i % 7 = 0 THEN i * 10 END", "n": "CASE WHEN i % 7 = 1 THEN repeat('é', CAST(i % 200 AS INT)) || i END", "b": "repeat('b', CAST(i % 300 AS INT))",
}
_REF = "CASE i % 5 WHEN 0 THEN 'https://www.google.com/search?q=x' WHEN 1 THEN u WHEN 2 THEN 'https://News.ycombinator.com/item' WHEN 3 THEN 'garbage' END"
_SITE = "regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path"
#: (i, url, the fields above, r) of every page.
_P = f"p0 AS (SELECT page_id AS i, url, {_SITE} FROM pages), p AS (SELECT *, {_REF} AS r FROM (SELECT *, {', '.join(f'{sql} AS {n}' for n, sql in _FIELDS.items())} FROM p0))"
#: Texts of conversations as exception reports: the columns, for both engines.
_REPORT_FIELDS = {
    "i": "conv_id", "turn": "turn", "u": "'https://app' || (conv_id % 5) || '.example.com/x'", "ty": "CASE WHEN turn % 2 = 0 THEN ' TypeError ' ELSE 'Oops' END", "msg": "text",
    "stack": "CASE WHEN turn % 3 = 0 THEN 'at run' || turn || ' (https://cdn.example.com/a.js:1:2)' || chr(10) || 'at run' || (turn + 3) || ' (https://cdn.example.com/b.js:7:9)' || chr(10) || ' at main (/srv/app/lib/util.js:10:4)' END",
    "fp": "CASE WHEN turn % 4 = 1 THEN ' own ' || conv_id END", "v": "CASE WHEN turn % 2 = 1 THEN ' 1.' || turn || ' ' END",
}
_C = f"c AS (SELECT {', '.join(f'{sql} AS {n}' for n, sql in _REPORT_FIELDS.items())} FROM conversations)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id AS i", "url", *_SITE.replace(", regexp", ",, regexp").split(",, "))
    return rows.selectExpr("*", *[f"{sql} AS {n}" for n, sql in _FIELDS.items()]).selectExpr("*", f"{_REF} AS r")


def _hits(spark, sf_dir) -> DataFrame:
    """Raw lines of hits, one for each page."""
    d = F.when(F.col("i") % 7 == 1, F.create_map(F.lit("b"), F.lit("x y"), F.lit("a"), F.col("i").cast("string")))
    body = F.to_json(F.struct("b", F.col("sid").alias("i"), "e", "u", "r", (F.col("i") % 2 == 0).alias("q"), (F.col("i") % 3 == 0).alias("p"), "t", "m", "n", d.alias("d")))
    return _pages(spark, sf_dir).select(F.lit("hit").alias("kind"), body.alias("body"), F.col("ua").alias("user_agent"), F.col("lang").alias("accept_language"), "dnt", F.col("gpc").alias("sec_gpc"), F.col("i").alias("received_ms"))


def _reports(spark, sf_dir) -> DataFrame:
    """Raw lines of exceptions, one for each turn of a conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr(*[f"{sql} AS {n}" for n, sql in _REPORT_FIELDS.items()])
    body = F.to_json(F.struct("u", "ty", F.col("msg").alias("m"), F.col("stack").alias("s"), "fp", "v", (F.col("turn") % 2 == 0).alias("h")))
    return rows.select(F.lit("exception").alias("kind"), body.alias("body"), F.lit("curl/8.5.0").alias("user_agent"), *[F.lit(None).cast("string").alias(c) for c in ("accept_language", "dnt", "sec_gpc")], (F.col("i") * 1000 + F.col("turn")).alias("received_ms"))


def cut_sql(x: str, n: int) -> str:
    """At most n UTF-8 bytes of x, with an ellipsis if anything was cut."""
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE left({x}, CAST(list_max(list_filter(range(0, {n + 1}), lambda z: strlen(left({x}, z)) <= {n})) AS BIGINT)) || '…' END"


def _n(*pairs: tuple[str, str]) -> str:
    return ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in pairs)


_APP = "CASE WHEN ua LIKE '%Firefox/%' THEN 'Firefox' WHEN ua LIKE '%Chrome/%' THEN 'Chrome' WHEN ua LIKE '%Version/%Safari/%' THEN 'Safari' WHEN ua LIKE 'Shop%' THEN regexp_extract(ua, '^([^/]+)/', 1) END"
_VER = "nullif(regexp_extract(ua, '(?:Firefox|Chrome|Version|^Shop[0-9]+)/([0-9.]+)', 1), '')"
_OS = "CASE WHEN ua LIKE '%iPhone%' THEN 'iOS' WHEN ua LIKE '%Android%' THEN 'Android' WHEN ua LIKE '%Windows%' THEN 'Windows' WHEN ua LIKE '%Mac OS X%' THEN 'macOS' WHEN ua LIKE '%Linux%' THEN 'Linux' END"
_KIND = "CASE WHEN ua = '' OR lower(ua) LIKE '%bot%' THEN 'Bot' WHEN ua LIKE 'Shop%' THEN 'App' WHEN ua LIKE '%Mobile%' THEN 'Mobile' ELSE 'Desktop' END"
_HOST = lambda c: f"nullif(regexp_replace(lower(regexp_extract({c}, '^[A-Za-z]+://([^/?#]+)', 1)), '^(www[.])+', ''), '')"
_RAWPATH = "CASE WHEN i % 6 = 4 THEN '/y' || i || '/' ELSE replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ' ', '%20') END"
_PATH = f"CASE WHEN {_HOST('u')} IS NOT NULL THEN coalesce(nullif({_RAWPATH}, ''), '/') END"
_GROUP = lambda h: f"CASE {h} WHEN 'google.com' THEN 'Search' WHEN 'news.ycombinator.com' THEN 'Social' END"
_UTM = {
    "utm_source": "CASE WHEN i % 6 = 1 THEN 'news ' || i ELSE nullif(regexp_extract(u, '[?&]utm_source=([^&#]+)', 1), '') END",
    "utm_medium": "CASE WHEN i % 6 = 1 THEN 'e-mail' ELSE nullif(regexp_extract(u, '[?&]utm_medium=([^&#]+)', 1), '') END",
    "utm_campaign": "CASE WHEN i % 6 = 4 THEN 'two' ELSE nullif(regexp_extract(u, '[?&]utm_campaign=([^&#]+)', 1), '') END",
}
_KEPT = f"coalesce(dnt, '') <> '1' AND coalesce(gpc, '') <> '1' AND {_KIND} <> 'Bot' AND {_HOST('u')} IS NOT NULL AND coalesce(e, 'load') <> 'bogus'"
_REFHOST = f"CASE WHEN {_HOST('r')} <> {_HOST('u')} THEN {_HOST('r')} END"
_EVENT = f"""SELECT received_ms, bid, sid, kind, source, pathname, is_unique_user, is_unique_page, referrer_host, {_GROUP('referrer_host')} AS referrer_group, country, language, ua_browser, ua_version, ua_os, ua_device,
 utm_source, utm_medium, utm_campaign, duration_ms, event_name, metadata_json FROM (SELECT i AS received_ms, {cut_sql('b', 256)} AS bid, nullif(trim(sid), '') AS sid,
 CASE e WHEN 'unload' THEN 'page_unload' WHEN 'custom' THEN 'custom' ELSE 'page_load' END AS kind, 'https://' || {_HOST('u')} AS source, coalesce(nullif(regexp_replace({_PATH}, '/+$', ''), ''), '/') AS pathname, i % 2 = 0 AS is_unique_user,
 i % 3 = 0 AS is_unique_page, {_REFHOST} AS referrer_host, CASE t WHEN 'America/New_York' THEN 'US' WHEN 'Europe/Berlin' THEN 'DE' END AS country, CASE i % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END AS language,
 {_APP} AS ua_browser, {_VER} AS ua_version, {_OS} AS ua_os, {_KIND} AS ua_device, {', '.join(f'{s} AS {n}' for n, s in _UTM.items())}, CAST(m AS BIGINT) AS duration_ms, {cut_sql('n', 256)} AS event_name,
 CASE WHEN i % 7 = 1 THEN '{{"a":"' || i || '","b":"x y"}}' END AS metadata_json FROM p WHERE {_KEPT})"""
_SPACES = "[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_fold = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[0-9]', '', 'g'), '{_SPACES}', ' ', 'g'))"
_LINE = "coalesce(list_filter(list_transform(string_split_regex(msg, '\\r?\\n'), lambda z: trim(z, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda z: z <> '')[1], '')"
_TWICE = lambda x: f"substr(sha256(unhex(sha256({x}))), 1, 16)"
_REPORT = f"""SELECT i * 1000 + turn AS received_ms, 'exception' AS kind, replace(regexp_extract(u, '(https://[^/]+)', 1), 'www.', '') AS source, 'curl' AS ua_browser, '8.5.0' AS ua_version, 'App' AS ua_device, ty AS exc_type, {cut_sql('msg', 1000)} AS exc_message,
 stack AS exc_stack, nullif(trim(v), '') AS app_version, turn % 2 = 0 AS exc_handled, CASE WHEN fp IS NOT NULL THEN substr(sha256(trim(fp)), 1, 16) ELSE {_TWICE(f"lower(trim(ty)) || chr(10) || CASE WHEN stack IS NOT NULL THEN 'at run ()' || chr(10) || 'at main (util.js::)' || chr(10) ELSE {_fold(_LINE)} END")} END AS exc_group FROM c"""
_REPORT_COLUMNS = ["received_ms", "kind", "source", "ua_browser", "ua_version", "ua_device", "exc_type", "exc_message", "exc_stack", "app_version", "exc_handled", "exc_group"]
_EVENT_COLUMNS = [c for c in COLUMNS if c not in ("created_ms", "seq", "app_version") and not c.startswith("exc_")]
_QUERIES: dict = {}
_SQL: dict = {}


def _add(name: str, query, sql: str | None, base: str = "") -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = base + sql


_WP, _WC = f"WITH {_P} ", f"WITH {_C} "
# user agents, URLs and the fields of a hit
_add("ua_classify", lambda s, d: _pages(s, d).select("i", agents.ua_classes("ua").alias("x")).select("i", "x.*"), f"SELECT i, {_APP} AS app, {_VER} AS version, {_OS} AS os, {_KIND} AS kind FROM p", _WP)
_AGENT = "CASE i % 3 WHEN 0 THEN 'Tool-' || i || '/v' || (i % 5) || '.' || (i % 7) || ' (X11; (nested ' || i || ') Ubuntu) extra/9.9' WHEN 1 THEN 'my-crawler' || i || ' 2.' || i ELSE 'Mozilla/5.0 (Macintosh) ' || i || '.5 Reader' || i || '/1.2beta smartbios' END"
_add(
    "ua_parts",
    lambda s, d: _pages(s, d).select("i", F.expr(_AGENT).alias("a")).select("i", agents.ua_parts("a").alias("x")).select("i", "x.*"),
    """SELECT i, CASE i % 3 WHEN 0 THEN 'Tool-' || i WHEN 1 THEN 'my-crawler' || i ELSE 'Reader' || i END AS product, CASE i % 3 WHEN 0 THEN (i % 5) || '.' || (i % 7) WHEN 1 THEN '2.' || i ELSE '5.0' END AS version,
 CASE i % 3 WHEN 0 THEN 'Linux' WHEN 2 THEN 'macOS' END AS os, CASE i % 3 WHEN 0 THEN 'Tool-' || i || '/v' || (i % 5) || '.' || (i % 7) || '  extra/9.9' WHEN 1 THEN 'my-crawler' || i || ' 2.' || i ELSE 'Mozilla/5.0  ' || i || '.5 Reader' || i || '/1.2beta smartbios' END AS outside,
 CASE i % 3 WHEN 0 THEN (i % 5) || '.' || (i % 7) WHEN 1 THEN '2.' || i ELSE '5.0' END AS number, i % 3 = 1 AS bot FROM p""",
    _WP,
)
_LABEL = "CASE i % 9 WHEN 0 THEN 'Windows ' || i WHEN 1 THEN 'iPhone' WHEN 2 THEN 'Mac OSX' WHEN 3 THEN 'Android ' || i WHEN 4 THEN 'ChromeOS' WHEN 5 THEN 'linux-' || i WHEN 6 THEN 'UNKNOWN' WHEN 7 THEN '' ELSE 'Plan ' || i END"
_add(
    "os_family",
    lambda s, d: _pages(s, d).select("i", F.expr(_LABEL).alias("label")).select("i", agents.os_family("label").alias("os")),
    f"SELECT i, CASE WHEN label IN ('UNKNOWN', '') THEN NULL WHEN label LIKE 'Windows%' THEN 'Windows' WHEN label = 'iPhone' THEN 'iOS' WHEN label LIKE 'Mac OS%' THEN 'macOS' WHEN label LIKE 'Android%' THEN 'Android' WHEN label = 'ChromeOS' THEN 'ChromeOS' WHEN label LIKE 'linux%' THEN 'Linux' ELSE label END AS os FROM (SELECT i, {_LABEL} AS label FROM p)",
    _WP,
)
_add("url_parts", lambda s, d: _pages(s, d).select("i", agents.url_fields("u").alias("x")).select("i", "x.*"), f"SELECT i, {_HOST('u')} AS host, {_PATH} AS path FROM p", _WP)
_add("utm_fields", lambda s, d: _pages(s, d).select("i", *[text.utm("u", n).alias(n) for n in _UTM]), f"SELECT i, {', '.join(f'{s} AS {n}' for n, s in _UTM.items())} FROM p", _WP)
_add(
    "referrers",
    lambda s, d: enrich.hits(enrich.parse(_hits(s, d), "hit"), zones.zones(s)).select("received_ms", "referrer_host", "referrer_group"),
    f"SELECT received_ms, referrer_host, {_GROUP('referrer_host')} AS referrer_group FROM (SELECT i AS received_ms, {_REFHOST} AS referrer_host FROM p WHERE {_KEPT})",
    _WP,
)
_add("build_event", lambda s, d: ingest.facts_of(_hits(s, d), zones.zones(s)).select(*_EVENT_COLUMNS), _EVENT, _WP)
_add("build_exception", lambda s, d: ingest.facts_of(_reports(s, d), zones.zones(s)).select(*_REPORT_COLUMNS), _REPORT, _WC)
_add("privacy", lambda s, d: enrich.allowed(_hits(s, d)).groupBy("sec_gpc").agg(F.count(F.lit(1)).alias("n")), f"SELECT gpc AS sec_gpc, {_n(('n', 'count(*)'))} FROM p WHERE coalesce(dnt, '') <> '1' AND coalesce(gpc, '') <> '1' GROUP BY 1", _WP)
_add("country_of_zone", lambda s, d: _pages(s, d).join(zones.zones(s), F.col("t") == F.col("zone"), "left").groupBy("t", "country").agg(F.count(F.lit(1)).alias("n")), f"SELECT t, CASE t WHEN 'America/New_York' THEN 'US' WHEN 'Europe/Berlin' THEN 'DE' END AS country, {_n(('n', 'count(*)'))} FROM p GROUP BY 1, 2", _WP)
_add("primary_language_headers", lambda s, d: _pages(s, d).select("i", text.primary_language("lang").alias("language")), "SELECT i, CASE i % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END AS language FROM p", _WP)
_PIXELS = [("px0", "p0", "Mail", "opened", {"b": "2", "a": "1"}), ("px1", "p1", "Ad", "seen", {}), ("px2", "gone", "Old", "seen", {f"k{j:02}": "v" for j in range(40)})]


def pixel_table(spark) -> DataFrame:
    return spark.createDataFrame([(*r, None, None) for r in _PIXELS], PIXEL)


_add(
    "pixel_hits",
    lambda s, d: enrich.pixel_hits(_pages(s, d).selectExpr("'px' || (i % 5) || CASE WHEN i % 2 = 0 THEN '.gif' ELSE '' END AS pixel_id", "i AS received_ms"), pixel_table(s)).select("received_ms", "kind", "source", "event_name", "metadata_json", "ua_browser"),
    """SELECT i AS received_ms, 'pixel' AS kind, 'pixel://px' || (i % 5) AS source, CASE i % 5 WHEN 0 THEN 'opened' ELSE 'seen' END AS event_name, CAST(NULL AS VARCHAR) AS ua_browser,
 CASE i % 5 WHEN 0 THEN '{"a":"1","b":"2"}' WHEN 2 THEN '{' || array_to_string(list_transform(range(0, 40), lambda z: '"k' || lpad(CAST(z AS VARCHAR), 2, '0') || '":"v"'), ',') || '}' END AS metadata_json FROM p WHERE i % 5 < 3""",
    _WP,
)
_add(
    "unique_visit",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("now"), F.expr("CASE WHEN event_id % 4 > 0 THEN cast(ts as timestamp) - make_interval(0, 0, 0, 0, cast(event_id % 50 as int)) END").alias("ims")).select("event_id", enrich.is_first_today(F.col("ims"), F.col("now")).alias("is_first")),
    "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN ts - to_hours(CAST(event_id % 50 AS INTEGER)) < date_trunc('day', ts) ELSE true END AS is_first FROM events",
)
# text functions of ingest and display
_add("truncate", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", text.truncate("text", 256).alias("t")), f"SELECT doc_id, {cut_sql('text', 256)} AS t FROM documents")
_add("clean_field", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.clean_field(F.when(F.col("turn") % 5 == 0, "   ").otherwise(F.concat(F.lit("  "), "text", F.lit("\n "))), 120).alias("t")), f"SELECT conv_id, turn, CASE WHEN turn % 5 <> 0 THEN {cut_sql('text', 120)} END AS t FROM conversations")
_KEYS = "transform(sequence(1, 40), x -> concat('k', lpad(cast(41 - x as string), 2, '0')))"
_VALUES = "transform(sequence(1, 40), x -> concat(repeat('v', cast(page_id * 50 % 2000 as int)), cast(41 - x as string)))"
_add(
    "metadata_capped",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.expr(f"map_from_arrays({_KEYS}, {_VALUES})").alias("m")).select("page_id", text.metadata_json("m").alias("json")),
    f"SELECT page_id, '{{' || array_to_string(list_transform(range(1, 33), lambda x: '\"k' || lpad(CAST(x AS VARCHAR), 2, '0') || '\":\"' || CASE WHEN length(repeat('v', CAST(page_id * 50 % 2000 AS INTEGER)) || x) <= 1024 THEN repeat('v', CAST(page_id * 50 % 2000 AS INTEGER)) || x ELSE left(repeat('v', CAST(page_id * 50 % 2000 AS INTEGER)) || x, 1024) || '…' END || '\"'), ',') || '}}' AS json FROM pages",
)
_add(
    "source_builders",
    lambda s, d: _pages(s, d).select("i", text.website_source(F.concat(F.lit(" "), F.upper(F.regexp_replace("site", "^https?://", "")), F.lit("."))).alias("website"), text.app_source(F.concat(F.lit(" Svc"), "i", F.lit(" "))).alias("app"), text.pixel_source(F.concat(F.lit("px"), "i")).alias("pixel")).withColumn("scheme", text.source_scheme("app")),
    "SELECT i, 'https://' || lower(regexp_replace(site, '^https?://', '')) AS website, 'app://Svc' || i AS app, 'pixel://px' || i AS pixel, 'app' AS scheme FROM p",
    _WP,
)
_add("day_of", lambda s, d: adapter.facts(s, d).groupBy(store.event_date().cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")), f"SELECT CAST(CAST(make_timestamp(received_ms * 1000) AS DATE) AS VARCHAR) AS day, {_n(('n', 'count(*)'))} FROM f GROUP BY 1", adapter.SQL)
_add("language_names", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", text.language_name(F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "-XX").otherwise(""))).alias("name"), text.language_name(F.lit("tlh")).alias("other")), "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS name, 'tlh' AS other FROM documents")
_add("country_flags", lambda s, d: adapter.facts(s, d).groupBy("country").agg(F.count(F.lit(1)).alias("n")).select("country", text.country_flag("country").alias("flag"), "n"), f"SELECT country, chr(127397 + ascii(country)) || chr(127397 + ascii(substr(country, 2))) AS flag, {_n(('n', 'count(*)'))} FROM f GROUP BY country", adapter.SQL)
_add(
    "consecutive_frames",
    lambda s, d: _pages(s, d).select("i", text.frames(F.expr("'at a' || i || ' (' || url || ')' || chr(10) || 'at a' || (i + 1) || ' (' || url || ')' || chr(13) || chr(10) || '  ' || chr(10) || 'at b' || chr(10) || 'at a (x)' || chr(10) || 'at a (y)'")).alias("f")).select("i", F.array_join("f", "|").alias("frames")),
    "SELECT i, 'at a ()|at b|at a (x)|at a (y)' AS frames FROM p WHERE url NOT LIKE '%?%' UNION ALL SELECT i, 'at a (|at b|at a (x)|at a (y)' FROM p WHERE url LIKE '%?%'",
    _WP,
)
_add("strip_digits", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.length(text.collapse(text.strip_digits(F.lower("text")))).cast("long").alias("n")), f"SELECT doc_id, {_n(('n', f'length({_fold("text")})'))} FROM documents")
_add(
    "normal_message",
    lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.normal_message(F.concat(text.summary_line("text"), F.lit(" 42 see https://x.example/y?z=1 0xBEEF"))).alias("t")),
    f"SELECT i AS conv_id, turn, trim({_fold(_LINE)} || ' see <addr>') AS t FROM c",
    _WC,
)


#: Requests for ranges, one for each event.
_REQUEST = {
    "a": "CASE WHEN seq % 5 > 0 THEN received_ms - (seq % 400) * 345600000 END", "b": "CASE WHEN seq % 3 > 0 THEN received_ms + (seq % 7) * 3600000 END",
    "name": "CASE seq % 8 WHEN 1 THEN 'minute' WHEN 2 THEN '15m' WHEN 3 THEN 'hour' WHEN 4 THEN '4h' WHEN 5 THEN 'day' WHEN 6 THEN 'week' WHEN 7 THEN 'odd' END",
}
_request = [f"{sql} AS {n}" for n, sql in _REQUEST.items()]
_add(
    "resolve_range",
    lambda s, d: adapter.facts(s, d).selectExpr("seq", *_request).select("seq", ranges.resolve_range("a", "b", "name", END).alias("r")).select("seq", "r.*"),
    f"""g AS (SELECT seq, {', '.join(_request)} FROM f), a1 AS (SELECT seq, a, name, greatest(1, least(coalesce(b, {END}), 4102444800000)) AS stop FROM g), b1 AS (SELECT seq, stop, name, greatest(0, least(coalesce(a, stop - 604800000), stop - 1)) AS start FROM a1),
l AS (SELECT unnest([60000, 900000, 3600000, 14400000, 21600000, 86400000, 604800000]) AS r),
w AS (SELECT *, CASE name WHEN 'minute' THEN 60000 WHEN '15m' THEN 900000 WHEN 'hour' THEN 3600000 WHEN '4h' THEN 14400000 WHEN 'week' THEN 604800000 ELSE 86400000 END AS want FROM b1)
SELECT seq, start, stop, CAST(coalesce((SELECT min(r) FROM l WHERE r >= want AND (stop - start) // r <= 2000), greatest((stop - start) // 2000 + 1, 604800000)) AS BIGINT) AS bucket FROM w""",
    adapter.SQL.rstrip() + ", ",
)
_add(
    "range_presets",
    lambda s, d: adapter.facts(s, d).selectExpr("seq", "received_ms", "CASE seq % 8 WHEN 0 THEN '24h' WHEN 1 THEN '7d' WHEN 2 THEN '30d' WHEN 3 THEN '90d' WHEN 4 THEN '180d' WHEN 5 THEN '12m' WHEN 6 THEN 'all' ELSE 'other' END AS name")
    .select("seq", ranges.preset_range("name", "received_ms", START).alias("r"), ranges.custom_interval(F.col("seq") % 300).alias("custom")).select("seq", "r.start", "r.stop", "r.interval", "custom"),
    f"""SELECT seq, CASE seq % 8 WHEN 6 THEN {START} WHEN 7 THEN NULL ELSE received_ms - CAST(list_extract([1, 7, 30, 90, 180, 365], seq % 8 + 1) AS BIGINT) * {DAY_MS} END AS start, CASE WHEN seq % 8 < 7 THEN received_ms END AS stop,
 list_extract(['15m', 'hour', '4h', 'day', 'day', 'week', 'week'], seq % 8 + 1) AS interval, CASE WHEN seq % 300 <= 2 THEN '15m' WHEN seq % 300 <= 14 THEN 'hour' WHEN seq % 300 <= 60 THEN '4h' WHEN seq % 300 <= 200 THEN 'day' ELSE 'week' END AS custom FROM f""",
    adapter.SQL,
)
_add(
    "axis_ticks",
    lambda s, d: adapter.facts(s, d).groupBy(F.expr("received_ms div 3600000").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("duration_ms"), F.lit(0)).alias("longest"))
    .select("hour", ranges.nice_ticks("n").alias("a"), ranges.nice_ticks("longest").alias("b")).select("hour", F.col("a.step").alias("step"), F.col("a.count").alias("count"), F.col("b.step").alias("long_step"), F.col("b.count").alias("long_count")),
    """h AS (SELECT received_ms // 3600000 AS hour, count(*) AS n, coalesce(max(duration_ms), 0) AS longest FROM f GROUP BY 1),
l AS (SELECT greatest(1, CAST(round(m * CAST('1e' || e AS DOUBLE)) AS BIGINT)) AS step, m * CAST('1e' || e AS DOUBLE) AS x, CAST('1e' || e AS DOUBLE) AS p FROM (SELECT unnest([1, 2, 2.5, 5, 10]) AS m), (SELECT unnest(range(-1, 9)) AS e)),
t AS (SELECT v, (SELECT min(step) FROM l WHERE p <= greatest(v / 4, 0.25) AND p * 10 > greatest(v / 4, 0.25) AND 4 * x >= v) AS step FROM (SELECT n AS v FROM h UNION SELECT longest FROM h))
SELECT hour, a.step, greatest(1, CAST(ceil(n / a.step) AS BIGINT)) AS count, b.step AS long_step, greatest(1, CAST(ceil(longest / b.step) AS BIGINT)) AS long_count FROM h JOIN t a ON a.v = n JOIN t b ON b.v = longest""",
    adapter.SQL.rstrip() + ", ",
)


def payload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of all hits and exceptions."""
    return _hits(spark, sf_dir).unionByName(_reports(spark, sf_dir))


def payload_sql() -> str:
    """Common table expressions that end with `lines`: kind, source and received_ms of what ingest makes of the payloads."""
    return f"{_P}, {_C}, lines AS (SELECT kind, source, received_ms FROM ({_EVENT}) UNION ALL SELECT kind, source, received_ms FROM ({_REPORT}))"


_add(
    "project_of_tables",
    lambda s, d: adapter.facts(s, d).where((Fields.of_tables(DASHBOARD, adapter.projects(s), adapter.sources(s).where("uri NOT LIKE 'pixel%'"), pixel_table(s)).is_in("project", ["ALPHA", "p1", "nobody"])).column).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT source, {_n(('n', 'count(*)'))} FROM f WHERE source IN (SELECT uri FROM sources WHERE project_id IN ('p0', 'p1')) GROUP BY source",
    adapter.SQL,
)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)

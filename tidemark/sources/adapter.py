"""The driver's `events` table as fact rows, and small entity tables that go with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fingerprint, referrer_group
from tidemark.schema import COLUMNS, DAY_MS, FACT


def _pick(i: Column, *values) -> Column:
    """The i-th value; None is null."""
    out = F.lit(None).cast("string")
    for n, v in enumerate(values):
        if v is not None:
            out = F.when(i == n, F.lit(v)).otherwise(out)
    return out


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a folder as fact rows; a folder's files are listed when it is first asked for."""
    # plans, not rows: thirty columns take a second or two to describe
    plans = spark.__dict__.setdefault("_tidemark_facts", {})
    if sf_dir not in plans:
        plans[sf_dir] = _facts(spark, sf_dir)
    return plans[sf_dir]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    e = e.select(F.col("event_id").alias("e"), F.col("user_id").alias("u"), "event_type", "value", "props", ms.alias("ms"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    u, k, t = F.col("u"), F.col("k"), F.col("event_type")
    kind = (
        F.when(t == "view", "page_load").when(t == "click", "page_unload").when(t == "error", "exception").when((t == "signup") & (F.col("e") % 5 == 0), "pixel").otherwise("custom")
    )
    e = e.withColumn("kind", kind)
    is_ = lambda *x: F.col("kind").isin(*x)
    day = F.expr(f"ms div {DAY_MS}")
    person = ~is_("pixel")
    place = F.when(is_("page_load", "page_unload", "custom"), F.concat(F.lit("/p"), (k % 12).cast("string")))
    e = e.withColumn("day", day).withColumn("pathname", place)
    first = lambda *by: is_("page_load") & (F.row_number().over(Window.partitionBy("u", "day", *by, is_("page_load")).orderBy("ms", "e")) == 1)
    host = F.when(is_("page_load"), _pick(k % 5, None, "google.com", "t.co", "blog.example.org", ""))
    browser = F.when(person, _pick(u % 5, "Chrome", "Firefox", "Safari", "Edge", None))
    utm = is_("page_load") & (k % 7 == 0)
    exc = is_("exception")
    kt = (k % 4).cast("string")
    stack = F.when(exc & (k % 2 == 1), F.concat(F.lit("at handler (https://cdn.example.com/js/app.js:"), kt, F.lit(":2)\nat main (/srv/app/lib/util.js:10:"), kt, F.lit(")")))
    typed = F.when(exc, _pick(u % 3, "TypeError", "RangeError", "NetworkError"))
    message = F.when(exc, F.concat(F.lit("boom at "), kt))
    cols = {
        "created_ms": F.col("ms"), "received_ms": F.col("ms"), "seq": F.col("e"),
        "bid": F.when(person, F.concat(F.lit("b"), u, F.lit("-"), F.expr("ms div 3600000"))).otherwise(""),
        "sid": F.when(person & (F.col("e") % 10 != 0), F.concat(F.lit("s"), u, F.lit("-"), F.col("day"))),
        "kind": F.col("kind"),
        "source": F.when(person, _pick(u % 4, "https://site0.example.com", "https://site1.example.com", "app://svc2", "https://site3.example.com")).otherwise(F.concat(F.lit("pixel://px"), u % 3)),
        "pathname": F.col("pathname"), "is_unique_user": first(), "is_unique_page": first("pathname"),
        "referrer_host": host, "referrer_group": referrer_group(host),
        "country": F.when(person & ~exc, _pick(u % 6, "US", "DE", "FR", "GB", "JP", None)), "language": F.when(person & ~exc, _pick(u % 4, "en", "de", "fr", None)),
        "ua_browser": browser, "ua_version": F.when(browser.isNotNull(), _pick(u % 3, "120.0", "121.0", "17.1")), "ua_os": F.when(person, _pick(u % 4, "Windows", "macOS", "Linux", None)), "ua_device": F.when(person, _pick(u % 3, "Desktop", "Mobile", None)),
        "utm_source": F.when(utm, _pick(k % 2, "newsletter", "ads")), "utm_medium": F.when(utm, _pick(k % 2, "email", "cpc")), "utm_campaign": F.when(utm, F.concat(F.lit("c"), k % 3)),
        "duration_ms": F.when(is_("page_unload"), F.floor(F.col("value") * 100).cast("long")),
        "event_name": F.when(is_("custom", "pixel") & (k % 17 != 0), t), "metadata_json": F.when(is_("custom") | (exc & (k % 3 == 0)), F.col("props")),
        "app_version": F.when(exc & (k % 7 != 0), F.concat(F.lit("1."), u % 3, F.lit(".0"))),
        "exc_type": typed, "exc_message": message, "exc_stack": stack, "exc_group": F.when(exc, fingerprint(typed, message, stack)), "exc_handled": F.when(exc, k % 4 == 1),
    }
    assert list(cols) == COLUMNS
    return e.select(*[c.cast(FACT[n].dataType).alias(n) for n, c in cols.items()])


def projects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p0", "Alpha"), ("p1", "Beta"), ("p2", "Gamma")], "id string, name string")


def sources(spark: SparkSession) -> DataFrame:
    """Known source URIs and pixels with the project that owns them; site3 and px2 of no project or an unknown one."""
    rows = [("https://site0.example.com", "p0"), ("https://site1.example.com", "p0"), ("app://svc2", "p1"), ("https://site3.example.com", None), ("pixel://px0", "p0"), ("pixel://px1", "p1"), ("pixel://px2", "gone")]
    return spark.createDataFrame(rows, "uri string, project_id string")


def country_names(spark: SparkSession) -> DataFrame:
    """Names of some of the countries; the others show their code."""
    return spark.createDataFrame([("US", "United States"), ("DE", "Germany"), ("FR", "France")], "code string, name string")


def triage(spark: SparkSession) -> DataFrame:
    """States of some groups, as schema.TRIAGE; the last is of a source that its project does not own."""
    rows = [
        ("p0", "TypeError", "https://site0.example.com", 1_706_000_000, None), ("p0", "RangeError", "https://site0.example.com", None, 1_704_000_000), ("p0", "RangeError", "https://site1.example.com", 1_800_000_000, None),
        ("p1", "NetworkError", "app://svc2", None, 1_704_000_000), ("p0", "TypeError", "app://svc2", 1_800_000_000, None),
    ]
    df = spark.createDataFrame(rows, "project_id string, kind string, source string, resolved long, muted long")
    group = fingerprint("kind", F.lit("boom at 1"), F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    return df.select("project_id", group.alias("group_id"), "source", F.timestamp_seconds("resolved").alias("resolved_at"), F.timestamp_seconds("muted").alias("muted_at"), none.alias("note"), F.timestamp_seconds(F.lit(1_704_000_000)).alias("updated_at"), none.alias("updated_by"))


#: The same rows for the oracle, as common table expressions.
SQL = r"""WITH e0 AS (SELECT event_id AS e, user_id AS u, event_type AS t, value, props, epoch_us(ts) // 1000 AS ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
e1 AS (SELECT *, CASE WHEN t = 'view' THEN 'page_load' WHEN t = 'click' THEN 'page_unload' WHEN t = 'error' THEN 'exception' WHEN t = 'signup' AND e % 5 = 0 THEN 'pixel' ELSE 'custom' END AS kind, ms // 86400000 AS day FROM e0),
e2 AS (SELECT *, CASE WHEN kind IN ('page_load', 'page_unload', 'custom') THEN '/p' || (k % 12) END AS pathname, kind <> 'pixel' AS person, kind = 'exception' AS exc,
  CASE WHEN kind = 'page_load' THEN CASE k % 5 WHEN 1 THEN 'google.com' WHEN 2 THEN 't.co' WHEN 3 THEN 'blog.example.org' WHEN 4 THEN '' END END AS referrer_host FROM e1),
f AS (SELECT ms AS created_ms, ms AS received_ms, e AS seq, CASE WHEN person THEN 'b' || u || '-' || (ms // 3600000) ELSE '' END AS bid,
  CASE WHEN person AND e % 10 <> 0 THEN 's' || u || '-' || day END AS sid, kind,
  CASE WHEN person THEN CASE u % 4 WHEN 0 THEN 'https://site0.example.com' WHEN 1 THEN 'https://site1.example.com' WHEN 2 THEN 'app://svc2' ELSE 'https://site3.example.com' END ELSE 'pixel://px' || (u % 3) END AS source, pathname,
  kind = 'page_load' AND row_number() OVER (PARTITION BY u, day, kind = 'page_load' ORDER BY ms, e) = 1 AS is_unique_user,
  kind = 'page_load' AND row_number() OVER (PARTITION BY u, day, pathname, kind = 'page_load' ORDER BY ms, e) = 1 AS is_unique_page,
  referrer_host, CASE referrer_host WHEN 'google.com' THEN 'Search' WHEN 't.co' THEN 'Social' END AS referrer_group,
  CASE WHEN person AND NOT exc THEN CASE u % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'GB' WHEN 4 THEN 'JP' END END AS country,
  CASE WHEN person AND NOT exc THEN CASE u % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END END AS language,
  CASE WHEN person THEN CASE u % 5 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Safari' WHEN 3 THEN 'Edge' END END AS ua_browser,
  CASE WHEN person AND u % 5 <> 4 THEN CASE u % 3 WHEN 0 THEN '120.0' WHEN 1 THEN '121.0' ELSE '17.1' END END AS ua_version,
  CASE WHEN person THEN CASE u % 4 WHEN 0 THEN 'Windows' WHEN 1 THEN 'macOS' WHEN 2 THEN 'Linux' END END AS ua_os,
  CASE WHEN person THEN CASE u % 3 WHEN 0 THEN 'Desktop' WHEN 1 THEN 'Mobile' END END AS ua_device,
  CASE WHEN kind = 'page_load' AND k % 7 = 0 THEN CASE k % 2 WHEN 0 THEN 'newsletter' ELSE 'ads' END END AS utm_source,
  CASE WHEN kind = 'page_load' AND k % 7 = 0 THEN CASE k % 2 WHEN 0 THEN 'email' ELSE 'cpc' END END AS utm_medium,
  CASE WHEN kind = 'page_load' AND k % 7 = 0 THEN 'c' || (k % 3) END AS utm_campaign,
  CASE WHEN kind = 'page_unload' THEN CAST(floor(value * 100) AS BIGINT) END AS duration_ms,
  CASE WHEN kind IN ('custom', 'pixel') AND k % 17 <> 0 THEN t END AS event_name,
  CASE WHEN kind = 'custom' OR (exc AND k % 3 = 0) THEN props END AS metadata_json,
  CASE WHEN exc AND k % 7 <> 0 THEN '1.' || (u % 3) || '.0' END AS app_version,
  CASE WHEN exc THEN CASE u % 3 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'RangeError' ELSE 'NetworkError' END END AS exc_type,
  CASE WHEN exc THEN 'boom at ' || (k % 4) END AS exc_message,
  CASE WHEN exc AND k % 2 = 1 THEN 'at handler (https://cdn.example.com/js/app.js:' || (k % 4) || ':2)' || chr(10) || 'at main (/srv/app/lib/util.js:10:' || (k % 4) || ')' END AS exc_stack,
  CASE WHEN exc THEN substr(sha256(unhex(sha256(CASE u % 3 WHEN 0 THEN 'typeerror' WHEN 1 THEN 'rangeerror' ELSE 'networkerror' END || chr(10) ||
    CASE WHEN k % 2 = 1 THEN 'at handler ()' || chr(10) || 'at main (util.js::)' || chr(10) ELSE 'boom at' END))), 1, 16) END AS exc_group,
  CASE WHEN exc THEN k % 4 = 1 END AS exc_handled FROM e2),
projects(id, name) AS (VALUES ('p0', 'Alpha'), ('p1', 'Beta'), ('p2', 'Gamma')),
sources(uri, project_id) AS (VALUES ('https://site0.example.com', 'p0'), ('https://site1.example.com', 'p0'), ('app://svc2', 'p1'), ('https://site3.example.com', NULL), ('pixel://px0', 'p0'), ('pixel://px1', 'p1'), ('pixel://px2', 'gone')),
triage AS (SELECT project_id, substr(sha256(unhex(sha256(lower(t) || chr(10) || 'boom at'))), 1, 16) AS group_id, source, resolved_ms, muted_ms FROM (VALUES ('p0', 'TypeError', 'https://site0.example.com', 1706000000000, NULL),
  ('p0', 'RangeError', 'https://site0.example.com', NULL, 1704000000000), ('p0', 'RangeError', 'https://site1.example.com', 1800000000000, NULL), ('p1', 'NetworkError', 'app://svc2', NULL, 1704000000000),
  ('p0', 'TypeError', 'app://svc2', 1800000000000, NULL)) x(project_id, t, source, resolved_ms, muted_ms))
"""

"""From wire payloads to fact rows.

Input rows have the payload's fields beside the request's: user_agent, accept_language, dnt, sec_gpc
and received_ms. Everything but URL and user-agent parsing is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.agents import ua_classes, url_fields
from tidemark.schema import HIT, MAX_APP_FIELD, MAX_BODY, MAX_FIELD, MAX_MESSAGE, MAX_PATH, MAX_STACK, REPORT
from tidemark.sources.scan import conform


def parse(lines: DataFrame, kind: str) -> DataFrame:
    """JSON text in column `body` as payload columns; lines of more than MAX_BODY bytes, that are no JSON object, or a hit of an unknown kind, go."""
    schema = HIT if kind == "hit" else REPORT
    rows = lines.where(F.octet_length("body") <= MAX_BODY).withColumn("p", F.from_json("body", schema)).where(F.col("p.u").isNotNull())
    if kind == "hit":
        rows = rows.where(F.coalesce("p.e", F.lit("load")).isin("load", "unload", "custom"))
    return rows.select("p.*", *[c for c in lines.columns if c != "body"])


def allowed(df: DataFrame) -> DataFrame:
    """Without requests that ask not to be tracked."""
    return df.where(~(F.col("dnt").eqNullSafe("1") | F.col("sec_gpc").eqNullSafe("1")))


def _client(df: DataFrame) -> DataFrame:
    df = df.withColumn("ua", ua_classes("user_agent")).withColumn("url", url_fields("u"))
    return df.where((F.col("ua.kind") != "Bot") & F.col("url.host").isNotNull())


def _ua() -> list:
    return [F.col(f"ua.{a}").alias(b) for a, b in (("app", "ua_browser"), ("version", "ua_version"), ("os", "ua_os"), ("kind", "ua_device"))]


def hits(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Page loads, unloads and custom events. zones: (zone, country), a few hundred rows."""
    df = _client(allowed(df)).withColumn("ref", url_fields("r"))
    df = df.join(zones, df["t"] == zones["zone"], "left")
    host = F.when(F.col("ref.host") != F.col("url.host"), F.col("ref.host"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("load", "page_load", "unload", "page_unload", "custom", "custom")]), F.coalesce("e", F.lit("load"))), F.lit("page_load"))
    return conform(
        df.select(
            F.col("received_ms").alias("created_ms"), "received_ms", F.lit(0).alias("seq"), F.coalesce(text.truncate("b", MAX_FIELD), F.lit("")).alias("bid"), text.clean_field("i", MAX_FIELD).alias("sid"), kind.alias("kind"),
            text.website_source("url.host").alias("source"), text.truncate(text.normalize_path("url.path"), MAX_PATH).alias("pathname"), F.coalesce("q", F.lit(False)).alias("is_unique_user"), F.coalesce("p", F.lit(False)).alias("is_unique_page"),
            host.alias("referrer_host"), text.referrer_group(host).alias("referrer_group"), "country", text.primary_language("accept_language").alias("language"), *_ua(),
            *[text.utm("u", n).alias(n) for n in ("utm_source", "utm_medium", "utm_campaign")], F.col("m").alias("duration_ms"),
            text.truncate("n", MAX_FIELD).alias("event_name"), text.metadata_json("d").alias("metadata_json"),
        )
    )


def reports(df: DataFrame) -> DataFrame:
    """Exceptions. Groups are made from the whole texts, which are stored cut."""
    df = _client(allowed(df))
    return conform(
        df.select(
            F.col("received_ms").alias("created_ms"), "received_ms", F.lit(0).alias("seq"), F.coalesce("b", F.lit("")).alias("bid"), text.clean_field("i", MAX_FIELD).alias("sid"), F.lit("exception").alias("kind"),
            text.website_source("url.host").alias("source"), F.lit(False).alias("is_unique_user"), F.lit(False).alias("is_unique_page"), *_ua(), text.metadata_json("d", capped=False).alias("metadata_json"),
            text.clean_field("v", MAX_APP_FIELD).alias("app_version"), text.truncate("ty", MAX_MESSAGE).alias("exc_type"), text.truncate("m", MAX_MESSAGE).alias("exc_message"), text.truncate("s", MAX_STACK).alias("exc_stack"),
            text.fingerprint("ty", "m", "s", "fp").alias("exc_group"), F.coalesce("h", F.lit(False)).alias("exc_handled"),
        )
    )


def pixel_hits(df: DataFrame, pixels: DataFrame) -> DataFrame:
    """Hits (pixel_id, received_ms) of known pixels; the id may end in .gif."""
    known = df.join(pixels, F.regexp_replace(df["pixel_id"], r"\.gif\z", "") == pixels["id"])
    return conform(
        known.select(
            F.col("received_ms").alias("created_ms"), "received_ms", F.lit(0).alias("seq"), F.lit("").alias("bid"), F.lit("pixel").alias("kind"), text.pixel_source("id").alias("source"),
            F.lit(False).alias("is_unique_user"), F.lit(False).alias("is_unique_page"), "event_name", text.metadata_json("metadata", capped=False).alias("metadata_json"),
        )
    )


def is_first_today(if_modified_since, now):
    """A visitor without a cached answer from today is new today."""
    return if_modified_since.isNull() | (if_modified_since < F.date_trunc("day", now))

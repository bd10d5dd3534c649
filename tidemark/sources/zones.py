"""Countries of time zones, from tables of the tz database that are handed in as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.log import Files
from tidemark.sources.store import written

#: Links are followed this far, so a ring of links ends.
HOPS = 32
FOLDER = "file:///usr/share/zoneinfo"


def countries_of_tabs(zone_tab: DataFrame, zone1970_tab: DataFrame) -> DataFrame:
    """(zone, country) from lines (column value) of zone.tab, and of zone1970.tab, by its first country, for zones that the other lacks."""

    def rows(lines: DataFrame, place: int) -> DataFrame:
        parts = F.split("value", "\t")
        code = F.trim(F.substring_index(F.get(parts, F.lit(0)), ",", 1))
        return lines.where(~F.startswith("value", F.lit("#"))).select(F.get(parts, F.lit(2)).alias("zone"), code.alias("country"), F.lit(place).alias("place")).where("zone IS NOT NULL AND country <> ''")

    return rows(zone_tab, 0).unionByName(rows(zone1970_tab, 1)).groupBy("zone").agg(F.min_by("country", "place").alias("country"))


def links_of_rules(lines: DataFrame) -> DataFrame:
    """(alias, target) from lines of tz source files, in which a link is `L target alias` or `Link target alias`; # begins a comment."""
    parts = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    return lines.select(parts.alias("p")).where(F.get("p", F.lit(0)).isin("L", "Link") & (F.size("p") >= 3)).groupBy(F.get("p", F.lit(2)).alias("alias")).agg(F.max(F.get("p", F.lit(1))).alias("target"))


def with_links(known: DataFrame, links: DataFrame, hops: int = HOPS) -> DataFrame:
    """(zone, country) of known zones, and of aliases of which a chain of at most `hops` links leads to one. A chain ends at the first known zone.

    Chains double in each step, so a few joins follow them all. Where aliases have one target, as links
    have, no step has more rows than there are links.
    """
    arrived = F.col("zone").isNotNull()
    step = links.where("alias IS NOT NULL").join(known, F.col("alias") == F.col("zone"), "left_anti").join(known, F.col("target") == F.col("zone"), "left")
    step, way, rest = written(step.select("alias", F.when(~arrived, F.col("target")).alias("now"), "country", arrived.alias("arrived")).distinct(), "ways"), None, int(hops)
    while rest > 0:
        if step.where("NOT arrived").isEmpty():  # all chains have ended
            way = step
            break
        if rest & 1:
            way = step if way is None else written(_onwards(way, step), "ways")
        rest >>= 1
        if rest:
            step = written(_onwards(step, step), "ways")
    return known if way is None else known.unionByName(way.where("arrived").select(F.col("alias").alias("zone"), "country").distinct())


def _onwards(first: DataFrame, then: DataFrame) -> DataFrame:
    """Ways (alias, now, country, arrived) that were not at an end after `first`, continued by `then`. A way that nothing continues goes."""
    then = then.select(F.col("alias").alias("now"), F.col("now").alias("_now"), F.col("country").alias("_country"), F.col("arrived").alias("_arrived"))
    more = first.where("NOT arrived").join(then, "now").select("alias", F.col("_now").alias("now"), F.col("_country").alias("country"), F.col("_arrived").alias("arrived"))
    return first.where("arrived").unionByName(more).distinct()


def zones(spark: SparkSession, folder: str = FOLDER) -> DataFrame:
    """(zone, country) of a folder with zone.tab, zone1970.tab and tzdata.zi, as rows that the plan holds: there are some six hundred. A session reads a folder once.

    The default folder is one of the driver's machine; on a cluster hand in one that all machines can read.
    """
    kept = spark.__dict__.setdefault("_tidemark_zones", {})
    if folder not in kept:
        files, empty = Files(spark, folder), spark.createDataFrame([], "value string")
        lines = [spark.read.text(f"{folder}/{n}") if files.exists(f"{folder}/{n}") else empty for n in ("zone.tab", "zone1970.tab", "tzdata.zi")]
        found = [tuple(r) for r in with_links(countries_of_tabs(*lines[:2]), links_of_rules(lines[2])).orderBy("zone").collect()]
        if not found:
            raise FileNotFoundError(f"no time-zone tables in {folder}; hand in another folder or a table (zone, country)")
        kept[folder] = spark.createDataFrame(found, "zone string, country string")
    return kept[folder]


def countries(spark: SparkSession, folder: str = FOLDER) -> DataFrame:
    """(code, name) of a folder's iso3166.tab; empty where it has none."""
    if not Files(spark, folder).exists(f"{folder}/iso3166.tab"):
        return spark.createDataFrame([], "code string, name string")
    parts = F.split("value", "\t")
    return spark.read.text(f"{folder}/iso3166.tab").where(~F.startswith("value", F.lit("#"))).select(F.get(parts, F.lit(0)).alias("code"), F.get(parts, F.lit(1)).alias("name")).where("name IS NOT NULL")

"""Registered queries of storage: each writes the whole events table to folders of its own and reads it back, with DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.ingest_catalog import END, HALF, START, payload_lines, payload_sql, pixel_table
from tidemark.operators import details
from tidemark.schema import DAY_MS, TRIAGE
from tidemark.sources import adapter, hot, scan, store, zones
from tidemark.sources.entities import Entities
from tidemark.streaming import ingest

_QUERIES: dict = {}
_SQL: dict = {}


def _add(name: str, query, sql: str, base: str = adapter.SQL) -> None:
    _QUERIES[name], _SQL[name] = query, base + sql


def _n(*pairs: tuple[str, str]) -> str:
    return ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in pairs)


def _hot(spark: SparkSession, *frames: DataFrame) -> hot.HotStore:
    out = hot.HotStore(spark, store.new_folder(spark, "hot"))
    for df in frames:
        out.append(df)
    return out


def _cold(spark: SparkSession, df: DataFrame) -> str:
    at = store.new_folder(spark, "cold")
    store.write_cold(df, at)
    return at


def _by_day(df: DataFrame, place: str) -> DataFrame:
    return df.groupBy(F.lit(place).alias("place"), store.event_date().cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_day = "CAST(CAST(make_timestamp(received_ms * 1000) AS DATE) AS VARCHAR)"


def _count():
    return F.count(F.lit(1)).alias("n")


def _append(spark, sf_dir) -> DataFrame:
    df = store.written(adapter.facts(spark, sf_dir), "facts")  # a batch filters rows only after their windows
    rows = _hot(spark, df.where("seq % 2 = 0"), df.where("seq % 2 = 1"))
    return rows.read().groupBy("kind").agg(_count(), F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum("seq").alias("total")).withColumn("used", F.lit(rows.state()["next_seq"] - 1).cast("long"))


_add(
    "append_batches",
    _append,
    f"""SELECT kind, {_n(('n', 'count(*)'), ('first', 'min(k)'), ('last', 'max(k)'), ('total', 'sum(k)'))}, CAST(max(used) AS BIGINT) AS used FROM (SELECT kind, (SELECT count(*) FROM f) AS used,
 row_number() OVER (PARTITION BY seq % 2 ORDER BY received_ms, created_ms, bid, sid NULLS FIRST, kind, source, pathname NULLS FIRST) + CASE WHEN seq % 2 = 1 THEN (SELECT count(*) FROM f WHERE seq % 2 = 0) ELSE 0 END AS k FROM f) GROUP BY kind""",
)


def _compact(spark, sf_dir) -> DataFrame:
    rows, cold = _hot(spark, adapter.facts(spark, sf_dir)), store.new_folder(spark, "cold")
    due = store.cutoff(END, 10 * DAY_MS + 3_600_000)
    rows.copy_old(cold, due)  # a run that is killed before it publishes
    rows.compact(cold, due)
    return _by_day(scan.read_cold(spark, cold), "cold").unionByName(_by_day(rows.read(), "hot"))


_add("compaction", _compact, f"SELECT CASE WHEN received_ms < {END - 10 * DAY_MS - 3_600_000} THEN 'cold' ELSE 'hot' END AS place, {_day} AS day, {_n(('n', 'count(*)'))} FROM f GROUP BY 1, 2")
_add(
    "cold_window",
    lambda s, d: _by_day(scan.read_cold(s, _cold(s, adapter.facts(s, d)), HALF, HALF + 3 * DAY_MS), "cold"),
    f"SELECT 'cold' AS place, {_day} AS day, {_n(('n', 'count(*)'))} FROM f WHERE received_ms >= {HALF} AND received_ms < {HALF + 4 * DAY_MS} GROUP BY 2",
)


def _both(spark, sf_dir) -> DataFrame:
    rows, cold = _hot(spark, adapter.facts(spark, sf_dir)), store.new_folder(spark, "cold")
    rows.copy_old(cold, HALF + DAY_MS)  # its rows are in both places
    return _by_day(scan.window(spark, cold, rows, START + DAY_MS, END), "all")


_add("both_places", _both, f"SELECT 'all' AS place, {_day} AS day, {_n(('n', 'count(*)'))} FROM f WHERE received_ms >= {START + DAY_MS} GROUP BY 2")


def _shared(spark, sf_dir) -> DataFrame:
    """A stream, two appends, two compactions of which the first is killed, and regrouping on one store."""
    df, rows, cold = adapter.facts(spark, sf_dir), _hot(spark), store.new_folder(spark, "cold")
    folder, mark = store.new_folder(spark, "lines"), store.new_folder(spark, "mark")
    lines = payload_lines(spark, sf_dir)
    stream = lambda: ingest.start(spark, folder, rows, mark, zones.zones(spark), once=True, files_per_trigger=2).awaitTermination()
    rows.append(df.where("seq % 2 = 0"))
    lines.where("received_ms % 2 = 0").repartition(3).write.mode("append").json(folder)
    stream()
    rows.copy_old(cold, HALF)
    rows.append(df.where("seq % 2 = 1"))
    moved = rows.compact(cold, HALF)
    lines.where("received_ms % 2 = 1").repartition(3).write.mode("append").json(folder)
    stream()
    rows.regroup()
    moved += hot.upkeep(rows, cold, END, "query", keep_hot_ms=END - HALF)["moved"]
    every = scan.window(spark, cold, rows, 0, END).groupBy("kind").agg(_count(), F.count_distinct("seq").alias("numbers"))
    places = scan.read_cold(spark, cold).groupBy(F.lit("cold").alias("kind")).agg(_count(), F.count_distinct("seq").alias("numbers"))
    return every.unionByName(places).withColumn("numbered", F.lit(rows.state()["next_seq"] - 1 - rows.read().count()).cast("long") - scan.read_cold(spark, cold).count())


_add(
    "hot_store_shared",
    _shared,
    f"every AS (SELECT kind, received_ms FROM f UNION ALL SELECT kind, received_ms FROM lines) SELECT kind, {_n(('n', 'count(*)'), ('numbers', 'count(*)'), ('numbered', '0'))} FROM every GROUP BY 1 UNION ALL SELECT 'cold', count(*), count(*), 0 FROM every WHERE received_ms < {HALF}",
    adapter.SQL.rstrip() + f", {payload_sql()}, ",
)


def _retention(spark, sf_dir) -> DataFrame:
    cold = _cold(spark, adapter.facts(spark, sf_dir))
    gone = store.enforce_retention(spark, cold, END, 10 * DAY_MS)
    return _by_day(scan.read_cold(spark, cold), "cold").withColumn("deleted", F.lit(len(gone)).cast("long"))


_kept = f"(received_ms // {DAY_MS} + 1) * {DAY_MS} - 1000 >= {END - 10 * DAY_MS}"
_add("retention", _retention, f"SELECT 'cold' AS place, {_day} AS day, {_n(('n', 'count(*)'))}, (SELECT count(DISTINCT received_ms // {DAY_MS}) FROM f WHERE NOT ({_kept})) AS deleted FROM f WHERE {_kept} GROUP BY 2")


def _earliest(spark, sf_dir) -> DataFrame:
    df = adapter.facts(spark, sf_dir)
    cold, young, none = _cold(spark, df), _hot(spark, df.where(F.col("received_ms") >= HALF)), store.new_folder(spark, "cold")
    found = [("cold", scan.earliest_ms(spark, cold, young)), ("hot", scan.earliest_ms(spark, none, young)), ("none", scan.earliest_ms(spark, none, _hot(spark)))]
    files = scan.Files(spark, cold)
    files.fs.mkdirs(files.path(f"{cold}/event_date=2001-02-03"))
    found.append(("empty day", scan.earliest_ms(spark, cold, young)))
    return spark.createDataFrame(found, "place string, ms long")


_add(
    "earliest_event",
    _earliest,
    f"SELECT 'cold' AS place, CAST(min(received_ms) // {DAY_MS} * {DAY_MS} AS BIGINT) AS ms FROM f UNION ALL SELECT 'hot', CAST(min(received_ms) AS BIGINT) FROM f WHERE received_ms >= {HALF} UNION ALL SELECT 'none', NULL UNION ALL SELECT 'empty day', epoch_ms(TIMESTAMP '2001-02-03')",
)


def _files(spark, sf_dir) -> DataFrame:
    """Days by listing alone, and rows by footers; one file is junk."""
    cold = _cold(spark, adapter.facts(spark, sf_dir))
    files = scan.Files(spark, cold)
    files.publish("no parquet at all", f"{cold}/event_date=2024-01-05/shard=3/part-junk.parquet")
    listed = scan.check_files(spark, cold, START, END).groupBy(F.col("event_date").cast("string").alias("day")).agg(F.sum("rows").alias("n"), F.count_if(F.col("rows").isNull()).alias("unreadable"))
    told: list[str] = []
    read = scan.read_cold(spark, cold, START, END, told.extend)
    return listed.unionByName(read.groupBy(F.lit("all").alias("day")).agg(_count()).withColumn("unreadable", F.lit(len(told)).cast("long")))


_add(
    "cold_files",
    _files,
    f"SELECT {_day} AS day, {_n(('n', 'count(*)'))}, CASE WHEN {_day} = '2024-01-05' THEN 1::BIGINT ELSE 0 END AS unreadable FROM f GROUP BY 1 UNION ALL SELECT 'all', count(*), 1 FROM f",
)
_add("before_threshold", lambda s, d: scan.before(adapter.facts(s, d), HALF).groupBy("kind").agg(_count(), F.max("seq").alias("last")), f"SELECT kind, {_n(('n', 'count(*)'), ('last', 'max(seq)'))} FROM f WHERE received_ms < {HALF} GROUP BY kind")


def _delete(spark, sf_dir) -> DataFrame:
    rows = _hot(spark, adapter.facts(spark, sf_dir))
    gone = rows.delete_keys(rows.read().where("seq % 3 = 0").select("seq"))
    return rows.read().groupBy("kind").agg(_count(), F.sum("seq").alias("total")).withColumn("gone", F.lit(gone).cast("long"))


_RANK = "row_number() OVER (ORDER BY received_ms, created_ms, bid, sid NULLS FIRST, kind, source, pathname NULLS FIRST) AS k"
_add("delete_keys", _delete, f"SELECT kind, {_n(('n', 'count(*)'), ('total', 'sum(k)'))}, (SELECT CAST(count(*) // 3 AS BIGINT) FROM f) AS gone FROM (SELECT kind, {_RANK} FROM f) WHERE k % 3 <> 0 GROUP BY kind")


def _regroup(spark, sf_dir) -> DataFrame:
    stale = adapter.facts(spark, sf_dir).withColumn("exc_group", F.when(F.col("exc_group").isNotNull() & (F.col("seq") % 3 == 0), "old").otherwise(F.col("exc_group")))
    state, aside = store.new_folder(spark, "state"), store.new_folder(spark, "staging")
    rows, cold = _hot(spark, stale.where(F.col("received_ms") >= HALF)), _cold(spark, stale.where(F.col("received_ms") < HALF))
    changed = store.regroup_if_needed(spark, rows, cold, state, aside, END)
    again = store.regroup_if_needed(spark, rows, cold, state, aside, END)
    groups = rows.read().unionByName(scan.read_cold(spark, cold)).where("exc_group IS NOT NULL").groupBy(F.col("exc_group").alias("what")).agg(_count())
    marks = spark.createDataFrame([("hot", changed[0]), ("cold", changed[1]), ("version", store.applied_version(spark, state)), ("again", int(again is not None))], "what string, n long")
    return groups.unionByName(marks)


_old = "exc_group IS NOT NULL AND seq % 3 = 0"
_add(
    "regroup",
    _regroup,
    f"""SELECT exc_group AS what, {_n(('n', 'count(*)'))} FROM f WHERE exc_group IS NOT NULL GROUP BY 1 UNION ALL SELECT 'hot', count(*) FROM f WHERE {_old} AND received_ms >= {HALF}
 UNION ALL SELECT 'cold', count(*) FROM f WHERE {_old} AND received_ms < {HALF} UNION ALL SELECT 'version', {store.FINGERPRINT_VERSION} UNION ALL SELECT 'again', 0""",
)


# point lookups on the table as it is written
def _session(spark, sf_dir) -> DataFrame:
    df = adapter.facts(spark, sf_dir)
    sid = df.where(details.has_session()).groupBy("sid").agg(_count()).orderBy(F.desc("n"), "sid").first().sid
    return details.session_timeline(scan.read_session(spark, _cold(spark, df), sid, START, END), sid)


_SID = "(SELECT sid FROM f WHERE sid <> '' GROUP BY sid ORDER BY count(*) DESC, sid LIMIT 1)"
_add("session_lookup", _session, f"SELECT received_ms, seq, kind, bid, pathname, event_name, exc_type, exc_message, duration_ms, metadata_json FROM (SELECT * FROM f WHERE sid = {_SID} ORDER BY received_ms, seq LIMIT 1000) WHERE kind <> 'pixel'")


def _group(spark, sf_dir) -> DataFrame:
    df = adapter.facts(spark, sf_dir)
    cold = _cold(spark, df)
    group = details.exceptions(df).groupBy("exc_group").agg(_count()).orderBy(F.desc("n"), "exc_group").first().exc_group
    rows = scan.read_group(spark, cold, group, START, END)
    ids = [r.sid for r in rows.where(details.has_session()).groupBy("sid").agg(F.max(details.order()).alias("o")).orderBy(F.desc("o"), "sid").limit(10).collect()]
    sessions = scan.read_sessions(spark, cold, ids, START, END).groupBy("sid").agg(_count()).select(F.col("sid").alias("what"), "n", F.lit(None).cast("long").alias("first_ms"))
    return rows.groupBy(F.col("source").alias("what")).agg(_count(), F.min("received_ms").alias("first_ms")).unionByName(sessions)


_GROUP = "(SELECT exc_group FROM f WHERE kind = 'exception' AND exc_group IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_add(
    "exception_lookup",
    _group,
    f"""SELECT source AS what, {_n(('n', 'count(*)'))}, min(received_ms) AS first_ms FROM f WHERE exc_group = {_GROUP} GROUP BY 1 UNION ALL
 SELECT sid, count(*), NULL FROM f WHERE sid IN (SELECT sid FROM f WHERE exc_group = {_GROUP} AND sid <> '' GROUP BY sid ORDER BY max((received_ms, seq)) DESC, sid LIMIT 10) GROUP BY 1""",
)


def _events(spark, sf_dir) -> DataFrame:
    df = adapter.facts(spark, sf_dir)
    name = df.where("kind IN ('custom', 'pixel') AND event_name IS NOT NULL").groupBy("event_name").agg(_count()).orderBy(F.desc("n"), "event_name").first().event_name
    return details.event_variants(scan.read_events(spark, _cold(spark, df), name, HALF, END), 50).select("metadata_json", "n", "first_ms", "last_ms")


_NAME = "(SELECT event_name FROM f WHERE kind IN ('custom', 'pixel') AND event_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_add(
    "event_lookup",
    _events,
    f"SELECT metadata_json, {_n(('n', 'count(*)'))}, min(received_ms) AS first_ms, max(received_ms) AS last_ms FROM f WHERE kind IN ('custom', 'pixel') AND event_name = {_NAME} AND received_ms >= {HALF} GROUP BY 1 ORDER BY n DESC, metadata_json NULLS FIRST LIMIT 50",
)


def _entities(spark, sf_dir) -> DataFrame:
    """Changes to the small tables, two of which meet: both count."""
    start = {"projects": adapter.projects(spark), "sources": adapter.sources(spark).withColumns({"kind": F.lit("website"), "created_at": F.lit(None).cast("timestamp"), "first_seen": F.lit(None).cast("timestamp"), "last_seen": F.lit(None).cast("timestamp")}), "pixels": pixel_table(spark)}
    tables = Entities(spark, store.new_folder(spark, "entities"), {n: df.schema for n, df in start.items()} | {"triage": TRIAGE})
    tables.update(lambda t: start)
    project = lambda *row: spark.createDataFrame([row], "id string, name string")
    calls: list[int] = []

    def meets(t: dict) -> dict:
        calls.append(1)
        if len(calls) == 1:  # another caller comes between
            tables.put_project(project("p3", "Delta"))
        return {"projects": store.put_project(t["projects"], project("p1", "Better"))}

    tables.update(meets)
    try:
        tables.put_project(project("p4", "aLPHA"))
        clash = 0
    except ValueError:
        clash = 1
    tables.delete_project("p0")
    tables.update(lambda t: {"sources": t["sources"].where("uri LIKE 'https%'")})
    free = tables.read("sources")
    tables.register(scan.new_sources(adapter.facts(spark, sf_dir), free, 10_000), None, 10_000)
    for change in ({"resolved": True}, {"muted": True, "note": " seen "}):
        tables.set_triage("p1", "g", "app://svc2", dt.datetime(2024, 1, 1), **change)
    one = lambda df, what, a, b: df.select(F.lit(what).alias("what"), F.col(a).alias("a"), F.coalesce(F.col(b), F.lit("")).alias("b"))
    out = one(store.listed(tables.read("projects"), "id"), "project", "id", "name").unionByName(one(free, "source", "uri", "project_id")).unionByName(one(tables.read("pixels"), "pixel", "id", "project_id"))
    out = out.unionByName(one(tables.read("sources"), "registered", "uri", "kind")).unionByName(one(store.found(tables.read("projects"), "id", "p1"), "found", "id", "name"))
    state = tables.read("triage").where("resolved_at IS NOT NULL AND muted_at IS NOT NULL")
    return out.unionByName(one(state, "triage", "group_id", "note")).unionByName(spark.createDataFrame([("clash", str(clash), ""), ("tries", str(len(calls)), "")], "what string, a string, b string"))


_add(
    "entities",
    _entities,
    """SELECT 'project' AS what, id AS a, CASE id WHEN 'p1' THEN 'Better' ELSE name END AS b FROM projects WHERE id <> 'p0' UNION ALL SELECT 'project', 'p3', 'Delta' UNION ALL SELECT 'source', uri, coalesce(nullif(project_id, 'p0'), '') FROM sources WHERE uri LIKE 'https%'
 UNION ALL VALUES ('pixel', 'px1', 'p1'), ('pixel', 'px2', 'gone'), ('found', 'p1', 'Better'), ('clash', '1', ''), ('tries', '2', ''), ('triage', 'g', 'seen') UNION ALL SELECT 'registered', uri, CASE WHEN uri LIKE 'app://%' THEN 'application' ELSE 'website' END FROM (SELECT uri FROM sources WHERE uri LIKE 'https%' UNION SELECT source FROM f)""",
)


def _stream(spark, sf_dir) -> DataFrame:
    folder, mark, marks = (store.new_folder(spark, x) for x in ("lines", "mark", "mark"))
    rows, tables = _hot(spark), Entities(spark, store.new_folder(spark, "entities"))
    payload_lines(spark, sf_dir).repartition(4).write.json(folder)
    ingest.start(spark, folder, rows, mark, zones.zones(spark), once=True, files_per_trigger=2).awaitTermination()
    facts = ingest.facts_of(ingest.lines(spark, folder, 2), zones.zones(spark))
    ingest.register_sources(spark, facts, tables, marks, dt.datetime(2024, 1, 1), once=True).awaitTermination()
    counts = rows.read().groupBy("kind", "source").agg(_count(), F.count_distinct("seq").alias("numbers"))
    return counts.unionByName(tables.read("sources").groupBy(F.lit("new").alias("kind"), F.col("uri").alias("source")).agg(_count(), F.lit(0).cast("long").alias("numbers")))


_add(
    "stream_ingest",
    _stream,
    f"SELECT kind, source, {_n(('n', 'count(*)'), ('numbers', 'count(*)'))} FROM lines GROUP BY 1, 2 UNION ALL SELECT 'new', source, 1, 0 FROM (SELECT DISTINCT source FROM lines)",
    f"WITH {payload_sql()} ",
)


def _new_sources(spark, sf_dir) -> DataFrame:
    """A stream over payloads and events in two runs; some of the sources are known when it first begins."""
    folder, mark = store.new_folder(spark, "lines"), store.new_folder(spark, "mark")
    tables, now = Entities(spark, store.new_folder(spark, "entities")), dt.datetime(2024, 1, 1)
    tables.register(adapter.sources(spark).where("uri LIKE 'https%'"), now, 10_000)
    lines = payload_lines(spark, sf_dir)
    for part in (0, 1):
        lines.where(F.col("received_ms") % 2 == part).repartition(3).write.mode("append").json(folder)
        facts = ingest.facts_of(ingest.lines(spark, folder, 4), zones.zones(spark))
        ingest.register_sources(spark, facts, tables, mark, now + dt.timedelta(days=1 + part), once=True).awaitTermination()
    return tables.read("sources").select("uri", "kind", F.unix_date(F.to_date("created_at")).cast("long").alias("day"))


_add(
    "new_sources_stream",
    _new_sources,
    """s AS (SELECT source, min(received_ms % 2) AS part FROM lines GROUP BY 1) SELECT uri, CASE WHEN uri LIKE 'app://%' THEN 'application' ELSE 'website' END AS kind, CAST(19723 AS BIGINT) AS day FROM sources WHERE uri LIKE 'https%'
 UNION ALL SELECT source, 'website', 19724 + part FROM s WHERE source NOT IN (SELECT uri FROM sources)""",
    adapter.SQL.rstrip() + f", {payload_sql()}, ",
)


def _links(spark, sf_dir) -> DataFrame:
    """Zones by nation, and customers as aliases: of a nation, of another customer, in chains that are too long, or in rings."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("Zone/"), "n_nationkey").alias("zone"), F.substring("n_name", 1, 2).alias("country"))
    links = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('c', c_custkey) AS alias", f"{_TARGET} AS target")
    return zones.with_links(nations, links).groupBy("country").agg(_count(), F.max("zone").alias("last"))


_TARGET = "CASE WHEN c_custkey % 11 = 0 THEN concat('Zone/', c_nationkey) WHEN c_custkey % 211 = 1 THEN concat('c', c_custkey + 1) WHEN c_custkey % 211 = 2 THEN concat('c', c_custkey - 1) WHEN c_custkey % 50 < 49 THEN concat('c', c_custkey - 1) ELSE concat('c', c_custkey - 11) END"
_add(
    "zone_links",
    _links,
    f"""WITH RECURSIVE known AS (SELECT 'Zone/' || n_nationkey AS zone, substr(n_name, 1, 2) AS country FROM nation), l AS (SELECT 'c' || c_custkey AS alias, {_TARGET} AS target FROM customer),
way AS (SELECT alias, alias AS now, 0 AS hops FROM l UNION ALL SELECT w.alias, l.target, w.hops + 1 FROM way w JOIN l ON l.alias = w.now WHERE w.hops < 32),
every AS (SELECT zone, country FROM known UNION ALL SELECT DISTINCT w.alias, k.country FROM way w JOIN known k ON k.zone = w.now)
SELECT country, {_n(('n', 'count(*)'))}, max(zone) AS last FROM every GROUP BY 1""",
    "",
)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)

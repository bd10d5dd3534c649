"""Structured Streaming ingest: payload files to the hot store, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.schema import MAX_SOURCES
from tidemark.sources import enrich
from tidemark.sources.entities import Entities
from tidemark.sources.hot import HotStore

#: A raw line with its request; `kind` is hit or exception.
RAW = "kind string, body string, user_agent string, accept_language string, dnt string, sec_gpc string, received_ms long"


def lines(spark: SparkSession, folder: str, files_per_trigger: int = 512) -> DataFrame:
    """JSON files of raw lines. The number of files a trigger takes replaces the queue's load shedding: nothing is dropped."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def facts_of(raw: DataFrame, zones: DataFrame) -> DataFrame:
    """Batch or stream of raw lines as fact rows without sequence numbers."""
    hits = enrich.hits(enrich.parse(raw.where("kind = 'hit'").drop("kind"), "hit"), zones)
    return hits.unionByName(enrich.reports(enrich.parse(raw.where("kind = 'exception'").drop("kind"), "exception")))


def sink(hot: HotStore, zones: DataFrame, stream: str = "payloads"):
    """A foreachBatch function that appends to the hot store. A batch that is run again adds nothing twice: the store knows the last one of each stream."""
    return lambda raw, batch: hot.append(facts_of(raw, zones), (stream, batch)) and None


def start(spark: SparkSession, folder: str, hot: HotStore, checkpoint: str, zones: DataFrame, once: bool = False, files_per_trigger: int = 512, stream: str = "payloads"):
    query = lines(spark, folder, files_per_trigger).writeStream.foreachBatch(sink(hot, zones, stream)).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="1 second")).start()


class _FirstSeen(StatefulProcessor):
    """Lets the first row of a key through. Keys of the initial state have been seen."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "known boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield Row(uri=key[0])

    def close(self) -> None:
        pass


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0).unique()], ["source"])


def new_source_stream(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Streaming URIs (column uri) of facts that are met for the first time and were not known when the stream first began.

    The stream's state holds a row a source, seeded from known (column uri) at the first start; a batch
    is looked up in it by key and is never joined with all known sources. Batches send a source once a task.
    """
    sources = facts.select("source").where("source IS NOT NULL").mapInArrow(_each_once, "source string").groupBy("source")
    seen = known.select(F.col("uri").alias("source")).distinct().groupBy("source")
    return sources.transformWithState(statefulProcessor=_FirstSeen(), outputStructType="uri string", outputMode="Append", timeMode="None", initialState=seen)


#: The state store that keyed state needs.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def register_sources(spark: SparkSession, facts: DataFrame, entities: Entities, checkpoint: str, now, once: bool = False):
    """Starts a query that registers new sources of a stream of facts, up to MAX_SOURCES. A batch that is run again finds its sources registered."""
    was = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        stream = new_source_stream(facts, entities.read("sources")).writeStream.foreachBatch(lambda fresh, _: entities.register(fresh, now, MAX_SOURCES) if not fresh.isEmpty() else None).option("checkpointLocation", checkpoint)
        return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="1 minute")).start()
    finally:
        spark.conf.set(ROCKS[0], was)


def live_series(facts: DataFrame, bucket: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Streaming counts by epoch-aligned bucket of received time, each row once by its sequence number."""
    at = F.timestamp_millis("received_ms")
    rows = facts.withColumn("at", at).withWatermark("at", late).dropDuplicatesWithinWatermark(["seq"])
    return rows.groupBy(F.window("at", bucket)).agg(F.count_if(F.col("kind") == "page_load").alias("pageviews"), F.count_if(F.col("kind").isin("custom", "pixel")).alias("events"))

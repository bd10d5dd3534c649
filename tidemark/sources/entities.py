"""The small tables (projects, sources, pixels, triage) with versions: changes of several callers are made one after another."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.schema import PIXEL, PROJECT, SOURCE, TRIAGE
from tidemark.sources import store
from tidemark.sources.log import Files, Log

TABLES = {"projects": PROJECT, "sources": SOURCE, "pixels": PIXEL, "triage": TRIAGE}


class Entities:
    """Tables in a folder. A version names each table's folder, so a change of several tables is seen as a whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, T.StructType] | None = None):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables or TABLES
        self.log, self.files = Log(spark, folder, {}), Files(spark, folder)

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """A table as it is now; empty where nothing was ever written."""
        at = (self.log.load()[1] if state is None else state).get(name)
        return self.spark.createDataFrame([], self.tables[name]) if at is None else self.spark.read.schema(self.tables[name]).parquet(f"{self.folder}/{at}")

    def update(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> int:
        """Publishes change(tables), the tables that it returns, as the next version; returns its number.

        If another caller was faster, change is called again on what that one has left, so no update
        is lost; an error that it raises leaves everything as it is.
        """

        def write(state: dict) -> dict:
            new = change({n: self.read(n, state) for n in self.tables})
            names = {n: f"{n}-{uuid.uuid4().hex}" for n in new}
            for n, df in new.items():
                df.select(*self.tables[n].fieldNames()).coalesce(1).write.parquet(f"{self.folder}/{names[n]}")
            return state | names

        return self.log.commit(write)[0]

    def put_project(self, row: DataFrame) -> int:
        """Adds or replaces a project; its name must not be another's. Holds against callers that do so at the same time."""
        return self.update(lambda t: {"projects": store.put_project(t["projects"], row)})

    def delete_project(self, project: str) -> int:
        """Removes a project and its pixels and frees its sources, in one version."""

        def change(t: dict) -> dict:
            return dict(zip(("projects", "sources", "pixels"), store.delete_project(t["projects"], t["sources"], t["pixels"], project), strict=True))

        return self.update(change)

    def upsert(self, table: str, rows: DataFrame, *keys: str) -> int:
        return self.update(lambda t: {table: store.upsert(t[table], rows, *keys)})

    def register(self, fresh: DataFrame, now, most: int) -> int:
        """Adds sources (column uri) that are not known, while there are fewer than `most`."""

        def change(t: dict) -> dict:
            known = t["sources"]
            new = fresh.select("uri").distinct().join(known.select("uri"), "uri", "left_anti").orderBy("uri").limit(max(most - known.count(), 0))
            return {"sources": store.registered(known, new, now)}

        return self.update(change)

    def set_triage(self, project: str, group: str, source: str, now, **change) -> int:
        """Changes one state as store.set_triage does; what another caller sets at the same time stays."""
        return self.update(lambda t: {"triage": store.set_triage(t["triage"], project, group, source, now, **change)})

    def vacuum(self, before: int) -> list[str]:
        """Deletes folders of older versions that were last changed before a time in ms, which readers of that age must have left."""
        listed = set(self.log.load()[1].values())
        gone = [n for n, folder, ms in self.files.listed(self.folder) if folder and n.rpartition("-")[0] in self.tables and n not in listed and ms < before]
        for n in gone:
            self.files.delete(f"{self.folder}/{n}")
        self.log.clear()
        return gone

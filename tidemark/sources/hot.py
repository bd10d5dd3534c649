"""The hot store: young rows of the fact table, which a stream, appends, compaction and regrouping share.

Rows lie in parts, each a folder that one job has written and that never changes. A log of versions
lists the parts; a step becomes visible when its version is published. A step writes new parts first,
so one that is cut off leaves a folder that nobody reads, and `vacuum` removes it later. Appending steps
never disturb others. Steps that replace parts (compaction, regrouping, deletion) publish only if the
parts they read are all still there, and hold a lease while they run.

Compaction writes to the cold table before it publishes. In between, rows lie in both places, where
the combined scan drops one of them. That a run has begun is in the log: if it was cut off, the next
one leaves out what the cold table has already.

The log also holds the next sequence number. A writer leases as many as it has rows before it writes
them, so numbers are unique across writers and restarts; a writer that is cut off leaves a gap.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from threading import Event

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import COLUMNS, FACT
from tidemark.sources import store
from tidemark.sources.log import Files, Log, Lost
from tidemark.sources.scan import conform, read_cold

#: How long a lease on replacing parts holds, in ms; longer than a run takes.
LEASE_MS = 6 * 3_600_000


@dataclass
class Move:
    """What compaction has written to the cold table: rows, the parts they are from, and a part of these parts' other rows."""

    rows: int
    parts: list[str]
    young: dict


class HotStore:
    """folder: where the parts and the log are."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, folder, {"next_seq": 1, "parts": {}, "batches": {}, "moving": {}, "leases": {}, "last_run": 0})
        self.files = Files(spark, folder)

    # reading

    def state(self) -> dict:
        return self.log.load()[1]

    def span(self, state: dict | None = None) -> tuple[int, int]:
        """Times of the first and last row, from the log; (0, -1) if there is none."""
        parts = (self.state() if state is None else state)["parts"].values()
        return (min(p["first"] for p in parts), max(p["last"] for p in parts)) if parts else (0, -1)

    def parts_of(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], FACT)
        return self.spark.read.schema(FACT).parquet(*[f"{self.folder}/{n}" for n in names])

    def read(self, start: int | None = None, end: int | None = None, state: dict | None = None) -> DataFrame:
        """The rows of the newest version, or of a state that was taken before. Parts that have no rows from `start` up to `end` are not opened; others are read whole."""
        inside = lambda p: (start is None or p["last"] >= start) and (end is None or p["first"] < end)
        return self.parts_of([n for n, p in (self.state() if state is None else state)["parts"].items() if inside(p)])

    # appending

    def lease(self, n: int) -> int:
        """Sets n sequence numbers aside; returns the first."""
        _, state = self.log.commit(lambda s: s | {"next_seq": s["next_seq"] + n})
        return state["next_seq"] - n

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds rows, numbered in order of received time; returns how many.

        batch: stream and number. One that is not above the stream's last batch has been added before
        and is left out, so a stream may deliver its last batch again.
        """
        done = lambda s: batch is not None and s["batches"].get(batch[0], -1) >= batch[1]
        if done(self.state()):
            return 0
        ranked = store.ranked(df)
        part = {}
        if ranked.rows:
            part = self._write(ranked.numbered(self.lease(ranked.rows) - 1))

        def add(s: dict) -> dict | None:
            if done(s):
                return None
            return s | {"parts": s["parts"] | part, "batches": s["batches"] | ({batch[0]: batch[1]} if batch else {})}

        _, state = self.log.commit(add)
        if part and not part.keys() <= state["parts"].keys():  # another run of the batch was faster
            self.files.delete(f"{self.folder}/{next(iter(part))}")
            return 0
        return ranked.rows

    def _write(self, rows: DataFrame) -> dict:
        """Rows as a part that no version lists yet; nothing where there are no rows."""
        name, seen = f"part-{uuid.uuid4().hex}", Observation()
        rows = conform(rows).observe(seen, F.count(F.lit(1)).alias("rows"), F.min("received_ms").alias("first"), F.max("received_ms").alias("last"))
        rows.write.parquet(f"{self.folder}/{name}")
        return {name: seen.get} if seen.get["rows"] else {}

    # replacing

    def take(self, name: str, owner: str, now: int, ms: int = LEASE_MS) -> bool:
        """Whether `owner` holds the lease from now on: nobody else does, or only one that has run out."""

        def change(s: dict) -> dict | None:
            held = s["leases"].get(name)
            if held and held["owner"] != owner and held["until"] > now:
                return None
            return s | {"leases": s["leases"] | {name: {"owner": owner, "until": now + ms}}}

        return self.log.commit(change)[1]["leases"].get(name, {}).get("owner") == owner

    def release(self, name: str, owner: str) -> None:
        self.log.commit(lambda s: s | {"leases": {k: v for k, v in s["leases"].items() if k != name or v["owner"] != owner}})

    @contextmanager
    def alone(self, owner: str, now: int) -> Iterator[bool]:
        """Whether `owner` may replace parts and rewrite the cold table inside the block: nobody else does so by this store's lease."""
        mine = self.take("replace", owner, now)
        try:
            yield mine
        finally:
            if mine:
                self.release("replace", owner)

    def _replace(self, old: list[str], new: dict, **more) -> None:
        def change(s: dict) -> dict:
            if not set(old) <= s["parts"].keys():
                raise Lost("parts were replaced by another step")
            return s | {"parts": {n: p for n, p in s["parts"].items() if n not in old} | new} | more

        try:
            self.log.commit(change)
        except Lost:
            for n in new:
                self.files.delete(f"{self.folder}/{n}")
            raise

    def copy_old(self, cold: str, cutoff: int) -> Move | None:
        """The first half of `compact`: rows received before `cutoff` are written to the cold table and are still here too."""
        before = self.state()
        due = {n: p for n, p in before["parts"].items() if p["first"] < cutoff}
        if not due:
            return None
        self.log.commit(lambda s: s | {"moving": s["moving"] | {uuid.uuid4().hex: list(due)}})
        old = self.parts_of(list(due)).where(F.col("received_ms") < cutoff)
        if before["moving"] and store.exists(self.spark, cold):
            # a run was cut off: it may have written some of these rows
            first, last = min(p["first"] for p in due.values()), max(p["last"] for p in due.values())
            old = old.join(read_cold(self.spark, cold, first, last).select("seq"), "seq", "left_anti")
        moved = store.write_cold(old, cold)
        mixed = [n for n, p in due.items() if p["last"] >= cutoff]
        young = self._write(self.parts_of(mixed).where(F.col("received_ms") >= cutoff)) if mixed else {}
        return Move(moved, list(due), young)

    def compact(self, cold: str, cutoff: int) -> int:
        """To be called inside `alone`. Moves rows received before `cutoff` to the cold table; returns how many. Parts without such rows are not touched, nor is what is appended meanwhile."""
        move = self.copy_old(cold, cutoff)
        if move is None:
            return 0
        self._replace(move.parts, move.young, moving={})
        return move.rows

    def _rewrite(self, rows: DataFrame, parts: list[str]) -> None:
        if self.state()["moving"]:
            raise Lost("a compaction was cut off; compact first")
        self._replace(parts, self._write(rows))

    def regroup(self) -> int:
        """Groups stored exceptions anew; only parts in which a group changes are written again. Returns the number of changed rows."""
        return self._change(store.regrouped, "changed")

    def delete_keys(self, keys: DataFrame) -> int:
        """Removes the rows of given sequence numbers (column seq); only parts that hold some are written again. Returns how many."""
        gone = keys.select("seq").distinct().withColumn("changed", F.lit(True))
        return self._change(lambda df: df.join(gone, "seq", "left").withColumn("changed", F.coalesce("changed", F.lit(False))), "changed", drop=True)

    def _change(self, change, mark: str, drop: bool = False) -> int:
        names = list(self.state()["parts"])
        if not names:
            return 0
        part = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        counts = change(self.parts_of(names).select(*COLUMNS, part.alias("_part"))).groupBy("_part").agg(F.count_if(mark).alias("n")).where("n > 0").collect()  # a row a part
        hit = [r["_part"] for r in counts]
        if hit:
            rows = change(self.parts_of(hit))
            self._rewrite((rows.where(~F.col(mark)) if drop else rows).select(*COLUMNS), hit)
        return sum(r["n"] for r in counts)

    # upkeep

    def vacuum(self, before: int) -> list[str]:
        """Deletes part folders that no version lists and that were last changed before a time in ms, which readers and writers of that age must have left; clears old versions."""
        listed = self.state()["parts"]
        gone = [n for n, folder, ms in self.files.listed(self.folder) if folder and n.startswith("part-") and n not in listed and ms < before]
        for n in gone:
            self.files.delete(f"{self.folder}/{n}")
        self.log.clear()
        return gone


def _warn(e: Exception) -> None:
    warnings.warn(f"upkeep failed: {e}", stacklevel=3)


def upkeep(hot: HotStore, cold: str, now: int, owner: str, keep_hot_ms: int = store.KEEP_HOT_MS, every_ms: int = store.EVERY_MS, keep_cold_ms: int | None = None, vacuum_ms: int = store.DAY_MS) -> dict | None:
    """Compaction, retention and vacuum, if they are due and nobody else is at it. Returns what was moved and deleted, or None.

    To be called by a scheduler as often as it likes, on any number of machines: a run is due once in
    every_ms, and one owner holds the lease. An owner that dies keeps it until it runs out.
    """
    if now < store.next_run(hot.state()["last_run"], every_ms):
        return None
    with hot.alone(owner, now) as mine:
        if not mine:
            return None
        moved = hot.compact(cold, store.cutoff(now, keep_hot_ms))
        days = store.enforce_retention(hot.spark, cold, now, keep_cold_ms) if keep_cold_ms is not None and store.exists(hot.spark, cold) else []
        gone = hot.vacuum(now - vacuum_ms)
        hot.log.commit(lambda s: s | {"last_run": now})
    return {"moved": moved, "days": days, "vacuumed": len(gone)}


def keep_up(hot: HotStore, cold: str, owner: str, stop: Event, clock: Callable[[], int], every_ms: int = store.EVERY_MS, failed: Callable[[Exception], None] = _warn, **more) -> int:
    """Calls `upkeep` whenever it can be due, until `stop` is set; returns how many runs did something. A run that fails is told to `failed`, and the next one tries again."""
    done = 0
    while not stop.is_set():
        try:
            done += upkeep(hot, cold, clock(), owner, every_ms=every_ms, **more) is not None
        except Exception as e:  # noqa: BLE001  the next run may succeed
            failed(e)
        stop.wait(max(every_ms, 1000) / 1000)
    return done

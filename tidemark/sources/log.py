"""Small states that several jobs change: numbered versions in a folder, each published as a whole or not at all."""

from __future__ import annotations

import copy
import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Versions that are kept for readers which listed them a moment ago.
KEPT = 20


class Lost(RuntimeError):
    """What a step was based on is gone: another step has replaced it meanwhile."""


class Files:
    """The file system of a folder, through Hadoop's interface, so that every store that Spark writes to will do."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self.conf)

    def path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def exists(self, at: str) -> bool:
        return self.fs.exists(self.path(at))

    def delete(self, at: str) -> None:
        self.fs.delete(self.path(at), True)

    def listed(self, at: str) -> list[tuple[str, bool, int]]:
        """(name, whether it is a folder, time of change in ms) of what lies in a folder; nothing where there is none."""
        if not self.exists(at):
            return []
        return [(s.getPath().getName(), s.isDirectory(), s.getModificationTime()) for s in self.fs.listStatus(self.path(at))]

    def text(self, at: str) -> str:
        stream = self.fs.open(self.path(at))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, at: str) -> bool:
        """Makes a file with its whole text; False if there is one already. Of several that try, one succeeds.

        On a local or mounted file system a hard link is made, elsewhere the file is renamed without
        overwriting, which HDFS does as one step.
        """
        aside = f"{at.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside))
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        try:
            if self.fs.getScheme() == "file":
                local = [self.jvm.java.io.File(self.path(x).toUri().getPath()).toPath() for x in (at, aside)]
                self.jvm.java.nio.file.Files.createLink(*local)
            else:
                context = fs.FileContext.getFileContext(self.path(at).toUri(), self.conf)
                context.rename(self.path(aside), self.path(at), self.gateway.new_array(fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.delete(aside)


class Log:
    """A state (a JSON object) in a folder. `commit` reads the newest version, changes it and publishes the next one; who comes second does it again."""

    def __init__(self, spark: SparkSession, folder: str, empty: dict):
        self.folder, self.empty, self.files = f"{folder.rstrip('/')}/_log", empty, Files(spark, folder)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, folder, _ in self.files.listed(self.folder) if not folder and re.fullmatch(r"\d{20}\.json", n))

    def load(self) -> tuple[int, dict]:
        for _ in range(10):
            version = max(self.versions(), default=0)
            if not version:
                return 0, copy.deepcopy(self.empty)
            try:
                return version, json.loads(self.files.text(f"{self.folder}/{version:020}.json"))
            except Py4JJavaError as e:  # cleared since it was listed: there are newer ones
                if "FileNotFound" not in e.java_exception.getClass().getName():
                    raise
        raise Lost(f"no version of {self.folder} can be read")

    def commit(self, change: Callable[[dict], dict | None], tries: int = 1000) -> tuple[int, dict]:
        """Publishes change(state), which may be called again on a newer state; None leaves everything as it is. Returns the version and state that hold now."""
        for _ in range(tries):
            version, state = self.load()
            new = change(copy.deepcopy(state))
            if new is None:
                return version, state
            if self.files.publish(json.dumps(new), f"{self.folder}/{version + 1:020}.json"):
                return version + 1, new
        raise Lost(f"{tries} others were faster in {self.folder}")

    def clear(self) -> None:
        """Removes versions that are older than the last KEPT."""
        for v in self.versions()[:-KEPT]:
            self.files.delete(f"{self.folder}/{v:020}.json")

"""Session helpers: worker imports, shared folders and materialised tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
#: A null doc_id orders after every other one.
LAST_ID = 2**63 - 1
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2500


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where PYTHONPATH does not hold it already, and keeps Arrow batches of whole texts small."""
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_src.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in (ROOT / "tidemark").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(at))
    sc._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a folder of this machine, if Spark runs on this machine alone; else an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_tidemark_shared", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = sc._tidemark_shared = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of rows sorted by keys, cut anew so that rows of equal keys are in one frame."""
    parts: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        same = (f[keys] == f[keys].iloc[-1]).all(axis=1).to_numpy()
        if parts and same[0] and (parts[-1][keys].iloc[-1] == f[keys].iloc[-1]).all():
            parts.append(f)
            continue
        at = len(f) - int(same.sum())
        if parts or at:
            yield pd.concat([*parts, f.iloc[:at]], ignore_index=True)
        parts = [f.iloc[at:]]
    if parts:
        yield pd.concat(parts, ignore_index=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def crc_fold(doc_id: Column, of: int = 5) -> Column:
    """crc32 of doc_id as text, modulo `of`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)).cast("int")

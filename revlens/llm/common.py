"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import ensure_checkpoint_dir

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (cuts lineage; survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a URI (local shared folder, HDFS, object store) and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def give_back_memory() -> None:
    """At the end of a task: hand freed memory back to the system, as a Python worker is used
    again by later stages and would keep it beside the executor's heap."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    give_back_memory()


def held_out(doc_id="doc_id"):
    """Rows kept out of training: crc32(doc_id as text) mod 4 is 2. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))

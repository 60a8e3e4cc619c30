"""Shared helpers: scratch tables in the cluster's shared folder, table reads, Arrow text access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

LOCAL_SCRATCH = "/tmp/checkpoints"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a local folder serves a local master only; a cluster's executors would
    not see each other's files there, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_SCRATCH
    return found.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"


#: for rows of megabytes: the writer looks at its buffers after each row, not each hundredth, and cuts row groups that a reader holds whole
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def materialize(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about ``max_bytes`` UTF-8 bytes.

    Yields (first row, row after the last, bytes, offsets). A null reads as an empty text;
    a text longer than ``max_bytes`` comes alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


#: bytes of a batch that Python workers get; the operators work on slices of a few MB, so larger ones only cost memory on both sides
BATCH_CONF, DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers that don't have it on their path, and bound their batches where the session has Spark's default."""
    if spark.conf.get(BATCH_CONF) == DEFAULT_BATCH:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if root in on_path or getattr(sc, "_tidemark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tidemark-")
    archive = os.path.join(folder, "tidemark_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in (Path(root) / "tidemark").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(archive)
    sc._tidemark_shipped = True


#: ids that may be broadcast (8 MB); beyond it both sides are shuffled
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, on: str, how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Semi- or anti-join on an id column; the ids are broadcast only if a count proves them at most ``most``."""
    return df.join(broadcast(ids) if ids.count() <= most else ids, on, how)

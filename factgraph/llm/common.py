"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import threading
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z only, unlike lower()."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or under a temporary one where that is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_dir(spark)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    """A temporary folder of this application; only where no shared one is set, as in local tests."""
    base = os.path.join(tempfile.gettempdir(), f"factgraph-{spark.sparkContext.applicationId}")
    os.makedirs(base, exist_ok=True)
    return base


def local_path(uri: str) -> str:
    """Path of a folder that all executors mount; other schemes cannot be memory-mapped."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: memory-mapped files need a shared folder that executors mount")
    return parts.path


def lean(run):
    """run, a function of a task's batches, after which freed memory goes back to the system: the worker process lives on, beside others."""
    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def byte_parts(batches, size: int = 4 << 20):
    """The batches in runs of rows of about `size` characters of text; a longer text is one of its own."""
    for pdf in batches:
        n = pdf.text.str.len().fillna(0).to_numpy()
        part = (np.cumsum(n) - n) // size
        for rows in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(part)) + 1):
            if len(rows):
                yield pdf.iloc[rows]


_owner = threading.local()


@contextlib.contextmanager
def collected(paths: list[str]):
    """Adds the paths of tables that are stored meanwhile, by this thread, to the list."""
    before, _owner.paths = getattr(_owner, "paths", None), paths
    try:
        yield
    finally:
        _owner.paths = before


def release(spark: SparkSession, paths: list[str], docs: DataFrame) -> None:
    """Deletes the listed tables and empties the list; those that docs still reads stay in it."""
    needed = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()} if paths else set()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in paths if p.rsplit("/", 1)[-1] not in needed]:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(conf).delete(own, True)
        paths.remove(path)


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    if getattr(_owner, "paths", None) is not None:
        _owner.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

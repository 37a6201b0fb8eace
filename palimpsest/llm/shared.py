"""Shared storage of the cluster for the operators here, and file systems for executors.

Executors can be lost at any time, so intermediate results that are read more
than once are written as Parquet under the folder named by
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.shared import fresh_path, shared_dir, written

__all__ = ["filesystem", "give_back", "one_thread", "fresh_path", "read_table", "shared_dir", "whole_numbers", "written"]


def filesystem(uri: str):
    """(file system, path) of a URI or an absolute path, usable on any executor."""
    from pyarrow import fs

    if uri.startswith("/"):
        uri = f"file://{uri}"
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def whole_numbers(df: DataFrame, column: str) -> None:
    """Refuse a column that is not of an integer type."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{column} must be an integer column, not {kind}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_thread() -> None:
    """Keep matrix products of this process to one thread: a task has one core, and idle threads spin on the others'.

    Concerns speed only; where the library isn't found, nothing happens.
    """
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def give_back() -> None:
    """Return what a finished task's batches have left in this worker's allocators; it idles beside the next stage."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)

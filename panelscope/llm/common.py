"""What the operators share: written tables, word patterns, null-safe inputs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelscope.plans.store import TableStore

#: White space of the contracts (ASCII only).
SPACE_CHARS = " \t\n\x0b\f\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage is cut, lost executors cost no recomputation."""
    return TableStore(df.sparkSession).write(name, df)


def whole_text(text_col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``: word starts are non-blanks that follow a blank or the start."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session, which the operator of a cluster sizes to the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: What this Python worker keeps from task to task, by module: functions that drop it.
KEPT: dict[str, Callable[[], None]] = {}


def keep_only(module: str) -> None:
    """Drop what other modules keep: workers are reused, and a pipeline would fill them with the caches of all its stages."""
    dropped = [KEPT.pop(m) for m in [*KEPT] if m != module]
    for drop in dropped:
        drop()
    if dropped:
        gc.collect()


def give_back() -> None:
    """Hand memory that is free again back to the machine: a reused worker, also an idle one, would hold on to the most it ever had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow``, with this package on the path of Python workers of this machine; clusters get it by ``--py-files``."""
    environment, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    path = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in path:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, path)])
    module = function.__module__

    def run(batches: Iterator) -> Iterator:
        keep_only(module)
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)

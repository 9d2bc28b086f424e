"""Where intermediate tables are written.

A stage that several others read is written once as Parquet and read back: the lineage is
cut, lost executors only cost the tasks that were running, and readers get column pruning
and real table sizes for the choice of joins. Tables go below ``spark.checkpoint.dir``, the
folder that all executors share.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import json
import tempfile
import uuid
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a fresh local one only when Spark itself runs locally."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="panelscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


# Folders made for one session only; they go with it.
_SESSION_STORES: list = []


@atexit.register
def drop_session_folders() -> None:
    """Delete the folders of stores that were given no root of their own. Their tables are no longer readable then."""
    while _SESSION_STORES:
        with contextlib.suppress(Exception):  # the session, or its Java side, may be gone already
            _SESSION_STORES.pop().drop()


@dataclass(frozen=True)
class Layout:
    """How a table lies in its files: one bucket per hash of ``keys``, sorted within.

    Readers that group, join or order by the keys (and more columns) find equal keys in one task already and deal nothing out again.
    """

    keys: tuple[str, ...]
    sort: tuple[str, ...]


class TableStore:
    """Parquet tables below one root, with their row counts."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/panelscope-{uuid.uuid4().hex}"
        self.row_counts: dict[str, int] = {}
        if root is None:
            _SESSION_STORES.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _file(self, path: str):
        """A path and its file system."""
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return file, file.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        """A table counts once its write has been committed."""
        marker, files = self._file(self.path(name) + "/_SUCCESS")
        return files.exists(marker)

    def drop(self) -> None:
        """Delete all tables."""
        root, files = self._file(self.root)
        files.delete(root, True)

    def claim(self, source: str, fresh: bool) -> None:
        """Note which input the tables come from; a store that holds those of another input is refused, unless all are built anew."""
        note, files = self._file(f"{self.root}/_input")
        if files.exists(note) and not fresh:
            found = [r["value"] for r in self.spark.read.text(f"{self.root}/_input").collect()]
            if found != [source]:
                raise ValueError(f"the tables in {self.root} come from another input: {found}, not {source}")
        else:
            self._note("_input", source)

    def write(self, name: str, df: DataFrame, layout: Layout | None = None) -> DataFrame:
        """Write a table and count its rows in the same pass. With a layout, it has as many buckets as the session has shuffle partitions."""
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        if layout is None:
            counted.write.mode("overwrite").parquet(self.path(name))
            self.row_counts[name] = seen.get["rows"]
            return self.read(name, df.schema)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        (
            counted.repartition(buckets, *layout.keys).write.mode("overwrite").option("path", self.path(name))
            .bucketBy(buckets, *layout.keys).sortBy(*layout.sort).saveAsTable(self._table(name))
        )
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        note = json.dumps({"columns": columns, "keys": layout.keys, "sort": layout.sort, "buckets": buckets})
        self._note(f"_layouts/{name}", note)
        self.row_counts[name] = seen.get["rows"]
        return self.spark.table(self._table(name))

    def write_days(self, name: str, df: DataFrame, days: tuple[date, date] | None = None) -> DataFrame:
        """Write a table with a partition per value of its column ``day``. With ``days`` (first, last) only those are replaced.

        A day of which ``df`` has no rows any more is taken away; a write that fails leaves the days as they were.
        """
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.collect_set(F.col("day").cast("string")).alias("found"))
        mode = "static" if days is None else "dynamic"
        counted.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("day").parquet(self.path(name))
        self.row_counts[name] = seen.get["rows"]
        found = set(seen.get["found"])
        at, last = days or (date.max, date.min)
        while at <= last:
            if str(at) not in found:
                gone, files = self._file(f"{self.path(name)}/day={at}")
                files.delete(gone, True)
            at += timedelta(days=1)
        return self.read(name, df.schema)

    def files_of(self, name: str) -> str:
        """Names of all files of a table: any write changes them."""
        path, files = self._file(self.path(name))
        found, every = [], files.listFiles(path, True)
        while every.hasNext():
            found.append(every.next().getPath().toString())
        return "\n".join(sorted(f for f in found if f.endswith(".parquet")))

    def noted(self, kind: str, name: str) -> str | None:
        """What was noted on a table."""
        note, files = self._file(f"{self.root}/_{kind}/{name}/_SUCCESS")
        return self.spark.read.text(f"{self.root}/_{kind}/{name}").first()["value"] if files.exists(note) else None

    def note(self, kind: str, name: str, text: str) -> None:
        self._note(f"_{kind}/{name}", text)

    def read(self, name: str, schema=None) -> DataFrame:
        """A table; one with a layout is made known to this session's catalog first."""
        note, files = self._file(f"{self.root}/_layouts/{name}")
        if schema is None and files.exists(note):
            if not self.spark.catalog.tableExists(self._table(name)):
                x = json.loads(self.spark.read.text(f"{self.root}/_layouts/{name}").first()["value"])
                self.spark.sql(
                    f"CREATE TABLE {self._table(name)} ({x['columns']}) USING parquet CLUSTERED BY ({', '.join(x['keys'])}) "
                    f"SORTED BY ({', '.join(x['sort'])}) INTO {x['buckets']} BUCKETS LOCATION '{self.path(name)}'")
            return self.spark.table(self._table(name))
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(name))

    def _table(self, name: str) -> str:
        """The catalog's name of a table with a layout; other roots have other names."""
        return f"panelscope_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{name}"

    def _note(self, name: str, text: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}")

"""Run the analysis over a panel export and write its tables.

    python -m panelscope.plans.pipeline --input s3a://panel/raw/ --trends s3a://panel/trends.csv --out s3a://panel/run1

``--input`` is a directory or glob of Parquet files, so a development sample is just another
path. Tables that later steps read are stored below ``<out>/tables``; ``--from 9`` reads the
stored tables of steps 1 to 8 and rebuilds the rest, ``--to`` stops after a step. ``--changed`` rebuilds
only what is stale: tables whose code, parameters or inputs changed, and what is built from them. ``--days 2026-05-01..2026-05-03`` takes
only these days from the input, keeps all raw events by day below ``<out>/tables`` and rebuilds the tables by day for these days alone. Result
tables are written as sorted CSV below ``<out>/exports``, and the number of rows and seconds
of every written table below ``<out>/manifest``.
"""

from __future__ import annotations

import argparse
import time
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelscope.plans.stages import TABLES, Workspace
from panelscope.plans.store import TableStore
from panelscope.sources.clickstream import read_export
from panelscope.sources.trends import read_trends


def export_csv(df: DataFrame, path: str) -> int:
    """CSV sorted on every column, so that reruns write the same lines; returns the number of rows.

    The sort is a range-partitioned one: small tables end up in one file, large ones in
    several whose names follow the order.
    """
    seen = Observation()
    (
        df.orderBy(*df.columns).observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    )
    return seen.get["rows"]


def input_fingerprint(spark: SparkSession, *paths: str | None) -> str:
    """Paths or globs with the number and total length of their files: another export gives another text."""
    parts = []
    for path in paths:
        if path:
            glob = spark._jvm.org.apache.hadoop.fs.Path(path)
            files = glob.getFileSystem(spark._jsc.hadoopConfiguration())
            found = [files.getContentSummary(s.getPath()) for s in files.globStatus(glob) or []]
            parts.append(f"{path}:{sum(f.getFileCount() for f in found)}:{sum(f.getLength() for f in found)}")
    return " ".join(parts)


def store_days(store: TableStore, raw: DataFrame, days: tuple[date, date]) -> DataFrame:
    """Put some days of raw events, by day, in the place of what the store had of them; returns all days. Events without a time are in no day."""
    wanted = raw.withColumn("day", F.to_date("created_time")).where(F.col("day").between(F.lit(days[0]), F.lit(days[1])))
    store.write_days("raw_clicks", wanted, days)
    return store.read("raw_clicks", wanted.schema)


def run(spark: SparkSession, raw: DataFrame, trends: DataFrame | None, out: str, first: int = 1, last: int = 99,
        keep_all: bool = False, threads: int = 16, source: str | None = None, changed: bool = False,
        days: tuple[date, date] | None = None) -> list[tuple[int, str, int, float]]:
    """Build the tables of steps ``first`` to ``last``; returns (step, table, rows, seconds since start) of each written.

    ``source`` names the input. A restart (``first`` above 1) on stored tables of another one is refused, and stored tables that are
    stale (see ``fingerprint``) are built again. With ``changed`` that holds for tables of all steps, and results that are not
    stale are not written. With ``days`` (first, last) the input adds to, or replaces, these days of the store.
    """
    store = TableStore(spark, f"{out}/tables")
    sources = None
    if days is not None:
        store.claim("days", fresh=False)
        raw = store_days(store, raw, days)
        sources = {"raw_clicks": store.files_of("raw_clicks"), "google_trends": source or ""}
    elif source is not None:
        store.claim(source, fresh=first <= 1)
        sources = {"raw_clicks": source, "google_trends": source}
    if changed and sources is None:
        raise ValueError("only a named source tells what has changed")
    work = Workspace(spark, raw, trends, store, 100 if changed else first, days, sources)
    start = time.time()

    def stale(name: str) -> bool:
        return not changed or store.noted("exported", name) != work.fingerprint(name)

    def write(name: str, df: DataFrame) -> tuple[int, str, int, float] | None:
        spec = TABLES[name]
        if keep_all and not spec.stored:
            df = store.write(name, df)
        rows = store.row_counts.get(name)
        if spec.export and stale(name):
            rows = export_csv(df, f"{out}/exports/{name}")
            if sources is not None:
                store.note("exported", name, work.fingerprint(name))
        if rows is None:
            return None
        done = (spec.step, name, rows, round(time.time() - start, 3))
        print(f"{spec.step:>3} {name:<26} {rows:>14,} rows, after {done[-1]:.1f} s", flush=True)
        return done

    names = [n for n, t in TABLES.items() if first <= t.step <= last and not (trends is None and _needs_trends(n))]
    written = [r for r in work.each(names, write, threads).values() if r is not None]
    if written:
        manifest = spark.createDataFrame(written, "step int, table string, rows long, seconds double")
        manifest.coalesce(1).write.mode("append").json(f"{out}/manifest")
    return written


def _needs_trends(name: str) -> bool:
    return name in TABLES and any(i == "google_trends" or _needs_trends(i) for i in TABLES[name].inputs)


def parse_days(text: str | None) -> tuple[date, date] | None:
    if not text:
        return None
    first, _, last = text.partition("..")
    days = date.fromisoformat(first), date.fromisoformat(last or first)
    if days[0] > days[1]:
        raise ValueError(f"the last day comes before the first: {text}")
    return days


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--input", required=True, help="directory or glob of Parquet files of the panel export")
    ap.add_argument("--trends", help="CSV with daily search interest; without it the seasonal tables are skipped")
    ap.add_argument("--out", required=True, help="folder for tables, exports and manifest")
    ap.add_argument("--from", dest="first", type=int, default=1, help="first step to build")
    ap.add_argument("--to", dest="last", type=int, default=99, help="last step to build")
    ap.add_argument("--changed", action="store_true", help="build only what is stale")
    ap.add_argument("--days", help="days of the input to take, as 2026-05-01 or 2026-05-01..2026-05-03; the store keeps the others")
    ap.add_argument("--threads", type=int, default=16, help="tables built at the same time")
    ap.add_argument("--keep-all", action="store_true", help="store every table, not only those other tables read")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("panelscope").getOrCreate()
    trends = read_trends(spark, args.trends) if args.trends else None
    run(spark, read_export(spark, args.input), trends, args.out, args.first, args.last, args.keep_all,
        args.threads, input_fingerprint(spark, args.input, args.trends), args.changed, parse_days(args.days))


if __name__ == "__main__":
    main()

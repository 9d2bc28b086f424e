"""Time the whole analysis and every table of it, and print one JSON line.

Reads ``$BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on ``local[$BENCH_CPUS]``. The
clickstream is derived and written as Parquet first and is not part of the times: it stands
for the delivered export.

``value``: wall time of one whole run, from the export to all stored tables and sorted CSV
results, cold, independent tables side by side. ``queries``: afterwards, seconds of each
table alone, reading stored inputs.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from panelscope.plans.pipeline import run
from panelscope.plans.stages import INTERNAL, TABLES, Workspace
from panelscope.plans.store import TableStore
from panelscope.sources.synthetic import read_clickstream
from panelscope.sources.trends import trends_from_orders


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("panelscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="panelscope-bench-") if not spark.conf.get("spark.checkpoint.dir", None) else None
    store = TableStore(spark, root)

    start = time.time()
    raw = store.write("raw_clicks", read_clickstream(spark, sf_dir))
    trends = trends_from_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    prepare = time.time() - start
    rows = store.row_counts["raw_clicks"]

    start = time.time()
    with contextlib.redirect_stdout(sys.stderr):
        run(spark, raw, trends, f"{store.root}/run", threads=2 * int(cpus))
    total = time.time() - start

    work = Workspace(spark, raw, trends, TableStore(spark, f"{store.root}/run/tables"), first_step=99)
    again = TableStore(spark, f"{store.root}/again")
    seconds: dict[str, float] = {}
    for name, spec in TABLES.items():
        start = time.time()
        df = spec.build(*[work.table(i) for i in spec.inputs])
        if spec.stored:
            again.write(name, df, spec.layout)
        else:
            df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "whole analysis, export to results",
        "value": round(total, 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "input_rows": rows,
        "rows_per_sec": round(rows / total),
        "tables": len(TABLES) - len(INTERNAL),
        "prepare_sec": round(prepare, 3),
        "one_by_one_sec": round(sum(seconds.values()), 3),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

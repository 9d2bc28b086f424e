"""Balanced contiguous shards from global prefix sums of sizes.

The rows are range-partitioned once by (order columns), the partitions are added up, and each
row's global prefix is the sum of the partitions before it plus a running sum inside its own.
Equal byte targets cut that line, so shards are contiguous and at most one row uneven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import stored, whole_text


def assign_shards(rows: DataFrame, size: Column, order: list[Column], shards: int, carry: list[str]) -> DataFrame:
    """``carry`` columns of every row, with ``size``, ``shard`` (from 0) and ``slot`` (gapless from 0 in a shard).

    Only ``carry`` and the order keys travel. Rows that are equal in every key are told apart by a
    unique number, so that any number of repeated rows can be split; which of them gets which slot is
    open. A null size counts as 0. With a total size of 0 all rows go to shard 0. An empty table
    gives an empty result. Fewer rows than shards leave shards empty.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = rows.select(
        F.struct(*carry).alias("_row"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        *[c.alias(k) for c, k in zip(order, keys, strict=True)], F.monotonically_increasing_id().alias("_uniq"),
    )
    line = [F.col(k).asc_nulls_last() for k in keys] + [F.col("_uniq")]
    placed = stored(keyed.repartitionByRange(*line).withColumn("_part", F.spark_partition_id()), "shard_line")

    totals = placed.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"), F.sum("_bytes").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*line)
    running = placed.select(
        "_row", "_size", "_part",
        (F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_ahead"),
        F.row_number().over(inside).alias("_nth"),
    )
    middle = (F.col("_bytes0") + F.col("_ahead")).cast("double") + F.col("_size") / 2
    ranked = stored(running.join(offsets, "_part").select(
        "_row", "_size", (F.col("_rows0") + F.col("_nth") - 1).alias("_rank"),
        F.coalesce(F.least(F.lit(shards - 1), F.floor(middle * shards / F.nullif("_total", F.lit(0)))), F.lit(0)).cast("int").alias("_shard"),
    ), "shard_ranks")
    firsts = ranked.groupBy("_shard").agg(F.min("_rank").alias("_first"))
    return ranked.join(firsts, "_shard").select(
        "_row.*", F.col("_size").alias("size"), F.col("_shard").alias("shard"), (F.col("_rank") - F.col("_first")).alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of near-equal bytes (law ``bytes``): id, size, text_crc32, law, shard, slot, grown_shard.

    The line is ordered by a hash of the text, then by id: equal texts stand together, and the order
    of sources and dates in the input does not carry over into shards. A null text has no bytes and
    crc32 0; a null id sorts last.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("_octets"), F.crc32(text.cast("binary")).alias("_crc"),
        F.md5(text.cast("binary")).alias("_hash"),
    )
    out = assign_shards(rows, F.col("_octets") + overhead, [F.col("_hash"), F.col("_id")], shards, ["_id", "_crc"])
    return out.select(
        F.col("_id").alias(id_col), "size", F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Mixing sources to target weights by pivotal dependent rounding.

Every document has a fractional number of copies, its source's target over its source's size. The
whole part is given; the fractions are paired: from one of two documents mass (fraction times size) moves to the other, in
a direction drawn so that expectations stay, until one fraction is 0 or 1. The other goes on to the next pair. A group of
documents leaves one fraction at most; groups are the documents of the next level of a tree, up to
one group per source. The mass of a source changes nowhere but in the last rounding, by half a document at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import stored, whole_text, word_count

#: Fractions that meet in one group of the tree.
GROUP = 64
#: A fraction so near to a whole number is one.
NEAR = 1e-12


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): its number, and ``target``.

    Targets share ``share`` of all sizes by weight; none is above ``most`` times its source's size, and what is cut
    off is shared again by weight. That is the level at which capped targets fill up to the total: sources in
    order of cap per weight are capped while the level of the rest is above their own.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    capped = numbered.select("*", weight.alias("_w"), (most * F.col("source_size")).alias("_cap"), (share * F.sum("source_size").over(everything)).alias("_total"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "number")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("_total") - before) / rest
    leveled = capped.withColumn("_level", level).withColumn("_level", F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level")))
    final = F.first("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # no level fits: all are capped
    return leveled.withColumn("target", F.coalesce(F.least("_cap", final * F.col("_w")), "_cap")).select("source", "source_size", "number", "target")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _pair(state: Column, new: Column, seed: int, level: int) -> Column:
    """One step: the carried fraction meets a new one; the one that becomes whole is done."""
    old = state["carry"]

    def masses(v: Column) -> Column:
        up = v["u"] * (v["a"] + v["b"]) < v["b"]  # mass moves to the old one with probability b / (a + b)
        whole_old = F.when(up, v["old_room"] <= v["new_mass"]).otherwise(v["old_mass"] <= v["new_room"])
        pick = F.when(up, F.when(whole_old, 1).otherwise(0)).otherwise(F.when(whole_old, 0).otherwise(1))
        left = F.when(
            up, F.when(whole_old, new["frac"] - v["a"] / new["size"]).otherwise(old["frac"] + v["a"] / old["size"])
        ).otherwise(F.when(whole_old, new["frac"] + v["b"] / new["size"]).otherwise(old["frac"] - v["b"] / old["size"]))
        gone, stays = F.when(whole_old, old["unit"]).otherwise(new["unit"]), F.when(whole_old, new).otherwise(old)
        return F.struct(
            F.struct(stays["unit"].alias("unit"), stays["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("frac")).alias("carry"),
            F.concat(state["done"], F.array(F.struct(gone.alias("unit"), pick.cast("int").alias("pick")))).alias("done"),
        )

    uniform = F.shiftrightunsigned(F.xxhash64(old["unit"], new["unit"], F.lit(seed), F.lit(level)), 11) / float(1 << 53)
    room = lambda x: (1 - x["frac"]) * x["size"]
    mass = lambda x: x["frac"] * x["size"]
    values = F.struct(
        F.least(room(old), mass(new)).alias("a"), F.least(mass(old), room(new)).alias("b"), uniform.alias("u"),
        room(old).alias("old_room"), mass(old).alias("old_mass"), room(new).alias("new_room"), mass(new).alias("new_mass"),
    )
    return F.when(old.isNull(), F.struct(new.alias("carry"), state["done"].alias("done"))).otherwise(_let(values, masses))


def _round_level(items: DataFrame, seed: int, level: int) -> DataFrame:
    """Pair the fractions of each (number, bucket): a row per group with the carried item and those done."""
    kind = items.select(F.struct("unit", "size", "frac").alias("x")).schema["x"].dataType.simpleString()
    unit = items.schema["unit"].dataType.simpleString()
    done = f"array<struct<unit:{unit},pick:int>>"
    start = F.struct(F.lit(None).cast(kind).alias("carry"), F.array().cast(done).alias("done"))
    # the largest first, so that what is left at the end is small; ties by unit
    lined = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("by"), "unit", "size", "frac")))
    groups = items.groupBy("number", "bucket").agg(lined.alias("items"))
    item = F.transform("items", lambda x: F.struct(x["unit"].alias("unit"), x["size"].alias("size"), x["frac"].alias("frac")))
    return groups.select("number", "bucket", F.aggregate(item, start, lambda s, x: _pair(s, x, seed, level)).alias("end"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often each document is taken: id, source, text_hash, size, source_size, target, rows, copies.

    One row per distinct (id, source, text), ``rows`` of them in the input, ``copies`` taken of all of them together. Sources are
    numbered by code point, null last, and weigh ``weights`` in turn. Null and empty texts have size 0 and are never
    taken. Draws are hashes of ids and ``seed``, so reruns agree. An empty table gives an empty result.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(source_col).alias("source"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")).alias("unit"), word_count(text).alias("size"))
    units = stored(rows.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("rows")), "mix_units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("_units"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    sources = stored(targets.join(sizes.select(F.col("source").alias("_s"), "_units"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix_sources")

    rate = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)) * F.col("rows")
    whole = F.floor(rate + NEAR)
    rated = units.withColumnRenamed("source", "_s").join(sources, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    groups = F.ceil(F.col("_units") / GROUP)
    rated = stored(rated.select(
        "number", "unit", "size", "rows", F.when(F.col("size") > 0, whole).otherwise(0).cast("long").alias("whole"),
        F.when((F.col("size") > 0) & (rate - whole > NEAR), rate - whole).otherwise(0.0).alias("frac"),
        F.pmod(F.xxhash64("unit", F.lit(seed)), groups).alias("bucket"), groups.alias("_groups"),
    ), "mix_rated")
    items = rated.where("frac > 0").select("number", "bucket", "unit", "size", "frac")
    last = rated.agg(F.max("_groups")).first()[0] or 1
    done, level = [], 0
    while True:
        ends = stored(_round_level(items, seed, level), f"mix_level{level}")
        done.append(ends.select("number", F.explode("end.done").alias("d")).select("number", "d.unit", "d.pick"))
        carried = ends.select("number", F.floor(F.col("bucket") / GROUP).alias("bucket"), "end.carry.*")
        settled = (F.col("frac") <= NEAR) | (F.col("frac") >= 1 - NEAR)
        if last <= 1:
            done.append(carried.select("number", "unit", F.when(F.col("frac") >= 0.5, 1).otherwise(0).alias("pick")))
            break
        done.append(carried.where(settled).select("number", "unit", F.when(F.col("frac") >= 0.5, 1).otherwise(0).alias("pick")))
        items, last, level = carried.where(~settled), -(-last // GROUP), level + 1
    picks = reduce(DataFrame.unionByName, done).select(F.col("number").alias("_n"), F.col("unit").alias("_u"), "pick")
    same = (F.col("_n") == F.col("number")) & F.col("_u.hash").eqNullSafe(F.col("unit.hash")) & F.col("_u.id").eqNullSafe(F.col("unit.id"))
    taken = rated.drop("bucket", "_groups").join(picks, same, "left").drop("_n", "_u")
    return taken.join(sources.select("number", "source", "source_size", "target"), "number").select(
        F.col("unit.id").alias(id_col), "source", F.col("unit.hash").alias("text_hash"), "size", "source_size", "target", "rows",
        (F.col("whole") + F.coalesce("pick", F.lit(0))).alias("copies"),
    )


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """A row per input row: id, size, source_size, target, taken. Copies of repeated rows are spread over them, the first rows get one more."""
    id_col = options.get("id_col", "doc_id")
    share = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("_k") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    out = mix(docs, **options).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(id_col, "size", "source_size", "target", (share * F.col("size")).cast("long").alias("taken"), "source")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, all columns, each as often as it is taken; the copies of repeated rows are spread over them as in ``mix_counts``."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    plan = mix(docs, **options).where("copies > 0").select(
        F.col(id_col).alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("text_hash").alias("_mix_hash"), F.col("rows").alias("_mix_rows"), F.col("copies").alias("_mix_copies"))
    same = (F.xxhash64(whole_text(text_col)) == F.col("_mix_hash")) & F.col(id_col).eqNullSafe(F.col("_mix_id")) & F.col(source_col).eqNullSafe(F.col("_mix_source"))
    joined = docs.join(plan, same)
    joined = joined.withColumn("_mix_row", F.struct(*docs.columns))
    single = joined.where("_mix_rows = 1").select("_mix_row", "_mix_copies")
    # repeated rows that are equal in all columns are counted, the others lined up by a hash of all columns
    key = ["_mix_id", "_mix_source", "_mix_hash", "_mix_rows", "_mix_copies"]
    kinds = joined.where("_mix_rows > 1").groupBy(*key, F.xxhash64(F.to_json("_mix_row")).alias("_mix_x")).agg(F.first("_mix_row").alias("_mix_row"), F.count(F.lit(1)).alias("_mix_n"))
    before = F.coalesce(F.sum("_mix_n").over(Window.partitionBy(*key).orderBy("_mix_x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("_mix_n"), F.col("_mix_copies") % F.col("_mix_rows") - before))
    copies = F.floor(F.col("_mix_copies") / F.col("_mix_rows")) * F.col("_mix_n") + more
    repeated = kinds.select("_mix_row", copies.cast("long").alias("_mix_copies")).where("_mix_copies > 0")
    out = single.unionByName(repeated).withColumn("_mix_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))))
    return out.select("_mix_row.*")

"""Mixing sources to target weights with a time-varying curriculum.

Each source's weight schedule is integrated to a cumulative token demand; inverting
that demand gives every document copy its training position, and the mix is range-sorted
by position. DataFrame functions only.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; documents of size 0 sit at the demand of the next document and are taken as often
as demand passes there; rows that repeat an id are documents of their own, each with its own
place, and equal rows are interchangeable; ties of the shuffle go by id, then size; a null id is
shuffled as an empty one; texts of any length are counted whole; an empty table gives an empty
mix. Other columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import drop_table, write_table

#: A source's weight goes linearly from START to END times its mean over the run: later sources come later.
START, END = 1.5, 0.5
_BITS = 12


#: Columns of :func:`row_key`.
KEY = ("_h1", "_h2")


def row_key(*columns: str) -> dict[str, Column]:
    """128 bits that tell apart rows that differ in these columns, as columns to add."""
    each = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return {name: F.xxhash64(F.lit(i), *each) for i, name in enumerate(KEY)}


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, u, and the columns ``keep``): one row a document; u is a reproducible shuffle key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    size = F.when(F.trim(blank) == "", 0).otherwise(F.size(F.split(F.trim(blank), " +")))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("u"), *keep,
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, rank, last_rank, target) from one row a source.

    The level of ``sum(min(most * size, level * weight)) = total`` is found in one pass over the
    sources in the order in which they reach their cap, as those below the level are a prefix.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("rank"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    levelled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    # the first source in this order that its share doesn't fill sets the level of all that follow
    settled = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("k"), "rank", "level"))).over(everything)
    closed = settled.isNull() | (F.struct((F.col("cap") / F.col("w")).alias("k"), F.col("rank"), F.col("level")) < settled)
    return levelled.withColumn("target", F.when(closed, F.col("cap")).otherwise(settled["level"] * F.col("w"))).select("source", "source_size", "rank", F.max("rank").over(everything).alias("last_rank"), "target")


def demand_inverse(share: Column, start: Column | float, end: Column | float) -> Column:
    """Time in [0, 1] at which the integral of a weight that goes from start to end reaches ``share`` of its total."""
    a, b = (F.lit(x) if not isinstance(x, Column) else x for x in (start, end))
    half, slope = (a + b) / 2, b - a
    root = F.sqrt(F.greatest(a * a + 2 * slope * half * share, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-12, share).otherwise((root - a) / F.when(F.abs(slope) < 1e-12, F.lit(1.0)).otherwise(slope))


def _position(demand: Column) -> Column:
    """Training position of a place in a source's demand. Schedules tilt from falling (first source) to rising (last)."""
    start = START + (END - START) * F.col("rank") / F.greatest(F.col("last_rank"), F.lit(1))
    share = F.least(F.lit(1.0), demand / F.greatest(F.col("target"), F.lit(1e-9)))
    return demand_inverse(share, start, F.lit(START + END) - start)


def assign(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, keep: tuple[str, ...] = (), **columns) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken, offset (its place in its source's demand), position (of its first copy, null if none), and the columns ``keep``."""
    rows = write_table(sized(docs, keep=keep, **columns), "sizes")  # words are counted once
    # A source is cut by shuffle key into 2 ** _BITS slots: sums of slots give each slot's start, and only a slot is ever sorted.
    rows = rows.withColumn("slot", F.conv(F.substring("u", 1, _BITS // 4), 16, 10).cast("int"))
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    start = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("slot_start", F.coalesce(F.sum("slot_size").over(start), F.lit(0)))
    per_source = targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, most)
    plan = slots.join(per_source, slots.source.eqNullSafe(per_source.source)).drop(per_source.source)
    order = Window.partitionBy("r.source", "r.slot").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    r, p = rows.alias("r"), plan.alias("p")
    both = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.slot") == F.col("p.slot")))
    both = both.withColumn("offset", F.col("slot_start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # copy k sits at demand offset + k * source_size; it is taken if the target reaches its middle
    span = F.greatest(F.col("source_size"), F.lit(1))
    copies = F.least(F.lit(most), F.greatest(F.lit(0), F.floor((F.col("target") - F.col("offset") - F.col("size") / 2) / span) + 1))
    # what is missing from a source's target, or beyond it, is made up by one more or one less of the document whose size is nearest
    first = both.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "rank", "last_rank", "target", "offset", copies.alias("copies"), *keep)
    first = write_table(first, "copies")
    drop_table(rows)
    gaps = first.groupBy(F.col("source").alias("_source")).agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    near = first.join(gaps, F.col("source").eqNullSafe(F.col("_source")))
    miss = F.abs(F.col("size") - F.abs("gap"))
    can = (F.col("size") > 0) & (miss < F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    best = near.where(can).groupBy("_source").agg(F.min(F.struct(miss.alias("miss"), "offset")).alias("b"), F.first(F.signum("gap")).cast("int").alias("by"))
    best = best.select("_source", F.col("b.offset").alias("_offset"), "by")
    met = first.join(best, F.col("source").eqNullSafe(F.col("_source")) & (F.col("offset") == F.col("_offset")) & (F.col("size") > 0), "left")
    met = met.withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0)))
    position = F.when(F.col("copies") > 0, _position(F.col("offset")))
    return met.select(
        "doc_id", "source", "size", "source_size", "rank", "last_rank", "target", F.col("copies").cast("int").alias("copies"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "offset", position.alias("position"), *keep,
    )


def mixed(assigned: DataFrame) -> DataFrame:
    """The mix itself: one row for each copy, range-sorted by training position."""
    out = assigned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    out = out.withColumn("position", _position(F.col("offset") + F.col("copy") * F.col("source_size")))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")


def dealt(docs: DataFrame, **columns) -> DataFrame:
    """The rows of :func:`assign` with ``taken`` as the written mix holds them, in the order of ``position``; documents that the mix leaves out come last."""
    assigned = write_table(assign(docs, **columns), "assigned")
    mix = write_table(mixed(assigned).select("doc_id", "source", "size", "offset", "copy", "position"), "mix")
    keys = ("doc_id", "source", "size", "offset")
    met = mix.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count_distinct("copy").alias("_dealt"), F.min("position").alias("_position"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = assigned.join(met, same, "left").select(
        *[c for c in assigned.columns if c not in ("taken", "position")], (F.coalesce("_dealt", F.lit(0)) * F.col("size")).cast("long").alias("taken"), F.col("_position").alias("position")
    )
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")

"""Signed years: domain, buckets, ticks, and lanes for intervals that must not overlap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DEFAULT = (-400, 400)


def bucket(year, width: int):
    """The nearest multiple of width, halves up."""
    return (F.floor(year / F.lit(width) + F.lit(0.5)) * width).cast("long")


def bucket_width(pixels_per_year: float) -> int:
    return max(2, min(60, int(90 / pixels_per_year + 0.5)))


def buckets(records: DataFrame, *, year: str = "data_inizio", width: int = 10) -> DataFrame:
    """(bucket, n, first_id)."""
    return records.where(F.col(year).isNotNull()).groupBy(bucket(F.col(year), width).alias("bucket")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def domain(records: DataFrame, *, start: str = "data_inizio", end: str = "data_fine") -> DataFrame:
    """(low, high): whole centuries with one to spare on either side."""
    low, high = F.floor(F.min(start) / 100) * 100 - 100, F.ceil(F.max(end) / 100) * 100 + 100
    return records.agg(F.coalesce(low, F.lit(DEFAULT[0])).cast("long").alias("low"), F.coalesce(high, F.lit(DEFAULT[1])).cast("long").alias("high"))


def century_ticks(records: DataFrame, **names: str) -> DataFrame:
    return domain(records, **names).select(F.explode(F.sequence("low", "high", F.lit(100).cast("long"))).alias("tick"))


def lanes(rows: DataFrame, group: str, *, key: str = "id", start: str = "low", end: str = "high") -> DataFrame:
    """(group, key, lane): first-fit lanes from 0, in order of start and key, within each group.

    Rows stream by, sorted; only the ends of a group's lanes are held.
    """
    slim = rows.select(F.col(group), F.col(start).cast("long").alias("__a"), F.col(key).cast("long").alias(key), F.col(end).cast("long").alias("__b"))
    dealt = slim.repartition(group).sortWithinPartitions(group, "__a", key, "__b")
    return dealt.mapInArrow(_packed, StructType([slim.schema[group], StructField(key, LongType()), StructField("lane", IntegerType())]))


def _packed(batches):
    group, ends = object(), []
    for batch in batches:
        out = []
        for g, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if g != group:
                group, ends = g, []
            lane = next((i for i, e in enumerate(ends) if e < a), len(ends))
            ends[lane : lane + 1] = [b]
            out.append(lane)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.int32())], [batch.schema.names[0], batch.schema.names[2], "lane"])


def reach(packed: DataFrame, group: str) -> DataFrame:
    """(group, lanes): how many lanes each drawing takes."""
    return packed.groupBy(group).agg((F.max("lane") + 1).alias("lanes"))


# Fixed values of the drawing, in pixels: half a box's width, gaps beside and between lanes, the connector's least
# length, how far a branch bends at least, more by lane, and at most, and the margin of the whole.
HALF_WIDTH, LANE_GAP, BETWEEN, CONNECTOR, BEND, BEND_BY_LANE, BEND_MOST, MARGIN = 86, 12, 14, 20, 12, 7, 34, 40


def box_height(n: Column) -> Column:
    """The height of a box of n records: one is a pill, more are a list under a heading, which scrolls when it is long."""
    return F.when(n <= 1, 42).otherwise(36 + F.least(n * 40, F.lit(108))).cast("long")


def _sided(batches):
    group, up, down, place = object(), [], [], 0
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for g, left in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if g != group:
                group, up, down, place = g, [], [], 0
            lane_up, lane_down = (next((i for i, edge in enumerate(edges) if left - HALF_WIDTH >= edge + LANE_GAP), len(edges)) for edges in (up, down))
            is_up = lane_up < lane_down or lane_up == lane_down and place % 2 == 0
            edges, lane = (up, lane_up) if is_up else (down, lane_down)
            edges[lane : lane + 1] = [left + HALF_WIDTH]
            for to, value in zip(out, (place, "up" if is_up else "down", lane), strict=True):
                to.append(value)
            place += 1
        kinds = (pa.int64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], [batch.schema.names[i] for i in (0, 2, 3)] + ["place", "side", "lane"])


def two_sided(clusters: DataFrame, group: str, *, key: str, left: str, n: str) -> DataFrame:
    """(group, key, n, place, side, lane, connector, bend) of clusters on both sides of a group's axis.

    In order of their position each cluster takes the lane nearest to the axis that is free there, on the side where
    that is nearer, and by turns where it is equally near.  A lane begins beyond the highest boxes of the lanes before
    it.  Clusters stream by, sorted; only the lanes' edges are held.  The offsets are windows over lanes.
    """
    slim = clusters.select(F.col(group), F.col(left).cast("double").alias("__left"), F.col(key).cast("long").alias(key), F.col(n).cast("long").alias(n))
    dealt = slim.repartition(group).sortWithinPartitions(group, "__left", key, n)
    placed = dealt.mapInArrow(_sided, StructType([slim.schema[group], StructField(key, LongType()), StructField(n, LongType()), StructField("place", LongType()), StructField("side", StringType()), StructField("lane", IntegerType())]))
    heights = placed.groupBy(group, "side", "lane").agg((F.max(box_height(F.col(n))) + BETWEEN).alias("__high"))
    nearer = Window.partitionBy(group, "side").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heights.select(F.col(group).alias("__group"), F.col("side").alias("__side"), F.col("lane").alias("__lane"), F.coalesce(F.sum("__high").over(nearer), F.lit(0)).alias("__offset"))
    joined = placed.join(offsets, F.col(group).eqNullSafe(F.col("__group")) & (F.col("side") == F.col("__side")) & (F.col("lane") == F.col("__lane")))
    bend = F.least(F.lit(BEND_MOST), BEND + F.col("lane") * BEND_BY_LANE) * F.when(F.col("place") % 2 == 0, 1).otherwise(-1)
    return joined.select(group, key, n, "place", "side", "lane", (F.col("__offset") + CONNECTOR).alias("connector"), bend.cast("int").alias("bend"))


def vertical_reach(drawn: DataFrame, group: str, n: str) -> DataFrame:
    """(group, reach): how high each drawing of ``two_sided`` is on either side of its axis."""
    return drawn.groupBy(group).agg((F.max(F.col("connector") + box_height(F.col(n))) + MARGIN).alias("reach"))

"""Records rolled up to places, and how dense they are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import density_colour

#: Places are a dimension; beyond this many they are shuffled, not broadcast (some 100 bytes each).
BROADCAST_PLACES = 200_000


def with_places(records: DataFrame, places: DataFrame, uri: str = "uri") -> DataFrame:
    """Records that have coordinates."""
    small = places.count() <= BROADCAST_PLACES
    return records.join(F.broadcast(places) if small else places, uri)


def rollup(records: DataFrame, place: str, active: Column, kind: str, order: str) -> DataFrame:
    """(place, n_total, n_active, first_kind) with the kind of the place's first record."""
    return records.groupBy(F.col(place).alias("place")).agg(F.count("*").alias("n_total"), F.count_if(active).alias("n_active"), F.min_by(kind, order).alias("first_kind"))


def density(rolled: DataFrame, low: tuple[int, int, int] = (255, 237, 160), high: tuple[int, int, int] = (128, 0, 38)) -> DataFrame:
    """Adds share of the fullest place, colour, and whether the place is hot."""
    most = rolled.agg(F.greatest(F.max("n_active"), F.lit(1)).alias("most"))
    out = rolled.join(F.broadcast(most))  # one row
    hot = F.col("n_active") >= F.greatest(F.lit(3), F.ceil(F.col("most") * 0.6))
    return out.select("place", "n_active", density_colour(F.col("n_active"), F.col("most"), low, high).alias("colour"), hot.alias("hot"))


def bounds(places: DataFrame) -> DataFrame:
    return places.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"), F.count("*").alias("n"))



"""Minima and maxima of planes and channels; NaN never wins, a plane of NaN keeps infinities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INF = float("inf")


def plane_min_max(planes: DataFrame, samples: int = 1, interleaved: bool = True) -> DataFrame:
    """minimum and maximum of each plane and component, from arrays and without a shuffle."""
    each = F.sequence(F.lit(0), F.lit(samples - 1))
    length = F.floor(F.size("samples") / samples).cast("int")
    own = (lambda k: F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get("samples", i * samples + k))) if interleaved else (lambda k: F.slice("samples", k * length + 1, length))
    value = F.filter(own(F.col("component")), lambda v: ~F.isnan(v))
    out = planes.withColumn("component", F.explode(each))
    return out.select(*[c for c in planes.columns if c != "samples"], "component", F.coalesce(F.array_min(value), F.lit(_INF)).alias("minimum"), F.coalesce(F.array_max(value), F.lit(-_INF)).alias("maximum"))


def known_min_max(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Over what has been read: rows of minimum and maximum, partial or whole."""
    return parts.groupBy(*keys).agg(F.min("minimum").alias("known_minimum"), F.max("maximum").alias("known_maximum"))


def global_min_max(parts: DataFrame, keys: list[str], image_count: int | Column) -> DataFrame:
    """Known values, and global ones once every plane has been read in full (column full).

    image_count: how many planes there are, a number or an aggregate.
    """
    return parts.groupBy(*keys).agg(
        (F.lit(image_count) if isinstance(image_count, int) else image_count).alias("__all"),
        F.min("minimum").alias("known_minimum"),
        F.max("maximum").alias("known_maximum"),
        F.count_distinct(F.when(F.col("full"), F.col("plane_index"))).alias("planes_read"),
    ).withColumn("global_minimum", F.when(F.col("planes_read") == F.col("__all"), F.col("known_minimum"))).withColumn("global_maximum", F.when(F.col("planes_read") == F.col("__all"), F.col("known_maximum"))).drop("__all")

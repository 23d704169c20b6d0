"""Clipping, scaling and calibration of features.

Global statistics are one aggregation with partial sums; their single row is
joined back as a broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(c: str | Column) -> Column:
    """NaN as NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def clip_symmetric(c: str, limit: float) -> Column:
    """Clipped to +-limit (infinities too); NULL and NaN become 0."""
    x = F.col(c)
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.least(x, F.lit(limit)), F.lit(-limit)))


def clipped_events(df: DataFrame, c: str, limit: float) -> DataFrame:
    """How many values clip_symmetric changes: beyond the limit, and missing."""
    x = F.col(c)
    return df.agg(F.count_if(~F.isnan(x) & (F.abs(x) > limit)).alias("n_clipped"), F.count_if(x.isNull() | F.isnan(x)).alias("n_missing"), F.count("*").alias("n"))


def max_abs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Largest absolute value of each column, one row; NULL and NaN passed over."""
    return df.agg(*[F.max(F.abs(clean(c))).alias(c) for c in cols])


def scale_max_abs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns divided by their largest absolute value; a divisor of 0 counts as 1."""
    m = F.broadcast(df.agg(*[F.max(F.abs(clean(c))).alias(f"_m_{c}") for c in cols]))
    out = df.crossJoin(m)  # one row
    return out.withColumns({c: F.col(c) / F.when(F.col(f"_m_{c}") > 0, F.col(f"_m_{c}")).otherwise(1.0) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def z_scores(df: DataFrame, cols: list[str], *, keys: list[str] | None = None, population: bool = False) -> DataFrame:
    """Columns as z-scores over the whole frame or within keys; sample deviation unless population; NULL where it is 0."""
    dev = F.stddev_pop if population else F.stddev_samp
    stats = df.groupBy(*(keys or [])).agg(*[F.avg(clean(c)).alias(f"_a_{c}") for c in cols], *[dev(clean(c)).alias(f"_s_{c}") for c in cols])
    out = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: F.try_divide(clean(c) - F.col(f"_a_{c}"), F.col(f"_s_{c}")) for c in cols}).drop(*[f"_{p}_{c}" for p in "as" for c in cols])


def absolute(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.abs(c) for c in cols})


def row_sum(cols: list[str]) -> Column:
    """Sum over columns, NULLs passed over."""
    return reduce(add, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])


def activity_signal(df: DataFrame, cols: list[str], *, keys: list[str] | None = None, name: str = "activity") -> DataFrame:
    """Sum of the absolute z-scores of the axes."""
    scored = absolute(z_scores(df, cols, keys=keys), cols)
    return scored.withColumn(name, row_sum(cols))


def mean_divisor(divisors: DataFrame, cols: list[str], most: float = 0.05) -> DataFrame:
    """Mean of a one-row frame of divisors; an error if they spread by more than ``most`` of it."""
    tall = divisors.unpivot([], cols, "axis", "value").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
    spread = (F.col("hi") - F.col("lo")) / F.col("mean")
    return tall.select(F.when(spread <= most, F.col("mean")).otherwise(F.raise_error(F.lit("divisors are too unlike for one mean"))).alias("divisor"))


def rezero(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Columns less their minimum within keys."""
    low = df.groupBy(*keys).agg(*[F.min(c).alias(f"_l_{c}") for c in cols])
    return df.join(low, keys).withColumns({c: F.col(c) - F.col(f"_l_{c}") for c in cols}).drop(*[f"_l_{c}" for c in cols])


def bounding_box(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def normalise_centroids(centroids: DataFrame) -> DataFrame:
    """Tall centroids (cluster_id, dim, value) divided by the largest absolute value of each dimension."""
    return centroids.withColumn("value", F.try_divide("value", F.max(F.abs("value")).over(Window.partitionBy("dim"))))

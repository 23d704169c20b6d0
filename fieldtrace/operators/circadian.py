"""Day and night, hourly proportions, time budgets and paired tests."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The recording site.
LATITUDE, LONGITUDE, ZONE = -38.11015, 175.49841, "Pacific/Auckland"
ZENITH = 90.833


def solar_events(dates: DataFrame, *, latitude: float = LATITUDE, longitude: float = LONGITUDE, zone: str = ZONE, margin_min: float = 15.0) -> DataFrame:
    """Adds sunrise, sunset, day_start and day_end (TIMESTAMP_NTZ, wall clock of zone) to a frame of dates.

    The published general solar position equations, evaluated at 0 h UTC of the date.
    """
    rad, deg = F.radians, F.degrees
    lat = rad(F.lit(latitude))
    t = (F.unix_date("date") + F.lit(2440587.5) - F.lit(2451545.0)) / F.lit(36525.0)
    df = dates.select("date", t.alias("t"))
    t = F.col("t")
    df = df.withColumn("l0", (F.lit(280.46646) + t * (F.lit(36000.76983) + t * 0.0003032)) % 360)
    df = df.withColumn("m", F.lit(357.52911) + t * (F.lit(35999.05029) - t * 0.0001537))
    df = df.withColumn("e", F.lit(0.016708634) - t * (F.lit(0.000042037) + t * 0.0000001267))
    m, l0, e = rad("m"), rad("l0"), F.col("e")
    centre = F.sin(m) * (F.lit(1.914602) - t * (F.lit(0.004817) + t * 0.000014)) + F.sin(2 * m) * (F.lit(0.019993) - t * 0.000101) + F.sin(3 * m) * 0.000289
    node = rad(F.lit(125.04) - t * 1934.136)
    df = df.withColumn("long", rad(F.col("l0") + centre - 0.00569 - F.sin(node) * 0.00478))
    tilt = F.lit(23) + (F.lit(26) + (F.lit(21.448) - t * (F.lit(46.815) + t * (F.lit(0.00059) - t * 0.001813))) / 60) / 60
    df = df.withColumn("eps", rad(tilt + F.cos(node) * 0.00256))
    df = df.withColumn("decl", F.asin(F.sin("eps") * F.sin("long"))).withColumn("y", F.tan(F.col("eps") / 2) * F.tan(F.col("eps") / 2))
    y = F.col("y")
    eq = 4 * deg(y * F.sin(2 * l0) - 2 * e * F.sin(m) + 4 * e * y * F.sin(m) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * e * e * F.sin(2 * m))
    half = deg(F.acos(F.cos(rad(F.lit(ZENITH))) / (F.cos(lat) * F.cos("decl")) - F.tan(lat) * F.tan("decl")))
    df = df.withColumn("noon", F.lit(720.0) - 4 * longitude - eq).withColumn("half", 4 * half)
    noon_utc = F.to_timestamp(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00")))
    shift = (F.unix_timestamp(F.from_utc_timestamp(noon_utc, zone)) - F.unix_timestamp(noon_utc)) / 60
    at = lambda minutes: F.timestamp_add("SECOND", F.round(60 * minutes).cast("int"), F.col("date").cast("timestamp_ntz"))
    df = df.withColumn("up", F.col("noon") - F.col("half") + shift).withColumn("down", F.col("noon") + F.col("half") + shift)
    return df.select(
        "date", at(F.col("up")).alias("sunrise"), at(F.col("down")).alias("sunset"), at(F.col("up") + margin_min).alias("day_start"), at(F.col("down") - margin_min).alias("day_end")
    )


def day_night(stream: DataFrame, *, ts: str = "ts", margin_min: float = 15.0, **site) -> DataFrame:
    """Adds daylight: 1 from day_start to day_end, -1 in the margins inside sunrise and sunset, else 0.

    Solar events are computed for the distinct dates only (bounded by the span
    of the calendar), which are broadcast.
    """
    dates = stream.select(F.to_date(ts).alias("date")).distinct()
    sun = F.broadcast(solar_events(dates, margin_min=margin_min, **site))
    at = F.col(ts)
    flag = F.when((at >= F.col("day_start")) & (at < F.col("day_end")), 1).when((at >= F.col("sunrise")) & (at < F.col("sunset")), -1).otherwise(0)
    joined = stream.withColumn("date", F.to_date(ts)).join(sun, "date")
    return joined.withColumn("daylight", flag).drop("date", "sunrise", "sunset", "day_start", "day_end")


def proportions(df: DataFrame, by: Column, name: str, labels: list[int], weight: Column | None = None) -> DataFrame:
    """Share of each listed label in each group, one column a label; the listed labels alone make the whole."""
    weight = F.lit(1) if weight is None else weight
    sums = [F.sum(F.when(F.col("label") == k, weight).otherwise(0)) for k in labels]
    got = df.where(F.col("label").isin(*labels)).groupBy(by.alias(name)).agg(F.sum(weight).alias("n"), *[s.alias(f"c{k}") for s, k in zip(sums, labels, strict=True)])
    return got.select(name, "n", *[(F.col(f"c{k}") / F.col("n")).alias(f"label_{k}") for k in labels])


def day_night_rates(stream: DataFrame, events: list[int], activity: list[int]) -> DataFrame:
    """Per animal: event and activity counts by day and night and the rates of events to activity (NULL without activity)."""
    def count(labels: list[int], light: int) -> Column:
        return F.count_if(F.col("label").isin(*labels) & (F.col("daylight") == light))

    got = stream.groupBy("animal_id").agg(
        count(activity, 1).alias("day_act"), count(activity, 0).alias("night_act"), count(events, 1).alias("day_ear"), count(events, 0).alias("night_ear")
    )
    return got.withColumn("rate_day", F.try_divide("day_ear", "day_act")).withColumn("rate_night", F.try_divide("night_ear", "night_act"))


def ratio_summary(rates: DataFrame, least: int = 6) -> DataFrame:
    """Over animals with both rates: number, how many are higher by day, median and 2.5/97.5 % quantiles of day to night (NULL below ``least``)."""
    both = rates.dropna(subset=["rate_day", "rate_night"])
    ratio = F.when(F.col("rate_night") > 0, F.col("rate_day") / F.col("rate_night"))
    got = both.agg(F.count("*").alias("n_animals"), F.count_if(F.col("rate_day") > F.col("rate_night")).alias("n_day_higher"), F.percentile(ratio, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    q = lambda k: F.when(F.col("n_animals") >= least, F.col("q")[k])
    return got.select("n_animals", "n_day_higher", q(1).alias("median_ratio"), q(0).alias("q025_ratio"), q(2).alias("q975_ratio"))


def signed_ranks(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Average ranks of the absolute differences with their signs; zero differences are left out.

    Ranks come from the counts of distinct differences; one row each is sorted.
    """
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    sizes = d.groupBy("size").agg(F.count("*").alias("ties"))
    up = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)  # one pair an animal
    sizes = sizes.withColumn("rank", F.coalesce(F.sum("ties").over(up), F.lit(0)) + (F.col("ties") + 1) / 2)
    return d.join(sizes, "size").select("d", "rank", "ties")


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Two-sided signed-rank test: n, W (smaller rank sum) and p.

    Exact for up to 50 pairs without ties, else the normal approximation with
    tie correction.  One row; NULLs without pairs.
    """
    ranked = signed_ranks(pairs, a, b)
    s = ranked.agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0)).alias("minus"),
        F.max("ties").alias("ties"), F.sum((F.col("ties") * F.col("ties") - 1) / 48).alias("tied"),
    ).withColumn("W", F.least("plus", "minus"))
    row = s.first()
    p = None
    if row["n"]:
        n, w = row["n"], row["W"]
        if n <= 50 and row["ties"] == 1:
            ways = [1]
            for r in range(1, n + 1):
                ways = [(ways[k] if k < len(ways) else 0) + (ways[k - r] if 0 <= k - r < len(ways) else 0) for k in range(len(ways) + r)]
            p = min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
        else:
            from statistics import NormalDist

            spread = (n * (n + 1) * (2 * n + 1) / 24 - row["tied"]) ** 0.5
            p = 2 * NormalDist().cdf((w - n * (n + 1) / 4) / spread) if spread else None
    return s.select("n", "W", F.lit(p).cast("double").alias("p"))


def binomial_tail(n: int, k: int) -> float:
    """Chance of k or more heads in n fair throws."""
    return sum(comb(n, i) for i in range(k, n + 1)) / 2**n

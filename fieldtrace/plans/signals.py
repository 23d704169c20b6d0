"""Queries on readings and positions: features, day and night, tracks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import circadian as C
from ..operators import features as X
from ..operators import track as G
from ..session import table
from .adapters import LABELS_SQL, label_stream, rounded
from .cleaning import wall_us

Query = Callable[[SparkSession, str], DataFrame]
HEAD, EAR = ["X_head", "Y_head", "Z_head"], ["X_ear", "Y_ear", "Z_ear"]
LABELS = [0, 1, 2, 3, 4]
ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def filed_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as filed, copies included, NULL animals and times left out, NaN as NULL. What a row gives by itself is dealt with before copies go."""
    df = table(spark, folder, "accelerometer_data").where("deer_id IS NOT NULL AND NZ_DateTime IS NOT NULL")
    return df.withColumns({c: X.clean(c) for c in HEAD + EAR})


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings once each, with their time and chunk; NULL animals and times left out, NaN as NULL."""
    df = table(spark, folder, "accelerometer_data").where("deer_id IS NOT NULL AND NZ_DateTime IS NOT NULL").distinct()
    df = df.withColumns({c: X.clean(c) for c in HEAD + EAR}).withColumn("us", wall_us("NZ_DateTime"))
    return df.withColumn("chunk", F.floor(F.col("us") / 3_600_000_000))


def fixes(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "trajectory_data").where("deer_id IS NOT NULL AND data_id IS NOT NULL").distinct()
    return df.withColumn("abs_speed_mPs", X.clean("abs_speed_mPs")).withColumn("chunk", F.floor(F.col("data_id") / (1 << 16)))


def proj2_clip(spark: SparkSession, folder: str) -> DataFrame:
    return filed_readings(spark, folder).select("data_id", X.clip_symmetric("Z_ear", 7.99).alias("z_ear")).distinct()


def proj2_clip_events(spark: SparkSession, folder: str) -> DataFrame:
    return X.clipped_events(readings(spark, folder), "Z_ear", 7.99)


def a18_max_abs(spark: SparkSession, folder: str) -> DataFrame:
    return X.max_abs(readings(spark, folder), HEAD + EAR)


def proj3_max_abs_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """Means of order lines scaled by their largest values, by return flag and line status."""
    df = X.scale_max_abs(table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", *ITEM), ITEM)
    return rounded(df.groupBy("l_returnflag", "l_linestatus").agg(*[F.avg(c).alias(c) for c in ITEM]))


def proj4_z_scores(spark: SparkSession, folder: str) -> DataFrame:
    df = X.z_scores(readings(spark, folder).select("data_id", "deer_id", *HEAD), HEAD, keys=["deer_id"])
    return rounded(df.select("data_id", *[F.col(c).alias(c.lower()) for c in HEAD]), 5)


def proj7_activity_signal(spark: SparkSession, folder: str) -> DataFrame:
    df = X.activity_signal(readings(spark, folder).select("data_id", "deer_id", *EAR), EAR, keys=["deer_id"])
    return rounded(df.select("data_id", "activity"), 5)


def proj8_group_z_scores(spark: SparkSession, folder: str) -> DataFrame:
    """z-scores of both sensors over all animals, population deviation."""
    df = X.z_scores(readings(spark, folder).select("data_id", "X_head", "X_ear"), ["X_head", "X_ear"], population=True)
    return rounded(df.select("data_id", F.col("X_head").alias("x_head"), F.col("X_ear").alias("x_ear")), 5)


def proj19_rezeroed(spark: SparkSession, folder: str) -> DataFrame:
    df = X.rezero(fixes(spark, folder).select("deer_id", "data_id", "pos_NZMG_x_meter"), ["pos_NZMG_x_meter"], ["deer_id"])
    return rounded(df.select("data_id", F.col("pos_NZMG_x_meter").alias("x")), 3)


def proj20_bounding_box(spark: SparkSession, folder: str) -> DataFrame:
    return X.bounding_box(fixes(spark, folder), "pos_NZMG_x_meter", "pos_NZMG_y_meter", ["deer_id"])


def a33_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Head and ear correlation per animal, readings within 16 g."""
    df = readings(spark, folder).where("abs(X_head) <= 16 AND abs(X_ear) <= 16")
    return rounded(df.groupBy("deer_id").agg(F.corr("X_head", "X_ear").alias("r")), 6)


def a26_speed_statistics(spark: SparkSession, folder: str) -> DataFrame:
    df = fixes(spark, folder).where("abs_speed_mPs BETWEEN 0 AND 25")
    sem = F.stddev_samp("abs_speed_mPs") / F.sqrt(F.count("*"))
    return rounded(df.groupBy("deer_id").agg(F.avg("abs_speed_mPs").alias("mean_speed"), sem.alias("sem_speed"), F.avg("tortuosity").alias("mean_tortuosity")))


def f8_solar_events(spark: SparkSession, folder: str) -> DataFrame:
    dates = label_stream(spark, folder).select(F.to_date("ts").alias("date")).distinct()
    return C.solar_events(dates).select(F.col("date").cast("string").alias("date"), wall_us("sunrise").alias("sunrise_us"), wall_us("sunset").alias("sunset_us"))


def f7_day_night(spark: SparkSession, folder: str) -> DataFrame:
    return C.day_night(label_stream(spark, folder)).select("event_id", "daylight")


def a14_hourly_proportions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.proportions(label_stream(spark, folder), F.hour("ts"), "hour", LABELS))


def a15_time_budget(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.proportions(label_stream(spark, folder), F.col("animal_id"), "animal_id", LABELS))


def a16_day_night_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.day_night_rates(C.day_night(label_stream(spark, folder)), [2, 4], [1, 2, 3, 4]))


def a17_ratio_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.ratio_summary(C.day_night_rates(C.day_night(label_stream(spark, folder)), [2, 4], [1, 2, 3, 4])))


def w19_signed_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Signed ranks of each animal's morning to afternoon counts."""
    halves = label_stream(spark, folder).groupBy("animal_id").agg(F.count_if(F.hour("ts") < 12).alias("am"), F.count_if(F.hour("ts") >= 12).alias("pm"))
    return C.signed_ranks(halves, "am", "pm").groupBy(F.col("d").alias("difference")).agg(F.max("rank").alias("rank"), F.count("*").alias("n"))


def m8_wilcoxon(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.wilcoxon(C.day_night_rates(C.day_night(label_stream(spark, folder)), [2, 4], [1, 2, 3, 4]).dropna(subset=["rate_day", "rate_night"]), "rate_day", "rate_night"))


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    return fixes(spark, folder).dropna(subset=["pos_NZMG_x_meter", "pos_NZMG_y_meter", "pos_WGS84_lat", "pos_WGS84_lon"])


def w7_straightness_metres(spark: SparkSession, folder: str) -> DataFrame:
    df = G.straightness_and_speed(_positions(spark, folder), keys=["deer_id"], order=["data_id"], a="pos_NZMG_x_meter", b="pos_NZMG_y_meter", dt_seconds=0.02)
    return rounded(df.select("data_id", "straightness", "speed"), 5)


def w8_straightness_great_circle(spark: SparkSession, folder: str) -> DataFrame:
    df = G.straightness_and_speed(_positions(spark, folder), keys=["deer_id"], order=["data_id"], a="pos_WGS84_lat", b="pos_WGS84_lon", dt_seconds=2.0, distance=G.great_circle_m)
    return rounded(df.select("data_id", "straightness", "speed"), 4)


def w9_interpolated(spark: SparkSession, folder: str) -> DataFrame:
    df = G.interpolate(fixes(spark, folder), keys=["deer_id"], order=["data_id"], col="pos_NZMG_x_meter")
    return rounded(df.select("data_id", F.col("pos_NZMG_x_meter").alias("x")), 4)


def w10_interpolated_forward(spark: SparkSession, folder: str) -> DataFrame:
    df = G.interpolate(fixes(spark, folder), keys=["deer_id"], order=["data_id"], col="abs_speed_mPs", backward=False)
    return rounded(df.select("data_id", F.col("abs_speed_mPs").alias("speed")).where("speed IS NOT NULL"), 5)


def w11_straightness_over_gaps(spark: SparkSession, folder: str) -> DataFrame:
    track = fixes(spark, folder).select("deer_id", "data_id", "chunk", "pos_NZMG_x_meter", "pos_NZMG_y_meter")
    df = G.straightness_over_gaps(track, keys=["deer_id"], order=["data_id"], a="pos_NZMG_x_meter", b="pos_NZMG_y_meter", dt_seconds=0.02)
    return rounded(df.select("data_id", "straightness", "speed"), 4)


def w12_null_runs(spark: SparkSession, folder: str) -> DataFrame:
    return G.null_runs(fixes(spark, folder), keys=["deer_id"], order=["data_id"], col="pos_WGS84_lat")


def w13_inclusive_fill(spark: SparkSession, folder: str) -> DataFrame:
    df = G.fill_inclusive(fixes(spark, folder), keys=["deer_id"], order=["data_id"], col="pos_NZMG_y_meter")
    return rounded(df.select("data_id", F.col("pos_NZMG_y_meter").alias("y")), 4)


def w14_gaussian_smooth(spark: SparkSession, folder: str) -> DataFrame:
    df = G.interpolate(fixes(spark, folder), keys=["deer_id"], order=["data_id"], col="pos_NZMG_x_meter")
    return rounded(G.gaussian_smooth(df, keys=["deer_id"], order=["data_id"], id_col="data_id", col="pos_NZMG_x_meter"), 3)


def f9_step_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Great-circle metres from each animal's first fix to every one of its fixes."""
    df = _positions(spark, folder)
    first = df.groupBy("deer_id").agg(F.min(F.struct("data_id", F.col("pos_WGS84_lat").alias("lat"), F.col("pos_WGS84_lon").alias("lon"))).alias("f"))
    far = G.great_circle_m(F.col("f.lat"), F.col("f.lon"), F.col("pos_WGS84_lat"), F.col("pos_WGS84_lon"))
    return rounded(df.join(first, "deer_id").select("data_id", far.alias("metres")), 4)


def f10_map_grid(spark: SparkSession, folder: str) -> DataFrame:
    df = G.map_grid(fixes(spark, folder), lat="pos_WGS84_lat", lon="pos_WGS84_lon")
    return rounded(df.select("data_id", "x_m", "y_m"), 3)


def _recorded(spark: SparkSession, folder: str) -> DataFrame:
    df = G.recordings(readings(spark, folder), keys=["deer_id"], order=["us", "data_id"], time_us="us", gap_us=60_000_000)
    keys = ["deer_id", "recording"]
    df = X.activity_signal(df, HEAD, keys=["deer_id"], name="head")
    return X.activity_signal(df, EAR, keys=["deer_id"], name="ear").select(*keys, "us", "data_id", "head", "ear")


def w16_drops(spark: SparkSession, folder: str) -> DataFrame:
    return G.drops(_recorded(spark, folder), keys=["deer_id", "recording"], order=["us", "data_id"], id_col="data_id", signals={"head": "head", "ear": "ear"}, prominence=5.0, distance=50)


def w17_first_drops(spark: SparkSession, folder: str) -> DataFrame:
    return G.first_drops(w16_drops(spark, folder), keys=["deer_id", "recording"])


def w18_best_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Lag of the ear's sum of axes behind the head's in each recording, among all lags."""
    df = G.recordings(readings(spark, folder), keys=["deer_id"], order=["us", "data_id"], time_us="us", gap_us=60_000_000)
    df = df.where(" AND ".join(f"abs({c}) <= 16" for c in [*HEAD, *EAR]))
    total = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    df = df.withColumn("head", total(HEAD)).withColumn("ear", total(EAR))
    return rounded(G.best_lag(df, keys=["deer_id", "recording"], order=["us", "data_id"], x="head", y="ear"), 3)


def w21_time_axis(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds from 0 to n / 50 spread evenly over an animal's fixes."""
    from ..operators.ordered import numbered

    df = numbered(fixes(spark, folder), keys=["deer_id"], order=["data_id"])
    n = fixes(spark, folder).groupBy("deer_id").agg(F.count("*").alias("n"))
    return rounded(df.join(n, "deer_id").select("data_id", F.try_divide(F.col("seq") * F.col("n") / 50.0, F.col("n") - 1).alias("t")))


def w23_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of successive positions, as line segments."""
    from ..operators.ordered import following

    df = following(_positions(spark, folder), keys=["deer_id"], order=["data_id"], cols={"x1": "pos_NZMG_x_meter", "y1": "pos_NZMG_y_meter"})
    return df.where("x1 IS NOT NULL").select("data_id", F.col("pos_NZMG_x_meter").alias("x0"), F.col("pos_NZMG_y_meter").alias("y0"), "x1", "y1")


_NAN = lambda c: f'CASE WHEN NOT isnan("{c}") THEN "{c}" END'
_R = (
    "WITH rd AS (SELECT DISTINCT data_id, deer_id, \"NZ_DateTime\", "
    + ", ".join(f'{_NAN(c)} AS {c.lower()}' for c in HEAD + EAR)
    + ' FROM accelerometer_data WHERE deer_id IS NOT NULL AND "NZ_DateTime" IS NOT NULL)'
)
_F = (
    'WITH fx AS (SELECT DISTINCT data_id, deer_id, "pos_WGS84_lat" AS lat, "pos_WGS84_lon" AS lon, "pos_NZMG_x_meter" AS x, "pos_NZMG_y_meter" AS y, '
    'CASE WHEN NOT isnan("abs_speed_mPs") THEN "abs_speed_mPs" END AS sp, tortuosity AS tort FROM trajectory_data WHERE deer_id IS NOT NULL AND data_id IS NOT NULL),\n'
    "ps AS (SELECT * FROM fx WHERE lat IS NOT NULL AND lon IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL)"
)
_SUN = f"""WITH {LABELS_SQL}, d0 AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM ls),
d1 AS (SELECT date, (date_diff('day', DATE '1970-01-01', date) + 2440587.5 - 2451545.0) / 36525.0 AS t FROM d0),
d2 AS (SELECT *, (280.46646 + t * (36000.76983 + t * 0.0003032)) % 360 AS l0, 357.52911 + t * (35999.05029 - t * 0.0001537) AS m, 0.016708634 - t * (0.000042037 + t * 0.0000001267) AS e, radians(125.04 - t * 1934.136) AS node FROM d1),
d3 AS (SELECT *, radians(l0 + sin(radians(m)) * (1.914602 - t * (0.004817 + t * 0.000014)) + sin(2 * radians(m)) * (0.019993 - t * 0.000101) + sin(3 * radians(m)) * 0.000289 - 0.00569 - sin(node) * 0.00478) AS lng,
  radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + cos(node) * 0.00256) AS eps FROM d2),
d4 AS (SELECT *, asin(sin(eps) * sin(lng)) AS decl, tan(eps / 2) * tan(eps / 2) AS y, radians(l0) AS l, radians(m) AS mr FROM d3),
d5 AS (SELECT *, 720.0 - 4 * 175.49841 - 4 * degrees(y * sin(2 * l) - 2 * e * sin(mr) + 4 * e * y * sin(mr) * cos(2 * l) - 0.5 * y * y * sin(4 * l) - 1.25 * e * e * sin(2 * mr)) AS noon,
  4 * degrees(acos(cos(radians(90.833)) / (cos(radians(-38.11015)) * cos(decl)) - tan(radians(-38.11015)) * tan(decl))) AS half FROM d4),
sun AS (SELECT date, epoch_us(CAST(date AS TIMESTAMP)) AS base, CAST(round(60 * (noon - half + 780)) AS BIGINT) AS up, CAST(round(60 * (noon + half + 780)) AS BIGINT) AS down,
  CAST(round(60 * (noon - half + 780 + 15)) AS BIGINT) AS day_up, CAST(round(60 * (noon + half + 780 - 15)) AS BIGINT) AS day_down FROM d5),
dn AS (SELECT ls.*, CASE WHEN epoch_us(ts) >= base + day_up * 1000000 AND epoch_us(ts) < base + day_down * 1000000 THEN 1
  WHEN epoch_us(ts) >= base + up * 1000000 AND epoch_us(ts) < base + down * 1000000 THEN -1 ELSE 0 END AS daylight FROM ls JOIN sun ON CAST(ts AS DATE) = date),
rt AS (SELECT animal_id, count(*) FILTER (label IN (1, 2, 3, 4) AND daylight = 1) AS day_act, count(*) FILTER (label IN (1, 2, 3, 4) AND daylight = 0) AS night_act,
  count(*) FILTER (label IN (2, 4) AND daylight = 1) AS day_ear, count(*) FILTER (label IN (2, 4) AND daylight = 0) AS night_ear FROM dn GROUP BY animal_id),
rr AS (SELECT *, day_ear / nullif(day_act, 0) AS rate_day, night_ear / nullif(night_act, 0) AS rate_night FROM rt)"""
_SHARES = ", ".join(f"round(count(*) FILTER (label = {k}) / count(*), 6) AS label_{k}" for k in LABELS)
_STEPS = """, st AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lag(lat) OVER w AS la0, lag(lon) OVER w AS lo0 FROM ps WINDOW w AS (PARTITION BY deer_id ORDER BY data_id)),
ds AS (SELECT *, sqrt((x - x0) ** 2 + (y - y0) ** 2) AS d1, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS d2, sqrt((x2 - x0) ** 2 + (y2 - y0) ** 2) AS c,
  sin(radians(lat - la0) / 2) ** 2 + cos(radians(la0)) * cos(radians(lat)) * sin(radians(lon - lo0) / 2) ** 2 AS h FROM st),
tv AS (SELECT *, CASE WHEN d1 + d2 = 0 THEN 0 ELSE c / (d1 + d2) END AS tt, d1 / 0.02 AS v, 2 * 6378137.0 * atan2(sqrt(h), sqrt(1 - h)) / 2.0 AS g FROM ds)"""
_KNOWN = """, sq AS (SELECT *, row_number() OVER (PARTITION BY deer_id ORDER BY data_id) - 1 AS seq FROM fx),
kn AS (SELECT *, last_value(CASE WHEN {c} IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS s0, last_value({c} IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN {c} IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS s1, first_value({c} IGNORE NULLS) OVER b AS v1 FROM sq
  WINDOW a AS (PARTITION BY deer_id ORDER BY data_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY deer_id ORDER BY data_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_Z = lambda c, over, dev: f"round(({c} - avg({c}) OVER ({over})) / {dev}({c}) OVER ({over}), 5)"


def _gc(a: str, b: str, c: str, d: str) -> str:
    h = f"sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2"
    return f"2 * 6378137.0 * atan2(sqrt({h}), sqrt(1 - ({h})))"


def _grid_sql() -> str:
    """The map grid of positions by the published series, step by step."""
    e_new, e_old = 0.0066943799901413165, 2 / 297.0 - (1 / 297.0) ** 2
    b_old = 6378388.0 * (1 - 1 / 297.0)
    psi = "0"
    for c in (0.00034, -0.00067, 0.001333, -0.0026906, 0.0055161, -0.0117879, 0.02526853, -0.063294409, 0.1358797613, -0.6399175073):
        psi = f"({psi} + ({-c})) * step"
    steps = ""
    series = ((-0.6870983, -1.1651967), (-0.26623489, -0.36249218), (-0.10162907, 0.01727609), (-0.001541739, 0.041058560), (0.249204646, 0.003371507), (0.7557853228, 0.0))
    for k, (re, im) in enumerate(series):
        before = ("0.0", "0.0", "h") if k == 0 else ("r", "i", f"s{k - 1}")
        steps += f", s{k} AS (SELECT data_id, a, o, ({before[0]} + ({re})) * a - ({before[1]} + ({im})) * o AS r, ({before[0]} + ({re})) * o + ({before[1]} + ({im})) * a AS i FROM {before[2]})"
    return f"""{_F}, b AS (SELECT data_id, radians(lat) AS phi, radians(lon) AS lam, 6378137.0 / sqrt(1 - {e_new!r} * sin(radians(lat)) ** 2) AS n FROM fx),
c AS (SELECT data_id, n * cos(phi) * cos(lam) - 59.47 AS x, n * cos(phi) * sin(lam) + 5.04 AS y, n * (1 - {e_new!r}) * sin(phi) - 187.44 AS z FROM b),
d AS (SELECT data_id, 1.0000045993 * (x - radians(1.024 / 3600) * y + radians(-0.1 / 3600) * z) AS u, 1.0000045993 * (radians(1.024 / 3600) * x + y - radians(0.47 / 3600) * z) AS v, 1.0000045993 * (-radians(-0.1 / 3600) * x + radians(0.47 / 3600) * y + z) AS w FROM c),
e AS (SELECT *, sqrt(u * u + v * v) AS p, atan2(w * 6378388.0, sqrt(u * u + v * v) * {b_old!r}) AS t FROM d),
g AS (SELECT data_id, degrees(atan2(w + {e_old / (1 - e_old) * b_old!r} * sin(t) ** 3, p - {e_old * 6378388.0!r} * cos(t) ** 3)) AS lat, degrees(atan2(v, u)) AS lon FROM e),
j AS (SELECT data_id, (lat + 41) * 0.036 AS step, radians(lon - 173) AS o FROM g), h AS (SELECT data_id, {psi} AS a, o FROM j){steps}
SELECT data_id, round(2510000.0 + i * 6378388.0, 3) AS x_m, round(6023150.0 + r * 6378388.0, 3) AS y_m FROM s5"""


def oracle_sql() -> dict[str, str]:
    by_deer = "PARTITION BY deer_id"
    return {
        "proj2_clip": f"{_R} SELECT data_id, CASE WHEN z_ear IS NULL THEN 0.0 ELSE greatest(least(z_ear, 7.99), -7.99) END AS z_ear FROM rd",
        "proj2_clip_events": f"{_R} SELECT count(*) FILTER (abs(z_ear) > 7.99) AS n_clipped, count(*) FILTER (z_ear IS NULL) AS n_missing, count(*) AS n FROM rd",
        "a18_max_abs": f"{_R} SELECT " + ", ".join(f'max(abs({c.lower()})) AS "{c}"' for c in HEAD + EAR) + " FROM rd",
        "proj3_max_abs_scaled": "WITH m AS (SELECT " + ", ".join(f"max(abs({c})) AS m_{c}" for c in ITEM) + " FROM lineitem) SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(avg({c} / m_{c}), 6) AS {c}" for c in ITEM) + " FROM lineitem, m GROUP BY ALL",
        "proj4_z_scores": f"{_R} SELECT data_id, " + ", ".join(f"{_Z(c.lower(), by_deer, 'stddev_samp')} AS {c.lower()}" for c in HEAD) + " FROM rd",
        "proj7_activity_signal": f"{_R}, z AS (SELECT data_id, " + ", ".join(f"abs(({c} - avg({c}) OVER ({by_deer})) / stddev_samp({c}) OVER ({by_deer})) AS {c}" for c in map(str.lower, EAR)) + ") SELECT data_id, round(coalesce(x_ear, 0) + coalesce(y_ear, 0) + coalesce(z_ear, 0), 5) AS activity FROM z".replace(") SELECT", " FROM rd) SELECT"),
        "proj8_group_z_scores": f"{_R} SELECT data_id, {_Z('x_head', '', 'stddev_pop')} AS x_head, {_Z('x_ear', '', 'stddev_pop')} AS x_ear FROM rd",
        "proj19_rezeroed": f"{_F} SELECT data_id, round(x - min(x) OVER ({by_deer}), 3) AS x FROM fx",
        "proj20_bounding_box": f"{_F} SELECT deer_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM fx GROUP BY deer_id",
        "a33_correlation": f"{_R} SELECT deer_id, round(corr(x_head, x_ear), 6) AS r FROM rd WHERE abs(x_head) <= 16 AND abs(x_ear) <= 16 GROUP BY deer_id",
        "a26_speed_statistics": f"{_F} SELECT deer_id, round(avg(sp), 6) AS mean_speed, round(stddev_samp(sp) / sqrt(count(*)), 6) AS sem_speed, round(avg(tort), 6) AS mean_tortuosity FROM fx WHERE sp BETWEEN 0 AND 25 GROUP BY deer_id",
        "f8_solar_events": f"{_SUN} SELECT CAST(date AS VARCHAR) AS date, base + up * 1000000 AS sunrise_us, base + down * 1000000 AS sunset_us FROM sun",
        "f7_day_night": f"{_SUN} SELECT event_id, daylight FROM dn",
        "a14_hourly_proportions": f"WITH {LABELS_SQL} SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, {_SHARES} FROM ls GROUP BY 1",
        "a15_time_budget": f"WITH {LABELS_SQL} SELECT animal_id, count(*) AS n, {_SHARES} FROM ls GROUP BY 1",
        "a16_day_night_rates": f"{_SUN} SELECT animal_id, day_act, night_act, day_ear, night_ear, round(rate_day, 6) AS rate_day, round(rate_night, 6) AS rate_night FROM rr",
        "a17_ratio_summary": f"""{_SUN}, q AS (SELECT count(*) AS n_animals, count(*) FILTER (rate_day > rate_night) AS n_day_higher, quantile_cont(CASE WHEN rate_night > 0 THEN rate_day / rate_night END, [0.025, 0.5, 0.975]) AS q FROM rr WHERE rate_day IS NOT NULL AND rate_night IS NOT NULL)
SELECT n_animals, n_day_higher, round(q[2], 6) AS median_ratio, round(q[1], 6) AS q025_ratio, round(q[3], 6) AS q975_ratio FROM q""",
        "w19_signed_ranks": f"""WITH {LABELS_SQL}, h AS (SELECT animal_id, count(*) FILTER (hour(ts) < 12) - count(*) FILTER (hour(ts) >= 12) AS d FROM ls GROUP BY 1),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rank FROM h WHERE d <> 0) SELECT d AS difference, max(rank) AS rank, count(*) AS n FROM r GROUP BY d""",
        "w7_straightness_metres": f"""{_F}{_STEPS} SELECT data_id, round(CASE WHEN d1 IS NULL THEN lead(tt) OVER w WHEN d2 IS NULL THEN lag(tt) OVER w ELSE tt END, 5) AS straightness, round(coalesce(v, lead(v) OVER w), 5) AS speed FROM tv WINDOW w AS ({by_deer} ORDER BY data_id)""",
        "w8_straightness_great_circle": f"""{_F}, st AS (SELECT *, lag(lat) OVER w AS a0, lag(lon) OVER w AS o0, lead(lat) OVER w AS a2, lead(lon) OVER w AS o2 FROM ps WINDOW w AS ({by_deer} ORDER BY data_id)),
ds AS (SELECT *, {_gc("a0", "o0", "lat", "lon")} AS d1, {_gc("lat", "lon", "a2", "o2")} AS d2, {_gc("a0", "o0", "a2", "o2")} AS c FROM st), tv AS (SELECT *, CASE WHEN d1 + d2 = 0 THEN 0 ELSE c / (d1 + d2) END AS tt, d1 / 2.0 AS g FROM ds)
SELECT data_id, round(CASE WHEN d1 IS NULL THEN lead(tt) OVER w WHEN d2 IS NULL THEN lag(tt) OVER w ELSE tt END, 4) AS straightness, round(coalesce(g, lead(g) OVER w), 4) AS speed FROM tv WINDOW w AS ({by_deer} ORDER BY data_id)""",
        "w14_gaussian_smooth": f"""{_F}{_KNOWN.format(c='x')}, v AS (SELECT deer_id, data_id, seq, count(*) OVER ({by_deer}) AS n, CASE WHEN x IS NOT NULL THEN x WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * ((seq - s0) / (s1 - s0)) ELSE coalesce(v0, v1) END AS x FROM kn),
k AS (SELECT unnest(generate_series(-300, 300)) AS k), wt AS (SELECT k, exp(-0.5 * (k / 75.0) ** 2) / sum(exp(-0.5 * (k / 75.0) ** 2)) OVER () AS w FROM k),
p AS (SELECT deer_id, data_id, w, n, ((seq + k) % (2 * n) + 2 * n) % (2 * n) AS p FROM v CROSS JOIN wt)
SELECT p.data_id, round(sum(w * v.x), 3) AS smooth FROM p JOIN v ON v.deer_id = p.deer_id AND v.seq = CASE WHEN p.p >= p.n THEN 2 * p.n - 1 - p.p ELSE p.p END GROUP BY p.data_id""",
        "w18_best_lag": f"""{_R}, g AS (SELECT *, epoch_us("NZ_DateTime") AS us, CASE WHEN epoch_us("NZ_DateTime") - lag(epoch_us("NZ_DateTime")) OVER w <= 60000000 THEN 0 ELSE 1 END AS new FROM rd WINDOW w AS (PARTITION BY deer_id ORDER BY epoch_us("NZ_DateTime"), data_id)),
rc AS (SELECT *, CAST(sum(new) OVER (PARTITION BY deer_id ORDER BY us, data_id) AS BIGINT) AS recording FROM g),
h AS (SELECT deer_id, recording, us, data_id, x_head + y_head + z_head AS h, x_ear + y_ear + z_ear AS e FROM rc WHERE {" AND ".join(f"abs({c.lower()}) <= 16" for c in HEAD + EAR)}),
c AS (SELECT deer_id, recording, row_number() OVER (PARTITION BY deer_id, recording ORDER BY us, data_id) AS pos, h - avg(h) OVER (PARTITION BY deer_id, recording) AS h, e - avg(e) OVER (PARTITION BY deer_id, recording) AS e FROM h),
s AS (SELECT a.deer_id, a.recording, b.pos - a.pos AS lag, round(sum(a.h * b.e), 6) AS s FROM c a JOIN c b ON a.deer_id = b.deer_id AND a.recording = b.recording GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY deer_id, recording ORDER BY s DESC, lag) AS best FROM s) SELECT deer_id, recording, lag, round(s, 3) AS correlation FROM r WHERE best = 1""",
        "f10_map_grid": _grid_sql(),
        "w9_interpolated": f"{_F}{_KNOWN.format(c='x')} SELECT data_id, round(CASE WHEN x IS NOT NULL THEN x WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * ((seq - s0) / (s1 - s0)) ELSE coalesce(v0, v1) END, 4) AS x FROM kn",
        "w10_interpolated_forward": f"{_F}{_KNOWN.format(c='sp')}, o AS (SELECT data_id, round(CASE WHEN sp IS NOT NULL THEN sp WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * ((seq - s0) / (s1 - s0)) ELSE v0 END, 5) AS speed FROM kn) SELECT * FROM o WHERE speed IS NOT NULL",
        "w11_straightness_over_gaps": f"""{_F}{_STEPS.replace("FROM ps", "FROM fx WHERE x IS NOT NULL AND y IS NOT NULL")},
ed AS (SELECT data_id, CASE WHEN d1 IS NULL THEN lead(tt) OVER w WHEN d2 IS NULL THEN lag(tt) OVER w ELSE tt END AS st, coalesce(v, lead(v) OVER w) AS sd FROM tv WINDOW w AS ({by_deer} ORDER BY data_id)),
al AS (SELECT fx.deer_id, fx.data_id, st, sd, row_number() OVER (PARTITION BY deer_id ORDER BY data_id) AS seq FROM fx LEFT JOIN ed USING (data_id)),
kn AS (SELECT *, last_value(CASE WHEN st IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS s0, first_value(CASE WHEN st IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS s1,
  last_value(st IGNORE NULLS) OVER a AS t0, first_value(st IGNORE NULLS) OVER b AS t1, last_value(sd IGNORE NULLS) OVER a AS v0, first_value(sd IGNORE NULLS) OVER b AS v1 FROM al
  WINDOW a AS (PARTITION BY deer_id ORDER BY data_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY deer_id ORDER BY data_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT data_id, round(CASE WHEN st IS NOT NULL THEN st WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN t0 + (t1 - t0) * ((seq - s0) / (s1 - s0)) ELSE coalesce(t0, t1) END, 4) AS straightness,
  round(CASE WHEN sd IS NOT NULL THEN sd WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN v0 + (v1 - v0) * ((seq - s0) / (s1 - s0)) ELSE coalesce(v0, v1) END, 4) AS speed FROM kn""",
        "w12_null_runs": f"""{_F}, sq AS (SELECT *, row_number() OVER w - 1 AS seq FROM fx WINDOW w AS ({by_deer} ORDER BY data_id)),
g AS (SELECT deer_id, seq, seq - row_number() OVER ({by_deer} ORDER BY seq) AS grp FROM sq WHERE lat IS NULL) SELECT deer_id, min(seq) AS start_seq, max(seq) + 1 AS stop_seq FROM g GROUP BY deer_id, grp""",
        "w13_inclusive_fill": f"{_F}{_KNOWN.format(c='y')} SELECT data_id, round(coalesce(y, v0 + (v1 - v0) * CASE WHEN s1 - s0 - 1 > 1 THEN (seq - s0 - 1) / (s1 - s0 - 2) ELSE 0 END), 4) AS y FROM kn",
        "f9_step_distance": f"""{_F}, f AS (SELECT *, first_value(lat) OVER w AS la, first_value(lon) OVER w AS lo FROM ps WINDOW w AS ({by_deer} ORDER BY data_id)),
h AS (SELECT data_id, sin(radians(lat - la) / 2) ** 2 + cos(radians(la)) * cos(radians(lat)) * sin(radians(lon - lo) / 2) ** 2 AS h FROM f) SELECT data_id, round(2 * 6378137.0 * atan2(sqrt(h), sqrt(1 - h)), 4) AS metres FROM h""",
        "w21_time_axis": f"{_F} SELECT data_id, round((row_number() OVER ({by_deer} ORDER BY data_id) - 1) * (count(*) OVER ({by_deer})) / 50.0 / nullif(count(*) OVER ({by_deer}) - 1, 0), 6) AS t FROM fx",
        "w23_segments": f"{_F}, n AS (SELECT data_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ps WINDOW w AS ({by_deer} ORDER BY data_id)) SELECT * FROM n WHERE x1 IS NOT NULL",
    }


def queries() -> dict[str, Query]:
    extra = (m8_wilcoxon, w16_drops, w17_first_drops)
    return {k: globals()[k] for k in oracle_sql()} | {f.__name__: f for f in extra}

"""Queries for intervals, regular grids and implausible readings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.control import flag_implausible
from ..operators.grid import filled_stretches, regular_grid
from ..operators.intervals import merge_intervals
from ..session import table

HOUR_US = 3_600_000_000
ACCELERATION = (-16.0, 16.0)
SPEED = (0.0, 25.0)


def wall_us(name: str) -> F.Column:
    """Microseconds since 1970-01-01 of a wall-clock column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', `{name}`)")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    clips = table(spark, folder, "video_observation_reference").select(
        "repetition", "deer", wall_us("start_time").alias("start_us"), wall_us("stop_time").alias("stop_us")
    )
    return merge_intervals(clips, keys=["repetition", "deer"], start="start_us", stop="stop_us", gap_below=6 * HOUR_US)


def p4_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The regular series of both sensors, covered and filled slots."""
    readings = table(spark, folder, "accelerometer_data")
    slot = F.floor(wall_us("NZ_DateTime") / 20_000)
    return regular_grid(readings, id_col="data_id", key_col="deer_id", slot=slot, value_cols={"ear": "X_ear", "head": "X_head"})


def p4_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Slots of the regular series, covered or filled, with the bounds of filled stretches and the values that were read."""
    read = F.when(~F.col("filled"), F.round("value", 6)).alias("value")
    return p4_grid(spark, folder).select("deer_id", "sensor", "slot", "filled", "gap_first", "gap_last", read)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return filled_stretches(p4_grid(spark, folder), key_col="deer_id")


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Faulty readings with the reason of each."""
    shaken = flag_implausible(
        table(spark, folder, "accelerometer_data"), id_col="data_id", key_col="deer_id", order=wall_us("NZ_DateTime"),
        fields={"X_head": ACCELERATION, "Z_ear": ACCELERATION}, chunk=4 * HOUR_US,
    )
    moved = flag_implausible(
        table(spark, folder, "trajectory_data"), id_col="data_id", key_col="deer_id", order=F.col("data_id"),
        fields={"abs_speed_mPs": SPEED}, chunk=1 << 16,
    )
    named = lambda df, name: df.select(F.lit(name).alias("table_name"), F.col("id").alias("data_id"), "field", "reason")
    return named(shaken, "accelerometer_data").union(named(moved, "trajectory_data"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_reasons(spark, folder).select("table_name", "data_id", "field").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p4_found, p4_grid, p4_slots, p5_found, p5_reasons)}


_GAPS = """
SELECT deer_id, '{name}' AS sensor, prev + 1 AS first_slot, slot - 1 AS last_slot FROM (
  SELECT deer_id, slot, lag(slot) OVER (PARTITION BY deer_id ORDER BY slot) AS prev FROM (
    SELECT DISTINCT deer_id, CAST(floor(epoch_us("NZ_DateTime") / 20000) AS BIGINT) AS slot FROM accelerometer_data
    WHERE deer_id IS NOT NULL AND "NZ_DateTime" IS NOT NULL AND "{col}" IS NOT NULL AND NOT isnan("{col}")))
WHERE slot - prev - 1 BETWEEN 5 AND 2999"""

_SPIKES = """
SELECT * FROM (
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY deer_id ORDER BY {order}) AS pos FROM (
      SELECT DISTINCT deer_id, data_id, {when} AS t, "{col}" AS v FROM {table} WHERE deer_id IS NOT NULL AND {when} IS NOT NULL AND NOT isnan("{col}"))),
  k AS (SELECT *, count(*) OVER (PARTITION BY deer_id, run) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY deer_id ORDER BY pos) AS run FROM (
      SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY deer_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM r))),
  f AS (SELECT deer_id, data_id, pos, n, abs(v - median(round(v, 3)) OVER (PARTITION BY deer_id)) AS far FROM k WHERE v BETWEEN {low} AND {high}),
  g AS (SELECT *, quantile_cont(far, 0.9) OVER (PARTITION BY deer_id) AS usual, lag(far) OVER (PARTITION BY deer_id ORDER BY far) AS below FROM f WHERE n < 12),
  s AS (SELECT *, min(CASE WHEN below >= usual AND far > 2 * below AND below > 0 THEN far END) OVER (PARTITION BY deer_id) AS least FROM g),
  c AS (SELECT *, pos - row_number() OVER (PARTITION BY deer_id ORDER BY pos) AS stretch FROM s WHERE far >= least),
  l AS (SELECT deer_id, max(far) AS lasting FROM (SELECT *, count(*) OVER (PARTITION BY deer_id, stretch) AS m FROM c) WHERE m > 3 GROUP BY 1),
  e AS (SELECT s.*, coalesce(lasting, 0) AS lasting FROM s LEFT JOIN l USING (deer_id)),
  z AS (SELECT *, min(CASE WHEN far > lasting AND below >= usual AND far > 2 * greatest(below, lasting) AND below > 0 THEN far END) OVER (PARTITION BY deer_id) AS bound FROM e)
  SELECT '{table}' AS table_name, data_id, '{col}' AS field, 'spike' AS reason FROM z WHERE far >= bound)
"""

_SLOTS = """
SELECT * FROM (
  WITH c AS (SELECT deer_id, CAST(floor(epoch_us(t) / 20000) AS BIGINT) AS slot, round(avg(v), 6) AS value FROM (
      SELECT DISTINCT deer_id, data_id, "NZ_DateTime" AS t, "{col}" AS v FROM accelerometer_data WHERE deer_id IS NOT NULL AND "NZ_DateTime" IS NOT NULL AND "{col}" IS NOT NULL AND NOT isnan("{col}")) GROUP BY 1, 2),
  g AS (SELECT deer_id, lag(slot) OVER (PARTITION BY deer_id ORDER BY slot) + 1 AS a, slot - 1 AS b FROM c)
  SELECT deer_id, '{name}' AS sensor, slot, false AS filled, NULL::BIGINT AS gap_first, NULL::BIGINT AS gap_last, value FROM c
  UNION ALL SELECT deer_id, '{name}', unnest(generate_series(a, b)), true, a, b, NULL FROM g WHERE b - a + 1 BETWEEN 1 AND 2999)"""

_FAULTS = """
SELECT '{table}' AS table_name, data_id, '{col}' AS field, reason FROM (
  SELECT data_id, 'impossible' AS reason FROM (SELECT DISTINCT data_id, "{col}" AS v FROM {table}) WHERE NOT isnan(v) AND (v < {low} OR v > {high})
  UNION
  SELECT data_id, 'stuck' FROM (
    SELECT data_id, count(*) OVER (PARTITION BY deer_id, run) AS n FROM (
      SELECT *, sum(new) OVER (PARTITION BY deer_id ORDER BY {order}) AS run FROM (
        SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY deer_id ORDER BY {order}) THEN 0 ELSE 1 END AS new FROM (
          SELECT DISTINCT deer_id, data_id, {when} AS t, "{col}" AS v FROM {table} WHERE deer_id IS NOT NULL AND {when} IS NOT NULL AND NOT isnan("{col}"))))) WHERE n >= 12)
"""


def oracle_sql() -> dict[str, str]:
    shaken = {"table": "accelerometer_data", "order": "t, data_id", "when": '"NZ_DateTime"', "low": -16, "high": 16}
    moved = {"table": "trajectory_data", "order": "data_id", "when": "data_id", "low": 0, "high": 25}
    fields = [(shaken, "X_head"), (shaken, "Z_ear"), (moved, "abs_speed_mPs")]
    faults = " UNION ".join(f"SELECT * FROM ({sql.format(col=c, **kind)})" for kind, c in fields for sql in (_FAULTS, _SPIKES))
    return {
        "p5_reasons": faults,
        "p5_found": f"SELECT DISTINCT table_name, data_id, field FROM ({faults})",
        "p4_slots": " UNION ALL ".join(_SLOTS.format(name=n, col=c) for n, c in (("ear", "X_ear"), ("head", "X_head"))),
        "p1_found": """
WITH c AS (SELECT DISTINCT repetition, deer, epoch_us(start_time) AS a, epoch_us(stop_time) AS b FROM video_observation_reference
  WHERE repetition IS NOT NULL AND deer IS NOT NULL AND start_time <= stop_time),
m AS (SELECT *, max(b) OVER (PARTITION BY repetition, deer ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
i AS (SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY repetition, deer ORDER BY a, b) AS island FROM m),
p AS (SELECT repetition, deer, min(a) AS a, max(b) AS b FROM i GROUP BY repetition, deer, island),
g AS (SELECT repetition, deer, lag(b) OVER (PARTITION BY repetition, deer ORDER BY a) AS a, a AS b FROM p)
SELECT 'period' AS kind, repetition, deer, a AS start_us, b AS stop_us FROM p
UNION ALL SELECT 'gap', repetition, deer, a, b FROM g WHERE b - a < 21600000000""",
        "p4_found": " UNION ALL ".join(_GAPS.format(name=n, col=c) for n, c in (("ear", "X_ear"), ("head", "X_head"))),
    }

"""The tables as the frames that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

N_STATES = 5
FPS = 50.0
ORDER = ["ts", "event_id"]
KINDS = ["click", "error", "purchase", "signup", "view"]

#: The label stream in SQL; N_STATES labels in the order of KINDS.
LABELS_SQL = (
    "ls AS (SELECT user_id AS animal_id, ts, event_id, value, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    + " END AS label FROM events)"
)
RUNS_SQL = (
    LABELS_SQL
    + """, lr AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS new, row_number() OVER w - 1 AS seq FROM ls WINDOW w AS (PARTITION BY animal_id ORDER BY ts, event_id)),
lb AS (SELECT *, sum(new) OVER (PARTITION BY animal_id ORDER BY ts, event_id) AS bout FROM lr),
bouts AS (SELECT animal_id, bout, min(label) AS label, count(*) AS length, min(seq) AS start_seq FROM lb GROUP BY animal_id, bout)"""
)


def label_stream(spark: SparkSession, folder: str) -> DataFrame:
    """events as a label stream: animal_id, ts, event_id, value, label; a chunk is a day."""
    label = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int") - 1
    df = table(spark, folder, "events").select(F.col("user_id").alias("animal_id"), "ts", "event_id", "value", label.alias("label"))
    return df.where("animal_id IS NOT NULL AND ts IS NOT NULL AND label >= 0").withColumn("chunk", F.unix_date(F.to_date("ts")))


def exported_bouts(spark: SparkSession, folder: str) -> DataFrame:
    """bout_stream, each bout once, without NULL labels: animal_id, label, length, start_index, bout_id, chunk."""
    df = table(spark, folder, "bout_stream").where("labels IS NOT NULL AND animal_id IS NOT NULL AND start_index IS NOT NULL").distinct()
    return df.select("animal_id", F.col("labels").alias("label"), F.col("lengths").alias("length"), "start_index", "bout_id", F.floor(F.col("start_index") / (1 << 20)).alias("chunk"))


EXPORTED_SQL = (
    "eb AS (SELECT DISTINCT animal_id, labels AS label, lengths AS length, start_index, bout_id FROM bout_stream "
    "WHERE labels IS NOT NULL AND animal_id IS NOT NULL AND start_index IS NOT NULL)"
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

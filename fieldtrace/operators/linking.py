"""Joins of readings with clips, labels and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def frames_of_readings(readings: DataFrame, clips: DataFrame, *, bucket_us: int = 3_600_000_000, fps: float = 30.0) -> DataFrame:
    """The video frame of every reading that lies in a clip: (data_id, clip_id, frame).

    readings: data_id, animal, us; clips: clip_id, animal, start_us, stop_us.
    Ends count as inside; of several clips the smallest id wins; readings
    outside all clips give no row.  Both sides meet in (animal, hour) buckets,
    so neither a busy animal nor a long clip meets all of the other side.
    """
    span = F.sequence(F.floor(F.col("start_us") / bucket_us), F.floor(F.col("stop_us") / bucket_us))
    spread = clips.where("start_us <= stop_us AND animal IS NOT NULL").select("clip_id", "animal", "start_us", "stop_us", F.explode(span).alias("bucket"))
    timed = readings.where("animal IS NOT NULL AND us IS NOT NULL").withColumn("bucket", F.floor(F.col("us") / bucket_us))
    inside = timed.join(spread, ["animal", "bucket"]).where("us BETWEEN start_us AND stop_us")
    first = inside.groupBy("data_id").agg(F.min(F.struct("clip_id", "start_us", "us")).alias("m"))
    return first.select("data_id", "m.clip_id", F.floor((F.col("m.us") - F.col("m.start_us")) / 1e6 * fps).alias("frame"))


def join_by_position(left: DataFrame, right: DataFrame, *, left_order: list[str], right_order: list[str], keys: list[str]) -> DataFrame:
    """Rows of both frames with the same place within a key; both need a chunk column."""
    a = numbered(left, keys=keys, order=left_order).drop("chunk")
    b = numbered(right, keys=keys, order=right_order).drop("chunk")
    return a.join(b, [*keys, "seq"])


def override(base: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which rows of newer replace those of base with the same keys."""
    return base.join(newer.select(*keys).distinct(), keys, "left_anti").unionByName(newer)


def highest(df: DataFrame, by: list[str], value: str, tie: list[str]) -> DataFrame:
    """The row of each group with the largest value, the first by tie among equals."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), *tie)
    return df.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def with_existing_files(df: DataFrame, path_col: str, folder: str) -> DataFrame:
    """Rows whose path is that of a file below folder."""
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"))
    return df.join(files, F.regexp_replace(path_col, "^file:/+", "/") == F.col("_path"), "left_semi")


def animal_of_name(name) -> F.Column:
    """R and D parts of a file name such as R2_D9_00001.mp4, as R2D9; NULL if either is missing."""
    parts = F.split(F.element_at(F.split(name, "/"), -1), "[_.]")
    r, d = F.filter(parts, lambda p: p.rlike("^R[0-9]"))[0], F.filter(parts, lambda p: p.rlike("^D[0-9]"))[0]
    return F.concat(r, d)

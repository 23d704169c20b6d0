"""Readers of the raw and intermediate files, with fixed schemas."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import clean
from .npy import register_npy

RAW = "TagID STRING, Date STRING, Time STRING, X DOUBLE, Y DOUBLE, Z DOUBLE, `location-lat` DOUBLE, `location-lon` DOUBLE"
FIT = (
    "calinski_harabasz_score DOUBLE, inertia DOUBLE, data_file STRING, reduction_percent DOUBLE, cut_position_percent DOUBLE, "
    "centroids ARRAY<ARRAY<DOUBLE>>, analysis_start_date STRING, analysis_duration STRING"
)
VIDEO = "Filepath STRING, Rep INT, Deer INT, Frame_Count BIGINT, Start_Time STRING, Comments STRING"


def raw_readings(spark: SparkSession, path: str, *, ear: bool = False, shift_hours: int = 13) -> DataFrame:
    """Raw logger rows: ts (wall clock, shifted), X, Y, Z, and the position unless ear.

    A path that doesn't exist gives an empty frame; times that can't be read are NULL.
    """
    columns = ["Date", "Time", "X", "Y", "Z", *([] if ear else ["location-lat", "location-lon"])]
    if "*" not in path and "://" not in path and not Path(path).exists():
        df = spark.createDataFrame([], RAW)
    else:
        df = spark.read.schema(RAW).option("header", True).csv(path)
    text = F.concat_ws(" ", "Date", "Time")
    pattern = F.lit("dd/MM/yyyy HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]")
    ok = text.rlike(r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$")
    ts = F.when(ok, F.to_timestamp_ntz(text, pattern)) + F.make_dt_interval(hours=F.lit(shift_hours))
    return df.select(*columns).select(ts.alias("ts"), *[F.col(f"`{c}`") for c in columns[2:]])


def video_clips(spark: SparkSession, path: str, *, fps: float = 30.0) -> DataFrame:
    """Clips of a CSV file with their stop time from the number of frames."""
    df = spark.read.schema(VIDEO).option("header", True).option("enforceSchema", False).csv(path)
    start = F.to_timestamp_ntz("Start_Time", F.lit("yyyy-MM-dd HH:mm:ss"))
    stop = start + F.make_dt_interval(secs=F.col("Frame_Count") / fps)
    return df.select(
        F.col("Filepath").alias("original_file_path"), F.col("Rep").alias("repetition"), F.col("Deer").alias("deer"),
        F.col("Frame_Count").alias("frame_count"), start.alias("start_time"), stop.alias("stop_time"), F.col("Comments").alias("comment"),
    )


def fit_records(spark: SparkSession, folder: str, *, keep_centroids: bool = False) -> DataFrame:
    """Fit records of a folder and those below it: the JSON fields with k and file_path.

    Only files with _meta_k in their own name or their folder's; unreadable ones
    and those without a leave-out share or centroids are passed over.
    """
    reader = spark.read.schema(FIT + ", _corrupt_record STRING").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True)
    df = reader.json(folder).select("*", F.col("_metadata.file_path").alias("file_path")).where("file_path LIKE '%\\_meta\\_k%'")
    df = df.where("_corrupt_record IS NULL AND reduction_percent IS NOT NULL AND centroids IS NOT NULL")
    df = df.withColumn("k", F.size("centroids")).drop("_corrupt_record")
    return df if keep_centroids else df.drop("centroids")


def duration_minutes(c: F.Column) -> F.Column:
    """Minutes of a duration written H:MM:SS with or without a fraction; NULL if it isn't."""
    part = lambda k: F.regexp_extract(c, r"^(\d+):(\d{2}):(\d{2}(?:\.\d+)?)$", k)
    return F.when(part(1) != "", part(1).cast("double") * 60 + part(2).cast("double") + part(3).cast("double") / 60)


def task_tables(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All CSV files of a pattern as one frame."""
    return spark.read.schema(schema).option("header", True).csv(pattern)


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small CSV table; NaN becomes NULL."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*[clean(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def animal_codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes of a file with one on each line, sorted; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("code")).where("code <> ''").orderBy("code")


def generated_codes(spark: SparkSession, repetitions: int = 4, animals: int = 9) -> DataFrame:
    r, d = spark.range(1, repetitions + 1).withColumnRenamed("id", "r"), spark.range(1, animals + 1).withColumnRenamed("id", "d")
    return r.crossJoin(d).select(F.format_string("R%d_D%d", "r", "d").alias("code")).orderBy("code")


def array_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A .npy file; anything else is read as CSV with the given schema."""
    if path.endswith(".npy"):
        register_npy(spark)
        return spark.read.format("npy").load(path)
    return spark.read.schema(schema or "value DOUBLE").option("header", schema is not None).csv(path)


def sensor_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Synchronised recordings kept as parquet, one file an animal; animal from the file name (R..D..)."""
    from ..operators.linking import animal_of_name

    return spark.read.parquet(folder).withColumn("animal", animal_of_name(F.col("_metadata.file_name")))


def one_animal(df: DataFrame, key: str, value) -> DataFrame:
    """One animal's rows; on a table partitioned by key only its files are read."""
    return df.where(F.col(key) == F.lit(value))


def animals(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


class PathNotConfigured(LookupError):
    """No place is set for a name."""


def resolve_path(key: str, *, spark: SparkSession | None = None, env: str | None = None, file: str | None = None, default: str | None = None) -> str:
    """Where ``key`` lies: session setting fieldtrace.<key>, environment, JSON file, default; placeholders <...> don't count."""
    found = spark.conf.get(f"fieldtrace.{key}", None) if spark is not None else None
    if found:
        return found
    if env and os.environ.get(env):
        return os.environ[env]
    if file and Path(file).exists():
        value = json.loads(Path(file).read_text()).get(key)
        if value and not str(value).startswith("<"):
            return str(value)
    if default is not None:
        return default
    raise PathNotConfigured(f"no place is set for {key!r}")


def edge_slices(df: DataFrame, *, keys: list[str], size: int) -> DataFrame:
    """First, middle and last ``size`` rows (column part) of each key of a frame with seq; NULL keys have none."""
    with_n = df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    half = F.floor(F.col("_n") / 2)
    part = F.array_compact(F.array(
        F.when(F.col("seq") < size, F.lit("first")),
        F.when((F.col("seq") >= half - size // 2) & (F.col("seq") < half + size // 2), F.lit("middle")),
        F.when(F.col("seq") >= F.col("_n") - size, F.lit("last")),
    ))
    return with_n.withColumn("part", F.explode(part)).drop("_n")

"""Queries on readers, writers and streams: tables are written to the shared folder in the formats of the field, read back and held against the originals."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import features as X
from ..operators import linking as J
from ..operators import sequence as S
from ..session import shared_folder, table
from ..sources import readers as R
from ..sources import sinks as W
from ..streaming import online as O
from .adapters import EXPORTED_SQL, FPS, LABELS_SQL, N_STATES, ORDER, RUNS_SQL, exported_bouts, label_stream, rounded
from .cleaning import wall_us
from .signals import fixes, readings

Query = Callable[[SparkSession, str], DataFrame]
HEAD = ["X_head", "Y_head", "Z_head"]


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid4().hex}"


# ---- sources


def s1_raw_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Head readings written as a logger writes them, 13 hours early, and read again."""
    path = _scratch(spark)
    df = readings(spark, folder).dropna(subset=HEAD).withColumn("at", F.col("NZ_DateTime") - F.make_dt_interval(hours=F.lit(13)))
    raw = df.select(
        F.lit("T1").alias("TagID"), F.date_format("at", "dd/MM/yyyy").alias("Date"), F.date_format("at", "HH:mm:ss.SSSSSS").alias("Time"),
        *[F.col(c).alias(c[0]) for c in HEAD], F.lit(None).cast("double").alias("location-lat"), F.lit(None).cast("double").alias("location-lon"),
    )
    raw.write.option("header", True).csv(path)
    return R.raw_readings(spark, path).select(wall_us("ts").alias("us"), F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Z").alias("z"))


def s2_sensor_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each animal, named by the folder that its recordings are kept in."""
    path = _scratch(spark)
    df = readings(spark, folder).select("deer_id", "data_id", "X_head")
    W.write_by_animal(df, path)
    return spark.read.parquet(path).groupBy("deer_id").agg(F.count("*").alias("n"), F.sum(F.col("data_id")).alias("ids"))


def s3_array(spark: SparkSession, folder: str) -> DataFrame:
    """Positions written as .npy parts in the order of data_id, and read again."""
    path = _scratch(spark)
    df = fixes(spark, folder).dropna(subset=["pos_NZMG_x_meter", "pos_NZMG_y_meter"])
    W.write_array(df, ["data_id", "pos_NZMG_x_meter", "pos_NZMG_y_meter"], ["data_id"], path)
    R.register_npy(spark)
    return spark.read.format("npy").load(path).select(F.col("c0").cast("bigint").alias("data_id"), F.col("c1").alias("x"), F.col("c2").alias("y"))


def _fit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A record for each label of the exported bouts in the form of a fit: its animals' mean lengths are the centroids."""
    one = exported_bouts(spark, folder).groupBy("label", "animal_id").agg(F.avg("length").alias("m"), F.count("*").alias("n"))
    return one.groupBy("label").agg(
        F.sum("n").cast("double").alias("calinski_harabasz_score"), F.lit(None).cast("double").alias("inertia"), F.lit("bout_stream").alias("data_file"),
        F.lit(0.0).alias("reduction_percent"), F.lit(0.0).alias("cut_position_percent"),
        F.transform(F.array_sort(F.collect_list(F.struct("animal_id", "m"))), lambda x: F.array(x["m"])).alias("centroids"),
        F.lit("2018-10-22").alias("analysis_start_date"), F.format_string("0:%02d:30.5", "label").alias("analysis_duration"),
    )


def _write_fits(spark: SparkSession, folder: str) -> str:
    """Fits of the exported bouts, one for each of the (up to 8) labels, at the places of the sweep."""
    path = _scratch(spark)
    fits, bouts = _fit_rows(spark, folder), exported_bouts(spark, folder)
    for (label,) in bouts.select("label").distinct().collect():
        places = W.fit_paths(path, "fit", label, 0, 0)
        mine = fits.where(F.col("label") == label)
        W.write_fit(mine.drop("label"), mine.select(F.explode("centroids").alias("centroid")), bouts.where(F.col("label") == label).select("bout_id", "label"), places)
    return path


def s5_fit_records(spark: SparkSession, folder: str) -> DataFrame:
    """Fit records found below a folder: their number of centroids, score and minutes."""
    df = R.fit_records(spark, _write_fits(spark, folder))
    return rounded(df.select("k", F.col("calinski_harabasz_score").alias("ch"), R.duration_minutes(F.col("analysis_duration")).alias("minutes")))


def s6_fit_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """All centroids of the records found below a folder."""
    df = R.fit_records(spark, _write_fits(spark, folder), keep_centroids=True)
    return rounded(df.select(F.col("calinski_harabasz_score").alias("ch"), F.explode("centroids").alias("c")).select("ch", F.col("c")[0].alias("x0")))


def k8_fit_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels written beside each fit, by label, and whether their folder is that of the fit."""
    df = spark.read.parquet(f"{_write_fits(spark, folder)}/*/*/*/*/labels").withColumn("path", F.col("_metadata.file_path"))
    return df.groupBy("label").agg(F.count("*").alias("n"), F.min(F.col("path").contains(F.concat(F.lit("/k="), F.col("label"), F.lit("/")))).alias("in_place"))


def proj14_existing_fits(spark: SparkSession, folder: str) -> DataFrame:
    """Of all labels those with a record on file, best score first."""
    path = _write_fits(spark, folder)
    records = R.fit_records(spark, path)
    gone = records.select("k", "calinski_harabasz_score", F.concat("file_path", F.lit(".gone")).alias("file_path"))
    both = records.select("k", "calinski_harabasz_score", "file_path").union(gone)
    return J.with_existing_files(both, "file_path", path).orderBy(F.desc("calinski_harabasz_score")).select("k", F.col("calinski_harabasz_score").alias("ch"))


def s7_task_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Per-task CSV files, one for each animal, read as one table."""
    path = _scratch(spark)
    df = exported_bouts(spark, folder).select("bout_id", "animal_id", "length")
    df.repartition("animal_id").write.option("header", True).csv(path)
    return R.task_tables(spark, f"{path}/part-*.csv", "bout_id BIGINT, animal_id BIGINT, length BIGINT")


def s8_one_animal(spark: SparkSession, folder: str) -> DataFrame:
    return R.one_animal(readings(spark, folder), "deer_id", 12).select("data_id", "X_head").withColumnRenamed("X_head", "x_head")


def s10_animals(spark: SparkSession, folder: str) -> DataFrame:
    return R.animals(table(spark, folder, "accelerometer_data"), "deer_id")


def s11_animal_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The animals' codes written one on each line, with blanks, and read again."""
    path = _scratch(spark)
    codes = table(spark, folder, "deer_info").select(F.concat(F.lit(" "), "repetition_number", F.lit("_"), "deer_number", F.lit(" \n")).alias("value"))
    codes.write.text(path)
    return R.animal_codes(spark, path)


def s12_generated_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Generated codes that are those of an animal."""
    codes = table(spark, folder, "deer_info").select(F.concat_ws("_", "repetition_number", "deer_number").alias("code"))
    return R.generated_codes(spark).join(codes, "code")


def s13_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """The container capacities as a CSV table with a header."""
    path = _scratch(spark)
    W.save_table(table(spark, folder, "token_bins"), path)
    return R.dimension(spark, path, "bin_kind INT, capacity_tokens INT, used_for STRING")


def k20_saved_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Medians of bout lengths by animal and label, saved as CSV and read again."""
    path = _scratch(spark)
    W.save_table(a24_medians_by_two_keys(spark, folder), path)
    return R.dimension(spark, path, "animal_id BIGINT, label INT, n_fits BIGINT, length DOUBLE, length_low DOUBLE, length_high DOUBLE")


# ---- sinks


def k2_append(spark: SparkSession, folder: str) -> DataFrame:
    """Readings appended to a store that is made twice, in two parts."""
    path = _scratch(spark)
    W.create_store(spark, path)
    df = readings(spark, folder).drop("us", "chunk")
    for part in (0, 1):
        W.append_rows(df.where(F.pmod("data_id", F.lit(2)) == part), path, "accelerometer_data")
        W.create_store(spark, path)
    return rounded(spark.read.parquet(f"{path}/accelerometer_data").groupBy("deer_id").agg(F.count("*").alias("n"), F.avg("X_head").alias("x_head")))


def k3_append_known(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes appended to the store; every animal is on file. Speeds that are NaN come back as NULL."""
    path = _scratch(spark)
    df = table(spark, folder, "trajectory_data").where("deer_id IS NOT NULL AND data_id IS NOT NULL").distinct()
    W.append_known(df, table(spark, folder, "deer_info"), path, "trajectory_data")
    return spark.read.parquet(f"{path}/trajectory_data").select("data_id", "deer_id", F.col("abs_speed_mPs").alias("speed"))


def k4_video_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Clips written as the observers' CSV file; their stop time follows from the number of frames."""
    path = _scratch(spark)
    clips = table(spark, folder, "video_observation_reference").where("start_time IS NOT NULL AND frame_count IS NOT NULL").distinct()
    clips.select(
        F.col("original_file_path").alias("Filepath"), F.col("repetition").alias("Rep"), F.col("deer").alias("Deer"), F.col("frame_count").alias("Frame_Count"),
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("Start_Time"), F.lit("").alias("Comments"),
    ).coalesce(1).write.option("header", True).csv(path)
    got = R.video_clips(spark, path)
    return got.select("original_file_path", "repetition", "deer", "frame_count", wall_us("start_time").alias("start_us"), wall_us("stop_time").alias("stop_us"))


def k5_availability(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of readings as a CSV file, imported into the store."""
    from .analysis import j5_frames

    path = _scratch(spark)
    W.save_table(j5_frames(spark, folder).select(F.col("data_id").alias("accelerometer_data_id"), F.col("clip_id").alias("video_observation_reference_id"), "frame"), f"{path}/csv")
    W.append_rows(R.dimension(spark, f"{path}/csv", "accelerometer_data_id BIGINT, video_observation_reference_id BIGINT, frame BIGINT"), path, "video_availability")
    back = spark.read.parquet(f"{path}/video_availability")
    return back.select(F.col("accelerometer_data_id").alias("data_id"), F.col("video_observation_reference_id").alias("clip_id"), "frame")


def k6_labels_by_position(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of the exported bouts, in the order of their ids, put on the fixes in the order of theirs; one side is longer."""
    path = _scratch(spark)
    W.write_array(exported_bouts(spark, folder), ["label"], ["bout_id", "start_index"], path)
    R.register_npy(spark)
    labels = spark.read.format("npy").load(path).select("row", F.col("c0").alias("value"))
    return W.labels_by_position(fixes(spark, folder), labels, id_col="data_id", id_width=1 << 16)


def k7_export_animal(spark: SparkSession, folder: str) -> DataFrame:
    """The fixes of animal 12 as CSV."""
    path = _scratch(spark)
    W.export_animal(fixes(spark, folder).select("deer_id", "data_id", "pos_NZMG_x_meter"), 12, path)
    return spark.read.schema("deer_id BIGINT, data_id BIGINT, x DOUBLE").option("header", True).csv(path)


def k11_results_json(spark: SparkSession, folder: str) -> DataFrame:
    """The label report as JSON, with statistics put in, read back cell by cell."""
    stream = label_stream(spark, folder)
    shares = stream.groupBy("label").agg(F.count("*").alias("n"))
    shares = shares.crossJoin(shares.agg(F.sum("n").alias("total"))).select("label", (100.0 * F.col("n") / F.col("total")).alias("percent"))
    results = W.results_json(shares, S.mean_durations(S.bouts(stream, ORDER), N_STATES, FPS), S.transitions(stream, ORDER, N_STATES))
    stats = stream.groupBy("label").agg(F.avg("value").alias("mean_speed"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem_speed"))
    full = W.annotate_json(results, stats)
    kind = "STRUCT<centroids: ARRAY<STRUCT<label: INT, percent: DOUBLE, mean_s: DOUBLE, sem_s: DOUBLE, mean_speed: DOUBLE, sem_speed: DOUBLE>>>"
    return rounded(full.select(F.explode(F.from_json("json", kind)["centroids"]).alias("c")).select("c.*"), 5)


def k12_transitions_of_json(spark: SparkSession, folder: str) -> DataFrame:
    """The transition counts in the label report."""
    stream = label_stream(spark, folder)
    shares = stream.groupBy("label").agg(F.avg(F.lit(1.0)).alias("percent"))
    results = W.results_json(shares, S.mean_durations(S.bouts(stream, ORDER), N_STATES, FPS), S.transitions(stream, ORDER, N_STATES))
    kind = "STRUCT<transitions: ARRAY<STRUCT<from_state: INT, to_state: INT, n: BIGINT>>>"
    return results.select(F.explode(F.from_json("json", kind)["transitions"]).alias("t")).select("t.*")


def k13_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines scaled by their largest values, written with the divisors and scaled back."""
    path, cols = _scratch(spark), ["l_quantity", "l_extendedprice"]
    W.write_scaled(table(spark, folder, "lineitem").select("l_returnflag", *cols), cols, path)
    scale = spark.read.schema(", ".join(f"m_{c} DOUBLE" for c in cols)).option("header", True).csv(f"{path}/divisors")
    both = spark.read.parquet(f"{path}/data").crossJoin(F.broadcast(scale))
    return rounded(both.groupBy("l_returnflag").agg(*[F.avg(F.col(c) * F.col(f"m_{c}")).alias(c) for c in cols]), 4)


def k14_by_animal(spark: SparkSession, folder: str) -> DataFrame:
    """The label timeline written by animal, counted as it is written."""
    path = _scratch(spark)
    W.write_by_animal(label_stream(spark, folder).select("animal_id", "event_id", "label"), path, "animal_id")
    return spark.read.parquet(path).groupBy(F.col("animal_id").cast("bigint").alias("animal_id")).agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


def _relabelled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labels of the exported bouts before and after the even ones got the next label."""
    before = exported_bouts(spark, folder).groupBy(F.col("bout_id").alias("acc_id")).agg(F.min("label").alias("label"))
    newer = before.where("acc_id % 2 = 0").select("acc_id", (F.col("label") + 1).alias("label"))
    return before, W.relabel(before, newer, ["acc_id"])


def k15_archive(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    W.archive(_relabelled(spark, folder)[0], path)
    return spark.read.parquet(path)


def k16_relabel(spark: SparkSession, folder: str) -> DataFrame:
    return _relabelled(spark, folder)[1]


def k17_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Animals of the register's clips replaced by those of the information table."""
    path = _scratch(spark)
    old = table(spark, folder, "behaviour_register").where("deer_id IS NOT NULL").select("deer_id").distinct().withColumn("source", F.lit("register"))
    new = table(spark, folder, "deer_info").where("deer_number = 'D1'").select("deer_id").withColumn("source", F.lit("info"))
    W.upsert(old, new, ["deer_id"], path)
    return spark.read.parquet(path)


def k18_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Labels counted before and after, and ten spot checks (label -1) of those after."""
    before, after = _relabelled(spark, folder)
    spots = W.spot_checks(after, after, "acc_id").agg(F.count("*").alias("n_before"), F.count_if("agrees").alias("n_after"))
    spots = spots.select(F.lit(-1).alias("label"), "n_before", "n_after", (F.col("n_after") - F.col("n_before")).alias("change"))
    return W.verify_labels(before, after).union(spots)


# ---- small operators that other queries use with random fits only


def proj21_mean_divisor(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of the six axes' largest values within 16 g."""
    axes = [*HEAD, "X_ear", "Y_ear", "Z_ear"]
    return rounded(X.mean_divisor(X.max_abs(readings(spark, folder).where(" AND ".join(f"abs({c}) <= 16" for c in axes)), axes), axes, most=10.0))


def proj24_edge_slices(spark: SparkSession, folder: str) -> DataFrame:
    """First, middle and last twenty fixes of every animal."""
    from ..operators.ordered import numbered

    df = numbered(fixes(spark, folder), keys=["deer_id"], order=["data_id"])
    return R.edge_slices(df, keys=["deer_id"], size=20).select("deer_id", "data_id", "part")


def a24_medians_by_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Median and quartiles of bout lengths by animal and label, as for fits by share and k."""
    return rounded(K.per_k(exported_bouts(spark, folder), ["length"], by=["animal_id", "label"]))


def a23_medians_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(K.per_k(exported_bouts(spark, folder).withColumn("k", F.col("label")), ["length"]))


def a37_median_count(spark: SparkSession, folder: str) -> DataFrame:
    """The median number of bouts of an animal and label, as of fits for each k."""
    return K.median_count(exported_bouts(spark, folder), ["animal_id", "label"])


def t2_longest_bouts(spark: SparkSession, folder: str) -> DataFrame:
    """The longest bout of every animal, the first id on a tie."""
    return J.highest(exported_bouts(spark, folder).select("animal_id", "length", "bout_id"), ["animal_id"], "length", ["bout_id"])


def u1_union_all(spark: SparkSession, folder: str) -> DataFrame:
    """Head and ear readings below each other, rows by sensor."""
    one = lambda name, col: readings(spark, folder).select(F.lit(name).alias("sensor"), F.col(col).alias("x"))
    return rounded(S.union_all([one("head", "X_head"), one("ear", "X_ear")]).groupBy("sensor").agg(F.count("*").alias("n"), F.count("x").alias("n_known"), F.avg("x").alias("x")))


# ---- streams


def _streamed(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """events as files, read as a stream, and a folder for what comes of it."""
    path = _scratch(spark)
    df = label_stream(spark, folder).select("animal_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "label", "value")
    df.coalesce(1).write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{path}/in"), path


def _drained(df: DataFrame, path: str, mode: str) -> DataFrame:
    """All that the stream gives for the files that are there."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    df.sparkSession.createDataFrame([], df.schema).write.parquet(f"{path}/out")
    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/out")


def x1_classified(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the stream to the nearest of three centroids."""
    stream, path = _streamed(spark, folder)
    return _drained(O.classify(stream, ["value"], [[10.0], [50.0], [200.0]]).select("event_id", "cluster"), path, "append")


def _us(name: str) -> F.Column:
    return F.unix_micros(name).alias(f"{name}_us")


def x2_online_bouts(spark: SparkSession, folder: str) -> DataFrame:
    """Bouts that a label change has ended; an animal's last one is left out, as the stream may still hold it."""
    stream, path = _streamed(spark, folder)
    got = _drained(O.bouts(stream), path, "append")
    last = stream.sparkSession.read.parquet(f"{path}/in").groupBy("animal_id").agg(F.max("ts").alias("last"))
    # A bout that holds its animal's last row starts where none of that animal's rows of another label follows.
    other = label_stream(spark, folder).select("animal_id", F.col("ts").cast("timestamp").alias("ts"), "label")
    ends = other.join(last, "animal_id").groupBy("animal_id").agg(F.max_by("label", F.struct("ts")).alias("tail"), F.max("last").alias("last"))
    change = other.join(ends, "animal_id").where("label <> tail").groupBy("animal_id").agg(F.max("ts").alias("change"))
    whole = got.join(change, "animal_id").where(F.col("start") <= F.col("change"))
    return whole.select("animal_id", "label", _us("start"), "n")


def x3_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    stream, path = _streamed(spark, folder)
    return _drained(O.rolling_counts(stream), path, "complete").select(_us("start"), _us("stop"), "label", "n")


def x4_sessions(spark: SparkSession, folder: str) -> DataFrame:
    stream, path = _streamed(spark, folder)
    return _drained(O.sessions(stream, key="animal_id"), path, "complete").select("animal_id", _us("start"), _us("stop"), "n")


# ---- SQL

_R = (
    "WITH rd AS (SELECT DISTINCT data_id, deer_id, epoch_us(\"NZ_DateTime\") AS us, "
    + ", ".join(f'CASE WHEN NOT isnan("{c}") THEN "{c}" END AS {c.lower()}' for c in [*HEAD, "X_ear", "Y_ear", "Z_ear"])
    + ' FROM accelerometer_data WHERE deer_id IS NOT NULL AND "NZ_DateTime" IS NOT NULL)'
)
_FX = 'WITH fx AS (SELECT DISTINCT data_id, deer_id, "pos_NZMG_x_meter" AS x, "pos_NZMG_y_meter" AS y, CASE WHEN NOT isnan("abs_speed_mPs") THEN "abs_speed_mPs" END AS sp FROM trajectory_data WHERE deer_id IS NOT NULL AND data_id IS NOT NULL)'
_FIT = f"WITH {EXPORTED_SQL}, o AS (SELECT label, animal_id, avg(length) AS m, count(*) AS n FROM eb GROUP BY 1, 2), f AS (SELECT label, count(*) AS k, CAST(sum(n) AS DOUBLE) AS ch FROM o GROUP BY 1)"
_MED = "count(*) AS n_fits, round(quantile_cont(length, 0.5), 6) AS length, round(quantile_cont(length, 0.25), 6) AS length_low, round(quantile_cont(length, 0.75), 6) AS length_high"
_RL = f"WITH {EXPORTED_SQL}, b AS (SELECT bout_id AS acc_id, min(label) AS label FROM eb GROUP BY 1), a AS (SELECT acc_id, CASE WHEN acc_id % 2 = 0 THEN label + 1 ELSE label END AS label FROM b)"
_AXES = ("x_head", "y_head", "z_head", "x_ear", "y_ear", "z_ear")


def oracle_sql() -> dict[str, str]:
    from .analysis import oracle_sql as analysis_sql

    codes = "SELECT repetition_number || '_' || deer_number AS code FROM deer_info"
    medians = f"WITH {EXPORTED_SQL} SELECT animal_id, label, {_MED} FROM eb GROUP BY 1, 2"
    ls = f"WITH {LABELS_SQL}"
    return {
        "s1_raw_readings": f"{_R} SELECT us, x_head AS x, y_head AS y, z_head AS z FROM rd WHERE x_head IS NOT NULL AND y_head IS NOT NULL AND z_head IS NOT NULL",
        "s2_sensor_tables": f"{_R} SELECT CAST(deer_id AS INTEGER) AS deer_id, count(*) AS n, CAST(sum(data_id) AS BIGINT) AS ids FROM rd GROUP BY 1",
        "s3_array": f"{_FX} SELECT data_id, x, y FROM fx WHERE x IS NOT NULL AND y IS NOT NULL",
        "s5_fit_records": f"{_FIT} SELECT CAST(k AS INTEGER) AS k, ch, round(label + 30.5 / 60, 6) AS minutes FROM f",
        "s6_fit_centroids": f"{_FIT} SELECT ch, round(m, 6) AS x0 FROM o JOIN f USING (label)",
        "k8_fit_labels": f"WITH {EXPORTED_SQL} SELECT label, count(*) AS n, true AS in_place FROM eb GROUP BY 1",
        "proj14_existing_fits": f"{_FIT} SELECT CAST(k AS INTEGER) AS k, ch FROM f",
        "s7_task_tables": f"WITH {EXPORTED_SQL} SELECT bout_id, animal_id, length FROM eb",
        "s8_one_animal": f"{_R} SELECT data_id, x_head FROM rd WHERE deer_id = 12",
        "s10_animals": "SELECT DISTINCT deer_id FROM accelerometer_data WHERE deer_id IS NOT NULL",
        "s11_animal_codes": codes,
        "s12_generated_codes": codes,
        "s13_dimension": "SELECT * FROM token_bins",
        "k20_saved_medians": medians,
        "k2_append": f"{_R} SELECT deer_id, count(*) AS n, round(avg(x_head), 6) AS x_head FROM rd GROUP BY 1",
        "k3_append_known": f"{_FX} SELECT data_id, deer_id, sp AS speed FROM fx",
        "k4_video_clips": "SELECT DISTINCT ON (id, start_time) original_file_path, repetition, deer, frame_count, epoch_us(date_trunc('second', start_time)) AS start_us, epoch_us(date_trunc('second', start_time)) + CAST(round(frame_count * 1000000 / 30.0) AS BIGINT) AS stop_us FROM (SELECT DISTINCT * FROM video_observation_reference) WHERE start_time IS NOT NULL AND frame_count IS NOT NULL",
        "k5_availability": analysis_sql()["j5_frames"],
        "k6_labels_by_position": f"{_FX}, {EXPORTED_SQL}, a AS (SELECT data_id, row_number() OVER (ORDER BY data_id) AS place FROM fx), b AS (SELECT label, row_number() OVER (ORDER BY bout_id, start_index) AS place FROM eb) SELECT data_id AS acc_id, label FROM a JOIN b USING (place)",
        "k7_export_animal": f"{_FX} SELECT deer_id, data_id, x FROM fx WHERE deer_id = 12",
        "k11_results_json": f"""WITH {RUNS_SQL}, d AS (SELECT label, avg(length) / 50.0 AS mean_s, coalesce(stddev_samp(length), 0) / sqrt(count(*)) / 50.0 AS sem_s FROM bouts GROUP BY 1),
s AS (SELECT label, 100.0 * count(*) / sum(count(*)) OVER () AS percent, avg(value) AS mean_speed, stddev_samp(value) / sqrt(count(value)) AS sem_speed FROM ls GROUP BY 1)
SELECT label, round(percent, 5) AS percent, round(mean_s, 5) AS mean_s, round(sem_s, 5) AS sem_s, round(mean_speed, 5) AS mean_speed, round(sem_speed, 5) AS sem_speed FROM s JOIN d USING (label)""",
        "k12_transitions_of_json": f"""{ls}, pr AS (SELECT lag(label) OVER (PARTITION BY animal_id ORDER BY ts, event_id) AS a, label AS b FROM ls), st AS (SELECT CAST(range AS INTEGER) AS s FROM range({N_STATES}))
SELECT x.s AS from_state, y.s AS to_state, count(pr.a) AS n FROM st x CROSS JOIN st y LEFT JOIN pr ON pr.a = x.s AND pr.b = y.s GROUP BY 1, 2""",
        "k13_scaled": "SELECT l_returnflag, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1",
        "k14_by_animal": f"{ls} SELECT animal_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM ls GROUP BY 1",
        "k15_archive": f"{_RL} SELECT acc_id, label FROM b",
        "k16_relabel": f"{_RL} SELECT acc_id, label FROM a",
        "k17_upsert": "SELECT deer_id, 'info' AS source FROM deer_info WHERE deer_number = 'D1' UNION ALL SELECT DISTINCT deer_id, 'register' FROM behaviour_register WHERE deer_id IS NOT NULL AND deer_id NOT IN (SELECT deer_id FROM deer_info WHERE deer_number = 'D1')",
        "k18_verify": f"""{_RL}, n AS (SELECT label, (SELECT count(*) FROM b WHERE b.label = l.label) AS n_before, (SELECT count(*) FROM a WHERE a.label = l.label) AS n_after FROM (SELECT label FROM a UNION SELECT label FROM b) l)
SELECT label, n_before, n_after, n_after - n_before AS change FROM n UNION ALL SELECT -1, least(10, count(*)), least(10, count(*)), 0 FROM a""",
        "proj21_mean_divisor": f"{_R}, m AS (SELECT {', '.join(f'max(abs({c})) AS {c}' for c in _AXES)} FROM rd WHERE {' AND '.join(f'abs({c}) <= 16' for c in _AXES)}) SELECT round(({' + '.join(_AXES)}) / 6, 6) AS divisor FROM m",
        "proj24_edge_slices": f"""{_FX}, s AS (SELECT deer_id, data_id, row_number() OVER (PARTITION BY deer_id ORDER BY data_id) - 1 AS seq, count(*) OVER (PARTITION BY deer_id) AS n FROM fx)
SELECT deer_id, data_id, 'first' AS part FROM s WHERE seq < 20 UNION ALL SELECT deer_id, data_id, 'middle' FROM s WHERE seq >= n // 2 - 10 AND seq < n // 2 + 10 UNION ALL SELECT deer_id, data_id, 'last' FROM s WHERE seq >= n - 20""",
        "a24_medians_by_two_keys": medians,
        "a23_medians_by_label": f"WITH {EXPORTED_SQL} SELECT label AS k, {_MED} FROM eb GROUP BY 1",
        "a37_median_count": f"WITH {EXPORTED_SQL} SELECT quantile_cont(n, 0.5) AS median FROM (SELECT count(*) AS n FROM eb GROUP BY animal_id, label)",
        "t2_longest_bouts": f"WITH {EXPORTED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY animal_id ORDER BY length DESC NULLS LAST, bout_id) AS place FROM eb) SELECT animal_id, length, bout_id FROM r WHERE place = 1",
        "u1_union_all": f"{_R}, u AS (SELECT 'head' AS sensor, x_head AS x FROM rd UNION ALL SELECT 'ear', x_ear FROM rd) SELECT sensor, count(*) AS n, count(x) AS n_known, round(avg(x), 6) AS x FROM u GROUP BY 1",
        "x1_classified": f"{ls} SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value <= 30 THEN 0 WHEN value <= 125 THEN 1 ELSE 2 END AS cluster FROM ls",
        "x2_online_bouts": f"""WITH {RUNS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY animal_id ORDER BY bout DESC) AS back FROM bouts),
s AS (SELECT animal_id, bout, min(ts) AS start FROM lb GROUP BY 1, 2) SELECT l.animal_id, l.label, epoch_us(start) AS start_us, length AS n FROM l JOIN s USING (animal_id, bout) WHERE back > 1""",
        "x3_hourly_counts": f"{ls} SELECT epoch_us(date_trunc('hour', ts)) AS start_us, epoch_us(date_trunc('hour', ts)) + 3600000000 AS stop_us, label, count(*) AS n FROM ls GROUP BY 1, 2, 3",
        "x4_sessions": f"""{ls}, m AS (SELECT animal_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY animal_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM ls),
s AS (SELECT *, sum(new) OVER (PARTITION BY animal_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT animal_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS stop_us, count(*) AS n FROM s GROUP BY animal_id, session""",
    }


def queries() -> dict[str, Query]:
    return {k: globals()[k] for k in oracle_sql()}

"""Writers of tables, records and headers."""

from __future__ import annotations

import csv
import io
import logging
import re
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import clean
from ..operators.ordered import numbered

TABLES = {
    "deer_info": "deer_id BIGINT, repetition_number STRING, deer_number STRING",
    "accelerometer_data": "data_id BIGINT, deer_id BIGINT, NZ_DateTime TIMESTAMP_NTZ, X_head DOUBLE, Y_head DOUBLE, Z_head DOUBLE, X_ear DOUBLE, Y_ear DOUBLE, Z_ear DOUBLE",
    "trajectory_data": "data_id BIGINT, deer_id BIGINT, pos_WGS84_lat DOUBLE, pos_WGS84_lon DOUBLE, pos_NZMG_x_meter DOUBLE, pos_NZMG_y_meter DOUBLE, pos_x_meter_filt DOUBLE, pos_y_meter_filt DOUBLE, abs_speed_mPs DOUBLE, tortuosity DOUBLE",
    "video_observation_reference": "id BIGINT, original_file_path STRING, repetition INT, deer INT, frame_count BIGINT, start_time TIMESTAMP_NTZ, stop_time TIMESTAMP_NTZ, comment STRING",
    "video_availability": "id BIGINT, accelerometer_data_id BIGINT, video_observation_reference_id BIGINT, frame BIGINT",
    "cluster_labels": "id BIGINT, acc_id BIGINT, label INT",
}


def create_store(spark: SparkSession, folder: str) -> None:
    """Empty parquet tables for those that aren't there yet."""
    for name, schema in TABLES.items():
        if not Path(folder, name).exists():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def append_rows(df: DataFrame, folder: str, name: str) -> None:
    """Appends rows in the table's schema; columns it lacks are NULL, others are left out, NaN becomes NULL."""
    schema = df.sparkSession.createDataFrame([], TABLES[name]).schema
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    rows = df.select(*cols)
    rows.select(*[clean(c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]).write.mode("append").parquet(f"{folder}/{name}")


def append_known(df: DataFrame, known: DataFrame, folder: str, name: str, key: str = "deer_id") -> None:
    """Like append_rows; ValueError if a row's key is not in known."""
    unknown = df.join(known, key, "left_anti").select(key).distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"unknown {key}: {[r[0] for r in unknown]}")
    append_rows(df, folder, name)


def labels_by_position(readings: DataFrame, labels: DataFrame, *, id_col: str, id_width: int = 1 << 20) -> DataFrame:
    """(acc_id, label): the label whose row number is the reading's place in the order of ids; the longer side's rest is dropped with a warning."""
    n_readings, n_labels = readings.count(), labels.count()
    if n_readings != n_labels:
        logging.getLogger(__name__).warning("%d readings and %d labels: the rest of the longer side is left out", n_readings, n_labels)
    placed = numbered(readings.select(F.col(id_col).alias("acc_id"), F.lit(0).alias("all"), F.floor(F.col(id_col) / id_width).alias("chunk")), keys=["all"], order=["acc_id"], name="row")
    return placed.join(labels.select("row", F.col("value").cast("int").alias("label")), "row").select("acc_id", "label")


def relabel(labels: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """labels with the label of newer wherever the keys agree."""
    new = newer.select(*keys, F.col("label").alias("_new"))
    return labels.join(new, keys, "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def archive(df: DataFrame, path: str) -> None:
    """Writes a copy; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> None:
    """Writes old with rows of the same keys replaced by new to another path."""
    old.join(new.select(*keys), keys, "left_anti").unionByName(new).write.mode("overwrite").parquet(path)


def spot_checks(stored: DataFrame, expected: DataFrame, id_col: str, *, n: int = 10) -> DataFrame:
    """The n rows of expected with the smallest hashes of their id, each with its stored label and whether the two agree."""
    pick = expected.orderBy(F.xxhash64(id_col), id_col).limit(n).select(id_col, F.col("label").alias("expected"))
    both = pick.join(stored.select(id_col, F.col("label").alias("stored")), id_col, "left")
    return both.withColumn("agrees", F.col("stored").eqNullSafe(F.col("expected")))


def verify_labels(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows per label before and after and their difference, labels of either side."""
    count = lambda df, n: df.groupBy("label").agg(F.count("*").alias(n))
    both = count(before, "n_before").join(count(after, "n_after"), "label", "full").na.fill(0, ["n_before", "n_after"])
    return both.withColumn("change", F.col("n_after") - F.col("n_before"))


#: Rows of an animal that go into one file; beyond that its rows are spread over several.
ROWS_A_FILE = 1_000_000


def write_by_animal(df: DataFrame, path: str, key: str = "deer_id") -> int:
    """Writes one folder an animal; raises unless as many rows come back as went in.

    An animal has a file for every ROWS_A_FILE of its rows, so many small ones
    make few files.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    # A row for each animal that has more rows than fit into a file.
    large = F.broadcast(sizes.where(F.col("_n") > ROWS_A_FILE).select(F.col(key).alias("_key"), F.ceil(F.col("_n") / ROWS_A_FILE).alias("_files")))
    expected = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64(*df.columns), F.coalesce("_files", F.lit(1)))
    spread = df.join(large, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_part", part).drop("_key", "_files")
    spread.repartition(key, "_part").drop("_part").write.mode("overwrite").partitionBy(key).parquet(path)
    written = df.sparkSession.read.parquet(path).count()
    if written != expected:
        raise RuntimeError(f"{written} rows were written of {expected}")
    return written


def export_animal(df: DataFrame, animal: int, path: str, key: str = "deer_id") -> None:
    """One animal's rows as CSV files with a header."""
    df.where(F.col(key) == animal).write.mode("overwrite").option("header", True).csv(path)


def write_scaled(df: DataFrame, cols: list[str], path: str) -> None:
    """Max-abs scaled columns as parquet under path/data, the divisors as CSV under path/divisors."""
    from ..operators.features import max_abs, scale_max_abs

    scale_max_abs(df, cols).write.mode("overwrite").parquet(f"{path}/data")
    max_abs(df, cols).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/divisors")


def fit_paths(parent: str, tag: str, k: int, size: int, position: int) -> dict[str, str]:
    """Where a fit's centroids, labels and record go: partition folders of the sweep's parameters."""
    base = f"{parent}/tag={tag}/del_size={size}/k={k}/del_pos={position}"
    return {"centroids": f"{base}/centroids", "labels": f"{base}/labels", "meta": f"{base}/{tag}_meta_k{k}"}


def write_fit(meta: DataFrame, centroids: DataFrame, labels: DataFrame, paths: dict[str, str]) -> None:
    """A fit's record (one row, as JSON), centroids and labels (parquet) at the places of fit_paths."""
    centroids.write.mode("overwrite").parquet(paths["centroids"])
    labels.write.mode("overwrite").parquet(paths["labels"])
    meta.coalesce(1).write.mode("overwrite").json(paths["meta"])


def save_table(df: DataFrame, path: str) -> None:
    """A small table of fits as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def results_json(shares: DataFrame, durations: DataFrame, counts: DataFrame) -> DataFrame:
    """One row (json): shares and durations per label and the transition counts, labels from 0."""
    per = shares.join(durations, "label").agg(F.array_sort(F.collect_list(F.struct("label", "percent", "mean_s", "sem_s"))).alias("centroids"))
    cells = counts.agg(F.array_sort(F.collect_list(F.struct("from_state", "to_state", "n"))).alias("transitions"))
    return per.crossJoin(cells).select(F.to_json(F.struct("centroids", "transitions")).alias("json"))


def annotate_json(results: DataFrame, stats: DataFrame) -> DataFrame:
    """results_json with mean_speed and sem_speed of each label from stats."""
    kind = "STRUCT<centroids: ARRAY<STRUCT<label: INT, percent: DOUBLE, mean_s: DOUBLE, sem_s: DOUBLE>>, transitions: ARRAY<STRUCT<from_state: INT, to_state: INT, n: BIGINT>>>"
    parsed = results.select(F.from_json("json", kind).alias("j"))
    rows = parsed.select(F.explode("j.centroids").alias("c")).select("c.*").join(stats.select("label", "mean_speed", "sem_speed"), "label", "left")
    per = rows.agg(F.array_sort(F.collect_list(F.struct("label", "percent", "mean_s", "sem_s", "mean_speed", "sem_speed"))).alias("centroids"))
    return per.crossJoin(parsed.select("j.transitions")).select(F.to_json(F.struct("centroids", "transitions")).alias("json"))


def write_array(df: DataFrame, cols: list[str], order: list[str], path: str) -> int:
    """Numeric columns as .npy files of a folder, in order; rows written.

    The frame is range-partitioned by order, and every task writes its part to
    the folder, which all machines must see; a repeated task overwrites its own
    file.  The npy reader takes the folder as a whole.
    """
    path = re.sub("^file:/+", "/", path)
    Path(path).mkdir(parents=True, exist_ok=True)

    def write(batches):
        part = TaskContext.get().partitionId()
        rows = [np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols]) for b in batches if b.num_rows]
        if rows:
            draft = Path(path, f".{part:06d}-{uuid4().hex}")
            with draft.open("wb") as f:
                np.save(f, np.concatenate(rows))
            draft.rename(Path(path, f"part-{part:06d}.npy"))
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, rows))], pa.int64())], names=["n"])

    return df.select(*cols, *[c for c in order if c not in cols]).orderBy(*order).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def c_header(centroids: list[list[float]], *, name: str = "CENTROIDS", bits: int = 12) -> str:
    """Centroids as C declarations: fixed point with ``bits`` fraction bits, and float."""
    if not centroids or len({len(c) for c in centroids}) != 1:
        raise ValueError("centroids must be rows of one length")
    k, d = len(centroids), len(centroids[0])
    fixed = [[int(max(-32768, min(32767, np.rint(v * (1 << bits))))) for v in c] for c in centroids]
    block = lambda kind, label, rows: [f"static const {kind} {label}[{k}][{d}] = {{", *[f"    {{{', '.join(r)}}}," for r in rows], "};"]
    lines = ["#pragma once", "#include <stdint.h>", f"#define {name}_K {k}", f"#define {name}_D {d}", f"#define {name}_Q {bits}"]
    lines += block("int16_t", f"{name}_Q{bits}", [[str(v) for v in r] for r in fixed])
    lines += block("float", f"{name}_F", [[f"{v:.9g}f" if "." in f"{v:.9g}" or "e" in f"{v:.9g}" else f"{v:.9g}.0f" for v in r] for r in centroids])
    return "\n".join(lines) + "\n"


class CsvFormatter(logging.Formatter):
    """Log records as CSV rows: time, level, logger, message."""

    def format(self, record: logging.LogRecord) -> str:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow([self.formatTime(record), record.levelname, record.name, record.getMessage()])
        return out.getvalue()

"""Readers, writers and streams."""

from __future__ import annotations

import datetime
import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.sources import readers as R
from fieldtrace.sources import sinks as K
from fieldtrace.streaming import online as O


def test_raw_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TagID,Date,Time,X,Y,Z,location-lat,location-lon\nT,21/10/2018,23:00:00.25,1,2,3,-38.1,175.4\nT,bad,12:00:00,1,2,3,,\n")
    got = R.raw_readings(spark, str(tmp_path / "a.csv")).collect()
    assert got[0].ts == datetime.datetime(2018, 10, 22, 12, 0, 0, 250000) and got[1].ts is None
    assert R.raw_readings(spark, str(tmp_path / "none.csv"), ear=True).columns == ["ts", "X", "Y", "Z"]


def test_npy(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(12.0).reshape(6, 2))
    got = R.array_file(spark, str(tmp_path / "x.npy"))
    assert got.columns == ["row", "c0", "c1"] and [tuple(r) for r in got.orderBy("row").collect()][2] == (2, 4.0, 5.0)
    np.save(tmp_path / "l.npy", np.array([3, 1, 2], dtype=np.int8))
    labels = R.array_file(spark, str(tmp_path / "l.npy"))
    readings = spark.createDataFrame([(30,), (10,), (20,), (40,)], "data_id BIGINT")
    got = K.labels_by_position(readings, labels, id_col="data_id")
    assert sorted(tuple(r) for r in got.collect()) == [(10, 3), (20, 1), (30, 2)]


def test_fit_records(spark, tmp_path):
    deep = tmp_path / "k_2" / "x"
    deep.mkdir(parents=True)
    good = {"calinski_harabasz_score": 5.0, "inertia": None, "reduction_percent": 10, "centroids": [[1.0, 2.0], [3.0, 4.0]], "analysis_duration": "0:02:30.5"}
    (deep / "a_meta_k2.json").write_text(json.dumps(good))
    (deep / "b_meta_k2.json").write_text("{broken")
    (deep / "c_meta_k2.json").write_text("{}")
    (deep / "d.json").write_text(json.dumps(good))
    got = R.fit_records(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].k == 2 and "centroids" not in got[0].asDict()
    minutes = R.fit_records(spark, str(tmp_path), keep_centroids=True).select(R.duration_minutes(F.col("analysis_duration"))).first()[0]
    assert minutes == pytest.approx(2 + 30.5 / 60)


def test_codes_and_paths(spark, tmp_path, monkeypatch):
    assert R.generated_codes(spark).count() == 36
    (tmp_path / "c.txt").write_text("R1_D2\n\n R1_D1 \n")
    assert [r.code for r in R.animal_codes(spark, str(tmp_path / "c.txt")).collect()] == ["R1_D1", "R1_D2"]
    (tmp_path / "p.json").write_text('{"a": "<fill in>", "b": "/x"}')
    file = str(tmp_path / "p.json")
    assert R.resolve_path("b", file=file) == "/x" and R.resolve_path("a", file=file, default="/d") == "/d"
    monkeypatch.setenv("PLACE", "/e")
    assert R.resolve_path("b", env="PLACE", file=file) == "/e"
    with pytest.raises(R.PathNotConfigured):
        R.resolve_path("a", file=file)


def test_video_clips(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Filepath,Rep,Deer,Frame_Count,Start_Time,Comments\nx,1,2,45,2018-10-22 06:00:00,\n")
    got = R.video_clips(spark, str(tmp_path / "v.csv")).first()
    assert got.stop_time - got.start_time == datetime.timedelta(seconds=1.5)


def test_store(spark, tmp_path):
    folder = str(tmp_path)
    K.create_store(spark, folder)
    K.create_store(spark, folder)
    known = spark.createDataFrame([(1, "R1", "D1")], K.TABLES["deer_info"])
    K.append_rows(known, folder, "deer_info")
    K.append_known(spark.createDataFrame([(7, 1, 2.0)], "data_id BIGINT, deer_id BIGINT, abs_speed_mPs DOUBLE"), known, folder, "trajectory_data")
    with pytest.raises(ValueError):
        K.append_known(spark.createDataFrame([(7, 9)], "data_id BIGINT, deer_id BIGINT"), known, folder, "trajectory_data")
    back = spark.read.parquet(f"{folder}/trajectory_data").collect()
    assert len(back) == 1 and back[0].abs_speed_mPs == 2.0 and back[0].tortuosity is None
    K.archive(known, f"{folder}/copy")
    with pytest.raises(Exception, match="already exists"):
        K.archive(known, f"{folder}/copy")
    K.upsert(known, spark.createDataFrame([(1, "R2", "D2"), (2, "R1", "D3")], K.TABLES["deer_info"]), ["deer_id"], f"{folder}/new")
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/new").collect()} == {(1, "R2", "D2"), (2, "R1", "D3")}


def test_relabel_and_verify(spark, tmp_path):
    old = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "acc_id BIGINT, label INT")
    new = K.relabel(old, spark.createDataFrame([(2, 5)], "acc_id BIGINT, label INT"), ["acc_id"])
    assert {tuple(r) for r in K.verify_labels(old, new).collect()} == {(0, 2, 1, -1), (1, 1, 1, 0), (5, 0, 1, 1)}
    assert K.write_by_animal(old.withColumnRenamed("label", "deer_id"), str(tmp_path / "w")) == 3
    K.export_animal(old.withColumnRenamed("label", "deer_id"), 0, str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 2


def test_files_by_animal(spark, tmp_path, monkeypatch):
    """Small animals have one file each; a large one, or rows without an animal, have as many as they fill."""
    monkeypatch.setattr(K, "ROWS_A_FILE", 20)
    rows = [(k % 10, k) for k in range(100)] + [(10, k) for k in range(100)] + [(None, k) for k in range(30)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert K.write_by_animal(spark.createDataFrame(rows, "deer_id BIGINT, x BIGINT"), str(tmp_path / "w")) == 230
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "w").iterdir() if d.is_dir()}
    assert len(files) == 12 and all(files[f"deer_id={k}"] == 1 for k in range(10)) and files["deer_id=10"] > 1


def test_json_and_header(spark):
    shares = spark.createDataFrame([(0, 60.0), (1, 40.0)], "label INT, percent DOUBLE")
    times = spark.createDataFrame([(0, 1.0, 0.1), (1, 2.0, 0.2)], "label INT, mean_s DOUBLE, sem_s DOUBLE")
    counts = spark.createDataFrame([(0, 1, 4)], "from_state INT, to_state INT, n BIGINT")
    results = K.results_json(shares, times, counts)
    full = json.loads(K.annotate_json(results, spark.createDataFrame([(1, 3.0, 0.5)], "label INT, mean_speed DOUBLE, sem_speed DOUBLE")).first().json)
    assert full["centroids"][1]["mean_speed"] == 3.0 and full["transitions"] == [{"from_state": 0, "to_state": 1, "n": 4}]
    header = K.c_header([[0.5, -0.25]])
    assert "{2048, -1024}" in header and "0.5f" in header
    with pytest.raises(ValueError):
        K.c_header([[1.0], [1.0, 2.0]])
    record = logging.LogRecord("n", logging.INFO, "", 0, 'a "b"', (), None)
    assert K.CsvFormatter().format(record).endswith('"INFO","n","a ""b"""')


def _stream(spark, path, rows):
    spark.createDataFrame(rows, "animal_id INT, ts TIMESTAMP, label INT, x DOUBLE").coalesce(1).write.parquet(path)
    return spark.readStream.schema("animal_id INT, ts TIMESTAMP, label INT, x DOUBLE").parquet(path)


def _drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    t0 = datetime.datetime(2020, 1, 1)
    at = lambda m: t0 + datetime.timedelta(minutes=m)
    rows = [(1, at(k), l, float(l)) for k, l in enumerate([0, 0, 1, 1, 1, 0])] + [(2, at(3), 4, 0.9)]
    source = _stream(spark, str(tmp_path / "s"), rows)
    got = _drain(O.bouts(source), "bouts")
    assert sorted((r.animal_id, r.label, r.n) for r in got)[:2] == [(1, 0, 2), (1, 1, 3)]
    assert sum(r.n for r in _drain(O.rolling_counts(source, size="2 minutes"), "counts", "complete")) == 7
    assert {r.cluster for r in _drain(O.classify(source, ["x"], [[0.0], [1.0]]), "classes")} == {0, 1}
    assert sum(r.n for r in _drain(O.sessions(source, key="animal_id"), "sessions", "complete")) == 7

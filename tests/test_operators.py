"""Kernels and operators against brute force and known values."""

from __future__ import annotations

import datetime
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import ordered
from fieldtrace.operators import circadian as C
from fieldtrace.operators import cluster as K
from fieldtrace.operators import features as X
from fieldtrace.operators import nulls as N
from fieldtrace.operators import sequence as S
from fieldtrace.operators import track as G
from fieldtrace.operators import validate as V
from fieldtrace.plans import analysis as A


def stream(spark, labels, animals=None):
    animals = animals or [1] * len(labels)
    return spark.createDataFrame([(a, k, l, k // 3) for k, (a, l) in enumerate(zip(animals, labels, strict=True))], "animal_id INT, at INT, label INT, chunk INT")


def test_bouts(spark):
    got = S.bouts(stream(spark, [0, 0, 0, 1, 1, 2, 2, 2, 2, 0, 0]), ["at"]).orderBy("bout").collect()
    assert [(r.label, r.length, r.start_seq) for r in got] == [(0, 3, 0), (1, 2, 3), (2, 4, 5), (0, 2, 9)]
    assert S.bouts(stream(spark, []), ["at"]).count() == 0
    assert S.bouts(stream(spark, [0, 0, 1, 1, 0, 0, 1, 1], [1] * 4 + [2] * 4), ["at"]).groupBy("animal_id").count().collect()[0][1] == 2


def test_transitions(spark):
    got = {(r.from_state, r.to_state): r.n for r in S.transitions(stream(spark, [0, 0, 0, 1, 1, 2, 2, 2, 2, 0, 0]), ["at"], 3).collect()}
    assert got == {(0, 0): 3, (0, 1): 1, (0, 2): 0, (1, 0): 0, (1, 1): 1, (1, 2): 1, (2, 0): 1, (2, 1): 0, (2, 2): 3}


def test_triplets(spark):
    got = {(r.s1, r.s2, r.s3): r.n for r in S.ngrams(stream(spark, [0, 1, 2] * 3), ["at"], 3).collect()}
    assert got == {(0, 1, 2): 3, (1, 2, 0): 2, (2, 0, 1): 2}


@pytest.mark.parametrize(("share", "at", "kept"), [(0.0, 0.0, range(100)), (0.5, 0.0, range(50, 100)), (0.25, 0.9, range(15, 90))])
def test_leave_out(spark, share, at, kept):
    got = S.leave_out(stream(spark, [0] * 100), order=["at"], share=share, at=at)
    assert sorted(r.at for r in got.select("at").collect()) == list(kept)


def test_merge_modes(spark):
    runs = S.bouts(stream(spark, [0] * 5 + [1] + [2] * 3), ["at"])
    label = lambda df: [(r.label, r.length) for r in df.orderBy("bout").collect()]
    assert label(S.merge_short_bouts(runs, 2)) == [(0, 6), (2, 3)]
    assert label(S.merge_short_bouts(runs, 1, mode="next")) == [(0, 5), (2, 4)]
    with pytest.raises(ValueError):
        S.merge_short_bouts(runs, 1, mode="other")


def test_clip(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (8.0,), (-9.0,), (None,), (1.0,)], "x DOUBLE")
    assert [r[0] for r in df.select(X.clip_symmetric("x", 7.99)).collect()] == [0.0, 7.99, 7.99, -7.99, 0.0, 1.0]


def test_mean_divisor(spark):
    assert X.mean_divisor(spark.createDataFrame([(1.0, 1.02)], "a DOUBLE, b DOUBLE"), ["a", "b"]).first()[0] == pytest.approx(1.01)
    with pytest.raises(Exception, match="unlike"):
        X.mean_divisor(spark.createDataFrame([(1.0, 2.0)], "a DOUBLE, b DOUBLE"), ["a", "b"]).collect()


def test_sunrise_and_day(spark):
    day = datetime.datetime(2018, 11, 13)
    sun = C.solar_events(spark.createDataFrame([(day.date(),)], "date DATE")).first()
    assert abs((sun.sunrise - day.replace(hour=5, minute=58, second=31)).total_seconds()) < 60
    times = [(k, day.replace(hour=h, minute=m)) for k, (h, m) in enumerate([(12, 0), (2, 0), (6, 5)])]
    got = C.day_night(spark.createDataFrame(times, "k INT, ts TIMESTAMP_NTZ")).orderBy("k").collect()
    assert [r.daylight for r in got] == [1, 0, -1]


def test_wilcoxon_exact(spark):
    a, b = [1.1, 2.5, 3.0, 4.2, 5.9, 6.1, 7.7], [1.0, 2.0, 3.9, 2.0, 2.2, 2.3, 2.4]
    d = np.array(a) - np.array(b)
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    sums = [sum(r for r, s in zip(range(1, 8), format(k, "07b"), strict=True) if s == "1") for k in range(128)]
    got = C.wilcoxon(spark.createDataFrame(list(zip(a, b, strict=True)), "a DOUBLE, b DOUBLE"), "a", "b").first()
    assert got.W == w and got.p == pytest.approx(2 * sum(s <= w for s in sums) / 128)


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_hungarian(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        match = K.hungarian(cost)
        assert sorted(match) == list(range(n)) and cost[np.arange(n), match].sum() == pytest.approx(best)


def test_instabilities(spark):
    a = [[0.0, 0.0], [1.0, 1.0]]
    fits = spark.createDataFrame([(2, 0, 1.0, a), (2, 1, 3.0, a[::-1]), (2, 2, 2.0, [[0.0, 0.5], [1.0, 1.0]])], "k INT, fit_id INT, ch DOUBLE, centroids ARRAY<ARRAY<DOUBLE>>")
    got = {r.fit_id: (r.drift, r.medoid_sum) for r in K.instabilities(fits).collect()}
    assert got == {0: (0.0, 0.0), 1: (None, 0.0), 2: (0.25, 0.5)}


def test_kneedle(spark):
    curve = [(k, 100 - (k - 2) * 80 / 6 if k <= 8 else 20 - (k - 8) * 2 / 12) for k in range(2, 21)]
    assert abs(K.kneedle(spark.createDataFrame(curve, "k INT, inertia DOUBLE")).first().elbow_k - 8) <= 2


def test_q_format(spark):
    df = spark.createDataFrame([(0.5,), (100.0,), (-100.0,), (0.0,)], "x DOUBLE")
    assert [r[0] for r in df.select(K.encode_q(F.col("x"))).collect()] == [2048, 32767, -32768, 0]


def test_nearest(spark):
    c = [[0.0, 0.0], [0.5, 0.0], [0.0, 0.5], [-0.5, 0.0]]
    df = spark.createDataFrame([(0.0, 0.0), (0.4, 0.0), (0.0, 0.4), (-0.4, 0.0), (0.25, 0.0), (None, 1.0)], "a DOUBLE, b DOUBLE")
    assert [r.cluster for r in K.nearest(df, ["a", "b"], c).collect()] == [0, 1, 2, 3, 0, None]


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("x"))
    assert K.subsample(df, id_col="id", n=30).distinct().count() == 30
    exact = K.inertia(K.nearest(df, ["x"], [[1.0], [5.0]])).first().inertia
    assert K.subsample_inertia(df, ["x"], [[1.0], [5.0]], id_col="id", n=500).first().inertia == pytest.approx(exact, rel=0.15)
    box = K.box_points(df, [[0.0, 1.0], [1.0, 1.0]], id_col="id").agg(F.min("x0"), F.max("x0"), F.min("x1"), F.max("x1")).first()
    assert -0.1 <= box[0] < 0 and 1 < box[1] <= 1.1 and 0.9 <= box[2] and box[3] <= 1.1


def test_silhouettes_of_far_blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(k, k % 4, *map(float, rng.normal([10 * (k % 4 // 2), 10 * (k % 2)], 0.3))) for k in range(200)]
    df = spark.createDataFrame(rows, "id BIGINT, label INT, x DOUBLE, y DOUBLE")
    sample = K.stratified(df, label="label", id_col="id", per_label=20, repeats=2)
    assert sample.count() == 160
    assert K.silhouettes(sample, ["x", "y"], label="label", id_col="id").agg(F.avg("silhouette")).first()[0] > 0.85


def test_first_order_null_keeps_transitions(spark):
    rng = np.random.default_rng(0)
    p = np.array([[0.1, 0.6, 0.3], [0.3, 0.1, 0.6], [0.6, 0.3, 0.1]])
    state, labels = 0, []
    for _ in range(3000):
        labels.append(state)
        state = int(rng.choice(3, p=p[state]))
    null = N.markov_null(stream(spark, labels).withColumn("chunk", F.floor(F.col("at") / 700)), ["at"], 2, 3, replicates=10)
    total = {r.code: r.n for r in null.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    assert sum(total.values()) == 10 * 2999
    for a in range(3):
        row = [total.get(a * 3 + b, 0) for b in range(3)]
        assert np.abs(np.array(row) / sum(row) - p[a]).max() < 0.05


def test_marginal_null_keeps_counts(spark):
    s = stream(spark, [0, 1, 2, 3] * 50)
    null = N.null_distribution(s, ["at"], "at", 1, 4, kind="marginal", replicates=3)
    assert {(r.code, r.n) for r in null.collect()} == {(k, 50) for k in range(4)}
    with pytest.raises(ValueError):
        N.null_distribution(s, ["at"], "at", 1, 4, kind="other", replicates=1)


def test_chains_drawn_together_are_as_those_drawn_one_by_one():
    cdf = np.cumsum([[0.1, 0.6, 0.3], [0.3, 0.1, 0.6], [0.6, 0.3, 0.1]], axis=1)
    cdf[:, -1] = 1
    one, many = np.zeros((400, 27), dtype=np.int64), np.zeros((400, 27), dtype=np.int64)
    for k in range(50):
        N._simulate(cdf, np.full(400, 1), 6, 3, np.random.default_rng(k), one)
    N._simulate_alike(cdf, 1, 6, 3, 50, np.random.default_rng(1), many)
    assert (one.sum(axis=1) == 200).all() and (many.sum(axis=1) == 200).all()
    assert np.abs(one.mean(axis=0) - many.mean(axis=0)).max() < 0.8 and np.abs(one.std(axis=0) - many.std(axis=0)).max() < 0.6


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_marginal_null_counts_whole_permutations(spark, block):
    labels = [0, 1, 2, 3] * 30 + [0] * 40
    null = N.marginal_null(stream(spark, labels), 2, 4, replicates=300, block=block)
    total = {r.code: r.n for r in null.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    assert sum(total.values()) == 300 * 159
    share = np.array([70, 30, 30, 30]) / 160
    for a in range(4):
        for b in range(4):
            assert abs(total[a * 4 + b] / (300 * 159) - share[a] * (share[b] * 160 - (a == b)) / 159) < 0.01


def test_planted_triplet_is_flagged_with_the_registered_parameters(spark, monkeypatch):
    rng = np.random.default_rng(0)
    labels = [0, 1]
    while len(labels) < 4000:
        after = [k for k in range(5) if k != labels[-1]]
        labels.append(2 if labels[-2:] == [0, 1] and rng.random() < 0.8 else int(rng.choice(after)))
    monkeypatch.setattr(A, "_runs", lambda *_: stream(spark, labels).withColumnRenamed("at", "bout"))
    got = {r.code: r for r in A.m10_super_prototypes(spark, "").collect()}
    assert got[0 * 25 + 1 * 5 + 2].super_prototype and got[7].p == 1 / (1 + A.REPLICATES)
    assert not got[3 * 25 + 1 * 5 + 2].super_prototype


def test_significance(spark):
    rng = np.random.default_rng(0)
    observed = spark.createDataFrame([(0, 200), (1, 50), (5, 50)], "code BIGINT, n BIGINT")
    null = spark.createDataFrame([(r, c, int(rng.integers(40, 60))) for r in range(200) for c in (0, 1, 5)], "replicate INT, code BIGINT, n BIGINT")
    got = {r.code: r for r in N.significance(observed, null, 200).collect()}
    assert got[0].super_prototype and got[0].p == pytest.approx(1 / 201) and got[0].q == pytest.approx(3 / 201)
    assert not got[1].super_prototype and not got[5].super_prototype


def test_gaussian_is_the_same_in_any_blocks(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(1, k, float(v), k // 100) for k, v in enumerate(rng.normal(size=700))], "a INT, id BIGINT, v DOUBLE, chunk INT")
    one = {r.id: r.smooth for r in G.gaussian_smooth(df, keys=["a"], order=["id"], id_col="id", col="v", sigma=10).collect()}
    cut = {r.id: r.smooth for r in G.gaussian_smooth(df, keys=["a"], order=["id"], id_col="id", col="v", sigma=10, width=64).collect()}
    assert len(one) == 700 and max(abs(one[k] - cut[k]) for k in one) < 1e-12


def test_drops():
    signal = np.zeros(300)
    signal[[50, 55, 150, 250]] = [10, 8, 9, 3]
    assert G.find_drops(signal, 5.0, 20).tolist() == [50, 150]
    assert G.find_drops(np.zeros(2), 1, 1).size == 0


def test_straight_line_and_grid(spark):
    df = spark.createDataFrame([(1, k, k * 0.001, 0.0, 0) for k in range(5)], "a INT, k INT, lat DOUBLE, lon DOUBLE, chunk INT")
    got = G.straightness_and_speed(df, keys=["a"], order=["k"], a="lat", b="lon", dt_seconds=1.0, distance=G.great_circle_m).collect()
    assert all(abs(r.straightness - 1) < 0.05 for r in got)
    # The grid's origin lies near 41 S 173 E; the old datum is a few hundred metres off.
    origin = G.map_grid(spark.createDataFrame([(-41.0, 173.0), (None, 1.0)], "lat DOUBLE, lon DOUBLE"), lat="lat", lon="lon").collect()
    assert abs(origin[0].x_m - 2510000) < 400 and abs(origin[0].y_m - 6023150) < 400 and origin[1].x_m is None


def test_best_lag(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    df = spark.createDataFrame([(1, k, float(x[k]), float(x[k - 7]), k // 50) for k in range(7, 600)], "a INT, k BIGINT, x DOUBLE, y DOUBLE, chunk INT")
    assert G.best_lag(df, keys=["a"], order=["k"], x="x", y="y", most=20, width=100).first().lag == 7


@pytest.mark.parametrize("width", [64, 1 << 15])
@pytest.mark.parametrize("lag", [170, -230])
def test_best_lag_looks_at_every_lag(spark, lag, width):
    z = np.random.default_rng(1).normal(size=1000)
    x, y = z[300:700], z[300 - lag : 700 - lag]
    df = spark.createDataFrame([(1, k, float(x[k]), float(y[k]), k // 50) for k in range(400)], "a INT, k BIGINT, x DOUBLE, y DOUBLE, chunk INT")
    got = G.best_lag(df, keys=["a"], order=["k"], x="x", y="y", width=width).first()
    full = np.correlate(y - y.mean(), x - x.mean(), mode="full")
    assert got.lag == np.argmax(full) - 399 == lag and got.correlation == pytest.approx(full.max(), abs=1e-5)


def test_tokens_and_attribution(spark):
    texts = ["grazing walk, ear flick", "not in view", None, "drinking", "grazing"]
    df = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(zip(texts, [6, 1, 1, 2, 0], strict=True))], "id INT, t STRING, c INT")
    w = V.register(df, id_col="id", text_col="t", cluster_col="c")
    assert {r.id: set(r.tokens) for r in w.collect()} == {0: {"graze", "walk", "ear_flick"}, 1: {"not_in_view"}, 2: set(), 3: {"drink"}, 4: {"graze"}}
    assert {(r.id, r.video_k): r.weight for r in V.attributions(w).collect()} == {(0, 6): 1.0, (4, 7): 1.0}
    ci = spark.range(1).select(V.wilson(F.lit(10), F.lit(10)).alias("c")).first().c
    assert ci.hi == pytest.approx(1.0) and 0.6 < ci.lo < 0.8


def test_sweep_and_what_is_made_of_it(spark):
    """Fits with and without a share left out; scores, inertia, labels and silhouettes agree with plain numpy."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.3 + c for c in ((0, 0), (10, 0), (0, 10))])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)] + [(999, None, 1.0)], "id BIGINT, x DOUBLE, y DOUBLE").cache()
    fits = K.sweep(df, ["x", "y"], [2, 3], [1, 2], cuts=[(0.0, 0.0), (0.25, 0.5)]).cache()
    rows = fits.collect()
    assert len(rows) == 8 and {(r.k, r.share, r.position) for r in rows} == {(k, *c) for k in (2, 3) for c in ((0.0, 0.0), (0.25, 0.5))}
    assert K.sweep(df, ["x", "y"], [2], [1, 2], cuts=[(0.0, 0.0)], done=fits).count() == 0
    again = {(r.k, r.share, r.fit_id): r.inertia for r in K.inertia_of_fits(df, ["x", "y"], fits).collect()}
    for r in rows:
        d2 = ((x[:, None] - np.array(r.centroids)[None]) ** 2).sum(axis=2).min(axis=1)
        assert abs(again[r.k, r.share, r.fit_id] - d2.sum()) < 1e-6
        if r.share == 0:
            assert abs(r.inertia - d2.sum()) < 1e-6
    best = K.best_of(fits)
    labels = K.assigned(df, ["x", "y"], best.where("k = 3").select("k", "centroids"))
    assert labels.count() == 180 and labels.groupBy("cluster").count().where("count = 60").count() == 3
    shape = {r.k: r.silhouette for r in K.silhouettes_of_fits(df, ["x", "y"], best, repeats=2).where("repeat = 1").collect()}
    assert shape[3] > 0.85 > shape[2]
    moved = K.instabilities(fits).where("k = 3").collect()
    assert sum(r.drift is None for r in moved) == 2 and all(r.medoid_sum < 1.0 for r in moved)


def test_sweep_does_not_depend_on_partitions(spark):
    """Many columns, as wide as the points of the queries; the same fits however the points are spread."""
    x, cols = np.random.default_rng(1).normal(size=(90, 40)), [f"x{j}" for j in range(40)]
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], ", ".join(["id BIGINT", *[f"{c} DOUBLE" for c in cols]]))
    one, other = ({(r.k, r.share): (r.inertia, r.ch) for r in K.sweep(df.repartition(n), cols, [2, 5], [1], cuts=[(0.0, 0.0), (0.25, 0.5)]).collect()} for n in (1, 3))
    assert len(one) == 4 and all(one[f] == pytest.approx(other[f]) for f in one)
    assert K.sweep(df.limit(0), cols, [2], [1]).count() == 0


@pytest.mark.parametrize("size", [1, 3, 100])
def test_ordered_steps_cross_chunks(spark, size):
    labels = [None if i % 5 == 2 else (i * 7) % 4 for i in range(23)]
    rows = [(k, i, i // size, v, "mine") for k, n in ((1, 23), (2, 1)) for i, v in enumerate(labels[:n])]
    df = spark.createDataFrame(rows, "k int, i int, chunk int, v int, _before string")
    by = {"keys": ["k"], "order": ["i"]}
    at = lambda i: labels[i] if 0 <= i < 23 else None
    near = lambda way: next((labels[j] for j in way if labels[j] is not None), None)
    one = {r.i: r for r in ordered.earlier(df, **by, col="v", names=["b1", "b2", "b3"]).where("k = 1").collect()}
    assert [(one[i].b1, one[i].b2, one[i].b3) for i in range(23)] == [(at(i - 1), at(i - 2), at(i - 3)) for i in range(23)]
    two = {r.i: r for r in ordered.beside(df, **by, before={"b": "v"}, after={"a": "v"}).where("k = 1").collect()}
    assert [(two[i].b, two[i].a, two[i]["_before"]) for i in range(23)] == [(at(i - 1), at(i + 1), "mine") for i in range(23)]
    three = {r.i: r for r in ordered.known_around(df, **by, present=df.v.isNotNull(), before={"b": "v"}, after={"a": "v"}).where("k = 1").collect()}
    assert [(three[i].b, three[i].a) for i in range(23)] == [(near(range(i, -1, -1)), near(range(i, 23))) for i in range(23)]
    four = {r.i: r for r in ordered.running_sums(df, **by, values={"seq": F.lit(1), "total": F.col("v")}).where("k = 1").collect()}
    assert [(four[i].seq, four[i].total) for i in range(23)] == [(i + 1, sum(v or 0 for v in labels[: i + 1])) for i in range(23)]
    alone = ordered.earlier(df.where("k = 2"), **by, col="v", names=["b1"]).first()
    assert alone.b1 is None
    assert ordered.earlier(df.where("k = 3"), **by, col="v", names=["b1"]).count() == 0

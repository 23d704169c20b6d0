"""Intervals, grids and control charts on small cases: nulls, ties, copies, empty tables, clashing columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.operators.control import control_chart, flag_implausible
from fieldtrace.operators.grid import _Missing, _nodes, filled_stretches, regular_grid, ssa_fill, ssa_settle
from fieldtrace.operators.intervals import merge_intervals


def rows(df):
    return sorted(tuple(r) for r in df.collect())


INTERVALS = "animal STRING, a BIGINT, b BIGINT, chunk STRING, k0 INT, opens INT"


def intervals(spark, data):
    return spark.createDataFrame([(*d, "x", 1, 2) for d in data], INTERVALS)


def merged(spark, data, **kw):
    return rows(merge_intervals(intervals(spark, data), keys=["animal"], start="a", stop="b", **kw))


def test_periods_overlap_nest_touch_and_leave_gaps(spark):
    data = [("x", 0, 10), ("x", 2, 4), ("x", 10, 12), ("x", 13, 14), ("x", 13, 14), ("y", 5, 5)]
    assert merged(spark, data) == [("gap", "x", 12, 13), ("period", "x", 0, 12), ("period", "x", 13, 14), ("period", "y", 5, 5)]


def test_intervals_without_a_part(spark):
    data = [(None, 0, 1), ("x", None, 1), ("x", 0, None), ("x", 3, 2), ("x", 7, 7)]
    assert merged(spark, data) == [("period", "x", 7, 7)]
    assert merged(spark, []) == []


def test_only_short_gaps(spark):
    assert merged(spark, [("x", 0, 1), ("x", 5, 6), ("x", 10, 11)], gap_below=4) == [("period", "x", 0, 1), ("period", "x", 5, 6), ("period", "x", 10, 11)]


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_chunks_do_not_show(spark, chunk):
    rng = random.Random(chunk)
    data = [(rng.choice("xyz"), s := rng.randrange(300), s + rng.choice([0, 1, 3, 5, 60])) for _ in range(150)]
    expected = []
    for animal in "xyz":
        end = None
        for _, a, b in sorted(d for d in data if d[0] == animal):
            if end is not None and a <= end:
                expected[-1][3] = end = max(end, b)
            else:
                if end is not None:
                    expected.append(["gap", animal, end, a])
                expected.append(["period", animal, a, b])
                end = b
    assert merged(spark, data, chunk=chunk) == sorted(map(tuple, expected))


READINGS = "data_id BIGINT, deer STRING, slot BIGINT, x DOUBLE, y DOUBLE, key INT, id INT, chunk INT"


def grid(spark, data, **kw):
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in data], READINGS)
    return regular_grid(df, id_col="data_id", key_col="deer", slot=F.col("slot"), value_cols={"x": "x", "y": "y"}, **kw)


def test_grid_covers_fills_and_parts(spark):
    data = [(1, "a", 0, 1.0, None), (2, "a", 0, 3.0, None), (2, "a", 0, 3.0, None), (3, "a", 3, 2.0, float("nan")), (4, "a", 50, 5.0, 1.0), (5, None, 1, 9.0, 9.0), (6, "a", None, 9.0, 9.0)]
    got = grid(spark, data, longest=10).orderBy("sensor", "slot").collect()
    assert [(r.sensor, r.slot, r.filled, r.gap_first, r.gap_last) for r in got] == [
        ("x", 0, False, None, None), ("x", 1, True, 1, 2), ("x", 2, True, 1, 2), ("x", 3, False, None, None), ("x", 50, False, None, None), ("y", 50, False, None, None),
    ]
    assert got[0].value == 2.0 and 1.9 <= got[1].value <= 2.1
    assert grid(spark, []).count() == 0


@pytest.mark.parametrize("chunk", [100, 300])
def test_grid_is_the_same_in_any_chunks(spark, chunk):
    rng = random.Random(3)
    slots = sorted(rng.sample(range(900), 500))
    data = [(k, "a", s, float(np.sin(s / 9)), float(s % 7)) for k, s in enumerate(slots)]
    got = grid(spark, data, longest=20, chunk=chunk, block=100, context=16)
    whole = grid(spark, data, longest=20, chunk=100_000, block=100, context=16)
    assert rows(got.select("sensor", "slot", F.round("value", 9), "filled", "gap_first")) == rows(whole.select("sensor", "slot", F.round("value", 9), "filled", "gap_first"))
    gaps = [(a + 1, b - 1) for a, b in zip(slots, slots[1:], strict=False) if 3 <= b - a - 1 <= 20]
    assert [(r.first_slot, r.last_slot) for r in filled_stretches(got, key_col="deer", shortest=3).where("sensor = 'x'").orderBy("first_slot").collect()] == gaps


def test_ssa_restores_a_wave():
    t = np.arange(512)
    wave = np.sin(t / 6.0) + 0.5 * np.sin(t / 2.5)
    known = np.ones(512, dtype=bool)
    known[100:112] = known[300:309] = False
    filled = ssa_fill(np.where(known, wave, 0)[None], known[None], window=40, rank=4, rounds=200, tolerance=1e-6)[0]
    line = np.interp(t, t[known], wave[known])
    assert np.abs(filled - wave)[~known].mean() < 0.35 * np.abs(line - wave)[~known].mean()
    assert (filled[known] == wave[known]).all()


@pytest.mark.parametrize("gap", [20, 50, 200])
def test_ssa_goes_on_through_gaps_longer_than_its_window(gap):
    t = np.arange(1088)
    wave = np.sin(2 * np.pi * t / 40)
    known = np.ones(1088, dtype=bool)
    known[400 : 400 + gap] = False
    noisy = wave + np.random.default_rng(0).normal(0, 0.05, 1088)
    filled, settled = ssa_settle(np.where(known, noisy, 0)[None], known[None])
    assert settled.all() and np.abs(filled[0] - wave)[~known].max() < 0.2
    assert not ssa_settle(np.where(known, noisy, 0)[None], known[None], rounds=1)[1].any()


@pytest.mark.parametrize("gap", [20, 100])
@pytest.mark.parametrize("waves", [(1.0, 0.0), (1.0, 0.6)])
def test_ssa_beats_the_line_by_far(gap, waves):
    t = np.arange(1088)
    wave = waves[0] * np.sin(2 * np.pi * t / 40) + waves[1] * np.sin(2 * np.pi * t / 9)
    known = np.ones(1088, dtype=bool)
    known[500 : 500 + gap] = False
    filled = ssa_fill(np.where(known, wave, 0)[None], known[None], rank=3 if not waves[1] else 5)[0]
    line = np.interp(t, t[known], wave[known])
    assert np.abs(filled - wave)[~known].mean() < 0.2 * np.abs(line - wave)[~known].mean()


def test_stretches_left_out_change_nothing():
    """The solution for the missing entries is that of the whole dense matrix, with long gaps too."""
    rng = np.random.default_rng(0)
    window, sizes = 12, np.array([700, 640, 90])
    x, missing = np.zeros((3, 700)), np.zeros((3, 700), dtype=bool)
    for k, (m, gaps) in enumerate(zip(sizes, [[(3, 4), (40, 45), (60, 60 + 11 * 37 + 5), (690, 698)], [(20, 20 + 11 * 8), (130, 133), (300, 629)], [(30, 35)]], strict=True)):
        x[k, :m] = rng.normal(size=m)
        for a, b in gaps:
            missing[k, a:b] = True
    nodes = [_nodes(missing[k, : sizes[k]], sizes[k], window - 1) for k in range(3)]
    assert max(link.max() for _, link in nodes) >= 5
    order = np.argsort([-len(link) for _, link in nodes], kind="stable")
    vectors = np.linalg.qr(rng.normal(size=(3, window, window)))[0][:, :, 3:]
    trailing = vectors @ vectors.transpose(0, 2, 1)
    got = _Missing([nodes[k] for k in order], sizes[order], window).solve(trailing, x[order], 1e-9)
    for row, k in enumerate(order):
        form = np.zeros((sizes[k], sizes[k]))
        for j in range(sizes[k] - window + 1):
            form[j : j + window, j : j + window] += trailing[row]
        gone, there = np.flatnonzero(missing[k, : sizes[k]]), np.flatnonzero(~missing[k, : sizes[k]])
        want = np.linalg.solve(form[np.ix_(gone, gone)] + 1e-9 * np.eye(len(gone)), -form[np.ix_(gone, there)] @ x[k, there])
        assert np.allclose(got[row, gone], want, atol=1e-7)
        assert (got[row, there] == x[k, there]).all()


def test_a_spike_is_brief(spark):
    """Five far readings in succession are ordinary, three are a spike, and a far one is held against the five."""
    def found(far):
        rows = [(k, "a", k, 1.0 + (k % 5) / 10, None) for k in range(300)]
        for at, v in far.items():
            rows[at] = (at, "a", at, v, None)
        df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], READINGS)
        got = flag_implausible(df, id_col="data_id", key_col="deer", order=F.col("slot"), fields={"x": (-100.0, 100.0)}, chunk=1000)
        assert {r.reason for r in got.collect()} <= {"spike"}
        return {r.id for r in got.collect()}

    five = {k: 5.0 + k / 100 for k in range(100, 105)}
    assert found(five) == set()
    assert found({100: 5.0, 101: 5.1, 102: 5.2}) == {100, 101, 102}
    assert found(five | {200: 9.0}) == set()
    assert found(five | {200: 30.0}) == {200}


def test_grid_fills_a_long_gap_and_says_that_it_settled(spark):
    slots = [s for s in range(900) if not 300 <= s < 350]
    got = grid(spark, [(s, "a", s, float(np.sin(2 * np.pi * s / 40)), None) for s in slots]).where("filled").collect()
    assert len(got) == 50 and all(r.settled for r in got)
    assert max(abs(r.value - np.sin(2 * np.pi * r.slot / 40)) for r in got) < 0.05


SPIKY = "data_id BIGINT, deer STRING, t BIGINT, v DOUBLE, key INT, ord INT, id INT, field INT"


def flagged(spark, data, **kw):
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in data], SPIKY)
    got = flag_implausible(df, id_col="data_id", key_col="deer", order=F.col("t"), fields={"v": (-16.0, 16.0)}, **{"chunk": 50, **kw})
    return {(r["id"], r["reason"]) for r in got.collect()}


def test_faults_are_told_from_ordinary_life(spark):
    rng = np.random.default_rng(1)
    data = [(k, "a", k, float(np.round(rng.normal(0, 0.3), 3)), ) for k in range(400)]
    value = dict((d[0], d[3]) for d in data)
    value |= {20: 90.0, 60: 7.0, 61: -7.5, 300: None, 301: float("nan")}
    value |= {k: 0.25 for k in range(195, 210)}  # stuck over a chunk border
    data = [(k, "a", k, v) for k, v in value.items()] + [(500, None, 9, 99.0), (501, "a", None, 99.0), (502, "a", None, 1.0)]
    data += [data[5]] * 30
    got = flagged(spark, data)
    assert got == {(20, "impossible"), (500, "impossible"), (501, "impossible"), (60, "spike"), (61, "spike")} | {(k, "stuck") for k in range(195, 210)}
    assert flagged(spark, []) == set()


@pytest.mark.parametrize("chunk", [5, 12, 1000])
def test_stuck_runs_over_many_chunks(spark, chunk):
    values = [float(k % 3) for k in range(20)] + [1.5] * 40 + [float(k % 3) for k in range(20)] + [2.5] * 11 + [0.0]
    got = flagged(spark, [(k, "a", k, v) for k, v in enumerate(values)], chunk=chunk)
    assert {i for i, reason in got if reason == "stuck"} == set(range(20, 60))


def test_chart_follows_shifts_and_keeps_spikes_out():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 0.1, 300), rng.normal(1, 0.1, 300)])
    v[450] = 6.0
    marks = control_chart(v, 0.0, 0.1)
    assert marks[450] and marks[550:600].mean() < 0.2 and control_chart(np.zeros(0), 0, 1).size == 0

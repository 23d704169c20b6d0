"""Positions and signals: distances, straightness, speed, filling, projection, smoothing, peaks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import beside, known_around, numbered, previous, running_sum, running_sums

EARTH_RADIUS_M = 6378137.0

# The New Zealand Map Grid (EPSG method 9811) and the shift from NZGD49 to WGS84.
GRID_A, GRID_LAT, GRID_LON, GRID_E, GRID_N = 6378388.0, -41.0, 173.0, 2510000.0, 6023150.0
LATITUDE_SERIES = (0.6399175073, -0.1358797613, 0.063294409, -0.02526853, 0.0117879, -0.0055161, 0.0026906, -0.001333, 0.00067, -0.00034)
GRID_SERIES = ((0.7557853228, 0.0), (0.249204646, 0.003371507), (-0.001541739, 0.041058560), (-0.10162907, 0.01727609), (-0.26623489, -0.36249218), (-0.6870983, -1.1651967))
SHIFT = (59.47, -5.04, 187.44)
TURN = (0.47, -0.1, 1.024)
SCALE_PPM = -4.5993


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two positions on the sphere."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def planar_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def straightness_and_speed(track: DataFrame, *, keys: list[str], order: list[str], a: str, b: str, dt_seconds: float, distance=planar_m) -> DataFrame:
    """Adds straightness (chord to path over three positions, 0 at rest) and speed (metres a second).

    First and last row of a key copy their neighbour's straightness, the first
    its neighbour's speed; keys with fewer than three rows get NULL
    straightness.  Positions must not be NULL.
    """
    df = beside(track, keys=keys, order=order, before={"a0": a, "b0": b}, after={"a2": a, "b2": b})
    here = (F.col(a), F.col(b))
    back, ahead = (F.col("a0"), F.col("b0")), (F.col("a2"), F.col("b2"))
    path = distance(*back, *here) + distance(*here, *ahead)
    own = F.when(path == 0, 0.0).otherwise(distance(*back, *ahead) / path)
    df = df.withColumn("straightness", own).withColumn("speed", distance(*back, *here) / dt_seconds).drop("a0", "b0", "a2", "b2")
    ahead, back = {"next_straight": "straightness", "next_speed": "speed"}, {"last_straight": "straightness", "last_speed": "speed"}
    df = beside(df, keys=keys, order=order, before=back, after=ahead)
    first, last = F.col("last_speed").isNull() & F.col("speed").isNull(), F.col("next_speed").isNull()
    straight = F.when(first, F.col("next_straight")).when(last, F.col("last_straight")).otherwise(F.col("straightness"))
    df = df.withColumn("straightness", straight).withColumn("speed", F.coalesce("speed", "next_speed"))
    return df.drop("next_straight", "next_speed", "last_straight", "last_speed")


def interpolate(df: DataFrame, *, keys: list[str], order: list[str], col: str, forward: bool = True, backward: bool = True) -> DataFrame:
    """NULLs of a column filled linearly by position; behind the last value with it, before the first with it.

    forward and backward switch the two edges.
    """
    seq = numbered(df, keys=keys, order=order, name="_seq")
    there = F.col(col).isNotNull()
    seq = known_around(seq, keys=keys, order=["_seq"], present=there, before={"_s0": "_seq", "_v0": col}, after={"_s1": "_seq", "_v1": col})
    share = (F.col("_seq") - F.col("_s0")) / (F.col("_s1") - F.col("_s0"))
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share
    filled = F.when(there, F.col(col)).when(F.col("_v0").isNotNull() & F.col("_v1").isNotNull(), between)
    filled = filled.when(F.col("_v1").isNull() & F.lit(forward), F.col("_v0")).when(F.col("_v0").isNull() & F.lit(backward), F.col("_v1"))
    return seq.withColumn(col, filled).drop("_seq", "_s0", "_v0", "_s1", "_v1")


def straightness_over_gaps(track: DataFrame, *, keys: list[str], order: list[str], a: str, b: str, dt_seconds: float, distance=planar_m) -> DataFrame:
    """straightness_and_speed over the known positions, and interpolated at those that are missing."""
    known = straightness_and_speed(track.dropna(subset=[a, b]), keys=keys, order=order, a=a, b=b, dt_seconds=dt_seconds, distance=distance)
    back = track.join(known.select(*keys, *order, "straightness", "speed"), [*keys, *order], "left")
    for col in ("straightness", "speed"):
        back = interpolate(back, keys=keys, order=order, col=col)
    return back


def null_runs(df: DataFrame, *, keys: list[str], order: list[str], col: str) -> DataFrame:
    """Runs of NULLs of a column: (*keys, start_seq, stop_seq), stop exclusive; a run at the end counts."""
    seq = previous(df.withColumn("gone", F.col(col).isNull()), keys=keys, order=order, cols={"was_gone": "gone"})
    opens = F.when(F.col("gone") & ~F.coalesce("was_gone", F.lit(False)), 1).otherwise(0)
    seq = running_sums(seq, keys=keys, order=order, values={"seq": F.lit(1), "run": opens})
    return seq.where("gone").groupBy(*keys, "run").agg((F.min("seq") - 1).alias("start_seq"), F.max("seq").alias("stop_seq")).drop("run")


def fill_inclusive(df: DataFrame, *, keys: list[str], order: list[str], col: str) -> DataFrame:
    """NULL runs between two values filled with evenly spaced values whose ends repeat the two (one NULL: the left one)."""
    seq = numbered(df, keys=keys, order=order, name="_seq")
    there = F.col(col).isNotNull()
    seq = known_around(seq, keys=keys, order=["_seq"], present=there, before={"_s0": "_seq", "_v0": col}, after={"_s1": "_seq", "_v1": col})
    size, at = F.col("_s1") - F.col("_s0") - 1, F.col("_seq") - F.col("_s0") - 1
    share = F.when(size > 1, at / (size - 1)).otherwise(0.0)
    return seq.withColumn(col, F.coalesce(col, F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share)).drop("_seq", "_s0", "_v0", "_s1", "_v1")


def map_grid(df: DataFrame, *, lat: str, lon: str, x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Adds map grid metres of WGS84 positions; NULL where a position is missing."""
    # To geocentric, shifted back to the older datum, and to its latitude and longitude.
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    df = df.withColumns({"_x": n * F.cos(phi) * F.cos(lam), "_y": n * F.cos(phi) * F.sin(lam), "_z": n * (1 - e2) * F.sin(phi)})
    rx, ry, rz = (np.deg2rad(t / 3600) for t in TURN)
    k = 1 - SCALE_PPM * 1e-6
    x0, y0, z0 = F.col("_x") - SHIFT[0], F.col("_y") - SHIFT[1], F.col("_z") - SHIFT[2]
    df = df.withColumns({"_u": k * (x0 - rz * y0 + ry * z0), "_v": k * (rz * x0 + y0 - rx * z0), "_w": k * (-ry * x0 + rx * y0 + z0)})
    f = 1 / 297.0
    e2 = f * (2 - f)
    b = GRID_A * (1 - f)
    p = F.hypot("_u", "_v")
    turn = F.atan2(F.col("_w") * GRID_A, p * b)
    old = F.atan2(F.col("_w") + (e2 / (1 - e2)) * b * F.pow(F.sin(turn), F.lit(3)), p - e2 * GRID_A * F.pow(F.cos(turn), F.lit(3)))
    df = df.withColumns({"_phi": F.degrees(old), "_lam": F.degrees(F.atan2("_v", "_u"))})
    step = (F.col("_phi") - GRID_LAT) * 3600 * 1e-5
    psi = F.lit(0.0)
    for c in reversed(LATITUDE_SERIES):
        psi = (psi + c) * step
    df = df.withColumns({"_re": psi, "_im": F.radians(F.col("_lam") - GRID_LON)})
    re, im = F.lit(0.0), F.lit(0.0)
    for k, (c_re, c_im) in enumerate(reversed(GRID_SERIES)):
        s_re, s_im = re + c_re, im + c_im
        df = df.withColumns({f"_r{k}": s_re * F.col("_re") - s_im * F.col("_im"), f"_i{k}": s_re * F.col("_im") + s_im * F.col("_re")})
        re, im = F.col(f"_r{k}"), F.col(f"_i{k}")
    df = df.withColumns({x: GRID_E + im * GRID_A, y: GRID_N + re * GRID_A})
    return df.drop("_x", "_y", "_z", "_u", "_v", "_w", "_phi", "_lam", "_re", "_im", *[f"_{p}{k}" for p in "ri" for k in range(len(GRID_SERIES))])


def with_halo(df: DataFrame, *, keys: list[str], position: str, width: int, halo: int) -> DataFrame:
    """Rows spread to the blocks (column block) that need them: their own and those within halo of it."""
    at = F.col(position)
    blocks = F.array_distinct(F.array(F.floor(at / width), F.floor((at - halo) / width), F.floor((at + halo) / width)))
    return df.withColumn("block", F.explode(blocks))


def gaussian_smooth(df: DataFrame, *, keys: list[str], order: list[str], id_col: str, col: str, sigma: float = 75.0, width: int = 1 << 15) -> DataFrame:
    """Rows (id_col, smooth): a Gaussian of four sigmas' radius over each key's rows, mirrored at its ends.

    A group is one block of positions with the radius around it; NULL values
    must be filled before.
    """
    radius = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight /= weight.sum()
    seq = numbered(df, keys=keys, order=order, name="pos")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("size"))
    rows = seq.join(sizes, keys).select(*keys, F.col(id_col).alias("id"), "pos", "size", F.col(col).cast("double").alias("v"))
    rows = with_halo(rows, keys=keys, position="pos", width=width, halo=radius)

    def smooth(key: tuple, group: pa.Table) -> pa.Table:
        pos = group.column("pos").to_numpy()
        order_ = np.argsort(pos)
        pos, v = pos[order_], group.column("v").to_numpy(zero_copy_only=False)[order_]
        size, low = group.column("size")[0].as_py(), key[-1].as_py() * width
        own = (pos >= low) & (pos < low + width)
        if not own.any():
            return pa.table([group.column("id").slice(0, 0), pa.array([], pa.float64())], names=[id_col, "smooth"])
        want = np.arange(max(low, 0) - radius, min(low + width, size) + radius)
        folded = np.mod(want, 2 * size)
        folded = np.where(folded >= size, 2 * size - 1 - folded, folded)
        padded = v[np.clip(folded - pos[0], 0, len(v) - 1)]
        out = np.convolve(padded, weight, mode="valid")
        return pa.table([group.column("id").take(pa.array(order_[own])), pa.array(out)], names=[id_col, "smooth"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.groupBy(*keys, "block").applyInArrow(smooth, f"{id_col} {kind}, smooth double")


def find_drops(signal: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Indices of local maxima at least distance apart (higher ones first) and of the given prominence."""
    n = len(signal)
    if n < 3:
        return np.zeros(0, dtype=np.int64)
    edges = np.flatnonzero(np.diff(signal) != 0) + 1
    starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
    level = signal[starts]
    top = np.zeros(len(level), dtype=bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    peaks = ((starts + stops - 1) // 2)[top]
    keep = np.ones(len(peaks), dtype=bool)
    for k in np.argsort(signal[peaks], kind="stable")[::-1]:
        if keep[k]:
            near = np.searchsorted(peaks, [peaks[k] - distance + 1, peaks[k] + distance])
            keep[near[0] : near[1]] = False
            keep[k] = True
    peaks = peaks[keep]
    base = np.maximum(_lowest_before(signal), _lowest_before(signal[::-1])[::-1])
    return peaks[signal[peaks] - base[peaks] >= prominence].astype(np.int64)


def _lowest_before(signal: np.ndarray) -> np.ndarray:
    """For each value the lowest one between the last higher value (or the start) and it, in one pass over a falling stack."""
    out = np.empty(len(signal))
    stack: list[tuple[float, float]] = []
    for k, v in enumerate(signal.tolist()):
        least = v
        while stack and stack[-1][0] <= v:
            least = min(least, stack.pop()[1])
        # What is left on the stack is higher; from it on the value sees.
        out[k] = least
        stack.append((v, least))
    return out


def recordings(df: DataFrame, *, keys: list[str], order: list[str], time_us: str, gap_us: int) -> DataFrame:
    """Adds recording: a number that grows with every pause longer than gap_us."""
    df = previous(df, keys=keys, order=order, cols={"_before": time_us})
    opens = F.when(F.col(time_us) - F.col("_before") <= gap_us, 0).otherwise(1)
    return running_sum(df, keys=keys, order=order, value=opens, name="recording").drop("_before")


def drops(df: DataFrame, *, keys: list[str], order: list[str], id_col: str, signals: dict[str, str], prominence: float, distance: int) -> DataFrame:
    """Rows (*keys, sensor, at, id): the peaks of each signal within a key, at counted from 0 in order.

    A key should be one recording, whose length the logger bounds; NULLs are passed over.
    """
    fields = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def find(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in order])
        rows: dict[str, list] = {"sensor": [], "at": [], "id": []}
        for name, col in signals.items():
            v = group.column(col).to_numpy(zero_copy_only=False).astype(float)
            good = np.flatnonzero(~np.isnan(v))
            at = good[find_drops(v[good], prominence, distance)]
            rows["sensor"] += [name] * len(at)
            rows["at"] += at.tolist()
            rows["id"] += group.column(id_col).take(pa.array(at)).to_pylist()
        n = len(rows["at"])
        return pa.table([*[pa.array([k.as_py()] * n, type=group.schema.field(c).type) for c, k in zip(keys, key, strict=True)], pa.array(rows["sensor"], pa.string()), pa.array(rows["at"], pa.int64()), pa.array(rows["id"], pa.int64())], names=[*keys, "sensor", "at", "id"])

    return df.select(*{*keys, *order, id_col, *signals.values()}).groupBy(*keys).applyInArrow(find, ", ".join([*fields, "sensor string", "at bigint", "id bigint"]))


def first_drops(found: DataFrame, *, keys: list[str], n: int = 3) -> DataFrame:
    """Per key the first n drops of each sensor; only keys where every sensor has n."""
    best = found.groupBy(*keys, "sensor").agg(F.slice(F.array_sort(F.collect_set("at")), 1, n).alias("ats"))
    full = best.where(F.size("ats") == n)
    both = full.groupBy(*keys).agg(F.count("*").alias("sensors"), F.collect_list(F.struct("sensor", "ats")).alias("s")).where("sensors = 2")
    pick = lambda name: F.filter("s", lambda x: x["sensor"] == name)[0]["ats"]
    return both.select(*keys, pick("head").alias("head"), pick("ear").alias("ear"))


def best_lag(df: DataFrame, *, keys: list[str], order: list[str], x: str, y: str, most: int | None = None, width: int = 1 << 15) -> DataFrame:
    """Per key the lag of y behind x with the largest cross-correlation (smallest lag on a tie): any lag, or those within +-most.

    Every block of x meets every block of y that is in reach; each pair brings
    its partial sum for every lag it covers, by FFT, and the sums are added up
    per lag.  A key, such as one recording, of up to width rows is one pair.
    Values are centred on their key's mean.
    """
    whole = df.dropna(subset=[x, y])
    seq = numbered(whole, keys=keys, order=order, name="pos")
    means = whole.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.floor((F.count("*") - 1) / width).alias("last"))
    rows = seq.join(means, keys).select(*keys, "pos", "last", (F.col(x) - F.col("mx")).alias("x"), (F.col(y) - F.col("my")).alias("y"))
    rows = rows.withColumn("home", F.floor(F.col("pos") / width))
    apart = F.col("last") if most is None else F.least("last", F.lit(-(-most // width)))
    others = F.sequence(F.greatest(F.lit(0), F.col("home") - apart), F.least("last", F.col("home") + apart))
    side = lambda i, v, a, b: rows.withColumn("other", F.explode(others)).select(*keys, F.col(a).alias("block_x"), F.col(b).alias("block_y"), F.lit(i).alias("side"), "pos", F.col(v).alias("v"))
    rows = side(0, "x", "home", "other").unionByName(side(1, "y", "other", "home"))
    fields = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def partial(key: tuple, group: pa.Table) -> pa.Table:
        sides, pos, v = group.column("side").to_numpy(), group.column("pos").to_numpy(), group.column("v").to_numpy()
        parts = []
        for i in (0, 1):
            mine = np.flatnonzero(sides == i)
            mine = mine[np.argsort(pos[mine])]
            parts.append((pos[mine], v[mine]))
        (p, a), (q, b) = parts
        size = 1 << (len(a) + len(b) - 1).bit_length()
        got = np.fft.irfft(np.fft.rfft(b, size) * np.conj(np.fft.rfft(a, size)), size)
        shift = np.arange(-(len(a) - 1), len(b))
        lags, sums = shift + int(q[0] - p[0]), got[shift]
        if most is not None:
            sums, lags = sums[np.abs(lags) <= most], lags[np.abs(lags) <= most]
        n = len(lags)
        return pa.table([*[pa.array([v.as_py()] * n, type=group.schema.field(c).type) for c, v in zip(keys, key, strict=False)], pa.array(lags), pa.array(sums)], names=[*keys, "lag", "s"])

    sums = rows.groupBy(*keys, "block_x", "block_y").applyInArrow(partial, ", ".join([*fields, "lag bigint", "s double"]))
    total = sums.groupBy(*keys, "lag").agg(F.round(F.sum("s"), 6).alias("s"))
    return total.groupBy(*keys).agg(F.max(F.struct(F.col("s"), (-F.col("lag")).alias("neg"))).alias("best")).select(*keys, (-F.col("best.neg")).alias("lag"), F.col("best.s").alias("correlation"))

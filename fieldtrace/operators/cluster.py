"""Clustering: assignment, fits, and the measures that choose the number of clusters.

Points are a frame with feature columns.  Centroids are few (k by d numbers) and
travel as literals.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType

from .ordered import numbered

Q_BITS = 12


def squared_distance(cols: list[str], centre: list[float]) -> Column:
    return reduce(add, [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, centre, strict=True)])


def nearest(df: DataFrame, cols: list[str], centroids: list[list[float]]) -> DataFrame:
    """Adds cluster (nearest centroid, the smaller number on a tie) and d2 (squared distance); NULL if a feature is."""
    best = F.array_min(F.array(*[F.struct(squared_distance(cols, c).alias("d2"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    best = F.when(whole, best)
    return df.withColumn("best", best).withColumn("cluster", F.col("best.cluster")).withColumn("d2", F.col("best.d2")).drop("best")


def encode_q(c: Column, bits: int = Q_BITS) -> Column:
    """Fixed point with ``bits`` fraction bits in 16: half to even, clipped."""
    return F.greatest(F.least(F.rint(c * (1 << bits)), F.lit(32767.0)), F.lit(-32768.0)).cast("int")


def decode_q(c: Column, bits: int = Q_BITS) -> Column:
    return c / float(1 << bits)


def nearest_q(df: DataFrame, cols: list[str], centroids: list[list[float]], bits: int = Q_BITS) -> DataFrame:
    """Adds cluster_q by integer arithmetic on fixed-point features and centroids."""
    fixed = [[int(max(-32768, min(32767, np.rint(v * (1 << bits))))) for v in c] for c in centroids]
    def dist(c: list[int]) -> Column:
        return reduce(add, [(encode_q(F.col(x), bits).cast("long") - v) * (encode_q(F.col(x), bits).cast("long") - v) for x, v in zip(cols, c, strict=True)])
    best = F.array_min(F.array(*[F.struct(dist(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(fixed)]))
    return df.withColumn("cluster_q", best.getField("k"))


def round_trip(df: DataFrame, cols: list[str], centroids: list[list[float]], bits: int = Q_BITS) -> DataFrame:
    """Share of points whose fixed-point cluster differs from the exact one, and the largest error of a centroid."""
    both = nearest_q(nearest(df, cols, centroids), cols, centroids, bits)
    error = max(abs(v - round(v * (1 << bits)) / (1 << bits)) for c in centroids for v in c)
    return both.agg(F.avg((F.col("cluster") != F.col("cluster_q")).cast("double")).alias("mismatch"), F.lit(error).alias("largest_error"), F.count("*").alias("n"))


def inertia(df: DataFrame, d2: str = "d2") -> DataFrame:
    return df.agg(F.sum(d2).alias("inertia"), F.count(d2).alias("n"))


def calinski_harabasz(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Between to within dispersion in one pass of per-cluster sums; NULL for one cluster. One row."""
    per = df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.var_pop(c).alias(f"v_{c}") for c in cols])
    within = reduce(add, [F.col("n") * F.col(f"v_{c}") for c in cols])
    total = per.agg(
        F.count("*").alias("k"), F.sum("n").alias("n_all"), F.sum(within).alias("w"),
        *[F.sum(F.col("n") * F.col(f"m_{c}")).alias(f"s_{c}") for c in cols],
        F.sum(reduce(add, [F.col("n") * F.col(f"m_{c}") * F.col(f"m_{c}") for c in cols])).alias("ss"),
    )
    between = F.col("ss") - reduce(add, [F.col(f"s_{c}") * F.col(f"s_{c}") / F.col("n_all") for c in cols])
    return total.select("k", F.col("n_all").alias("n"), F.when(F.col("k") > 1, (between / (F.col("k") - 1)) / (F.col("w") / (F.col("n_all") - F.col("k")))).alias("ch"))


def stratified(df: DataFrame, *, label: str, id_col: str, per_label: int, repeats: int, seed: int = 0) -> DataFrame:
    """Per repeat up to per_label rows of every label without replacement (column repeat).

    Rows are drawn by the rank of a hash of id and repeat.  A first cut by
    ``per_label`` smallest hashes in each of many groups keeps the rank window
    to per_label rows a group, however many rows a label has.
    """
    spread = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("draw", F.xxhash64(id_col, "repeat", F.lit(seed)))
    spread = spread.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed + 1), id_col), F.lit(64)))
    first = Window.partitionBy("repeat", label, "grp").orderBy("draw", id_col)
    second = Window.partitionBy("repeat", label).orderBy("draw", id_col)
    cut = spread.withColumn("at", F.row_number().over(first)).where(F.col("at") <= per_label)
    return cut.withColumn("at", F.row_number().over(second)).where(F.col("at") <= per_label).drop("at", "grp", "draw")


def subsample(df: DataFrame, *, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: those of the smallest hashes of id and seed."""
    return df.withColumn("_draw", F.xxhash64(id_col, F.lit(seed))).orderBy("_draw", id_col).limit(n).drop("_draw")


def subsample_inertia(df: DataFrame, cols: list[str], centroids: list[list[float]], *, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Inertia of n sampled rows scaled up to all of them. One row."""
    whole = df.dropna(subset=cols)
    part = nearest(subsample(whole, id_col=id_col, n=n, seed=seed), cols, centroids).agg(F.sum("d2").alias("s"), F.count("*").alias("n"))
    return part.crossJoin(whole.agg(F.count("*").alias("n_all"))).select((F.col("s") * F.col("n_all") / F.col("n")).alias("inertia"))


def box_points(df: DataFrame, centroids: list[list[float]], *, id_col: str, margin: float = 0.1, seed: int = 0) -> DataFrame:
    """A point for each row of df, uniform in the box of the centroids widened by margin: id_col, x0, x1, ..."""
    unit = lambda j: F.pmod(F.xxhash64(id_col, F.lit(seed), F.lit(j)), F.lit(1 << 30)) / float(1 << 30)
    low, high = [min(v) - margin for v in zip(*centroids, strict=True)], [max(v) + margin for v in zip(*centroids, strict=True)]
    return df.select(id_col, *[(F.lit(a) + unit(j) * (b - a)).alias(f"x{j}") for j, (a, b) in enumerate(zip(low, high, strict=True))])


def silhouettes(sample: DataFrame, cols: list[str], *, label: str, id_col: str, blocks: int = 16) -> DataFrame:
    """Exact Euclidean silhouette of every row of a bounded sample within its repeat; a lone member of a cluster gets 0.

    The sample (its size is a parameter of stratified) meets itself block by
    block: each group holds the sample of one repeat against one block of it.
    """
    rows = sample.select("repeat", F.col(id_col).alias("id"), F.col(label).alias("label"), *cols)
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        x = np.column_stack([group.column(c).to_numpy(zero_copy_only=False) for c in cols]).astype(float)
        ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
        order = np.argsort(ids)
        x, ids, labels = x[order], ids[order], labels[order]
        names, code = np.unique(labels, return_inverse=True)
        size = np.bincount(code)
        own = np.arange(len(ids)) % blocks == key[1].as_py()
        out = np.zeros(int(own.sum()))
        member = np.eye(len(names))[code]
        for k, i in enumerate(np.flatnonzero(own)):
            far = np.sqrt(((x - x[i]) ** 2).sum(axis=1)) @ member
            c = code[i]
            if size[c] < 2 or len(names) < 2:
                continue
            a = far[c] / (size[c] - 1)
            other = np.where(np.arange(len(names)) == c, np.inf, far / size)
            b = other.min()
            out[k] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
        n = len(out)
        return pa.table([pa.array([key[0].as_py()] * n, pa.int32()), pa.array(ids[own], pa.int64()), pa.array(labels[own], pa.int32()), pa.array(out)], names=["repeat", "id", "label", "silhouette"])

    return spread.withColumn("label", F.col("label").cast("int")).groupBy("repeat", "block").applyInArrow(run, "repeat int, id bigint, label int, silhouette double")


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column matched to each row of a square cost matrix at the least total cost."""
    n = len(cost)
    row_price, col_price = np.zeros(n), np.zeros(n)
    match = np.full(n, -1)
    for row in range(n):
        slack = cost[row] - row_price[row] - col_price
        parent = np.full(n, row)
        from_col = np.full(n, -1)
        done = np.zeros(n, dtype=bool)
        reach = 0.0
        while True:
            open_cost = np.where(done, np.inf, slack)
            j = int(np.argmin(open_cost))
            reach = open_cost[j]
            done[j] = True
            if match[j] < 0:
                break
            nxt = match[j]
            through = reach + cost[nxt] - row_price[nxt] - col_price - (cost[nxt, j] - row_price[nxt] - col_price[j])
            better = ~done & (through < slack)
            slack = np.where(better, through, slack)
            parent[better], from_col[better] = nxt, j
        settled = done & (slack <= reach)
        for c in np.flatnonzero(settled):
            if match[c] >= 0:
                row_price[match[c]] += reach - slack[c]
            col_price[c] -= reach - slack[c]
        row_price[row] += reach
        while j >= 0:
            match[j], j_next = parent[j], from_col[j]
            j = j_next
    out = np.empty(n, dtype=int)
    out[match] = np.arange(n)
    return out


def _matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    cost = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return cost[np.arange(len(cost)), hungarian(cost)]


#: What names a fit: number of clusters, share left out, where, and number.
FIT = ["k", "share", "position", "fit_id"]


def instabilities(fits: DataFrame, *, unscale: list[float] | None = None) -> DataFrame:
    """Per fit (FIT, ch): drift (mean matched distance to the fit of best ch, NULL for that one) and medoid_sum.

    medoid_sum is the sum of matched distances to the fit whose total over all
    others is least.  Fits of one k and one share left out, wherever, are held
    against each other; they are as many as were asked for.  fits is a result of
    sweep; share and position may be missing, which is nothing left out.
    """
    for name in ("share", "position"):
        if name not in fits.columns:
            fits = fits.withColumn(name, F.lit(0.0))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["position", "fit_id"]).reset_index(drop=True)
        sets = [np.stack([np.asarray(r, dtype=float) for r in c]) * (np.asarray(unscale) if unscale else 1.0) for c in group["centroids"]]
        n = len(sets)
        total = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                total[i, j] = total[j, i] = _matched(sets[i], sets[j]).sum()
        best = int(group["ch"].fillna(-np.inf).to_numpy().argmax())
        medoid = int(total.sum(axis=1).argmin()) if n else 0
        drift = total[best] / len(sets[best])
        drift[best] = np.nan
        return group[[*FIT, "ch"]].assign(drift=[None if np.isnan(v) else float(v) for v in drift], medoid_sum=total[medoid])

    got = fits.groupBy("k", "share").applyInPandas(run, "k int, share double, position double, fit_id int, ch double, drift double, medoid_sum double")
    return got.withColumn("drift", F.when(~F.isnan("drift"), F.col("drift")))


def _draws(ids: np.ndarray, salt: str) -> np.ndarray:
    """A number in [0, 1) for each id, the same wherever the id lies."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(salt.encode()) << 16)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _labels(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point, and the squared distance."""
    mid = centres.mean(axis=0)
    away = centres - mid
    label = ((away * away).sum(axis=1) - 2 * (x - mid) @ away.T).argmin(axis=1)
    gap = x - centres[label]
    return label, np.einsum("ij,ij->i", gap, gap)


def _chosen(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """k centres of few weighted points: k-means++, then Lloyd's rounds; all of the distinct points if they are at most k."""
    points, where = np.unique(points, axis=0, return_inverse=True)
    weight = np.bincount(where.ravel(), weight)
    if len(points) <= k:
        return points
    picked = [int(rng.choice(len(points), p=weight / weight.sum()))]
    d2 = np.full(len(points), np.inf)
    while len(picked) < k:
        gap = points - points[picked[-1]]
        d2 = np.minimum(d2, (gap * gap).sum(axis=1))
        mass = weight * d2
        # Points without weight are taken once no other is left.
        mass = mass if mass.sum() > 0 else d2
        picked.append(int(rng.choice(len(points), p=mass / mass.sum())))
    centres, last = points[picked].copy(), None
    for _ in range(rounds):
        label, _ = _labels(points, centres)
        if last is not None and (label == last).all():
            break
        last, total = label, np.bincount(label, weight, minlength=k)
        moved = np.eye(k)[label].T @ (points * weight[:, None])
        centres[total > 0] = moved[total > 0] / total[total > 0, None]
    return centres


def _together(a: dict, b: dict) -> dict:
    """Sums of tuples by key; lists are joined."""
    out = dict(a)
    for key, value in b.items():
        out[key] = tuple(x + y for x, y in zip(out[key], value, strict=True)) if key in out else value
    return out


def _pass(blocks: DataFrame, sent: object, measure) -> dict:
    """What measure(ids, points, what is sent for a fit) gives for the points of each fit's cut, summed over all points.

    sent has (cut, ...) by fit.  Sums are formed in the tasks and then in a
    tree, so the driver gets a few, whatever the number of tasks.
    """
    context = blocks.sparkSession.sparkContext
    shared = context.broadcast(sent)

    def run(rows):
        total: dict = {}
        for row in rows:
            ids = np.frombuffer(row.ids, dtype=np.int64)
            x, inside = np.frombuffer(row.x).reshape(len(ids), -1), np.frombuffer(row.inside, dtype=bool).reshape(len(ids), -1)
            mine = {cut: (ids[inside[:, cut]], x[inside[:, cut]]) for cut in {s[0] for s in shared.value.values()}}
            total = _together(total, {fit: measure(*mine[cut], *more) for fit, (cut, *more) in shared.value.items() if len(mine[cut][0])})
        yield total

    try:
        return blocks.rdd.mapPartitions(run).treeAggregate({}, _together, _together)
    finally:
        shared.unpersist()


def _first(ids: np.ndarray, x: np.ndarray, salt: str) -> tuple:
    draws = _draws(ids, salt)
    k = int(draws.argmin())
    return ([(draws[k], x[k])],)


def _cost(ids: np.ndarray, x: np.ndarray, centres: np.ndarray) -> tuple:
    return (float(_labels(x, centres)[1].sum()),)


def _sampled(ids: np.ndarray, x: np.ndarray, centres: np.ndarray, rate: float, salt: str) -> tuple:
    return (list(x[_draws(ids, salt) < rate * _labels(x, centres)[1]]),)


def _sums(ids: np.ndarray, x: np.ndarray, centres: np.ndarray) -> tuple:
    label, d2 = _labels(x, centres)
    return np.bincount(label, minlength=len(centres)).astype(float), np.eye(len(centres))[label].T @ x, float(d2.sum())


def _fit_together(blocks: DataFrame, fits: dict[tuple, int], *, steps: int = 2, rounds: int = 20, tolerance: float = 1e-4) -> dict[tuple, tuple]:
    """Centroids, inertia and Calinski-Harabasz score of k-means|| fits, all of them in each pass over the points.

    fits has the cut by (k, seed, share, position).  A fit begins with ``steps`` rounds of sampling, about 2 k points each, and ends after
    ``rounds`` of Lloyd's, or when no centroid moves by more than tolerance.  A
    fit without points is left out.
    """
    salt = lambda fit, step: f"{fit} {step}"
    drawn = _pass(blocks, {fit: (cut, salt(fit, 0)) for fit, cut in fits.items()}, _first)
    fits = {fit: cut for fit, cut in fits.items() if fit in drawn}
    centres = {fit: min(drawn[fit][0], key=lambda p: (p[0], *p[1]))[1][None] for fit in fits}
    for step in range(steps):
        cost = _pass(blocks, {fit: (cut, centres[fit]) for fit, cut in fits.items()}, _cost)
        more = _pass(blocks, {fit: (cut, centres[fit], 2 * fit[0] / cost[fit][0], salt(fit, step + 1)) for fit, cut in fits.items() if cost[fit][0] > 0}, _sampled)
        centres = {fit: np.array([*centres[fit], *(more[fit][0] if fit in more else [])]) for fit in fits}
    got = _pass(blocks, {fit: (cut, centres[fit]) for fit, cut in fits.items()}, _sums)
    centres = {fit: _chosen(centres[fit], got[fit][0], fit[0], np.random.default_rng(zlib.crc32(salt(fit, "++").encode()))) for fit in fits}
    moving = dict(fits)
    for _ in range(rounds):
        if not moving:
            break
        got = _pass(blocks, {fit: (cut, centres[fit]) for fit, cut in moving.items()}, _sums)
        for fit, (n, sums, _) in got.items():
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[fit])
            if ((new - centres[fit]) ** 2).sum(axis=1).max() <= tolerance**2:
                del moving[fit]
            centres[fit] = new
    out = {}
    for fit, (n, sums, cost) in _pass(blocks, {fit: (cut, centres[fit]) for fit, cut in fits.items()}, _sums).items():
        there = n > 0
        size, mean = n[there], sums[there] / n[there, None]
        within = cost - (size[:, None] * (mean - centres[fit][there]) ** 2).sum()
        between = (size[:, None] * (mean - sums.sum(axis=0) / n.sum()) ** 2).sum()
        ch = (between / (len(size) - 1)) / (within / (n.sum() - len(size))) if len(size) > 1 and within > 0 else None
        out[fit] = ([c.tolist() for c in centres[fit]], cost, None if ch is None else float(ch))
    return out


def sweep(
    df: DataFrame, cols: list[str], ks: list[int], seeds: list[int], *, id_col: str = "id", cuts: Sequence[tuple[float, float]] = ((0.0, 0.0),),
    done: DataFrame | None = None, at_once: int = 100,
) -> DataFrame:
    """Fits of every (k, seed, cut) not in done: FIT, seed, inertia, ch, centroids. One row a fit.

    A cut (share, position) leaves out that share of the points, in the order of
    id_col, from that position on and around the end.  The points are read once
    and kept (in memory, or on disk where they don't fit); ``at_once`` fits run side by side, in the same passes over the points.
    Rows with a NULL feature take no part; without points there are no fits.
    """
    spark = df.sparkSession
    finished = {tuple(r) for r in done.select("k", "seed", "share", "position").collect()} if done is not None else set()
    todo = [(k, number, seed, *cut) for cut in cuts for k in ks for number, seed in enumerate(seeds) if (k, seed, *cut) not in finished]
    # One array, because plans over many single columns take minutes to optimise.
    whole = df.select(F.col(id_col).cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    whole = whole.where(F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    used = list(dict.fromkeys(t[3:] for t in todo))
    if any(share for share, _ in used):
        whole = numbered(whole.withColumns({"all": F.lit(0), "chunk": F.floor(F.col("id") / (1 << 16))}), keys=["all"], order=["id"])
        total = whole.count()
        inside = [F.pmod(F.col("seq") - int(total * position), F.lit(max(total, 1))) >= int(total * share) if share else F.lit(True) for share, position in used]
    else:
        inside = [F.lit(True) for _ in used]

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                flat = {"ids": batch.column("id"), "x": batch.column("x").flatten(), "inside": batch.column("inside").flatten()}
                yield pa.RecordBatch.from_pydict({c: [v.to_numpy(zero_copy_only=False).tobytes()] for c, v in flat.items()}, schema=made)

    made = pa.schema([("ids", pa.binary()), ("x", pa.binary()), ("inside", pa.binary())])
    fits: dict[tuple, tuple] = {}
    if todo:
        blocks = whole.select("id", "x", F.array(*inside).alias("inside")).mapInArrow(pack, "ids binary, x binary, inside binary").persist()
        try:
            for begin in range(0, len(todo), at_once):
                fits |= _fit_together(blocks, {(k, seed, *cut): used.index(tuple(cut)) for k, _, seed, *cut in todo[begin : begin + at_once]})
        finally:
            blocks.unpersist()
    rows = [(k, share, position, number, seed, *[fits[k, seed, share, position][i] for i in (1, 2, 0)]) for k, number, seed, share, position in todo if (k, seed, share, position) in fits]
    return spark.createDataFrame(rows, "k int, share double, position double, fit_id int, seed int, inertia double, ch double, centroids array<array<double>>")


def _each_fit(df: DataFrame, cols: list[str], fits: DataFrame):
    """The fits on all executors, and the distances of a batch of points to each of them."""
    named = [c for c in FIT if c in fits.columns]
    rows = [(tuple(r[c] for c in named), np.array(r["centroids"], dtype=float)) for r in fits.select(*named, "centroids").collect()]  # one row a fit
    sent = df.sparkSession.sparkContext.broadcast(rows)

    def distances(batch: pa.RecordBatch):
        x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols]).astype(float)
        x = x[~np.isnan(x).any(axis=1)]
        own = (x * x).sum(axis=1)
        for name, centres in sent.value:
            yield name, np.maximum(own[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)

    return named, distances, [f"{c} {fits.schema[c].dataType.simpleString()}" for c in named]


def inertia_of_fits(df: DataFrame, cols: list[str], fits: DataFrame) -> DataFrame:
    """Inertia of every fit over all points in one pass: what names a fit, inertia.

    The centroids (fits by k by dimensions numbers) are broadcast; a task sends
    one sum a fit.  Points with a NULL feature take no part.
    """
    named, distances, kinds = _each_fit(df, cols, fits)

    def run(batches):
        total: dict[tuple, float] = {}
        for batch in batches:
            for name, d2 in distances(batch):
                total[name] = total.get(name, 0.0) + float(d2.min(axis=1).sum())
        yield pa.RecordBatch.from_pydict({**{c: [n[i] for n in total] for i, c in enumerate(named)}, "inertia": list(total.values())}, schema=made)

    made = to_arrow_schema(fits.select(*named).schema.add("inertia", "double"))
    sums = df.select(*cols).mapInArrow(run, ", ".join([*kinds, "inertia double"]))
    return sums.groupBy(*named).agg(F.sum("inertia").alias("inertia"))


def assigned(df: DataFrame, cols: list[str], fits: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Each point with its cluster in every fit: what names a fit, id_col, cluster, and the features."""
    named, distances, kinds = _each_fit(df, cols, fits)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~np.isnan(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols]).astype(float)).any(axis=1)))
            for name, d2 in distances(batch):
                n = pa.array(np.zeros(len(d2), dtype=np.int32))
                same = [pa.array([v], type=made.field(c).type).take(n) for c, v in zip(named, name, strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(d2.argmin(axis=1).astype(np.int32)), *batch.columns], schema=made)

    whole = df.select(F.col(id_col), *cols)
    fields = [*kinds, "cluster int", *[f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields]]
    empty = fits.select(*named).schema.add("cluster", IntegerType())
    for f in whole.schema.fields:
        empty = empty.add(f.name, f.dataType)
    made = to_arrow_schema(empty)
    return whole.mapInArrow(run, ", ".join(fields))


def silhouettes_of_fits(df: DataFrame, cols: list[str], fits: DataFrame, *, id_col: str = "id", per_label: int = 200, repeats: int = 10) -> DataFrame:
    """Mean silhouette of each fit (one for each k) in each of ``repeats`` samples of up to per_label points a cluster: (k, repeat, silhouette)."""
    points = assigned(df, cols, fits.select("k", "centroids"), id_col=id_col)
    # Labels of different k must not meet: they are drawn and compared within their own k.
    sample = stratified(points.withColumn("cell", F.col("k") * 1000 + F.col("cluster")), label="cell", id_col=id_col, per_label=per_label, repeats=repeats)
    sample = sample.withColumn("repeat", F.col("k") * repeats + F.col("repeat"))
    got = silhouettes(sample, cols, label="cluster", id_col=id_col)
    mean = got.groupBy("repeat").agg(F.avg("silhouette").alias("silhouette"))
    return mean.select(F.floor(F.col("repeat") / repeats).cast("int").alias("k"), F.pmod("repeat", F.lit(repeats)).alias("repeat"), "silhouette")


def per_k(fits: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Median and quartiles of metrics over the fits of each k."""
    by = by or ["k"]
    q = lambda m: F.percentile(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{m}")
    got = fits.groupBy(*by).agg(F.count("*").alias("n_fits"), *[q(m) for m in metrics])
    return got.select(*by, "n_fits", *[F.col(f"q_{m}")[i].alias(f"{m}{end}") for m in metrics for i, end in ((1, ""), (0, "_low"), (2, "_high"))])


def median_count(fits: DataFrame, by: list[str]) -> DataFrame:
    """The median number of fits of a group. One row."""
    return fits.groupBy(*by).agg(F.count("*").alias("n")).agg(F.median("n").alias("median"))


def selection_summary(ks: DataFrame, parts: dict[str, DataFrame | None]) -> DataFrame:
    """Per k the median and band of every metric; NULL columns for a metric without a frame."""
    out = ks.select("k").distinct()
    for name, part in parts.items():
        cols = [name, f"{name}_low", f"{name}_high"]
        if part is None:
            out = out.withColumns({c: F.lit(None).cast("double") for c in cols})
        else:
            out = out.join(part.select("k", *cols), "k", "full")
    return out


def kneedle(curve: DataFrame, *, k: str = "k", y: str = "inertia", sensitivity: float = 1.0) -> DataFrame:
    """Elbow of a decreasing convex curve (a row for each k): elbow_k, elbow_y, elbow_index, distance; no row if there is none.

    The difference between the normalised curve and the diagonal has a local
    maximum; it is a knee once the difference falls below it by sensitivity
    times the mean step.
    """
    w = Window.orderBy(k)  # one row for each number of clusters
    whole = Window.partitionBy()
    xs, ys = F.col(k).cast("double"), F.col(y)
    df = curve.where(ys.isNotNull()).withColumn("index", F.row_number().over(w) - 1).withColumn("size", F.count("*").over(whole))
    x_n = (xs - F.min(xs).over(whole)) / (F.max(xs).over(whole) - F.min(xs).over(whole))
    y_n = (ys - F.min(ys).over(whole)) / (F.max(ys).over(whole) - F.min(ys).over(whole))
    df = df.withColumn("x_n", x_n).withColumn("diff", (1 - y_n) - x_n)
    top = (F.col("diff") >= F.lag("diff").over(w)) & (F.col("diff") >= F.lead("diff").over(w))
    df = df.withColumn("top", top).withColumn("threshold", F.when(F.col("top"), F.col("diff") - sensitivity / (F.col("size") - 1)))
    df = df.withColumn("group", F.sum(F.col("top").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("group")
    df = df.withColumn("least", F.min(F.when(~F.coalesce("top", F.lit(False)), F.col("diff"))).over(inside))
    knees = df.where(F.col("top") & (F.col("least") < F.col("threshold")))
    return knees.orderBy("index").limit(1).select(xs.cast("int").alias("elbow_k"), ys.alias("elbow_y"), F.col("index").alias("elbow_index"), F.col("diff").alias("distance"))


def surrogate(df: DataFrame, dims: int, *, seed: int = 0) -> DataFrame:
    """As many uniform points on [-1, 1]^dims as df has rows, by hashes of each row's key column ``id``."""
    unit = lambda j: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j)), F.lit(1 << 30)) / float(1 << 30)
    return df.select("id", *[(unit(j) * 2 - 1).alias(f"x{j}") for j in range(dims)])


def stability_null(points: DataFrame, dims: int, ks: list[int], seeds: list[int], *, surrogates: list[int], per_label: int = 200) -> DataFrame:
    """Drift, ch, inertia and silhouette of fits on uniform surrogates of the points: medians per (surrogate, k), then bands per k.

    The silhouette is that of the fit of best ch, over a stratified sample.
    """
    frames = []
    cols = [f"x{j}" for j in range(dims)]
    for s in surrogates:
        noise = surrogate(points, dims, seed=s)
        fits = sweep(noise, cols, ks, seeds)
        moved = instabilities(fits).select("k", "fit_id", "drift")
        inner = fits.join(moved, ["k", "fit_id"]).groupBy("k").agg(*[F.median(m).alias(m) for m in ("drift", "ch", "inertia")])
        shape = silhouettes_of_fits(noise, cols, best_of(fits), per_label=per_label, repeats=1).select("k", "silhouette")
        frames.append(inner.join(shape, "k", "left"))
    return per_k(reduce(DataFrame.unionByName, frames), ["drift", "ch", "inertia", "silhouette"])


def best_of(fits: DataFrame) -> DataFrame:
    """The fit of best ch of each k among those that left nothing out."""
    return fits.where("share = 0").groupBy("k").agg(F.max_by(F.struct("fit_id", "centroids"), F.struct("ch", -F.col("fit_id"))).alias("f")).select("k", "f.*")


def vectors(df: DataFrame, cols: list[str]) -> DataFrame:
    """Feature columns as one array column."""
    made = VectorAssembler(inputCols=cols, outputCol="v").transform(df)
    return made.withColumn("v", vector_to_array("v"))

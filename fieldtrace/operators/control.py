"""Implausible values: robust control charts, run-length counters and physical limits.

A source's readings are cut into chunks of their order.  In a chunk a robust
exponentially weighted chart follows the mean and scale of the source; values
beyond its warning limit are clipped before they move the chart, and become
suspects.  The scale never exceeds the source's ordinary one, so a lively
stretch does not hide a spike.  Run-length counters find stuck values; the runs
at chunk borders are joined afterwards, over two rows a chunk.  Suspects are
then held against the ordinary range of the source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Up to so many sources the table of their scales is broadcast (24 bytes a source and field).
BROADCAST_SOURCES = 50_000
STRIDE = 64


def control_chart(values: np.ndarray, centre: float, scale: float, *, weight: float = 0.1, limit: float = 2.5) -> np.ndarray:
    """Marks the suspects of a series in order.

    The series is followed in stretches of STRIDE readings side by side, each
    after a run-in over the STRIDE readings before it; with this weight what
    lies further back counts about a thousandth.  The first stretch starts
    from the source's centre, the others from the median of their run-in.
    """
    n = len(values)
    if not n:
        return np.zeros(0, dtype=bool)
    stretches = -(-n // STRIDE)
    padded = np.full((stretches + 1) * STRIDE, np.nan)
    padded[STRIDE : STRIDE + n] = values
    padded[:STRIDE] = centre
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * STRIDE)[::STRIDE][:stretches].T
    scale = max(scale, 1e-9)
    mean = np.median(view[:STRIDE], axis=0)
    spread = np.full(stretches, scale)
    marks = np.zeros((2 * STRIDE, stretches), dtype=bool)
    for t in range(2 * STRIDE):
        off = np.nan_to_num(view[t] - mean)
        size = np.abs(off)
        bound = limit * np.minimum(spread, scale)
        marks[t] = size > bound
        mean += weight * np.clip(off, -bound, bound)
        spread += weight * (1.2533 * np.minimum(size, bound) - spread)
        np.maximum(spread, 0.2 * scale, out=spread)
    return marks[STRIDE:].T.ravel()[:n]


def _chunk_rows(fields: list[tuple[float, float]], stuck: int, resolution: float):
    """The rows that one chunk contributes: see flag_implausible."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ident, when = group.column("id").to_numpy(), group.column("ord").to_numpy()
        order = np.lexsort((ident, when))
        keep = np.ones(len(order), dtype=bool)
        keep[1:] = (np.diff(ident[order]) != 0) | (np.diff(when[order]) != 0)
        order = order[keep]
        out: list[tuple] = []
        for f, (low, high) in enumerate(fields):
            values = group.column(f"v{f}").to_numpy(zero_copy_only=False).astype(float)[order]
            good = ~np.isnan(values)
            values, ids = values[good], ident[order][good]
            n = len(values)
            if not n:
                continue
            possible = (values >= low) & (values <= high)
            suspect = np.zeros(n, dtype=bool)
            centre, scale = group.column(f"c{f}")[0].as_py(), group.column(f"s{f}")[0].as_py()
            if centre is not None:
                suspect[possible] = control_chart(values[possible], centre, scale)
            edges = np.flatnonzero(np.diff(values) != 0) + 1
            starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
            long = np.repeat(stops - starts, stops - starts) >= stuck
            border = np.zeros(n, dtype=bool)
            border[: stops[0]] = border[starts[-1] :] = True
            inner = ~border
            where = np.where(np.arange(n) < stops[0], 0, 1)
            nothing = np.zeros(n, dtype=np.int64)
            kinds = (
                ("stuck", inner & long, ids, values, nothing),
                ("suspect", inner & ~long & possible & suspect, ids, values, np.arange(n)),
                ("edge", border, ids, values, np.arange(n) * 8 + where * 4 + possible * 2 + suspect),
            )
            for kind, mask, a, b, c in kinds:
                if mask.any():
                    out.append((f, kind, a[mask], b[mask], c[mask]))
            plain = values[inner & ~long & possible & ~suspect]
            if len(plain):
                out.append((f, "range", np.zeros(2, dtype=np.int64), np.array([plain.min(), plain.max()]), np.zeros(2, dtype=np.int64)))
            steps, count = np.unique(np.rint(values[possible] / resolution).astype(np.int64), return_counts=True)
            out.append((f, "count", steps, steps * resolution, count))
        sizes = [len(o[2]) for o in out]
        n = sum(sizes)
        repeat = lambda v, t: pa.array([v], type=t).take(pa.array(np.zeros(n, dtype=np.int64)))
        join = lambda k, t: pa.array(np.concatenate([o[k] for o in out]) if out else np.zeros(0), type=t)
        kinds = pa.array([o[1] for o in out], type=pa.string()).take(pa.array(np.repeat(np.arange(len(out)), sizes).astype(np.int64)))
        field = pa.array(np.repeat([o[0] for o in out], sizes).astype(np.int32))
        columns = [repeat(key[0].as_py(), group.schema.field("key").type), repeat(key[1].as_py(), pa.int64()), field, kinds]
        columns += [join(2, pa.int64()), join(3, pa.float64()), join(4, pa.int64())]
        return pa.table(columns, names=["key", "chunk", "field", "kind", "id", "value", "extra"])

    return run


def flag_implausible(
    readings: DataFrame,
    *,
    id_col: str,
    key_col: str,
    order: F.Column,
    fields: dict[str, tuple[float, float]],
    chunk: int,
    stuck: int = 12,
    factor: float = 2.0,
    brief: int = 3,
    resolution: float = 0.001,
) -> DataFrame:
    """Rows (id BIGINT, field STRING, reason STRING) of the faulty readings, distinct.

    fields maps a column to its physical limits.  reason is ``impossible``
    (beyond the limits, whatever the key or order), ``stuck`` (one of ``stuck``
    or more readings of a source in succession with exactly the same value) or
    ``spike`` (more than ``factor`` times as far from the source's median as any
    of its ordinary readings; no ordinary reading is a suspect beyond that, an
    impossible or a stuck one).  At most ``brief`` suspects in succession can be a
    spike; more of them are ordinary, and the rest is held against them too
    (successions that cross a chunk border count on either side of it).  Readings are ordered by ``order`` (BIGINT), id;
    those with a NULL key, order or id, or a NULL or NaN value, are passed over.
    Each id counts once; other columns are ignored; an empty table gives no rows.
    The median is taken over values rounded to ``resolution``, which bounds its
    histogram by the physical range; ``chunk`` is the width of order in one group.
    """
    names = list(fields)
    value = [F.col(c).cast("double") for c in names]
    given = readings.select(F.col(id_col).alias("id"), F.col(key_col).alias("key"), order.alias("ord"), *[F.when(~F.isnan(v), v).alias(f"v{k}") for k, v in enumerate(value)])
    limits = [fields[c] for c in names]
    possible = [F.when(F.col(f"v{k}").between(*limits[k]), F.round(F.col(f"v{k}") / resolution) * resolution) for k in range(len(names))]

    beyond = F.array_compact(
        F.array(*[F.when(~F.col(f"v{k}").between(*limits[k]), F.struct(F.lit(k).alias("field"))) for k in range(len(names))])
    )
    impossible = given.select("id", F.explode(beyond).alias("b")).select("id", "b.field", F.lit("impossible").alias("reason"))

    # The ordinary centre and scale of each source; only the chart starts from them.
    scales = given.where("key IS NOT NULL").groupBy("key").agg(*[F.percentile(p, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{k}") for k, p in enumerate(possible)])
    scales = cut_lineage(scales.select("key", *[c for k in range(len(names)) for c in (F.col(f"q{k}")[1].alias(f"c{k}"), ((F.col(f"q{k}")[2] - F.col(f"q{k}")[0]) / 1.349).alias(f"s{k}"))]))
    few = scales.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows = given.where("key IS NOT NULL AND ord IS NOT NULL AND id IS NOT NULL").distinct()
    rows = rows.join(F.broadcast(scales) if few else scales, "key").withColumn("chunk", F.floor(F.col("ord") / chunk))
    key_type = given.schema["key"].dataType.simpleString()
    seen = rows.groupBy("key", "chunk").applyInArrow(
        _chunk_rows(limits, stuck, resolution), f"key {key_type}, chunk bigint, field int, kind string, id bigint, value double, extra bigint"
    )
    seen = cut_lineage(seen)

    # Runs at chunk borders, joined with their neighbours.
    edge = seen.where("kind = 'edge'").select("key", "field", "chunk", "id", "value", F.expr("extra DIV 8").alias("place"), F.expr("(extra DIV 4) % 2").alias("side"), F.expr("(extra & 2) > 0").alias("possible"), F.expr("(extra & 1) > 0").alias("suspect"))
    runs = edge.groupBy("key", "field", "chunk", "side").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    along = Window.partitionBy("key", "field").orderBy("chunk", "side")
    goes_on = (F.col("value") == F.lag("value").over(along)) & (F.col("chunk") != F.lag("chunk").over(along))
    runs = runs.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(along))
    runs = runs.withColumn("long", F.sum("n").over(Window.partitionBy("key", "field", "run")) >= stuck)
    edge = edge.join(runs.select("key", "field", "chunk", "side", "long"), ["key", "field", "chunk", "side"])
    frozen = seen.where("kind = 'stuck'").select("id", "field").union(edge.where("long").select("id", "field"))

    # Suspects against the ordinary range: a gap of more than the factor lies between
    # two octaves of the distance, so the ends of the octaves are enough.
    counts = seen.where("kind = 'count'").groupBy("key", "field", "value").agg(F.sum("extra").alias("n"))
    medians = counts.groupBy("key", "field").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("median"))
    free = edge.where("possible AND NOT long")
    plain = seen.where("kind = 'range'").select("key", "field", "value").union(free.where("NOT suspect").select("key", "field", "value"))
    bounds = plain.groupBy("key", "field").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    base = medians.join(bounds, ["key", "field"], "left").select(
        "key", "field", "median", F.coalesce(F.greatest(F.col("high") - F.col("median"), F.col("median") - F.col("low")), F.lit(0.0)).alias("known")
    )
    fields_of = ("key", "field", "chunk", "id", "value")
    suspects = seen.where("kind = 'suspect'").select(*fields_of, F.col("extra").alias("place")).union(free.where("suspect").select(*fields_of, "place"))
    small = lambda df: F.broadcast(df) if few else df

    def beyond_ordinary(base: DataFrame) -> DataFrame:
        """Suspects behind the first gap outside the ordinary range."""
        far = suspects.join(small(base), ["key", "field"]).withColumn("far", F.abs(F.col("value") - F.col("median")))
        octaves = far.where("far > 0").groupBy("key", "field", F.floor(F.log2("far")).alias("octave")).agg(F.min("far").alias("near"), F.max("far").alias("far"), F.max("known").alias("known"))
        upward = Window.partitionBy("key", "field").orderBy("octave").rowsBetween(Window.unboundedPreceding, -1)
        octaves = octaves.withColumn("inside", F.greatest("known", F.max("far").over(upward)))
        steps = octaves.where((F.col("inside") > 0) & (F.col("near") > factor * F.col("inside"))).groupBy("key", "field").agg(F.min("near").alias("least"))
        return far.join(small(steps), ["key", "field"]).where("far >= least")

    first = beyond_ordinary(base)
    run = F.col("place") - F.row_number().over(Window.partitionBy("key", "field", "chunk").orderBy("place"))
    lasting = first.withColumn("run", run).groupBy("key", "field", "chunk", "run").agg(F.count("*").alias("n"), F.max("far").alias("far")).where(F.col("n") > brief)
    lasting = lasting.groupBy("key", "field").agg(F.max("far").alias("lasting"))
    base = base.join(lasting, ["key", "field"], "left").withColumn("known", F.greatest("known", F.coalesce("lasting", F.lit(0.0)))).drop("lasting")
    spikes = beyond_ordinary(base).select("id", "field")

    found = impossible.union(frozen.withColumn("reason", F.lit("stuck"))).union(spikes.withColumn("reason", F.lit("spike"))).distinct()
    return found.select("id", F.element_at(F.array(*map(F.lit, names)), F.col("field") + 1).alias("field"), "reason")

"""Order-dependent columns for sequences of any length.

A window over a whole sequence sorts it in one task.  Here a sequence is cut
into chunks of its order (a column ``chunk`` that grows with the order: a day, a
range of sample numbers), windows run inside a chunk, and what crosses a chunk
border is carried over one summary row a chunk.  The rows are shuffled once, by
(keys, chunk).  Rows with a NULL key or order must be dropped before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _windows(keys: list[str], order: list[str], descending: bool = False):
    inside = Window.partitionBy(*keys, "chunk").orderBy(*[F.desc(c) if descending else F.asc(c) for c in order])
    across = Window.partitionBy(*keys).orderBy(F.desc("chunk") if descending else F.asc("chunk"))
    return inside, across


def _held(cols: dict[str, Column | str]) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])


def beside(df: DataFrame, *, keys: list[str], order: list[str], before: dict[str, Column | str] | None = None, after: dict[str, Column | str] | None = None) -> DataFrame:
    """Adds for each name in before its column's value in the row before, and for each in after that in the row behind.

    NULL in a key's first, or last, row.  order must be unique within a key.
    Both directions share one sort and one summary of the chunks.
    """
    inside, across = _windows(keys, order)
    sides = [("_ordered_before", before, F.max, F.lag), ("_ordered_after", after, F.min, F.lead)]
    sides = [side for side in sides if side[1]]
    edges = df.groupBy(*keys, "chunk").agg(*[edge(F.struct(*order, _held(cols).alias("held"))).alias(name) for name, cols, edge, _ in sides])
    edges = edges.select(*keys, "chunk", *[shift(f"{name}.held").over(across).alias(f"{name}_carried") for name, _, _, shift in sides])
    out = df.withColumns({name: shift(_held(cols)).over(inside) for name, cols, _, shift in sides}).join(edges, [*keys, "chunk"])
    found = {n: F.coalesce(name, f"{name}_carried").getField(n) for name, cols, _, _ in sides for n in cols}
    return out.withColumns(found).drop(*[c for name, *_ in sides for c in (name, f"{name}_carried")])


def previous(df: DataFrame, *, keys: list[str], order: list[str], cols: dict[str, Column | str]) -> DataFrame:
    """Adds for each name in cols its column's value in the row before; NULL in a key's first row."""
    return beside(df, keys=keys, order=order, before=cols)


def following(df: DataFrame, *, keys: list[str], order: list[str], cols: dict[str, Column | str]) -> DataFrame:
    """Like previous, for the row behind."""
    return beside(df, keys=keys, order=order, after=cols)


def earlier(df: DataFrame, *, keys: list[str], order: list[str], col: str, names: list[str]) -> DataFrame:
    """Adds a column's value one, two, ... rows before under the given names; NULL where a key has no such row.

    order must be unique within a key.  A chunk hands on its last rows, as many
    as there are names; where chunks are shorter, those before them help out.
    """
    n = len(names)
    inside, across = _windows(keys, order)
    last = df.withColumn("_ordered_more", F.lead(F.lit(1), n).over(inside)).where("_ordered_more IS NULL")
    ends = last.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct(*order, F.col(col).alias("held"))), asc=False).alias("ends"))
    carried = F.flatten(F.reverse(F.collect_list("ends").over(across.rowsBetween(-n, -1))))
    ends = ends.select(*keys, "chunk", carried.alias("_ordered_carried"))
    inner = {f"_ordered_{name}": F.lag(col, j).over(inside) for j, name in enumerate(names, 1)}
    out = df.withColumns({"_ordered_place": F.row_number().over(inside), **inner}).join(ends, [*keys, "chunk"])
    place = F.col("_ordered_place")
    found = {name: F.when(place > j, F.col(f"_ordered_{name}")).otherwise(F.get("_ordered_carried", j - place).getField("held")) for j, name in enumerate(names, 1)}
    return out.withColumns(found).drop("_ordered_place", "_ordered_carried", *inner)


def running_sums(df: DataFrame, *, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its value up to and including each row."""
    inside, across = _windows(keys, order)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "chunk").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    sums = sums.select(*keys, "chunk", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_ordered_{n}") for n in values])
    out = df.withColumns({n: F.sum(v).over(inside) for n, v in values.items()}).join(sums, [*keys, "chunk"])
    return out.withColumns({n: F.coalesce(n, F.lit(0)) + F.col(f"_ordered_{n}") for n in values}).drop(*[f"_ordered_{n}" for n in values])


def running_sum(df: DataFrame, *, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of value up to and including each row."""
    return running_sums(df, keys=keys, order=order, values={name: value})


def known_around(df: DataFrame, *, keys: list[str], order: list[str], present: Column, before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """Adds for each name in before its column's value in the nearest row up to this one where present holds, and for each in after in the nearest from this one on.

    NULL where there is none.
    """
    sides = [("_ordered_before", before, F.max, _windows(keys, order)), ("_ordered_after", after, F.min, _windows(keys, order, True))]
    edges = df.groupBy(*keys, "chunk").agg(*[edge(F.when(present, F.struct(*order, _held(cols).alias("held")))).alias(name) for name, cols, edge, _ in sides])
    beyond = [F.last(f"{name}.held", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{name}_carried") for name, _, _, (_, across) in sides]
    edges = edges.select(*keys, "chunk", *beyond)
    inner = {
        name: F.last(F.when(present, _held(cols)), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        for name, cols, _, (inside, _) in sides
    }
    out = df.withColumns(inner).join(edges, [*keys, "chunk"])
    found = {n: F.coalesce(name, f"{name}_carried").getField(n) for name, cols, _, _ in sides for n in cols}
    return out.withColumns(found).drop(*[c for name, *_ in sides for c in (name, f"{name}_carried")])


def numbered(df: DataFrame, *, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Adds the position of each row in its key, from 0."""
    return running_sum(df, keys=keys, order=order, value=F.lit(1), name=name).withColumn(name, F.col(name) - 1)

"""Filling containers of one capacity with items, by optimal length buckets.

A container holds items of one bucket only, each given the room of the bucket's
bound, so ``capacity // bound`` of them: the token budget of a batch.  The
histogram of item sizes (at most one row for each size up to the capacity) goes
to the driver, where dynamic programming chooses the bounds that need the fewest
containers, the last and part-filled one of each bucket included.  Every bucket
is one stream of batches: its items are numbered through, by a row number in each
of many hash groups and a sum over the groups' sizes, and the number gives the
container.  A size that a third of the corpus has is thus spread over all groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def choose_buckets(sizes: list[int], counts: list[int], capacity: int, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` size buckets that need the fewest containers, the fewest buckets on a tie.

    n items in a bucket of bound b fill ceil(n / (capacity // b)) containers, so
    what the program counts is what pack_items uses; with the number of
    containers, padding and unused room are least together.  The last bound is
    the largest size.  No sizes give no bounds.
    """
    if not sizes:
        return []
    order = np.argsort(sizes)
    size, count = np.asarray(sizes)[order], np.asarray(counts, dtype=np.int64)[order]
    n, layers = len(size), min(buckets, len(size))
    many = np.concatenate([[0], np.cumsum(count)])
    # best[k, b]: containers of the b smallest sizes in k buckets.
    best = np.full((layers + 1, n + 1), np.iinfo(np.int64).max // 2)
    best[0, 0] = 0
    begin = np.zeros((layers + 1, n + 1), dtype=np.int64)
    for b in range(1, n + 1):
        per = capacity // int(size[b - 1])
        total = best[:-1, :b] - (many[:b] - many[b]) // per
        begin[1:, b] = np.argmin(total, axis=1)
        best[1:, b] = np.take_along_axis(total, begin[1:, b, None], axis=1)[:, 0]
    bounds, b = [], n
    for k in range(int(np.argmin(best[:, n])), 0, -1):
        bounds.append(int(size[b - 1]))
        b = int(begin[k, b])
    return bounds[::-1]


def pack_items(
    items: DataFrame, *, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", buckets: int = 64, group_rows: int = 50_000
) -> DataFrame:
    """Rows (id_col, part INT, size BIGINT, container STRING), in which no container holds more than capacity.

    Every item is in one container whole; only one longer than the capacity is
    cut, into full containers and a rest (part 0, 1, ...).  Items of size 0 or
    NULL (empty and NULL texts) need no room: one row with size 0 and a NULL
    container.  Repeated rows are packed as often as they occur; other columns
    are ignored; an empty table gives no rows.  The sizes are computed when the
    function is called, because the buckets depend on them.
    """
    items = cut_lineage(items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)).alias("size")))
    parts = items.where("size > 0").select(
        "id", F.posexplode(F.expr(f"transform(sequence(0L, (size - 1) DIV {capacity}), i -> least({capacity}L, size - i * {capacity}))")).alias("part", "size")
    )
    # At most one row for each size up to the capacity.
    histogram = {r["size"]: r["n"] for r in parts.where(F.col("size") < capacity).groupBy("size").agg(F.count("*").alias("n")).collect()}
    bounds = choose_buckets(list(histogram), list(histogram.values()), capacity, buckets)
    full = parts.where(F.col("size") == capacity).select("id", "part", "size", F.concat_ws("-", F.lit("full"), "id", "part").alias("container"))
    none = items.where("size <= 0").select("id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("container"))
    packed = full
    if bounds:
        groups = -(-sum(histogram.values()) // group_rows)
        bucket, per = F.lit(len(bounds) - 1), F.lit(capacity // bounds[-1])
        for k in reversed(range(len(bounds) - 1)):
            inside = F.col("size") <= bounds[k]
            bucket, per = F.when(inside, k).otherwise(bucket), F.when(inside, capacity // bounds[k]).otherwise(per)
        rest = parts.where(F.col("size") < capacity).select("id", "part", "size", bucket.alias("bucket"), per.alias("per"), F.pmod(F.xxhash64("id", "part"), F.lit(groups)).alias("grp"))
        at = F.row_number().over(Window.partitionBy("bucket", "grp").orderBy("id", "part"))
        # A row for each bucket and group.
        sums = rest.groupBy("bucket", "grp").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("bucket").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("bucket", "grp", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
        placed = rest.withColumn("at", at).join(sums, ["bucket", "grp"])
        no = F.expr("(at - 1 + earlier) DIV per")
        packed = packed.union(placed.select("id", "part", "size", F.concat_ws("-", "bucket", no).alias("container")))
    return packed.union(none).select(F.col("id").alias(id_col), "part", "size", "container")


def fill(packed: DataFrame, *, capacity: int) -> DataFrame:
    """One row of a pack_items result: capacity, n_items, n_containers, tokens and their share of the room."""
    sums = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    total = sums.agg(F.sum("n").alias("n_items"), F.count("*").alias("n_containers"), F.sum("size").alias("tokens"))
    return total.select(F.lit(capacity).alias("capacity_tokens"), "n_items", "n_containers", "tokens", F.try_divide("tokens", F.col("n_containers") * capacity).alias("fill"))

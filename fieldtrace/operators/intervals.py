"""Continuous periods and gaps of overlapping intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def merge_intervals(
    intervals: DataFrame, *, keys: list[str], start: str, stop: str, gap_below: int | None = None, chunk: int = DAY_US
) -> DataFrame:
    """Rows (kind, *keys, start, stop): the periods of each entity and the gaps between them.

    start and stop are BIGINT columns.  A period is a maximal union of intervals
    that overlap or touch; a gap lies between two periods in succession and is
    given if shorter than ``gap_below`` (all gaps if None).  Intervals with a
    NULL key, start or stop, or with stop before start, take no part; those of
    no length do.  Repeated rows count once; other columns are ignored; an empty
    table gives no rows.

    Rows are sorted by start within (entity, chunk of the start) and compared
    with the running maximum of the previous stops; what reaches into a chunk
    is a running maximum over one row a chunk.  Island labels are counted the
    same way.  No entity is sorted in one task: equal starts are merged before
    the shuffle, and ``chunk`` bounds what one group can hold.
    """
    given = intervals.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(start).alias("a"), F.col(stop).alias("b"))
    ks = [f"k{i}" for i in range(len(keys))]
    clean = given.where("a <= b").dropna(subset=ks)
    longest = clean.groupBy(*ks, "a").agg(F.max("b").alias("b")).withColumn("chunk", F.floor(F.col("a") / chunk))

    over_chunks = Window.partitionBy(*ks).orderBy("chunk")
    left = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    reach = longest.groupBy(*ks, "chunk").agg(F.max("b").alias("b")).select(*ks, "chunk", F.max("b").over(left).alias("carried"))
    in_chunk = Window.partitionBy(*ks, "chunk").orderBy("a")
    before = F.max("b").over(in_chunk.rowsBetween(Window.unboundedPreceding, -1))
    marked = longest.withColumn("before", before).join(reach, [*ks, "chunk"])
    marked = marked.withColumn("before", F.greatest("before", "carried"))  # greatest passes NULLs over
    marked = marked.withColumn("opens", F.when(F.col("before") >= F.col("a"), 0).otherwise(1))
    opened = marked.groupBy(*ks, "chunk").agg(F.sum("opens").alias("n")).select(*ks, "chunk", F.sum("n").over(left).alias("n"))
    marked = marked.withColumn("no", F.sum("opens").over(in_chunk)).join(opened, [*ks, "chunk"])
    marked = marked.withColumn("island", F.col("no") + F.coalesce("n", F.lit(0)))

    # The row that opens an island also ends the gap before it.
    periods = marked.groupBy(*ks, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max(F.when(F.col("opens") == 1, F.col("before"))).alias("last"))
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("a").alias("a"), F.col("b").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.col("last").alias("a"), F.col("a").alias("b")),
    )
    rows = periods.select(*ks, F.explode(kinds).alias("r")).select(*ks, "r.*").where("a IS NOT NULL")
    if gap_below is not None:
        rows = rows.where((F.col("kind") == "period") | (F.col("b") - F.col("a") < gap_below))
    return rows.select("kind", *[F.col(k).alias(n) for k, n in zip(ks, keys, strict=True)], F.col("a").alias(start), F.col("b").alias(stop))

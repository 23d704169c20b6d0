"""Collapsing runs of repeated events by associative run summaries.

Each entity's sequence is cut into range chunks of its order column.  A chunk
encodes its runs on its own; a run is a summary (label, first, count, largest
end, length) that can be joined with the next one.  What passes a chunk border
is one summary a chunk: the label and largest end of its last stretch of equal
labels.  A prefix scan over these few rows tells every chunk what it continues,
so no entity, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapse_runs(
    events: DataFrame,
    *,
    id_col: str = "bout_id",
    key_col: str = "animal_id",
    label_col: str = "labels",
    length_col: str = "lengths",
    start_col: str = "start_index",
    tolerance: int = 5,
    chunk: int = 1 << 20,
) -> DataFrame:
    """Rows (key_col, label_col, start_index, stop_index, n_events, duration), one for each run.

    Events of one key are ordered by start, id.  A run holds events in
    succession with the same label, each starting at most ``tolerance`` after
    the largest end in the run so far.  duration is the sum of the lengths,
    stop_index the largest end.  An event with a NULL label is a run of its own.
    Each id counts once (of differing rows with one id, the smallest by start,
    key, label and length); rows with NULL id, key or start take no part; a NULL
    length is 0.  ``chunk`` is the width of the order range handled by one
    group; events that share a range this narrow are few, copies are gone by then.
    """
    own = [F.col(start_col), F.col(key_col), F.col(label_col), F.coalesce(F.col(length_col), F.lit(0))]
    one = events.where(F.col(id_col).isNotNull() & F.col(key_col).isNotNull() & F.col(start_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.struct(*(c.alias(n) for c, n in zip(own, ("start", "key", "label", "len"), strict=True))).alias("e")
    )
    one = one.groupBy("id").agg(F.min("e").alias("e")).select("id", "e.*")
    one = one.withColumn("chunk", F.floor(F.col("start") / chunk)).withColumn("stop", F.col("start") + F.col("len"))

    in_chunk = Window.partitionBy("key", "chunk").orderBy("start", "id")
    same = F.col("label").eqNullSafe(F.lag("label").over(in_chunk)) & F.lag("id").over(in_chunk).isNotNull()
    one = one.withColumn("stretch", F.sum(F.when(same, 0).otherwise(1)).over(in_chunk))
    in_stretch = Window.partitionBy("key", "chunk", "stretch").orderBy("start", "id")
    reach = F.max("stop").over(in_stretch.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = F.col("label").isNotNull() & (F.col("start") <= reach + tolerance)
    one = one.withColumn("opens", F.when(goes_on, 0).otherwise(1))
    one = one.withColumn("run", F.sum("opens").over(in_stretch))
    local = one.groupBy("key", "chunk", "stretch", "run").agg(
        F.first("label").alias("label"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"), F.sum("len").alias("dur")
    )

    # One summary a chunk, and what reaches into each chunk from the left.
    ends = local.groupBy("key", "chunk").agg(
        F.min(F.struct("stretch", "label")).alias("head"),
        F.max(F.struct("stretch", "label")).alias("tail"),
        F.max(F.struct("stretch", "stop")).getField("stop").alias("tail_stop"),
    )
    over_chunks = Window.partitionBy("key").orderBy("chunk")
    breaks = (F.col("tail.stretch") > 1) | ~F.coalesce(F.col("head.label").eqNullSafe(F.lag("tail.label").over(over_chunks)), F.lit(False))
    ends = ends.withColumn("spell", F.sum(F.when(breaks, 1).otherwise(0)).over(over_chunks))
    ends = ends.withColumn("reach", F.max("tail_stop").over(Window.partitionBy("key", "spell").orderBy("chunk")))
    carried = ends.select("key", "chunk", F.lag("tail.label").over(over_chunks).alias("carry_label"), F.lag("reach").over(over_chunks).alias("carry_stop"))

    joins = (F.col("stretch") == 1) & (F.col("label") == F.col("carry_label")) & (F.col("start") <= F.col("carry_stop") + tolerance)
    merged = local.join(carried, ["key", "chunk"]).withColumn("opens", F.when(joins, 0).otherwise(1))
    opened = merged.groupBy("key", "chunk").agg(F.sum("opens").alias("opened"))
    before = opened.select("key", "chunk", F.sum("opened").over(over_chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    in_order = Window.partitionBy("key", "chunk").orderBy("stretch", "run")
    numbered = merged.join(before, ["key", "chunk"]).withColumn("no", F.coalesce("before", F.lit(0)) + F.sum("opens").over(in_order))
    runs = numbered.groupBy("key", "no").agg(
        F.first("label").alias("label"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"), F.sum("dur").alias("dur")
    )
    return runs.select(
        F.col("key").alias(key_col), F.col("label").alias(label_col), F.col("start").alias("start_index"),
        F.col("stop").alias("stop_index"), F.col("n").alias("n_events"), F.col("dur").alias("duration"),
    )

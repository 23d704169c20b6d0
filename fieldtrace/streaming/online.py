"""Online operators: classification, bouts, rolling counts and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cluster import nearest


def classify(stream: DataFrame, cols: list[str], centroids: list[list[float]]) -> DataFrame:
    """Nearest centroid of every row as it comes."""
    return nearest(stream, cols, centroids)


def rolling_counts(stream: DataFrame, *, ts: str = "ts", label: str = "label", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per window and label; rows later than ``late`` are dropped. ts must be a TIMESTAMP."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(window.alias("window"), label).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), label, "n")


def sessions(stream: DataFrame, *, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of a key's rows without a pause of ``gap``."""
    got = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n")


def bouts(stream: DataFrame, *, key: str = "animal_id", ts: str = "ts", label: str = "label", late: str = "1 minute") -> DataFrame:
    """Finished bouts of each key: (key, label, start, n), emitted when the label changes or the watermark has passed.

    The open bout (label, start, length) is the state.  Rows of a micro-batch
    are put in order; a row older than the open bout's last row is dropped.
    """
    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, label int, start timestamp, n bigint"
    state = "label int, start timestamp, last timestamp, n bigint"

    def run(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        if held.hasTimedOut:
            name, start, _, n = held.get
            held.remove()
            yield pd.DataFrame({key: [group[0]], "label": [name], "start": [start], "n": [n]})
            return
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        open_ = held.get if held.exists else None
        for t, name in zip(rows[ts], rows[label], strict=True):
            if open_ is not None and t < open_[2]:
                continue
            if open_ is not None and open_[0] == name:
                open_ = (name, open_[1], t, open_[3] + 1)
            else:
                if open_ is not None:
                    done.append(open_)
                open_ = (int(name), t, t, 1)
        held.update(open_)
        held.setTimeoutTimestamp(max(int(open_[2].timestamp() * 1000), held.getCurrentWatermarkMs()) + 1)
        if done:
            yield pd.DataFrame({key: group[0], "label": [d[0] for d in done], "start": [d[1] for d in done], "n": [d[3] for d in done]})

    marked = stream.withWatermark(ts, late).where(F.col(label).isNotNull() & F.col(key).isNotNull())
    return marked.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)

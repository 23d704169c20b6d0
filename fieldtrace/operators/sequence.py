"""Label streams: runs, transitions, durations and n-grams.

A label stream has the columns animal_id, chunk, label and an order (one or more
columns, unique within an animal).  Rows with a NULL animal, order or label
must be dropped before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import beside, earlier, numbered, previous, running_sum, running_sums

ANIMAL = ["animal_id"]


def states(stream: DataFrame, n_states: int, name: str = "label") -> DataFrame:
    return stream.sparkSession.range(n_states).select(F.col("id").cast("int").alias(name))


def bouts(stream: DataFrame, order: list[str]) -> DataFrame:
    """Runs of equal labels: (animal_id, bout, label, length, start_seq, chunk).  Single rows are kept."""
    marked = previous(stream, keys=ANIMAL, order=order, cols={"before": "label"})
    change = F.when(F.col("before") == F.col("label"), 0).otherwise(1)
    marked = running_sums(marked, keys=ANIMAL, order=order, values={"seq": F.lit(1), "bout": change})
    return marked.groupBy("animal_id", "bout").agg(
        F.first("label").alias("label"), F.count("*").alias("length"), (F.min("seq") - 1).alias("start_seq"), F.min("chunk").alias("chunk")
    )


def transitions(stream: DataFrame, order: list[str], n_states: int, *, smoothing: float = 0.0, single_chain: bool = False) -> DataFrame:
    """Counts (from_state, to_state, n) of successive labels, zero cells included.

    single_chain also counts the step from an animal's last to the next animal's
    first label (animals in the order of their ids), one row an animal.
    """
    pairs = previous(stream, keys=ANIMAL, order=order, cols={"before": "label"}).where("before IS NOT NULL").select(F.col("before").alias("from_state"), F.col("label").alias("to_state"))
    if single_chain:
        ends = stream.groupBy("animal_id").agg(F.min_by("label", F.struct(*order)).alias("head"), F.max_by("label", F.struct(*order)).alias("tail"))
        by_animal = Window.orderBy("animal_id")  # one row an animal
        pairs = pairs.union(ends.select(F.lag("tail").over(by_animal).alias("from_state"), F.col("head").alias("to_state")).where("from_state IS NOT NULL"))
    counts = pairs.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    grid = states(stream, n_states, "from_state").crossJoin(states(stream, n_states, "to_state"))  # n_states squared
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, ["from_state", "to_state"], "left").select("from_state", "to_state", (n + smoothing if smoothing else n).alias("n"))


def conditional(counts: DataFrame) -> DataFrame:
    """Row-normalised transition probabilities; rows without transitions stay 0."""
    total = F.sum("n").over(Window.partitionBy("from_state"))
    return counts.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def marginals(stream: DataFrame, n_states: int) -> DataFrame:
    """Share of each label (label, n, rate), zero states included."""
    counts = stream.groupBy("label").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # n_states rows
    full = states(stream, n_states).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("rate", F.col("n") / F.sum("n").over(whole))


def baseline_flags(conditionals: DataFrame, rates: DataFrame, factor: float = 1.0) -> DataFrame:
    """1 if p exceeds factor times the target's rate, -1 if below (but not 0), else 0."""
    m = rates.select(F.col("label").alias("to_state"), "rate")
    flag = F.when(F.col("p") > factor * F.col("rate"), 1).when((F.col("p") < factor * F.col("rate")) & (F.col("p") > 0), -1).otherwise(0)
    return conditionals.join(F.broadcast(m), "to_state").select("from_state", "to_state", "p", flag.alias("flag"))


def expected_durations(conditionals: DataFrame, fps: float) -> DataFrame:
    """Seconds a state lasts if dwell times are geometric; NULL (unbounded) where p is 1."""
    own = conditionals.where("from_state = to_state")
    return own.select(F.col("from_state").alias("label"), F.when(F.col("p") < 1, 1 / (1 - F.col("p")) / fps).alias("expected_s"))


def cumulative_rows(conditionals: DataFrame) -> DataFrame:
    """Cumulative distribution of each row of the transition matrix."""
    w = Window.partitionBy("from_state").orderBy("to_state").rowsBetween(Window.unboundedPreceding, 0)
    return conditionals.withColumn("cdf", F.sum("p").over(w))


def duration_stats(runs: DataFrame, by: list[str], fps: float) -> DataFrame:
    """Seconds per bout in each group: n, median, quartiles, mean, largest, sum."""
    s = F.col("length") / fps
    q = F.percentile(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = runs.groupBy(*by).agg(F.count("*").alias("n_bouts"), q.alias("q"), F.avg(s).alias("mean_s"), F.max(s).alias("max_s"), F.sum(s).alias("total_s"))
    return got.select(*by, "n_bouts", F.col("q")[1].alias("median_s"), F.col("q")[0].alias("q25_s"), F.col("q")[2].alias("q75_s"), "mean_s", "max_s", "total_s")


def mean_durations(runs: DataFrame, n_states: int, fps: float, *, ignore_ones: bool = False) -> DataFrame:
    """Mean bout duration and its standard error per label; NULL for absent labels, error 0 for one bout."""
    kept = runs.where("length > 1") if ignore_ones else runs
    stats = kept.groupBy("label").agg(F.avg("length").alias("m"), F.coalesce(F.stddev_samp("length"), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
    return states(runs, n_states).join(stats, "label", "left").select("label", (F.col("m") / fps).alias("mean_s"), (F.col("s") / F.sqrt("n") / fps).alias("sem_s"))


def cohort_durations(runs: DataFrame, fps: float) -> DataFrame:
    """Per label over animals: mean of means with its error (NULL for one animal), median of medians with quartiles."""
    one = duration_stats(runs, ["animal_id", "label"], fps)
    q = F.percentile("median_s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = one.groupBy("label").agg(
        F.count("*").alias("n_animals"), F.sum("n_bouts").alias("n_bouts"), F.avg("mean_s").alias("mean_s"),
        (F.stddev_samp("mean_s") / F.sqrt(F.count("*"))).alias("sem_s"), q.alias("q"),
    )
    return got.select("label", "n_animals", "n_bouts", "mean_s", "sem_s", F.col("q")[1].alias("median_s"), F.col("q")[0].alias("q25_s"), F.col("q")[2].alias("q75_s"))


def ngrams(stream: DataFrame, order: list[str], n: int) -> DataFrame:
    """Counts of n successive labels per animal: (s1, ..., sn, n)."""
    names = [f"b{k}" for k in range(1, n)]
    df = earlier(stream, keys=ANIMAL, order=order, col="label", names=names) if names else stream
    cols = [*reversed(names), "label"]
    return df.dropna(subset=cols).groupBy(*[F.col(c).alias(f"s{i + 1}") for i, c in enumerate(cols)]).agg(F.count("*").alias("n"))


def differences(stream: DataFrame, order: list[str], col: str) -> DataFrame:
    """First difference of a column within an animal; the first row has none and is left out."""
    return previous(stream, keys=ANIMAL, order=order, cols={"before": col}).where("before IS NOT NULL").withColumn("diff", F.col(col) - F.col("before"))


def merge_short_bouts(runs: DataFrame, cutoff: int, *, mode: str = "longer") -> DataFrame:
    """Bouts shorter than cutoff take the label of the longer neighbour (the previous one on a tie).

    mode "next" takes bouts of at most cutoff, and the next one where the
    previous is longer.  Neighbours are the bouts as they were; runs that become
    equal are joined.
    """
    if mode not in ("longer", "next"):
        raise ValueError(f"unknown mode {mode!r}")
    held = {"label": "label", "length": "length"}
    df = beside(runs, keys=ANIMAL, order=["bout"], before={f"before_{k}": v for k, v in held.items()}, after={f"after_{k}": v for k, v in held.items()})
    back, ahead = F.coalesce("before_length", F.lit(-1)), F.coalesce("after_length", F.lit(-1))
    if mode == "longer":
        short, take_back = F.col("length") < cutoff, back >= ahead
    else:
        short, take_back = F.col("length") <= cutoff, back <= ahead
    chosen = F.when(take_back, F.coalesce("before_label", "after_label")).otherwise(F.coalesce("after_label", "before_label"))
    df = df.withColumn("label", F.when(short, F.coalesce(chosen, "label")).otherwise(F.col("label")))
    df = previous(df.select("animal_id", "bout", "label", "length", "start_seq", "chunk"), keys=ANIMAL, order=["bout"], cols={"before": "label"})
    df = running_sum(df, keys=ANIMAL, order=["bout"], value=F.when(F.col("before") == F.col("label"), 0).otherwise(1), name="merged")
    return df.groupBy("animal_id", F.col("merged").alias("bout")).agg(F.first("label").alias("label"), F.sum("length").alias("length"), F.min("start_seq").alias("start_seq"), F.min("chunk").alias("chunk"))


def leave_out(stream: DataFrame, *, order: list[str], share: float, at: float) -> DataFrame:
    """Drops int(n * share) rows in succession from position int(n * at) on, around the end, over all animals.

    share and at are fractions; the position of a row is its animal's offset
    plus its own, so nothing is sorted globally.
    """
    if not share:
        return stream
    seq = numbered(stream, keys=ANIMAL, order=order)
    sizes = stream.groupBy("animal_id").agg(F.count("*").alias("size"))
    by_animal = Window.orderBy("animal_id").rowsBetween(Window.unboundedPreceding, -1)  # one row an animal
    offsets = sizes.select("animal_id", F.coalesce(F.sum("size").over(by_animal), F.lit(0)).alias("offset"), F.sum("size").over(Window.partitionBy()).alias("total"))
    pos = F.col("seq") + F.col("offset")
    cut = F.floor(F.col("total") * share)
    ahead = F.pmod(pos - F.floor(F.col("total") * at), F.col("total"))
    return seq.join(offsets, "animal_id").where(ahead >= cut).drop("offset", "total")


def day_index(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Whole days since the midnight before an animal's first row."""
    first = stream.groupBy("animal_id").agg(F.to_date(F.min(ts)).alias("first_day"))
    return stream.join(first, "animal_id").withColumn("day", F.datediff(F.to_date(ts), "first_day")).drop("first_day")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

"""Null models for n-grams of labels, and significance against them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import conditional, cumulative_rows, transitions

#: So many chains of one first state and length are drawn together rather than one by one.
ALIKE = 32


def _simulate(cdf: np.ndarray, first: np.ndarray, length: int, n: int, rng: np.random.Generator, counts: np.ndarray) -> None:
    """Adds to counts (chains, states ** n) the n-grams of chains run side by side from their first states."""
    k, chains = len(cdf), len(first)
    state, code, at = first.copy(), first.astype(np.int64), np.arange(chains)
    span = k ** (n - 1)
    for step in range(1, length):
        state = (rng.random(chains)[:, None] >= cdf[state]).sum(axis=1)
        code = (code % span) * k + state
        if step >= n - 1:
            counts[at, code] += 1


def _simulate_alike(cdf: np.ndarray, first: int, length: int, n: int, copies: int, rng: np.random.Generator, counts: np.ndarray) -> None:
    """Like _simulate for ``copies`` chains of a replicate (a row of counts) with one first state, n at least 2.

    Chains with the same last n - 1 labels are alike, so it is enough to draw how many of them go to each state.
    """
    k, replicates = len(cdf), len(counts)
    p = np.maximum(np.diff(cdf, axis=1, prepend=0.0), 0.0)
    held = np.zeros((replicates, k), dtype=np.int64)
    held[:, first] = copies
    for _ in range(1, length):
        width = held.shape[1]
        held = rng.multinomial(held, p[np.arange(width) % k]).reshape(replicates, width * k)
        if width * k == k**n:
            counts += held
            held = held.reshape(replicates, k, -1).sum(axis=1)


def _tasks(stream: DataFrame) -> int:
    """Tasks of little input and much work, which would be coalesced if their number weren't given."""
    spark = stream.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def markov_null(stream: DataFrame, order: list[str], n: int, n_states: int, *, replicates: int, seed: int = 0, segment_rows: int = 20_000) -> DataFrame:
    """n-gram counts (replicate, code, n) of first-order chains with the stream's transitions.

    code writes the n labels as the digits of a number to base n_states.  A
    chain has the length of an animal's sequence; it is drawn in segments (the
    stream's chunks), each from the label the sequence had there, and only the
    counts leave a task.  A state that never was left goes anywhere alike.
    Segments run side by side on the cluster; replicates are vectorised.
    """
    counts = transitions(stream, order, n_states)
    rows = cumulative_rows(conditional(counts)).select("from_state", "to_state", "cdf").collect()  # n_states squared
    cdf = np.zeros((n_states, n_states))
    for r in rows:
        cdf[r["from_state"], r["to_state"]] = r["cdf"]
    for k in range(n_states):
        if cdf[k, -1] <= 0:
            cdf[k] = np.arange(1, n_states + 1) / n_states
        cdf[k, -1] = 1.0
    segments = stream.groupBy("animal_id", "chunk").agg(F.count("*").alias("rows"), F.min(F.struct(*order, "label")).getField("label").alias("first"))
    ahead = F.lead("rows").over(Window.partitionBy("animal_id").orderBy("chunk"))
    segments = segments.withColumn("length", F.col("rows") + F.when(ahead.isNotNull(), n - 1).otherwise(0))
    # Long segments are cut once more; a cut piece starts from the segment's first label.
    piece = F.explode(F.expr(f"transform(sequence(0L, (length - 1) DIV {segment_rows}), i -> least({segment_rows + n - 1}L, length - i * {segment_rows}))"))
    segments = segments.select(F.col("first").cast("int").alias("first"), piece.alias("length")).where(F.col("length") >= n)
    groups = segments.groupBy("first", "length").agg(F.count("*").alias("copies"))
    work = groups.repartition(_tasks(stream), F.xxhash64("first", "length"))

    def run(batches):
        total = np.zeros((replicates, n_states**n), dtype=np.int64)
        for batch in batches:
            for first, length, copies in zip(*(batch.column(c).to_pylist() for c in ("first", "length", "copies")), strict=True):
                rng = np.random.default_rng([seed, first, length])
                if copies >= ALIKE and n > 1:
                    _simulate_alike(cdf, first, length, n, copies, rng, total)
                    continue
                for _ in range(copies):
                    _simulate(cdf, np.full(replicates, first), length, n, rng, total)
        replicate, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(replicate.astype(np.int32)), pa.array(code), pa.array(total[replicate, code])], names=["replicate", "code", "n"])

    return work.select("first", "length", "copies").mapInArrow(run, "replicate int, code bigint, n bigint").groupBy("replicate", "code").agg(F.sum("n").alias("n"))


def marginal_null(stream: DataFrame, n: int, n_states: int, *, replicates: int, seed: int = 0, block: int = 1 << 20) -> DataFrame:
    """n-gram counts (replicate, code, n) of random permutations of all labels.

    A permutation depends on how often each label occurs only, so the labels stay
    where they are.  Replicates run side by side on the cluster; each is drawn
    block by block, the labels of a block without replacement from those left,
    and only the counts leave a task.  n-grams with a NULL label don't count.
    """
    held = np.zeros(n_states + 1, dtype=np.int64)
    for r in stream.groupBy("label").agg(F.count("*").alias("n")).collect():  # a row a label
        held[n_states if r["label"] is None else r["label"]] += r["n"]

    def run(batches):
        for batch in batches:
            for replicate in batch.column("id").to_pylist():
                rng = np.random.default_rng([seed, replicate])
                left, total = held.copy(), np.zeros(n_states**n, dtype=np.int64)
                tail = np.zeros(0, dtype=np.int64)
                while left.any():
                    take = left if left.sum() <= block else rng.multivariate_hypergeometric(left, block, method="marginals")
                    left = left - take
                    part = np.concatenate([tail, rng.permutation(np.repeat(np.arange(n_states + 1), take))])
                    grams = [part[k : len(part) - n + 1 + k] for k in range(n)] if len(part) >= n else []
                    if grams:
                        code = sum(g * n_states ** (n - 1 - k) for k, g in enumerate(grams))
                        total += np.bincount(code[np.max(grams, axis=0) < n_states], minlength=n_states**n)
                    tail = part[len(part) - min(n - 1, len(part)) :]
                code = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), replicate, dtype=np.int32)), pa.array(code), pa.array(total[code])], names=["replicate", "code", "n"])

    return stream.sparkSession.range(replicates).repartition(_tasks(stream), "id").mapInArrow(run, "replicate int, code bigint, n bigint")


def null_distribution(stream: DataFrame, order: list[str], id_col: str, n: int, n_states: int, *, kind: str, replicates: int, seed: int = 0) -> DataFrame:
    """Either null, by name: "first_order" or "marginal"."""
    if kind == "first_order":
        return markov_null(stream, order, n, n_states, replicates=replicates, seed=seed)
    if kind == "marginal":
        return marginal_null(stream, n, n_states, replicates=replicates, seed=seed)
    raise ValueError(f"unknown null {kind!r}")


def with_codes(grams: DataFrame, n: int, n_states: int) -> DataFrame:
    """n-gram counts with their code."""
    code = sum((F.col(f"s{i + 1}") * F.lit(n_states ** (n - 1 - i)) for i in range(n)), F.lit(0))
    return grams.withColumn("code", code.cast("bigint"))


def significance(observed: DataFrame, null: DataFrame, replicates: int, *, percentile: float = 99.9, alpha: float = 0.05) -> DataFrame:
    """Adds null_median, null_q975, null_qp, p, q, and the flags to observed (code, n).

    A replicate without a code counts 0.  p is (1 + replicates of at least the
    observed count) to (1 + replicates); q is Benjamini-Hochberg; super_prototype
    needs the percentile and the q flag.  The codes are at most n_states ** n.
    """
    grid = observed.select("code", F.col("n").alias("observed")).join(null.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")))
    cells = grid.join(null, ["code", "replicate"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    points = F.percentile("n", F.array(F.lit(0.5), F.lit(0.975), F.lit(percentile / 100)))
    got = cells.groupBy("code", "observed").agg(((1 + F.count_if(F.col("n") >= F.col("observed"))) / (1 + replicates)).alias("p"), points.alias("q"))
    got = got.select("code", "observed", F.col("q")[0].alias("null_median"), F.col("q")[1].alias("null_q975"), F.col("q")[2].alias("null_qp"), "p")
    got = benjamini_hochberg(got, "p", "code")
    flag = F.col("observed") > F.col("null_qp")
    return got.withColumn("percentile_flag", flag).withColumn("fdr_flag", F.col("q") < alpha).withColumn("super_prototype", flag & (F.col("q") < alpha))


def benjamini_hochberg(df: DataFrame, p: str, tie: str) -> DataFrame:
    """Adds q.  Sorts the tests in one place: one row a hypothesis."""
    up = Window.orderBy(F.col(p), F.col(tie))
    down = Window.orderBy(F.col(p).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_rank", F.row_number().over(up)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    return df.withColumn("q", F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down)).drop("_rank", "_m")

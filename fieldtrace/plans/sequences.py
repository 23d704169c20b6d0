"""Queries on label streams: runs, transitions, durations, n-grams, leave-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence as S
from .adapters import EXPORTED_SQL, FPS, LABELS_SQL, N_STATES, ORDER, RUNS_SQL, exported_bouts, label_stream, rounded

Query = Callable[[SparkSession, str], DataFrame]
N_LABELS = 8


def _bouts(spark: SparkSession, folder: str) -> DataFrame:
    return S.bouts(label_stream(spark, folder), ORDER)


def _counts(spark: SparkSession, folder: str, **kw) -> DataFrame:
    return S.transitions(label_stream(spark, folder), ORDER, N_STATES, **kw)


def w1_bouts(spark: SparkSession, folder: str) -> DataFrame:
    return _bouts(spark, folder).select("animal_id", "bout", "label", "length", "start_seq")


def w3_short_bouts_merged(spark: SparkSession, folder: str) -> DataFrame:
    merged = S.merge_short_bouts(_bouts(spark, folder), 2)
    return merged.select("animal_id", "bout", "label", "length", "start_seq")


def w6_differences(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.differences(label_stream(spark, folder), ORDER, "value").select("event_id", "diff"))


def w15_day_index(spark: SparkSession, folder: str) -> DataFrame:
    return S.day_index(label_stream(spark, folder)).select("event_id", "day")


def a1_prevalence(spark: SparkSession, folder: str) -> DataFrame:
    m = S.marginals(label_stream(spark, folder), N_STATES)
    return rounded(m.select("label", "n", (100 * F.col("rate")).alias("percent")))


def a2_marginal_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of the exported bouts' labels, over bouts."""
    return rounded(S.marginals(exported_bouts(spark, folder), N_LABELS))


def a3_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder)


def a3_transitions_smoothed(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, smoothing=1.0)


def a3_transitions_single_chain(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, single_chain=True)


def a4_bout_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Transitions between the exported bouts."""
    return S.transitions(exported_bouts(spark, folder), ["start_index", "bout_id"], N_LABELS)


def a5_conditional_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.conditional(_counts(spark, folder)).select("from_state", "to_state", "p"))


def a6_baseline_flags(spark: SparkSession, folder: str) -> DataFrame:
    rates = S.marginals(label_stream(spark, folder), N_STATES)
    return rounded(S.baseline_flags(S.conditional(_counts(spark, folder)), rates, 1.05))


def a7_expected_durations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.expected_durations(S.conditional(_counts(spark, folder)), FPS))


def a8_run_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """How many runs of each label have each length, single rows left out."""
    return _bouts(spark, folder).where("length > 1").groupBy("label", "length").agg(F.count("*").alias("n"))


def a9_mean_durations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.mean_durations(_bouts(spark, folder), N_STATES, FPS))


def a10_duration_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.duration_stats(exported_bouts(spark, folder), ["label"], FPS))


def a11_animal_duration_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.duration_stats(exported_bouts(spark, folder), ["animal_id", "label"], FPS))


def a12_cohort_durations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.cohort_durations(exported_bouts(spark, folder), FPS))


def a13_triplets(spark: SparkSession, folder: str) -> DataFrame:
    return S.ngrams(_bouts(spark, folder), ["bout"], 3)


def a13_pairs_of_exported_bouts(spark: SparkSession, folder: str) -> DataFrame:
    return S.ngrams(exported_bouts(spark, folder), ["start_index", "bout_id"], 2)


def t6_top_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent triplets of bouts."""
    return a13_triplets(spark, folder).orderBy(F.desc("n"), "s1", "s2", "s3").limit(10)


def w22_cumulative_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.cumulative_rows(S.conditional(_counts(spark, folder))).select("from_state", "to_state", "cdf"))


def proj9_leave_out(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of all rows left out, from 90 % on and around the end."""
    return S.leave_out(label_stream(spark, folder), order=ORDER, share=0.25, at=0.9).select("event_id")


def proj18_block_of_bouts(spark: SparkSession, folder: str) -> DataFrame:
    """Bouts 10 to 29 of every animal: a block in succession."""
    return _bouts(spark, folder).where("bout BETWEEN 10 AND 29").select("animal_id", "bout", "label", "length")


_SPLIT = f"WITH {RUNS_SQL}"
_T = f"""WITH {LABELS_SQL}, pr AS (SELECT lag(label) OVER (PARTITION BY animal_id ORDER BY ts, event_id) AS a, label AS b FROM ls),
st AS (SELECT CAST(range AS INTEGER) AS s FROM range({N_STATES})),
tc AS (SELECT x.s AS from_state, y.s AS to_state, count(pr.a) AS n FROM st x CROSS JOIN st y LEFT JOIN pr ON pr.a = x.s AND pr.b = y.s GROUP BY 1, 2),
cp AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY from_state) > 0 THEN n / sum(n) OVER (PARTITION BY from_state) ELSE 0 END AS p FROM tc)"""
_STATS = """count(*) AS n_bouts, round(quantile_cont(length / 50.0, 0.5), 6) AS median_s, round(quantile_cont(length / 50.0, 0.25), 6) AS q25_s,
round(quantile_cont(length / 50.0, 0.75), 6) AS q75_s, round(avg(length / 50.0), 6) AS mean_s, round(max(length / 50.0), 6) AS max_s, round(sum(length / 50.0), 6) AS total_s"""


def oracle_sql() -> dict[str, str]:
    return {
        "w1_bouts": f"{_SPLIT} SELECT animal_id, CAST(bout AS BIGINT) AS bout, label, length, start_seq FROM bouts",
        "w3_short_bouts_merged": f"""{_SPLIT}, nb AS (SELECT *, lag(label) OVER w AS bl, lag(length) OVER w AS bn, lead(label) OVER w AS al, lead(length) OVER w AS an FROM bouts WINDOW w AS (PARTITION BY animal_id ORDER BY bout)),
rl AS (SELECT animal_id, bout, length, start_seq, CASE WHEN length < 2 THEN coalesce(CASE WHEN coalesce(bn, -1) >= coalesce(an, -1) THEN coalesce(bl, al) ELSE coalesce(al, bl) END, label) ELSE label END AS label FROM nb),
mk AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY animal_id ORDER BY bout) THEN 0 ELSE 1 END AS new FROM rl),
gr AS (SELECT *, sum(new) OVER (PARTITION BY animal_id ORDER BY bout) AS g FROM mk)
SELECT animal_id, CAST(g AS BIGINT) AS bout, min(label) AS label, CAST(sum(length) AS BIGINT) AS length, min(start_seq) AS start_seq FROM gr GROUP BY animal_id, g""",
        "w6_differences": f"WITH {LABELS_SQL}, d AS (SELECT event_id, value - lag(value) OVER (PARTITION BY animal_id ORDER BY ts, event_id) AS diff FROM ls) SELECT event_id, round(diff, 6) AS diff FROM d WHERE diff IS NOT NULL",
        "w15_day_index": f"WITH {LABELS_SQL} SELECT event_id, CAST(date_diff('day', CAST(min(ts) OVER (PARTITION BY animal_id) AS DATE), CAST(ts AS DATE)) AS INTEGER) AS day FROM ls",
        "a1_prevalence": f"WITH {LABELS_SQL} SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM ls GROUP BY label",
        "a2_marginal_rates": f"WITH {EXPORTED_SQL} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM eb GROUP BY label",
        "a3_transitions": f"{_T} SELECT from_state, to_state, n FROM tc",
        "a3_transitions_smoothed": f"{_T} SELECT from_state, to_state, CAST(n + 1 AS DOUBLE) AS n FROM tc",
        "a3_transitions_single_chain": f"""WITH {LABELS_SQL}, pr AS (SELECT lag(label) OVER (ORDER BY animal_id, ts, event_id) AS a, label AS b FROM ls),
st AS (SELECT CAST(range AS INTEGER) AS s FROM range({N_STATES}))
SELECT x.s AS from_state, y.s AS to_state, count(pr.a) AS n FROM st x CROSS JOIN st y LEFT JOIN pr ON pr.a = x.s AND pr.b = y.s GROUP BY 1, 2""",
        "a4_bout_transitions": f"""WITH {EXPORTED_SQL}, pr AS (SELECT lag(label) OVER (PARTITION BY animal_id ORDER BY start_index, bout_id) AS a, label AS b FROM eb),
st AS (SELECT CAST(range AS INTEGER) AS s FROM range({N_LABELS}))
SELECT x.s AS from_state, y.s AS to_state, count(pr.a) AS n FROM st x CROSS JOIN st y LEFT JOIN pr ON pr.a = x.s AND pr.b = y.s GROUP BY 1, 2""",
        "a5_conditional_transitions": f"{_T} SELECT from_state, to_state, round(p, 6) AS p FROM cp",
        "a6_baseline_flags": f"""{_T}, m AS (SELECT label, count(*) / sum(count(*)) OVER () AS rate FROM ls GROUP BY label)
SELECT from_state, to_state, round(p, 6) AS p, CASE WHEN p > 1.05 * rate THEN 1 WHEN p < 1.05 * rate AND p > 0 THEN -1 ELSE 0 END AS flag FROM cp JOIN m ON m.label = to_state""",
        "a7_expected_durations": f"{_T} SELECT from_state AS label, round(CASE WHEN p < 1 THEN 1 / (1 - p) / 50.0 END, 6) AS expected_s FROM cp WHERE from_state = to_state",
        "a8_run_lengths": f"{_SPLIT} SELECT label, length, count(*) AS n FROM bouts WHERE length > 1 GROUP BY 1, 2",
        "a9_mean_durations": f"{_SPLIT} SELECT label, round(avg(length) / 50.0, 6) AS mean_s, round(coalesce(stddev_samp(length), 0) / sqrt(count(*)) / 50.0, 6) AS sem_s FROM bouts GROUP BY label",
        "a10_duration_stats": f"WITH {EXPORTED_SQL} SELECT label, {_STATS} FROM eb GROUP BY label",
        "a11_animal_duration_stats": f"WITH {EXPORTED_SQL} SELECT animal_id, label, {_STATS} FROM eb GROUP BY animal_id, label",
        "a12_cohort_durations": f"""WITH {EXPORTED_SQL}, o AS (SELECT animal_id, label, count(*) AS n, avg(length / 50.0) AS m, quantile_cont(length / 50.0, 0.5) AS md FROM eb GROUP BY 1, 2)
SELECT label, count(*) AS n_animals, CAST(sum(n) AS BIGINT) AS n_bouts, round(avg(m), 6) AS mean_s, round(stddev_samp(m) / sqrt(count(*)), 6) AS sem_s, round(quantile_cont(md, 0.5), 6) AS median_s,
round(quantile_cont(md, 0.25), 6) AS q25_s, round(quantile_cont(md, 0.75), 6) AS q75_s FROM o GROUP BY label""",
        "a13_triplets": f"{_SPLIT}, t AS (SELECT lag(label, 2) OVER w AS s1, lag(label) OVER w AS s2, label AS s3 FROM bouts WINDOW w AS (PARTITION BY animal_id ORDER BY bout)) SELECT s1, s2, s3, count(*) AS n FROM t WHERE s1 IS NOT NULL GROUP BY 1, 2, 3",
        "a13_pairs_of_exported_bouts": f"WITH {EXPORTED_SQL}, t AS (SELECT lag(label) OVER (PARTITION BY animal_id ORDER BY start_index, bout_id) AS s1, label AS s2 FROM eb) SELECT s1, s2, count(*) AS n FROM t WHERE s1 IS NOT NULL GROUP BY 1, 2",
        "t6_top_triplets": f"{_SPLIT}, t AS (SELECT lag(label, 2) OVER w AS s1, lag(label) OVER w AS s2, label AS s3 FROM bouts WINDOW w AS (PARTITION BY animal_id ORDER BY bout)) SELECT s1, s2, s3, count(*) AS n FROM t WHERE s1 IS NOT NULL GROUP BY 1, 2, 3 ORDER BY n DESC, s1, s2, s3 LIMIT 10",
        "w22_cumulative_transitions": f"{_T} SELECT from_state, to_state, round(sum(p) OVER (PARTITION BY from_state ORDER BY to_state), 6) AS cdf FROM cp",
        "proj9_leave_out": f"""WITH {LABELS_SQL}, n AS (SELECT event_id, row_number() OVER (ORDER BY animal_id, ts, event_id) - 1 AS pos, count(*) OVER () AS total FROM ls)
SELECT event_id FROM n WHERE ((pos - CAST(floor(total * 0.9) AS BIGINT)) % total + total) % total >= floor(total * 0.25)""",
        "proj18_block_of_bouts": f"{_SPLIT} SELECT animal_id, CAST(bout AS BIGINT) AS bout, label, length FROM bouts WHERE bout BETWEEN 10 AND 29",
    }


def queries() -> dict[str, Query]:
    return {k: globals()[k] for k in oracle_sql()}

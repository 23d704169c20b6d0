"""Queries on clustering, null models, observers' text and joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import linking as J
from ..operators import nulls as N
from ..operators import sequence as S
from ..operators import validate as V
from ..session import table
from .adapters import EXPORTED_SQL, N_STATES, ORDER, RUNS_SQL, exported_bouts, label_stream, rounded
from .cleaning import wall_us
from .signals import filed_readings, fixes, readings

Query = Callable[[SparkSession, str], DataFrame]
AXES = ["X_head", "Y_head", "Z_head", "X_ear", "Y_ear", "Z_ear"]
DIMS = [f"x{i}" for i in range(64)]

#: The sweep: numbers of clusters, seeds, and what is left out (share, from where). The reference goes up to 50 clusters, 200 seeds
#: and 50 % at ten positions, which are the same parameters.
KS, SEEDS, CUTS = list(range(2, 13)), [1, 2], [(0.0, 0.0), (0.25, 0.0), (0.25, 0.5)]
#: Posture centres on the six axes: head up or down against ear forward, back or moving.
CENTRES = [[h * 0.5, 0.1 * e, 0.6 - abs(h) * 0.4, e * 0.45, -0.1 * h, 0.5 * h * e + 0.1] for h in (-1, 1) for e in (-1, 0, 1, 2)]

#: Of the null models. The smallest p is 1 / 2001, so a triplet that stands alone among the 80 that can occur still passes
#: the correction (q 0.04); with the reference's 1,000 it can't (q 0.08).
REPLICATES = 2000


def points(spark: SparkSession, folder: str) -> DataFrame:
    """All dimensions of embeddings."""
    df = table(spark, folder, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return df.select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMS)])


def j12_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return K.nearest(filed_readings(spark, folder), AXES, CENTRES).where("cluster IS NOT NULL").select("data_id", "cluster").distinct()


def a19_inertia(spark: SparkSession, folder: str) -> DataFrame:
    df = K.nearest(filed_readings(spark, folder).where(" AND ".join(f"abs({c}) <= 16" for c in AXES)), AXES, CENTRES)
    return rounded(K.inertia(df.select("data_id", "d2").distinct()), 3)


def a1_cluster_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How the readings of each animal spread over the nearest centres."""
    df = K.nearest(filed_readings(spark, folder), AXES, CENTRES).where("cluster IS NOT NULL").select("deer_id", "data_id", "cluster").distinct()
    return df.groupBy("deer_id", "cluster").agg(F.count("*").alias("n"))


def f13_q_format(spark: SparkSession, folder: str) -> DataFrame:
    df = readings(spark, folder).where("X_head IS NOT NULL").withColumn("q", K.encode_q(F.col("X_head")))
    return rounded(df.select("data_id", "q", K.decode_q(F.col("q")).alias("decoded")))


def m16_fixed_point_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return K.nearest_q(filed_readings(spark, folder).dropna(subset=AXES), AXES, CENTRES).select("data_id", "cluster_q").distinct()


def m15_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return K.round_trip(readings(spark, folder).where(" AND ".join(f"abs({c}) <= 7.99" for c in AXES)), AXES, CENTRES)


def a21_calinski_harabasz(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(K.calinski_harabasz(points(spark, folder), DIMS, "label"), 4)


def _silhouettes(spark: SparkSession, folder: str) -> DataFrame:
    sample = K.stratified(points(spark, folder), label="label", id_col="id", per_label=5000, repeats=1)
    return K.silhouettes(sample, DIMS, label="label", id_col="id")


def m5_silhouettes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_silhouettes(spark, folder).select("id", "silhouette"), 5)


def a22_silhouette_summary(spark: SparkSession, folder: str) -> DataFrame:
    q = F.percentile("silhouette", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = _silhouettes(spark, folder).groupBy("label").agg(F.count("*").alias("n"), q.alias("q"))
    return rounded(got.select("label", "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75")), 5)


def a22_over_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Medians and quartiles over 50 samples of up to 30 points a label: of each label's mean silhouette."""
    sample = K.stratified(points(spark, folder), label="label", id_col="id", per_label=30, repeats=50)
    one = K.silhouettes(sample, DIMS, label="label", id_col="id", blocks=2).groupBy("repeat", "label").agg(F.avg("silhouette").alias("silhouette"))
    return K.per_k(one, ["silhouette"], by=["label"])


@lru_cache(maxsize=4)
def _fits(spark: SparkSession, folder: str) -> DataFrame:
    """The fits of the sweep, made once a session for all queries on them: one row a fit."""
    return K.sweep(points(spark, folder), DIMS, KS, SEEDS, cuts=CUTS)


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    return _fits(spark, folder).where("share = 0")


def m3_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return _fits(spark, folder).select(*K.FIT, "seed", "inertia", "ch")


def m4_instabilities(spark: SparkSession, folder: str) -> DataFrame:
    return K.instabilities(_fits(spark, folder))


def m12_inertia_of_fits(spark: SparkSession, folder: str) -> DataFrame:
    return K.inertia_of_fits(points(spark, folder), DIMS, _fits(spark, folder))


def a23_per_k(spark: SparkSession, folder: str) -> DataFrame:
    """Medians and quartiles of each number of clusters and share left out."""
    return K.per_k(_fits(spark, folder), ["ch", "inertia"], by=["k", "share"])


def m6_kneedle(spark: SparkSession, folder: str) -> DataFrame:
    return K.kneedle(K.per_k(_whole(spark, folder), ["inertia"]))


def m13_selection_summary(spark: SparkSession, folder: str) -> DataFrame:
    fits = _whole(spark, folder)
    bands = K.per_k(fits, ["ch", "inertia"])
    moved = K.per_k(K.instabilities(fits), ["drift"])
    shape = K.per_k(K.silhouettes_of_fits(points(spark, folder), DIMS, K.best_of(fits)), ["silhouette"])
    return K.selection_summary(bands, {"ch": bands, "drift": moved, "silhouette": shape, "inertia": bands})


def t2_best_fits(spark: SparkSession, folder: str) -> DataFrame:
    return J.highest(_fits(spark, folder).select(*K.FIT, "ch"), ["k", "share"], "ch", ["position", "fit_id"])


def t3_most_stable_fits(spark: SparkSession, folder: str) -> DataFrame:
    """The fit of each k and share with the smallest sum of matched distances, the first on a tie."""
    return J.highest(K.instabilities(_fits(spark, folder)).withColumn("stable", -F.col("medoid_sum")), ["k", "share"], "stable", ["position", "fit_id"]).drop("stable")


def j9_fits_with_inertia(spark: SparkSession, folder: str) -> DataFrame:
    """Fits beside their inertia computed anew over all points; the two agree."""
    fits = _whole(spark, folder)
    again = K.inertia_of_fits(points(spark, folder), DIMS, fits).withColumnRenamed("inertia", "inertia_again")
    return fits.select(*K.FIT, "inertia").join(again, K.FIT, "left")


def s14_uniform_points(spark: SparkSession, folder: str) -> DataFrame:
    """Means and extent of the uniform surrogate of the points, dimension by dimension."""
    noise = K.surrogate(points(spark, folder), len(DIMS))
    cols = DIMS
    return noise.unpivot("id", cols, "dim", "value").groupBy("dim").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def s15_box_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of the fixed-point and the exact classifier on vectors drawn in the centres' box, one for each reading."""
    noise = K.box_points(readings(spark, folder), CENTRES, id_col="data_id")
    return K.round_trip(noise, [f"x{j}" for j in range(6)], CENTRES)


def m14_stability_null(spark: SparkSession, folder: str) -> DataFrame:
    return K.stability_null(points(spark, folder), len(DIMS), KS[::4], SEEDS, surrogates=[0, 1])


def proj22_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Mean embedding of each label, normalised dimension by dimension."""
    means = points(spark, folder).groupBy(F.col("label").alias("cluster_id")).agg(*[F.avg(d).alias(d) for d in DIMS]).unpivot("cluster_id", DIMS, "dim", "value")
    from ..operators.features import normalise_centroids

    return rounded(normalise_centroids(means))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return S.bouts(label_stream(spark, folder), ORDER)


def _null(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    runs = _runs(spark, folder).withColumn("id", F.xxhash64("animal_id", "bout"))
    return N.null_distribution(runs, ["bout"], "id", 3, N_STATES, kind=kind, replicates=REPLICATES)


def m7_first_order_null(spark: SparkSession, folder: str) -> DataFrame:
    return _null(spark, folder, "first_order")


def m7b_marginal_null(spark: SparkSession, folder: str) -> DataFrame:
    return _null(spark, folder, "marginal")


def m10_super_prototypes(spark: SparkSession, folder: str) -> DataFrame:
    seen = N.with_codes(S.ngrams(_runs(spark, folder), ["bout"], 3), 3, N_STATES)
    return N.significance(seen, _null(spark, folder, "first_order"), REPLICATES, percentile=97.5)


def w20_benjamini_hochberg(spark: SparkSession, folder: str) -> DataFrame:
    """q of triplets whose p is taken as 1 / (1 + their number)."""
    seen = N.with_codes(S.ngrams(_runs(spark, folder), ["bout"], 3), 3, N_STATES).withColumn("p", 1 / (1 + F.col("n")))
    return rounded(N.benjamini_hochberg(seen, "p", "code").select("code", "p", "q"), 8)


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return V.register(table(spark, folder, "behaviour_register"), id_col="register_id", text_col="Behaviour", cluster_col="Cluster Label")


def f1_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder).select(F.col("id").alias("register_id"), F.explode("tokens").alias("token"))


def f17_agreement_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder).select(F.col("id").alias("register_id"), "agrees")


def a27_token_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(V.token_confusion(_windows(spark, folder)))


def f16_attributions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(V.attributions(_windows(spark, folder)).select(F.col("id").alias("register_id"), "k", "video_k", "weight"))


def a28_cluster_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(V.cluster_confusion(_windows(spark, folder)))


def a29_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(V.agreement(_windows(spark, folder)))


def a30_overall_agreement(spark: SparkSession, folder: str) -> DataFrame:
    w = _windows(spark, folder).where("NOT not_in_view")
    return rounded(w.agg(F.count("*").alias("n"), F.avg(F.col("agrees").cast("int")).alias("agreement")))


def a36_inactive_share(spark: SparkSession, folder: str) -> DataFrame:
    """Per animal the share of its exported samples in inactive states, highest first."""
    kinds = F.broadcast(V.clusters(spark).select(F.col("k").alias("label"), "category"))
    df = exported_bouts(spark, folder).join(kinds, "label").groupBy("animal_id")
    return rounded(df.agg((F.sum(F.when(F.col("category") == "inactive", F.col("length")).otherwise(0)) / F.sum("length")).alias("inactive")).orderBy(F.desc("inactive"), "animal_id"))


def t9_family_order(spark: SparkSession, folder: str) -> DataFrame:
    """Bouts per state with its name, in the order of families."""
    n = exported_bouts(spark, folder).groupBy("label").agg(F.count("*").alias("n"))
    kinds = F.broadcast(V.clusters(spark).select(F.col("k").alias("label"), "name", "category"))
    rank = F.array_position(F.array(F.lit("inactive"), F.lit("grazing"), F.lit("ear_flick")), F.col("category"))
    return n.join(kinds, "label").orderBy(rank, "label").select("label", "name", "category", "n")


def j1_inner(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    got = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return rounded(got, 2)


def j2_left(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of every customer, those without any included."""
    customers, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    got = customers.join(orders, customers.c_custkey == orders.o_custkey, "left").groupBy("c_custkey")
    return got.agg(F.count("o_orderkey").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def j3_animal(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of the animals D1, per animal."""
    info = table(spark, folder, "deer_info").where("deer_number = 'D1'")
    return readings(spark, folder).join(info, "deer_id").groupBy("deer_id", "repetition_number", "deer_number").agg(F.count("*").alias("n"))


def j4_speed_by_state(spark: SparkSession, folder: str) -> DataFrame:
    """Speed by the label of the bout with the number of the fix."""
    labels = exported_bouts(spark, folder).select(F.col("bout_id").alias("data_id"), "label")
    got = fixes(spark, folder).where("abs_speed_mPs BETWEEN 0 AND 25").join(labels, "data_id").groupBy("label")
    return rounded(got.agg(F.count("*").alias("n"), F.avg("abs_speed_mPs").alias("mean_speed")))


def _animals(spark: SparkSession, folder: str) -> DataFrame:
    """deer_info, a small fixed table, with the numbers by which clips name an animal; to be broadcast."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).cast("int")
    info = table(spark, folder, "deer_info")
    return F.broadcast(info.select("deer_id", number("repetition_number").alias("repetition"), number("deer_number").alias("deer")))


def j5_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of readings. Clips and recordings of these tables are of other days, so each animal's clips are moved to begin with its recordings."""
    clips = table(spark, folder, "video_observation_reference").join(_animals(spark, folder), ["repetition", "deer"]).select(F.col("id").alias("clip_id"), F.col("deer_id").alias("animal"), wall_us("start_time").alias("start_us"), wall_us("stop_time").alias("stop_us")).distinct()
    timed = readings(spark, folder).select("data_id", F.col("deer_id").alias("animal"), "us")
    begin = timed.groupBy("animal").agg(F.min("us").alias("first_us")).join(clips.groupBy("animal").agg(F.min("start_us").alias("first_clip")), "animal")
    by = F.col("first_us") - F.col("first_clip")
    clips = clips.join(begin, "animal").select("clip_id", "animal", (F.col("start_us") + by).alias("start_us"), (F.col("stop_us") + by).alias("stop_us"))
    return J.frames_of_readings(timed, clips)


def j6_positional(spark: SparkSession, folder: str) -> DataFrame:
    """Fix and bout with the same place in an animal's order."""
    bouts = exported_bouts(spark, folder).withColumnRenamed("animal_id", "deer_id").select("deer_id", "start_index", "bout_id", "label", "chunk")
    got = J.join_by_position(fixes(spark, folder).select("deer_id", "data_id", "chunk"), bouts, left_order=["data_id"], right_order=["start_index", "bout_id"], keys=["deer_id"])
    return got.select("deer_id", "seq", "data_id", "label")


def j7_features(spark: SparkSession, folder: str) -> DataFrame:
    """Readings and fixes side by side by place, complete rows only."""
    left = readings(spark, folder).select("deer_id", "us", F.col("data_id").alias("reading_id"), "X_head", "chunk")
    right = fixes(spark, folder).select("deer_id", "data_id", "abs_speed_mPs", "chunk")
    got = J.join_by_position(left, right, left_order=["us", "reading_id"], right_order=["data_id"], keys=["deer_id"]).dropna()
    return got.select("reading_id", "data_id", F.col("X_head").alias("x_head"), F.col("abs_speed_mPs").alias("speed"))


def j10_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Readings and clips per animal, either missing."""
    a = readings(spark, folder).groupBy("deer_id").agg(F.count("*").alias("readings"))
    clips = table(spark, folder, "video_observation_reference").join(_animals(spark, folder), ["repetition", "deer"])
    b = clips.groupBy("deer_id").agg(F.countDistinct("id").alias("clips"))
    return a.join(b, "deer_id", "full")


def semi_animals_filmed(spark: SparkSession, folder: str) -> DataFrame:
    """Register entries whose clip is on file."""
    clips = table(spark, folder, "video_observation_reference").select(F.col("id").alias("video_id"))
    return table(spark, folder, "behaviour_register").select("register_id", "video_id").distinct().join(clips, "video_id", "left_semi")


def anti_animals_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes whose number has no reading."""
    seen = readings(spark, folder).select("data_id")
    return fixes(spark, folder).select("data_id", "deer_id").join(seen, "data_id", "left_anti")


def u3_override(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per animal: of its fixes, replaced by those of its readings with the head forward where these are more than a hundred."""
    base = fixes(spark, folder).groupBy("deer_id").agg(F.count("*").alias("n")).withColumn("source", F.lit("fixes"))
    newer = readings(spark, folder).where("X_head > 0").groupBy("deer_id").agg(F.count("*").alias("n")).where("n > 100").withColumn("source", F.lit("readings"))
    return J.override(base, newer, ["deer_id"])


def a32_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "bout_stream").groupBy("labels").agg(F.count("*").alias("n"))


def a34_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "video_observation_reference").select("repetition", "deer").distinct()


def f3_animal_names(spark: SparkSession, folder: str) -> DataFrame:
    """Animals named by clip files and by the clips' columns, with how often they agree."""
    clips = table(spark, folder, "video_observation_reference").dropDuplicates(["id"])
    named = clips.select(J.animal_of_name(F.col("original_file_path")).alias("name"), F.concat(F.lit("R"), "repetition", F.lit("D"), "deer").alias("columns"))
    return named.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("name") == F.col("columns")).alias("n_same"))


def rollup_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Samples by animal and family with subtotals."""
    kinds = F.broadcast(V.clusters(spark).select(F.col("k").alias("label"), "category"))
    got = exported_bouts(spark, folder).join(kinds, "label").rollup("animal_id", "category").agg(F.sum("length").alias("samples"))
    return got


_R = (
    "rd AS (SELECT DISTINCT data_id, deer_id, epoch_us(\"NZ_DateTime\") AS us, "
    + ", ".join(f'CASE WHEN NOT isnan("{c}") THEN "{c}" END AS {c.lower()}' for c in AXES)
    + ' FROM accelerometer_data WHERE deer_id IS NOT NULL AND "NZ_DateTime" IS NOT NULL)'
)
_FX = 'fx AS (SELECT DISTINCT data_id, deer_id, CASE WHEN NOT isnan("abs_speed_mPs") THEN "abs_speed_mPs" END AS sp FROM trajectory_data WHERE deer_id IS NOT NULL AND data_id IS NOT NULL)'
_WHOLE = " AND ".join(f"{c.lower()} IS NOT NULL" for c in AXES)
_D2 = lambda c: " + ".join(f"({a.lower()} - ({v!r})) * ({a.lower()} - ({v!r}))" for a, v in zip(AXES, c, strict=True))
_BEST = "list_sort([" + ", ".join(f"struct_pack(d2 := {_D2(c)}, k := {i})" for i, c in enumerate(CENTRES)) + "])[1]"
_NEAR = f"{_R}, ne AS (SELECT data_id, deer_id, {_BEST} AS b FROM rd WHERE {_WHOLE})"
_Q = lambda a: f"greatest(least(CAST(round_even(({a}) * 4096, 0) AS DOUBLE), 32767), -32768)::BIGINT"
_DQ = lambda c: " + ".join(f"({_Q(a.lower())} - ({int(max(-32768, min(32767, round(v * 4096))))})) ** 2" for a, v in zip(AXES, c, strict=True))
_BEST_Q = "list_sort([" + ", ".join(f"struct_pack(d := {_DQ(c)}, k := {i})" for i, c in enumerate(CENTRES)) + "])[1]"
_PT = "pt AS (SELECT vec_id AS id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {d}" for i, d in enumerate(DIMS)) + " FROM embeddings)"
_SIL = f"""{_PT}, dd AS (SELECT a.id, a.label AS la, b.label AS lb, sum(sqrt({" + ".join(f"(a.{d} - b.{d}) ** 2" for d in DIMS)})) AS s, count(*) AS n FROM pt a CROSS JOIN pt b GROUP BY 1, 2, 3),
ab AS (SELECT id, la, max(CASE WHEN la = lb AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM dd GROUP BY 1, 2),
si AS (SELECT id, la AS label, coalesce((b - a) / greatest(a, b), 0) AS s FROM ab)"""
_TOK = (
    'wd AS (SELECT DISTINCT register_id, "Cluster Label" AS k, lower(coalesce("Behaviour", \'\')) AS t FROM behaviour_register WHERE "Cluster Label" IS NOT NULL), tk AS (SELECT register_id, k, list_filter(['
    + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{t}' END" for t, p in V.TOKENS.items())
    + "], lambda x: x IS NOT NULL) AS tokens FROM wd), ex(k, expected) AS (VALUES "
    + ", ".join(f"({k}, [{', '.join(repr(x) for x in t)}])" for k, t in V.EXPECTED.items())
    + "), wi AS (SELECT register_id, tk.k, tokens, list_contains(tokens, 'not_in_view') AS niv, coalesce(list_has_any(tokens, expected), false) AS agrees FROM tk LEFT JOIN ex ON ex.k = tk.k)"
)
_ATT = f"""{_TOK}, ob AS (SELECT *, list_filter(tokens, lambda x: x <> 'not_in_view') AS o FROM wi WHERE NOT niv AND len(tokens) > 0),
sc AS (SELECT register_id, ob.k, ex.k AS vk, len(list_intersect(o, expected)) / len(list_distinct(list_concat(o, expected))) AS s FROM ob JOIN ex ON ex.k <> ob.k WHERE NOT agrees),
tp AS (SELECT *, max(s) OVER (PARTITION BY register_id) AS m FROM sc WHERE s > 0),
att AS (SELECT register_id, k, k AS video_k, 1.0::DOUBLE AS weight FROM ob WHERE agrees UNION ALL SELECT register_id, k, vk, 1 / count(*) OVER (PARTITION BY register_id) FROM tp WHERE s = m)"""
_CAT = "ct(label, name, category) AS (VALUES " + ", ".join(f"({k}, '{n}', '{c}')" for k, (n, c) in V.NAMES.items()) + ")"


def oracle_sql() -> dict[str, str]:
    inside = " AND ".join(f"abs({c.lower()}) <= 16" for c in AXES)
    terms = "+".join(f"n * m_{d} * m_{d}" for d in DIMS)
    return {
        "j12_nearest": f"WITH {_NEAR} SELECT data_id, b.k AS cluster FROM ne",
        "a19_inertia": f"WITH {_R} SELECT round(sum({_BEST}.d2), 3) AS inertia, count(*) AS n FROM rd WHERE {inside}",
        "a1_cluster_shares": f"WITH {_NEAR} SELECT deer_id, b.k AS cluster, count(*) AS n FROM ne GROUP BY 1, 2",
        "f13_q_format": f"WITH {_R} SELECT data_id, CAST({_Q('x_head')} AS INTEGER) AS q, round({_Q('x_head')} / 4096.0, 6) AS decoded FROM rd WHERE x_head IS NOT NULL",
        "m16_fixed_point_clusters": f"WITH {_R} SELECT data_id, {_BEST_Q}.k AS cluster_q FROM rd WHERE {_WHOLE}",
        "m15_round_trip": f"""WITH {_R}, e AS (SELECT {_BEST}.k AS a, {_BEST_Q}.k AS b FROM rd WHERE {" AND ".join(f"abs({c.lower()}) <= 7.99" for c in AXES)}),
v(v) AS (VALUES {", ".join(f"({x!r})" for c in CENTRES for x in c)}) SELECT avg(CAST(a <> b AS DOUBLE)) AS mismatch, (SELECT max(abs(v - round_even(v * 4096, 0) / 4096)) FROM (SELECT CAST(v AS DOUBLE) AS v FROM v)) AS largest_error, count(*) AS n FROM e""",
        "a21_calinski_harabasz": f"""WITH {_PT}, pc AS (SELECT label, count(*) AS n, {", ".join(f"avg({d}) AS m_{d}, var_pop({d}) AS v_{d}" for d in DIMS)} FROM pt GROUP BY label),
t AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n_all, sum({"+".join(f"n * v_{d}" for d in DIMS)}) AS w, sum({terms}) AS ss, {", ".join(f"sum(n * m_{d}) AS s_{d}" for d in DIMS)} FROM pc)
SELECT k, n_all AS n, round(((ss - ({"+".join(f"s_{d} * s_{d} / n_all" for d in DIMS)})) / (k - 1)) / (w / (n_all - k)), 4) AS ch FROM t""",
        "m5_silhouettes": f"WITH {_SIL} SELECT id, round(s, 5) AS silhouette FROM si",
        "a22_silhouette_summary": f"WITH {_SIL} SELECT label, count(*) AS n, round(quantile_cont(s, 0.25), 5) AS q25, round(quantile_cont(s, 0.5), 5) AS median, round(quantile_cont(s, 0.75), 5) AS q75 FROM si GROUP BY label",
        "proj22_normalised": f"""WITH {_PT}, mn AS (SELECT label AS cluster_id, {", ".join(f"avg({d}) AS {d}" for d in DIMS)} FROM pt GROUP BY 1), ta AS (UNPIVOT mn ON {", ".join(DIMS)} INTO NAME dim VALUE value)
SELECT cluster_id, dim, round(value / max(abs(value)) OVER (PARTITION BY dim), 6) AS value FROM ta""",
        "w20_benjamini_hochberg": f"""WITH {RUNS_SQL}, t AS (SELECT lag(label, 2) OVER w AS s1, lag(label) OVER w AS s2, label AS s3 FROM bouts WINDOW w AS (PARTITION BY animal_id ORDER BY bout)),
c AS (SELECT CAST(s1 * 25 + s2 * 5 + s3 AS BIGINT) AS code, 1.0 / (1 + count(*)) AS p FROM t WHERE s1 IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, code) AS rk, count(*) OVER () AS m FROM c)
SELECT code, round(p, 8) AS p, round(min(p * m / rk) OVER (ORDER BY p DESC, code DESC ROWS UNBOUNDED PRECEDING), 8) AS q FROM r""",
        "f1_tokens": f"WITH {_TOK} SELECT register_id, unnest(tokens) AS token FROM wi",
        "f17_agreement_flags": f"WITH {_TOK} SELECT register_id, agrees FROM wi",
        "a27_token_confusion": f"WITH {_TOK}, nm(token) AS (VALUES {', '.join(f'({t!r})' for t in V.TOKENS)}), n AS (SELECT k, count(*) AS n FROM wi GROUP BY k) SELECT n.k, token, round((SELECT count(*) FROM wi WHERE wi.k = n.k AND list_contains(tokens, token)) / n, 6) AS share FROM n CROSS JOIN nm",
        "f16_attributions": f"WITH {_ATT} SELECT register_id, k, video_k, round(weight, 6) AS weight FROM att",
        "a28_cluster_confusion": f"""WITH {_ATT}, g AS (SELECT a.k, b.k AS video_k, coalesce((SELECT sum(weight) FROM att WHERE att.k = a.k AND att.video_k = b.k), 0) AS weight FROM ex a CROSS JOIN ex b)
SELECT k, video_k, round(weight, 6) AS weight, round(CASE WHEN sum(weight) OVER (PARTITION BY k) > 0 THEN weight / sum(weight) OVER (PARTITION BY k) ELSE 0 END, 6) AS share FROM g""",
        "a29_agreement": f"""WITH {_TOK}, c AS (SELECT k, count(*) AS n_total, count(*) FILTER (NOT niv) AS n, count(*) FILTER (NOT niv AND agrees) AS s FROM wi GROUP BY k),
w AS (SELECT *, s / n AS p, {V.Z95} AS z FROM c),
x AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS centre, z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n) AS half FROM w)
SELECT k, n_total, n AS n_evaluable, s AS n_agree, round(coalesce(p, 0), 6) AS agreement, round(CASE WHEN n > 0 THEN greatest(0, centre - half) ELSE 0 END, 6) AS ci_lo, round(CASE WHEN n > 0 THEN least(1, centre + half) ELSE 0 END, 6) AS ci_hi FROM x""",
        "a30_overall_agreement": f"WITH {_TOK} SELECT count(*) AS n, round(avg(agrees::INT), 6) AS agreement FROM wi WHERE NOT niv",
        "a36_inactive_share": f"WITH {EXPORTED_SQL}, {_CAT} SELECT animal_id, round(sum(CASE WHEN category = 'inactive' THEN length ELSE 0 END) / sum(length), 6) AS inactive FROM eb JOIN ct USING (label) GROUP BY 1",
        "t9_family_order": f"WITH {EXPORTED_SQL}, {_CAT} SELECT label, name, category, count(*) AS n FROM eb JOIN ct USING (label) GROUP BY ALL",
        "j1_inner": "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
        "j2_left": "SELECT c_custkey, count(o_orderkey) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
        "j3_animal": f"WITH {_R} SELECT deer_id, repetition_number, deer_number, count(*) AS n FROM rd JOIN deer_info USING (deer_id) WHERE deer_number = 'D1' GROUP BY ALL",
        "j4_speed_by_state": f"WITH {_FX}, {EXPORTED_SQL} SELECT label, count(*) AS n, round(avg(sp), 6) AS mean_speed FROM fx JOIN eb ON bout_id = data_id WHERE sp BETWEEN 0 AND 25 GROUP BY 1",
        "j5_frames": f"""WITH {_R}, c0 AS (SELECT DISTINCT id, deer_id, epoch_us(start_time) AS a, epoch_us(stop_time) AS b FROM video_observation_reference v JOIN deer_info d ON d.repetition_number = 'R' || v.repetition AND d.deer_number = 'D' || v.deer),
sh AS (SELECT deer_id, (SELECT min(us) FROM rd WHERE rd.deer_id = c0.deer_id) - min(a) AS moved FROM c0 GROUP BY deer_id),
cl AS (SELECT id, deer_id, a + moved AS a, b + moved AS b FROM c0 JOIN sh USING (deer_id) WHERE a <= b),
m AS (SELECT data_id, min(struct_pack(id := id, a := a, us := us)) AS m FROM rd JOIN cl ON cl.deer_id = rd.deer_id AND us BETWEEN a AND b GROUP BY data_id)
SELECT data_id, m.id AS clip_id, CAST(floor((m.us - m.a) / 1e6 * 30) AS BIGINT) AS frame FROM m""",
        "j6_positional": f"""WITH {_FX}, {EXPORTED_SQL}, a AS (SELECT deer_id, data_id, row_number() OVER (PARTITION BY deer_id ORDER BY data_id) - 1 AS seq FROM fx),
b AS (SELECT animal_id AS deer_id, label, row_number() OVER (PARTITION BY animal_id ORDER BY start_index, bout_id) - 1 AS seq FROM eb) SELECT deer_id, seq, data_id, label FROM a JOIN b USING (deer_id, seq)""",
        "j7_features": f"""WITH {_R}, {_FX}, a AS (SELECT deer_id, data_id AS reading_id, x_head, row_number() OVER (PARTITION BY deer_id ORDER BY us, data_id) AS seq FROM rd),
b AS (SELECT deer_id, data_id, sp AS speed, row_number() OVER (PARTITION BY deer_id ORDER BY data_id) AS seq FROM fx)
SELECT reading_id, data_id, x_head, speed FROM a JOIN b USING (deer_id, seq) WHERE x_head IS NOT NULL AND speed IS NOT NULL""",
        "j10_full_outer": f"WITH {_R}, a AS (SELECT deer_id, count(*) AS readings FROM rd GROUP BY 1), b AS (SELECT deer_id, count(DISTINCT id) AS clips FROM video_observation_reference v JOIN deer_info d ON d.repetition_number = 'R' || v.repetition AND d.deer_number = 'D' || v.deer GROUP BY 1) SELECT deer_id, readings, clips FROM a FULL JOIN b USING (deer_id)",
        "semi_animals_filmed": "SELECT DISTINCT register_id, video_id FROM behaviour_register WHERE video_id IN (SELECT id FROM video_observation_reference)",
        "anti_animals_unknown": f"WITH {_R}, {_FX} SELECT data_id, deer_id FROM fx WHERE data_id NOT IN (SELECT data_id FROM rd WHERE data_id IS NOT NULL)",
        "u3_override": f"WITH {_R}, {_FX}, n AS (SELECT deer_id, count(*) AS n, 'readings' AS source FROM rd WHERE x_head > 0 GROUP BY 1 HAVING count(*) > 100) SELECT deer_id, count(*) AS n, 'fixes' AS source FROM fx WHERE deer_id NOT IN (SELECT deer_id FROM n) GROUP BY 1 UNION ALL SELECT * FROM n",
        "a32_label_counts": "SELECT labels, count(*) AS n FROM bout_stream GROUP BY 1",
        "a34_pairs": "SELECT DISTINCT repetition, deer FROM video_observation_reference",
        "f3_animal_names": """WITH c AS (SELECT DISTINCT id, regexp_extract(original_file_path, '/(R[0-9]+)_(D[0-9]+)_[^/]*$', 1) || regexp_extract(original_file_path, '/(R[0-9]+)_(D[0-9]+)_[^/]*$', 2) AS name, 'R' || repetition || 'D' || deer AS columns FROM video_observation_reference)
SELECT nullif(name, '') AS name, count(*) AS n, count(*) FILTER (name = columns) AS n_same FROM c GROUP BY 1""",
        "rollup_budget": f"WITH {EXPORTED_SQL}, {_CAT} SELECT animal_id, category, CAST(sum(length) AS BIGINT) AS samples FROM eb JOIN ct USING (label) GROUP BY ROLLUP (animal_id, category)",
    }


def queries() -> dict[str, Query]:
    extra = (a22_over_repeats, m3_sweep, m4_instabilities, m12_inertia_of_fits, a23_per_k, m6_kneedle, m13_selection_summary, t2_best_fits, t3_most_stable_fits, j9_fits_with_inertia, s14_uniform_points, s15_box_vectors, m14_stability_null, m7_first_order_null, m7b_marginal_null, m10_super_prototypes)
    return {k: globals()[k] for k in oracle_sql()} | {f.__name__: f for f in extra}

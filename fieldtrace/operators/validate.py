"""Observers' free text held against cluster labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What an observer's wording of each token looks like, in reading order.
TOKENS = {
    "not_in_view": r"not[ _]?in[ _]?view|notinview|no in view",
    "lying": r"\bly\b|\bly_|\blying|lyrum|lypant",
    "standing": r"\bstand|\bst_|standstill",
    "head_still": r"headstill|head[_ ]still|hdstill|hd[_ ]still",
    "head_move": r"head[_ ]?turn|hdturn|headmove|hd[_ ]?move|head ?up|hdup|headdown|hd[_ ]?down|head ?moving|hdmoving|hd ?swing|head ?shake|headshake|hdbob|head ?bob",
    "ear_still": r"ear[s]?still|earstill|ears[_ ]still|ear[_ ]still",
    "ear_move": r"earmvt|ear ?mv|earout|earsback|earsfwd|earmove|ear ?move|ear[_ ]?turn",
    "ear_flick": r"earfl|earflick|ear flick|ear[_ ]?fl\b|earswing|ear swing",
    "graze": r"\bgraze|\bgr\b|grazing|gr\+|gr ",
    "walk": r"\bwalk|\bwalkg|stepg|steps?|step@",
    "pant": r"\bpant",
    "ruminate": r"(?:^|[ _])rum(?:[ _]|$)|ruminat|lyrum",
    "groom": r"groom|grooming|rubnose|rub[_ ]?nose|footscratch|foot ?scratch",
    "drink": r"\bdrink",
    "yawn": r"\byawn|yawing",
}
# The tokens that fit each cluster, and the clusters' names and families.
EXPECTED = {
    0: ["lying", "standing", "head_still", "ear_still"],
    1: ["lying", "head_still", "ear_still", "ruminate", "pant"],
    2: ["ear_flick", "ear_move", "head_move", "walk", "standing"],
    3: ["lying", "standing", "head_still", "ear_still", "pant", "ruminate"],
    4: ["ear_flick", "walk", "graze", "groom", "head_move", "pant"],
    5: ["ear_flick", "walk", "graze", "groom"],
    6: ["graze", "walk"],
    7: ["graze"],
}
NAMES = {
    0: ("Quiescent", "inactive"),
    1: ("Resting", "inactive"),
    2: ("Ear flick (out)", "ear_flick"),
    3: ("Resting, active", "inactive"),
    4: ("Ear flick (back)", "ear_flick"),
    5: ("Ear flick (composite)", "ear_flick"),
    6: ("Stepping, grazing", "grazing"),
    7: ("Stationary, grazing", "grazing"),
}
Z95 = 1.959963984540054


def clusters(spark: SparkSession) -> DataFrame:
    """One row a cluster: k, name, category, expected."""
    return spark.createDataFrame([(k, *NAMES[k], EXPECTED[k]) for k in NAMES], "k int, name string, category string, expected array<string>")


def tokens(text: Column) -> Column:
    """Tokens that occur in a text, in fixed order; none for NULL."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(t)) for t, p in TOKENS.items()]))


def register(rows: DataFrame, *, id_col: str, text_col: str, cluster_col: str) -> DataFrame:
    """Each window once with its tokens: id, k, tokens, not_in_view, agrees.

    agrees is false for a cluster without expected tokens; a NULL cluster takes
    no part.
    """
    one = rows.select(F.col(id_col).alias("id"), F.col(cluster_col).alias("k"), F.col(text_col).alias("text")).where("k IS NOT NULL").distinct()
    df = one.withColumn("tokens", tokens(F.col("text"))).drop("text")
    df = df.join(F.broadcast(clusters(rows.sparkSession).select("k", "expected")), "k", "left")
    return df.select("id", "k", "tokens", F.array_contains("tokens", "not_in_view").alias("not_in_view"), F.coalesce(F.arrays_overlap("tokens", "expected"), F.lit(False)).alias("agrees"))


def token_confusion(windows: DataFrame, *, in_view_only: bool = False) -> DataFrame:
    """Share of each cluster's windows with each token (k, token, share), zeros included."""
    names = [t for t in TOKENS if not (in_view_only and t == "not_in_view")]
    df = windows.where("NOT not_in_view") if in_view_only else windows
    got = df.groupBy("k").agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("tokens", t)).alias(t) for t in names])
    return got.unpivot(["k", "n"], names, "token", "c").select("k", "token", (F.col("c") / F.col("n")).alias("share"))


def attributions(windows: DataFrame) -> DataFrame:
    """Which cluster each in-view window's text speaks for: (id, k, video_k, weight).

    The assigned one if any token fits it; else the best Jaccard matches among
    the others, sharing the weight; no row if none fits.
    """
    seen = windows.where("NOT not_in_view").withColumn("observed", F.array_remove("tokens", "not_in_view")).where(F.size("observed") > 0)
    fits = seen.where("agrees").select("id", "k", F.col("k").alias("video_k"), F.lit(1.0).alias("weight"))
    table = F.array(*[F.struct(F.lit(k).alias("video_k"), F.array(*map(F.lit, t)).alias("expected")) for k, t in EXPECTED.items()])
    other = seen.where("NOT agrees").select("id", "k", "observed", F.explode(table).alias("e")).where("e.video_k <> k")
    score = F.size(F.array_intersect("observed", "e.expected")) / F.size(F.array_union("observed", "e.expected"))
    scored = other.select("id", "k", "e.video_k", score.alias("score")).where("score > 0")
    mine = Window.partitionBy("id")  # seven rows a window
    best = scored.withColumn("top", F.max("score").over(mine)).where("score = top")
    return fits.union(best.select("id", "k", "video_k", (1 / F.count("*").over(mine)).alias("weight")))


def cluster_confusion(windows: DataFrame) -> DataFrame:
    """Row-normalised matrix (k, video_k, weight, share); empty rows are 0."""
    spark = windows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in EXPECTED for b in EXPECTED], "k int, video_k int")
    sums = attributions(windows).groupBy("k", "video_k").agg(F.sum("weight").alias("weight"))
    full = grid.join(sums, ["k", "video_k"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = F.sum("weight").over(Window.partitionBy("k"))
    return full.withColumn("share", F.when(total > 0, F.col("weight") / total).otherwise(0.0))


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """Struct of lo and hi; (0, 0) without trials."""
    p = F.try_divide(successes, n)
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / denom
    some = n > 0
    return F.struct(
        F.when(some, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0).alias("lo"), F.when(some, F.least(F.lit(1.0), centre + half)).otherwise(0.0).alias("hi")
    )


def agreement(windows: DataFrame) -> DataFrame:
    """Per cluster: windows, those in view, agreeing, the share and its Wilson interval."""
    view = ~F.col("not_in_view")
    got = windows.groupBy("k").agg(F.count("*").alias("n_total"), F.count_if(view).alias("n_evaluable"), F.count_if(view & F.col("agrees")).alias("n_agree"))
    ci = wilson(F.col("n_agree"), F.nullif(F.col("n_evaluable"), F.lit(0)))
    share = F.coalesce(F.try_divide("n_agree", "n_evaluable"), F.lit(0.0))
    return got.withColumn("ci", ci).select("k", "n_total", "n_evaluable", "n_agree", share.alias("agreement"), F.coalesce("ci.lo", F.lit(0.0)).alias("ci_lo"), F.coalesce("ci.hi", F.lit(0.0)).alias("ci_hi"))

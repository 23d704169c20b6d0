"""Mapping of freely typed values to a canonical list, by a pigeonhole join.

A reference string of n letters may differ from what was typed by k(n) edits.
Cut into k + 1 stretches, at least one of them occurs unchanged in the typed
string, not far from where it stands in the reference.  The join is therefore an
equality join on (length, stretch number, substring); what it finds is verified
with the built-in levenshtein.  Everything is SQL.

The typed values are reduced to distinct phrases before the join, so a value
that fills a third of the table is looked up once.  The reference side grows
with the canonical list only; up to a checked size it is broadcast, so a probe
that meets no stretch never leaves its task.

Remarks that observers put before or behind a behaviour are learned from the
values themselves: words beside exactly written behaviours of several kinds.
What is learned depends on how often things are written relative to each other,
so that a larger table, with more misspellings, maps a value no differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# How observers part several behaviours in one value.
PARTING = r"\s*(?:[;,/&+]|\bthen\b|\s-\s)\s*"

#: Up to so many reference stretches (some 60 bytes each) are broadcast.
BROADCAST_STRETCHES = 100_000

# Forms that no rule below makes from a name or a description.
ALIASES = {
    "browsing leaves": "leaf browsing, stripping foliage",
    "galloping": "at full speed, full speed",
    "walking": "slow gait, four-beat gait",
    "trotting": "two-beat gait",
    "standing still": "stood still",
    "lying down": "lie down, lies down, lay down, lain down, down lying",
    "ruminating": "cud chewing, rumination",
    "ear flick": "flick of ear, ear swing",
    "ears pinned": "ear pinned, ears laid flat, ears flat along neck, ears flat",
    "head raised": "lift head",
    "head lowered": "drop head",
    "head turn": "rotate head",
    "head shake": "shook head, wag head",
    "panting": "open mouth breathing",
    "drinking": "drank, drunk, lapping",
    "yawning": "gaping, mouth wide open",
    "self grooming": "groom self",
    "mutual grooming": "groom mutually, licking each other",
    "wallowing": "rolling in mud",
    "sniffing ground": "smelling soil",
    "urinating": "urination",
    "defecating": "defecation",
    "roaring": "loud call",
    "sparring": "antlers locked",
    "tail wag": "tail swish, swish tail",
    "stretching": "back arched, legs extended",
    "licking mineral block": "at salt lick, salt lick",
    "sleeping": "asleep, slept, head on flank",
    "vigilance": "vigilant, being vigilant, alert",
    "shivering": "muscle tremor",
    "fence pacing": "up and down along wire",
    "body rub": "flank pressed along post, flank against trunk",
    "out of view": "no view, not in view, hidden, animal hidden from camera, hidden from camera",
    "foot stamp": "forefoot struck, hoof stomp",
}


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def _allowed(n: Column) -> Column:
    """Edits allowed for a reference string of n letters."""
    return F.when(n <= 4, 0).when(n == 5, 1).when(n <= 8, 2).otherwise(3)


def _forms(word: Column) -> Column:
    """Inflections of one word: every form that the rules of English spelling could make of its stem."""
    stem = F.when(word.rlike("ing$"), F.expr("substr(w, 1, length(w) - 3)")).when(word.rlike("ed$"), F.expr("substr(w, 1, length(w) - 2)")).otherwise(word)
    bases = F.array(stem, F.concat(stem, F.lit("e")), F.regexp_replace(stem, r"(.)\1$", "$1"))
    last = lambda b: F.when(F.substring(b, -1, 1).rlike("[bdfglmnprtz]"), F.substring(b, -1, 1)).otherwise("")
    made = F.transform(
        bases,
        lambda b: F.array(
            b,
            F.concat(b, F.lit("s")),
            F.concat(b, F.lit("ing")),
            F.concat(b, F.lit("ed")),
            F.concat(F.regexp_replace(b, "e$", ""), F.lit("ing")),
            F.concat(F.regexp_replace(b, "e$", ""), F.lit("ed")),
            F.concat(b, last(b), F.lit("ing")),
            F.concat(b, last(b), F.lit("ed")),
        ),
    )
    return F.array_distinct(F.flatten(made))


def references(canonical: DataFrame, *, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows (behaviour_id, ref, k, origin, n): the strings by which each entry may be named.

    From every name, phrase of a description and alias: the phrase itself, its
    words in either order with one of them inflected, and name beginnings; the
    codes stand for themselves.  Only letters count.  origin is 0 for what was made
    from a name or code, 1 for the rest.  The result grows with the canonical
    list alone.
    """
    spark = canonical.sparkSession
    aliases = ALIASES if aliases is None else aliases
    listed = spark.createDataFrame(list(aliases.items()), "name string, alias string")
    base = canonical.coalesce(1).select("behaviour_id", F.lower("name").alias("name"), "code", F.lower("description").alias("description")).join(F.broadcast(listed), "name", "left")
    none = F.array().cast("array<string>")
    said = F.split(F.regexp_replace("description", r"\b(the|a|an|one|its) | or [^,]*", ""), r"\s*,\s*")
    other = F.split("alias", r"\s*,\s*")
    whole = F.when(F.col("description").contains(","), F.array(F.regexp_replace("description", r"\b(the|a|an|one|its) ", "")))
    of_kind = lambda made, kind: F.transform(made, lambda p: F.struct(p.alias("phrase"), F.lit(kind).alias("kind")))
    described = F.concat(F.coalesce(said, none), F.coalesce(other, none))
    phrases = base.select("behaviour_id", F.inline(F.concat(of_kind(F.array("name"), 0), of_kind(described, 1), of_kind(F.coalesce(whole, none), 2))))
    origin = F.least(F.col("kind"), F.lit(1)).alias("origin")
    single = phrases.select("behaviour_id", F.col("phrase").alias("ref"), origin)
    words = phrases.where("kind < 2").withColumn("words", F.split("phrase", r"[^\p{L}]+")).where(F.size("words") <= 3)
    at = words.select("behaviour_id", origin, "words", F.posexplode("words").alias("at", "w"))
    # In a name the verb is a participle or stands last; elsewhere it can be any word.
    at = at.where((F.col("origin") == 1) | F.col("w").rlike("(ing|ed)$") | (F.col("at") == F.size("words") - 1)).select("behaviour_id", "origin", "words", "at", F.explode(_forms(F.col("w"))).alias("form"))
    inflected = at.select("behaviour_id", "origin", F.transform("words", lambda x, i: F.when(i == F.col("at"), F.col("form")).otherwise(x)).alias("words"), F.col("at"))
    taken, rest = F.slice("words", F.col("at") + 1, 1), F.expr("filter(words, (x, i) -> i <> at)")
    placed = inflected.select("behaviour_id", "origin", F.explode(F.array(F.concat(taken, rest), F.concat(rest, taken), F.col("words"))).alias("words"))
    plural = placed.select("behaviour_id", "origin", F.explode(F.array(F.col("words"), F.expr("transform(words, (x, i) -> IF(i = size(words) - 1, concat(x, 's'), x))"))).alias("words"))
    joined = plural.select("behaviour_id", F.concat_ws("", "words").alias("ref"), "origin")
    begun = phrases.where((F.col("kind") == 0) & ~F.col("phrase").contains(" ")).select("behaviour_id", F.explode(F.expr("transform(sequence(1, 3), i -> substr(phrase, 1, length(phrase) - i))")).alias("ref"), F.lit(0).alias("origin")).where(F.length("ref") >= 5)
    codes = base.select("behaviour_id", _letters(F.col("code")).alias("ref"), F.lit(0).alias("k"), F.lit(0).alias("origin"))
    # A form that the rules make for two entries is kept for the one whose own phrase it is, else for neither.
    own = single.select("behaviour_id", _letters(F.col("ref")).alias("ref"), F.lit(0).alias("rule"), "origin")
    made = joined.union(begun).select("behaviour_id", _letters(F.col("ref")).alias("ref"), F.lit(1).alias("rule"), "origin")
    made = own.union(made).where(F.length("ref") >= 3).groupBy("ref", "behaviour_id").agg(F.min("rule").alias("rule"), F.min("origin").alias("origin"))
    made = made.groupBy("ref").agg(F.min(F.struct("rule", "origin", "behaviour_id")).alias("best"), F.count("*").alias("n")).where("n = 1 OR best.rule = 0")
    made = made.select("best.behaviour_id", "ref", (_allowed(F.length("ref")) + F.expr("IF(best.rule = 0 AND length(ref) > 10, 1, 0)")).alias("k"), "best.origin")
    both = codes.select("behaviour_id", "ref", "k", "origin").union(made)
    return both.groupBy("behaviour_id", "ref").agg(F.min("k").alias("k"), F.min("origin").alias("origin")).withColumn("n", F.length("ref"))


def _stretches(n: str, k: str) -> str:
    """SQL: for every stretch of n letters cut into k + 1, its number, start (from 0) and length."""
    return (
        f"transform(sequence(0, {k}), i -> named_struct('no', i, 'at', int({n} * i DIV ({k} + 1)),"
        f" 'len', int({n} * (i + 1) DIV ({k} + 1)) - int({n} * i DIV ({k} + 1))))"
    )


def _tasks(df: DataFrame) -> int:
    """Tasks for little input and much work, which would be coalesced if their number weren't given."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_STRETCHES rows."""
    return F.broadcast(df) if df.limit(BROADCAST_STRETCHES + 1).count() <= BROADCAST_STRETCHES else df


def pigeonhole_pairs(typed: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows (typed, ref, behaviour_id, origin, d): each typed string with every reference string within its k edits.

    typed has a column ``typed`` of distinct strings of letters; refs has
    behaviour_id, ref, origin, k, n.  Complete: by the pigeonhole principle no pair
    within k edits is missed.  Some stretch i that is kept has at most i edits
    before it and at most k - i behind it, which bounds how far it can have moved.
    Empty tables give no rows, NULL never joins.  refs is read when the function
    is called, to learn the largest k and whether it can be broadcast.
    """
    most = refs.agg(F.max("k")).first()[0] or 0
    cut = refs.select("behaviour_id", "ref", "origin", "n", "k", F.explode(F.expr(_stretches("n", "k"))).alias("s")).select(
        "behaviour_id", "ref", "origin", "n", "k", F.col("s.no").alias("no"), F.expr("substr(ref, s.at + 1, s.len)").alias("part")
    )
    shapes = refs.select("n", "k").distinct()
    moves = "IF(greatest(-s.no, m - n - (k - s.no)) <= least(s.no, m - n + (k - s.no)), sequence(greatest(-s.no, m - n - (k - s.no)), least(s.no, m - n + (k - s.no))), array())"
    # The distinct strings may have come in one partition; the probes are many times their number.
    spread = typed.repartition(_tasks(typed), "typed")
    probe = (
        spread.withColumn("m", F.length("typed"))
        .withColumn("n", F.explode(F.expr(f"sequence(greatest(0, m - {most}), m + {most})")))
        .join(_small(shapes), "n")
        .where("abs(m - n) <= k")
        .select("typed", "n", "k", "m", F.explode(F.expr(_stretches("n", "k"))).alias("s"))
        .select("typed", "n", "k", "m", "s", F.explode(F.expr(moves)).alias("move"))
        .where("s.at + move >= 0 AND s.at + move + s.len <= m")
        .select("typed", "n", "k", F.col("s.no").alias("no"), F.expr("substr(typed, s.at + move + 1, s.len)").alias("part"))
    )
    found = probe.join(_small(cut), ["n", "k", "no", "part"]).withColumn("d", F.levenshtein("typed", "ref")).where("d <= k")
    return found.select("typed", "ref", "behaviour_id", "origin", "d").distinct()


def transposed_pairs(typed: DataFrame, refs: DataFrame, *, shortest: int = 4) -> DataFrame:
    """Like pigeonhole_pairs, for strings whose letters mainly changed places.

    The same join on the letters in alphabetical order, where a change of places
    is no edit; one edit is left for the rest of a form of 6 letters or more, none
    for shorter ones.  The strings themselves may then be 5, or 2, edits apart.
    Only forms made from names, of ``shortest`` letters or more.
    """
    ordered = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    left = F.when(F.col("n") >= 6, 1).otherwise(0)
    a = typed.select(F.col("typed").alias("as_typed"), ordered(F.col("typed")).alias("typed"))
    b = refs.where((F.col("origin") == 0) & (F.col("n") >= shortest)).select("behaviour_id", F.col("ref").alias("as_ref"), ordered(F.col("ref")).alias("ref"), "origin", left.alias("k"), "n")
    near = pigeonhole_pairs(a.select("typed").distinct(), b.select("behaviour_id", "ref", "origin", "k", "n").distinct()).drop("d", "origin")
    back = near.join(a, "typed").join(_small(b), ["behaviour_id", "ref"])
    d = F.levenshtein("as_typed", "as_ref")
    return back.where(d <= F.when(F.col("k") > 0, 5).otherwise(2)).select(F.col("as_typed").alias("typed"), F.col("as_ref").alias("ref"), "behaviour_id", "origin", d.alias("d"))


def _words(part: Column) -> Column:
    """The words of a phrase in lower case; numbers in a word stand as #, numbers alone are left out."""
    plain = F.regexp_replace(F.lower(part), r"\p{N}+", "#")
    return F.array_except(F.split(F.trim(F.regexp_replace(plain, r"[^\p{L}#]+", " ")), " "), F.array(F.lit("#"), F.lit("")))


def _spans(parts: DataFrame, longest: int) -> DataFrame:
    """parts (with words) once for every way of leaving out up to ``longest`` words at either end: phrase (all of them), before, behind and typed (the letters between)."""
    count = F.size("words")
    left_out = lambda rest: F.explode(F.expr(f"sequence(0, least({longest}, {rest}))"))
    rows = parts.where(count > 0).select("*", left_out("size(words) - 1").alias("_i")).select("*", left_out("size(words) - _i - 1").alias("_j"))
    text = lambda c: F.array_join(c, " ")
    return rows.select(
        *parts.columns,
        text(F.col("words")).alias("phrase"),
        text(F.slice("words", F.lit(1), F.col("_i"))).alias("before"),
        text(F.slice("words", count - F.col("_j") + 1, F.col("_j"))).alias("behind"),
        _letters(text(F.slice("words", F.col("_i") + 1, count - F.col("_i") - F.col("_j")))).alias("typed"),
    ).where("typed <> ''")


def learn_remarks(spans: DataFrame, refs: DataFrame, *, support: int = 3) -> DataFrame:
    """Rows (side, remark): what stands before (``before``) or behind (``behind``) exactly written entries of at least ``support`` kinds.

    spans is a result of _spans over single parts of values: in a whole value other
    entries stand beside an entry, and in a large table each of their misspellings
    beside several.  refs as in pigeonhole_pairs.  What is a reference string, or
    one edit from it, is no remark.
    """
    exact = _small(refs.select(F.col("ref").alias("typed"), "behaviour_id").distinct())
    one = spans.where("(before = '') <> (behind = '')").join(exact, "typed")
    beside = one.select(F.expr("IF(before = '', 'behind', 'before')").alias("side"), F.concat("before", "behind").alias("remark"), "behaviour_id")
    # A row for each pair of remark and entry, then of remarks; behaviour_id has as many values as the canonical list.
    often = beside.distinct().groupBy("side", "remark").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= support)
    often = cut_lineage(often.select("side", "remark", _letters(F.col("remark")).alias("_l")))
    entries = pigeonhole_pairs(often.select(F.col("_l").alias("typed")).distinct(), refs.withColumn("k", F.least("k", F.lit(1))))
    return often.join(entries.select(F.col("typed").alias("_l")).distinct(), "_l", "left_anti").select("side", "remark")


def lone_remarks(parts: DataFrame, pairs: DataFrame, *, support: int = 3) -> DataFrame:
    """Rows (typed): what is two or more edits from every reference string, stands as a part beside exactly written entries of
    at least ``support`` kinds, and is in more values than any reference string near it.

    A misspelling stands beside as many kinds in a large table, but is rarer than what it is a misspelling of.
    parts has value, first, typed (whole parts of the values); pairs is a result of pigeonhole_pairs over them.
    """
    often = parts.groupBy("typed").agg(F.countDistinct("value").alias("n"))
    near = pairs.join(often.select(F.col("typed").alias("ref"), F.col("n").alias("_n")), "ref", "left").groupBy("typed").agg(F.min("d").alias("d"), F.coalesce(F.max("_n"), F.lit(0)).alias("_n"))
    odd = near.where("d >= 2").join(often, "typed").where("n > _n").select("typed")
    exact = pairs.where("d = 0").select(F.col("typed").alias("_t"), "behaviour_id").join(parts.select("value", F.col("first").alias("_f"), F.col("typed").alias("_t")), "_t")
    beside = parts.join(odd, "typed").join(exact, "value").where("first <> _f").select("typed", "behaviour_id").distinct()
    return beside.groupBy("typed").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= support).select("typed")


def _runs(parts: DataFrame, longest: int) -> DataFrame:
    """Rows (value, first, last, words): every part of each value, runs of up to ``longest`` parts, and all parts together.

    parts has value, parts (arrays of words).
    """
    count = "size(parts)"
    ends = f"transform(sequence(0, {count} - 1), i -> transform(sequence(i, least(i + {longest}, {count}) - 1), j -> named_struct('first', i, 'last', j)))"
    whole = f"IF({count} > {longest}, array(named_struct('first', 0, 'last', {count} - 1)), array())"
    runs = parts.where(f"{count} > 0").select("value", "parts", F.explode(F.expr(f"concat(flatten({ends}), {whole})")).alias("r"))
    return runs.select("value", F.col("r.first").alias("first"), F.col("r.last").alias("last"), F.expr("array_distinct(flatten(slice(parts, r.first + 1, r.last - r.first + 1)))").alias("words"))


def map_values(
    rows: DataFrame, canonical: DataFrame, *, id_col: str = "register_id", value_col: str = "Behaviour", aliases: dict[str, str] | None = None,
    longest: int = 4, support: int = 3, joined: int = 3,
) -> DataFrame:
    """Rows (id_col, behaviour_id), distinct: what each non-blank value means, -1 if nothing on the list.

    The parts of a value are looked up one by one, and so are runs of up to
    ``joined`` parts and the whole value.  A run counts instead of its parts if a
    reference string is at most one edit away; with all edits allowed it counts
    if none of its parts means anything.  Parts that mean nothing (remarks) are left
    out.  Every phrase is looked up as it stands and without the remarks
    at its ends, which are learned from the values (learn_remarks; of up to
    ``longest`` words), as are parts that are remarks near a reference string (lone_remarks).  The nearest reference string wins; on a tie one made from
    a name, then the smaller behaviour_id.
    NULL and blank values give no row; a repeated id with the same value counts
    once; other columns are ignored; empty tables give no rows, an empty list -1.
    The references, remarks and pairs are computed when the function is called.
    """
    given = rows.select(F.col(id_col).alias("_id"), F.col(value_col).alias("value")).where(F.col("value").rlike(r"\S"))
    values = given.select("value").distinct().repartition(_tasks(rows), "value")
    refs = cut_lineage(references(canonical, aliases=aliases))
    parts = values.select("value", F.filter(F.transform(F.split(F.lower("value"), PARTING), _words), lambda w: F.size(w) > 0).alias("parts"))
    spans = cut_lineage(_spans(_runs(parts, joined), longest).drop("words"))
    remarks = cut_lineage(learn_remarks(spans.where("first = last"), refs, support=support))
    # As many rows as there are remarks in use; beyond the checked size it is an ordinary join.
    known = lambda side: _small(remarks.where(F.col("side") == side).select(F.col("remark").alias(side)).union(remarks.sparkSession.createDataFrame([("",)], f"{side} string")))
    # A phrase that is nothing but a remark means nothing.
    spans = spans.join(remarks.select(F.col("remark").alias("phrase")).distinct(), "phrase", "left_anti")
    units = spans.join(known("before"), "before").join(known("behind"), "behind").select("value", "first", "last", "typed").distinct()
    typed = units.select("typed").distinct()
    pairs = cut_lineage(pigeonhole_pairs(typed, refs))
    pairs = cut_lineage(pairs.union(transposed_pairs(typed.join(pairs.select("typed").distinct(), "typed", "left_anti"), refs)))
    alone = lone_remarks(spans.where("first = last AND before = '' AND behind = ''").select("value", "first", "typed").distinct(), pairs, support=support)
    pairs = pairs.join(alone, "typed", "left_anti")
    nearest = pairs.groupBy("typed").agg(F.min(F.struct("d", "origin", "behaviour_id")).alias("best"))
    meant = units.join(nearest, "typed").groupBy("value", "first", "last").agg(F.min("best").alias("best"))
    # A run that is as good as written comes before its parts, the longest one first; another one comes behind them.
    rank = F.when(F.col("first") == F.col("last"), 1).when(F.col("best.d") <= 1, 0).otherwise(2)
    length = F.when(rank == 0, F.col("first") - F.col("last")).otherwise(0)
    # As many elements as a value has parts and runs.
    units = meant.groupBy("value").agg(F.collect_list(F.struct(F.struct(rank.alias("rank"), length.alias("length"), "best", "first", "last").alias("order"), "first", "last", "best.behaviour_id")).alias("units"))
    kept = F.expr("filter(units, u -> NOT exists(units, v -> v.order < u.order AND v.first <= u.last AND v.last >= u.first))")
    meant = units.select("value", F.explode(kept).alias("u")).select("value", "u.behaviour_id").distinct()
    none = values.select("value").join(meant.select("value").distinct(), "value", "left_anti").select("value", F.lit(-1).alias("behaviour_id"))
    return given.join(meant.union(none), "value").select(F.col("_id").alias(id_col), F.col("behaviour_id").cast("int").alias("behaviour_id")).distinct()

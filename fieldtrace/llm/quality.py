"""Text statistics of documents, and text types learned from them without labels.

Each page is cut into cells (lines, and the columns of a line).  Built-in
functions count words, letters, common words and numbers of a cell; sums over
the cells give the statistics of the document.  Which words are common is learned
from the corpus: short ones that a large part of a language's documents has.
Thresholds on the statistics are labelling functions, one for each statistic, that
vote prose, other or nothing.  How far each is to be trusted is learned by
expectation-maximization from how they agree, over the histogram of vote
patterns, which has at most 3^m rows for m functions whatever the size of the
corpus.  Functions that err together are worth less than as many independent
ones; their evidence is tempered by the correlation that is left within the
types.  The posterior gives the text type.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CELL = "[\\t\\r\\u000b\\f\\u0085\\u2028\\u2029]+| {3,}|(?<=\\.)—"


def _plain_letters() -> tuple[str, str]:
    """Letter-like symbols (mathematical alphabets, long s) and the letters they stand for."""
    pairs = [(chr(k), unicodedata.normalize("NFKC", chr(k))) for k in [0x17F, *range(0x2100, 0x2150), *range(0x1D400, 0x1D800)]]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and b.isalnum() and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _plain(text: Column) -> Column:
    odd, plain = _plain_letters()
    # Letters of four bytes are looked for only where they can be many.
    return F.when(F.octet_length(text) > 1.1 * F.length(text), F.translate(text, odd, plain)).otherwise(text)


def common_words(docs: DataFrame, *, text_col: str = "text", lang_col: str | None = "lang", share: float = 0.25, longest: int = 4, least: float = 0.01) -> list[str]:
    """Words of 2 to ``longest`` letters that at least ``share`` of the documents of a language have, in lower case, sorted.

    Over all documents with a text.  A language is the first two letters of
    lang_col (NULL and an absent column are one of their own) if at least ``least``
    of the documents have it, so there are at most 1 / least of them, each with
    at most 1 / share words for every one that a document has on average.
    """
    lang = F.coalesce(F.lower(F.substring(F.trim(lang_col), 1, 2)), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.where(F.col(text_col).isNotNull()).select(lang.alias("lang"), F.lower(_plain(F.col(text_col))).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    total = rows.count()
    sizes = {r["lang"]: r["n"] for r in sizes.where(F.col("n") >= least * total).collect()}
    if not sizes:
        return []
    # Words between blanks and the usual marks; what else is around a word makes it another one.
    words = F.array_distinct(F.split("text", r"[\s.,;:!?\"“”()—-]+"))
    short = F.filter(words, lambda w: F.length(w).between(2, longest))
    found = rows.where(F.col("lang").isin(*sizes)).select("lang", F.explode(short).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    enough = F.lit(False)
    for name, n in sizes.items():
        enough = enough | ((F.col("lang") == name) & (F.col("n") >= max(share * n, 1)))
    return sorted({r["word"] for r in found.where(enough & F.col("word").rlike(r"^\p{L}+$")).select("word").distinct().collect()})


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", common: list[str]) -> DataFrame:
    """One row for each document whose text is neither NULL nor blank: id_col and its statistics.

    n_chars (without blanks at the ends of cells), n_words, mean_word_len (letters),
    symbol_ratio (what is neither letter, digit nor blank), digit_words (share),
    common_words (share of words in ``common``), line_ends (share of cells that
    end in a punctuation mark), misplaced (marks before a word, to words),
    turned (words that end in a capital after a small letter, to words; I is often
    a misread l), mute_words (words of three or more letters without a vowel, to
    words), and two shares of the characters: in cells of which every fifth word is common
    (spoken), and in cells that begin like an item of a list or hold a row of
    dots or bars (listed).
    """
    text, line = _plain(F.col(text_col)), F.col("line")
    mixed = F.lit(False)
    for mark in ("   ", "\t", ".—", "\r", "\x0b", "\f", "\x85", "\u2028", "\u2029"):
        mixed = mixed | line.contains(mark)
    lines = docs.where(F.col(text_col).rlike(r"[^\s\x{A0}\x{2000}-\x{200A}\x{3000}]")).select(F.col(id_col).alias("_id"), F.explode(F.split(text, "\n")).alias("line"))
    cells = lines.select("_id", F.explode(F.when(mixed, F.split(line, CELL)).otherwise(F.array(line))).alias("cell"))
    cells = cells.select("_id", F.trim("cell").alias("cell")).where("cell <> ''")
    cells = cells.select("_id", "cell", F.length("cell").alias("chars"), F.array_remove(F.split(F.lower("cell"), " "), "").alias("words"))
    known = [x + mark for x in common for mark in ("", ",", ".", ";")] or [""]
    cells = cells.select(
        "_id",
        "chars",
        F.size("words").alias("n"),
        F.size(F.filter("words", lambda w: w.isin(*known))).alias("common"),
        F.regexp_count("cell", F.lit(r"\p{N}[^ ]*")).alias("digits"),
        F.length(F.regexp_replace("cell", r"[\p{L}\p{N} ]+", "")).alias("symbols"),
        F.length(F.regexp_replace("cell", r"\P{L}+", "")).alias("letters"),
        F.regexp_count("cell", F.lit(r" [.,;]\p{L}")).alias("misplaced"),
        F.regexp_count("cell", F.lit(r"\p{Ll}[\p{Lu}&&[^I]](?!\p{L})")).alias("turned"),
        F.regexp_count("cell", F.lit(r"(?i)(?<![^ ])[b-df-hj-np-tv-xz]{3,}(?![^ ])")).alias("mute"),
        F.right(F.col("cell"), F.lit(1)).isin(*".!?;:,").cast("int").alias("ends"),
        F.col("cell").rlike(r"^(?:[*•·\-|] |\p{L}{0,4} ?[\dlIO]{1,3}[.:·)])|[.·]{4}").alias("listed"),
    )
    share = lambda c: F.sum(F.when(c, F.col("chars")).otherwise(0))
    sums = cells.groupBy("_id").agg(
        F.sum("chars").alias("n_chars"),
        F.sum("n").alias("n_words"),
        F.sum("letters").alias("letters"),
        F.sum("symbols").alias("symbols"),
        F.sum("digits").alias("digits"),
        F.sum("common").alias("common"),
        F.sum("misplaced").alias("misplaced"),
        F.sum("turned").alias("turned"),
        F.sum("mute").alias("mute"),
        F.avg("ends").alias("line_ends"),
        share((F.col("common") >= 0.2 * F.col("n")) & (F.col("n") > 0)).alias("spoken"),
        share(F.col("listed")).alias("listed"),
    )
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).alias(a)
    return sums.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "n_words",
        part("letters", "n_words").alias("mean_word_len"),
        part("symbols", "n_chars").alias("symbol_ratio"),
        part("digits", "n_words").alias("digit_words"),
        part("common", "n_words").alias("common_words"),
        "line_ends",
        part("misplaced", "n_words"),
        part("turned", "n_words"),
        part("mute", "n_words").alias("mute_words"),
        part("spoken", "n_chars"),
        part("listed", "n_chars"),
    )


def labelling_functions() -> dict[str, Column]:
    """Votes of the statistic thresholds: 1 for prose, 0 for other, 2 for none. No two read the same statistic."""

    def vote(name: str, prose: tuple[float, float], other: tuple[float, float]) -> Column:
        return F.when(F.col(name).between(*prose), 1).when(~F.col(name).between(*other), 0).otherwise(2)

    return {
        "spoken": vote("spoken", (0.55, 1.0), (0.45, 1.0)),
        "numbers": vote("digit_words", (0.0, 0.05), (0.0, 0.2)),
        "symbols": vote("symbol_ratio", (0.0, 0.08), (0.0, 0.18)),
        "listed": vote("listed", (0.0, 0.1), (0.0, 0.4)),
        "mute": vote("mute_words", (0.0, 0.05), (0.0, 0.15)),
        "order": vote("misplaced", (0.0, 0.01), (0.0, 0.04)),
        "capitals": vote("turned", (0.0, 0.01), (0.0, 0.03)),
        "word_length": vote("mean_word_len", (3.0, 6.5), (2.3, 8.0)),
    }


def _correlation(weight: np.ndarray, coded: np.ndarray) -> float:
    """Mean absolute correlation of the votes within a type, over pairs of functions and types by their weight."""
    m = coded.shape[1]
    if m < 2:
        return 0.0
    found = []
    for w in weight.T:
        off = coded - np.average(coded, axis=0, weights=w + 1e-12)
        cov = (off * w[:, None]).T @ off
        spread = np.sqrt(np.diag(cov))
        rho = np.abs(cov) / np.maximum(np.outer(spread, spread), 1e-12)
        found.append((rho.sum() - np.trace(rho)) / (m * (m - 1)))
    return float(np.average(found, weights=weight.sum(axis=0) + 1e-12))


def learn_accuracies(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, np.ndarray, float]:
    """Share of prose, for every function the probability of each vote (0, 1, 2) given other and prose, and the temper.

    Expectation-maximization over distinct vote patterns and their counts; starts
    from the majority of the votes and stops when nothing moves.  Counts are
    smoothed by one.  The temper is what m functions that correlate by rho within
    the learned types are worth, 1 / (1 + (m - 1) rho) of as many independent
    ones; it scales the log odds of the posterior, so that functions that err
    together don't claim more certainty than they have.  Without patterns the
    prior is one half.
    """
    if not patterns:
        return 0.5, np.zeros((0, 2, 3)), 1.0
    votes = np.array([p for p, _ in patterns])
    count = np.array([n for _, n in patterns], dtype=float)
    ones, zeros = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    prose = np.clip((ones + 0.5) / (ones + zeros + 1), 0.05, 0.95)
    seen = np.stack([votes == v for v in range(3)], axis=2).astype(float)
    coded = np.select([votes == 1, votes == 0], [1.0, -1.0], 0.0)
    prior, table = 0.5, np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([count * (1 - prose), count * prose], axis=1)
        prior = (weight[:, 1].sum() + 1) / (count.sum() + 2)
        table = np.einsum("pc,pfv->fcv", weight, seen) + 1
        table /= table.sum(axis=2, keepdims=True)
        logs = np.einsum("pfv,fcv->pc", seen, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        moved, prose = np.abs(new - prose).max(), new
        if moved < 1e-9:
            break
    weight = np.stack([count * (1 - prose), count * prose], axis=1)
    return float(prior), table, 1 / (1 + (votes.shape[1] - 1) * _correlation(weight, coded))


def text_types(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", functions: dict[str, Column] | None = None) -> DataFrame:
    """text_statistics with p_prose (the posterior) and text_type (``prose`` or ``other``).

    NULL and blank texts have no statistics and no row; an empty table gives no
    rows; other columns are ignored; a repeated id counts as one document.  The
    statistics are computed when the function is called, because the posteriors
    depend on all of them.  functions replaces labelling_functions().
    """
    functions = labelling_functions() if functions is None else functions
    common = common_words(docs, text_col=text_col, lang_col=lang_col)
    stats = cut_lineage(text_statistics(docs, id_col=id_col, text_col=text_col, common=common))
    return typed_by_votes(stats, functions)


def typed_by_votes(stats: DataFrame, functions: dict[str, Column]) -> DataFrame:
    """stats with p_prose and text_type as the votes of functions have it; stats is read when the function is called."""
    voted = stats.withColumns({f"vote_{k}": v for k, v in functions.items()})
    names = [f"vote_{k}" for k in functions]
    # At most 3^m rows.
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    prior, table, temper = learn_accuracies(patterns)
    odds = F.lit(float(temper * np.log(prior / (1 - prior))))
    for name, (other, prose) in zip(names, table, strict=False):
        odds = odds + F.element_at(F.array(*(F.lit(float(x)) for x in temper * np.log(prose / other))), F.col(name) + 1)
    voted = voted.withColumn("p_prose", 1 / (1 + F.exp(-odds)))
    return voted.withColumn("text_type", F.when(F.col("p_prose") >= 0.5, "prose").otherwise("other")).drop(*names)

"""Queries over the tables for the operators of this package, and SQL for those that SQL can check."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .bpe import count_tokens, encode_corpus
from .mapping import map_values
from .packing import fill, pack_items
from .quality import text_types
from .runs import collapse_runs


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return map_values(table(spark, folder, "behaviour_register"), table(spark, folder, "behaviour_list"))


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The typed values that mean nothing on the list, with how often they occur."""
    rows = table(spark, folder, "behaviour_register").dropDuplicates(["register_id"])
    none = map_values(rows, table(spark, folder, "behaviour_list")).where("behaviour_id = -1").select("register_id")
    return rows.join(none, "register_id", "left_semi").groupBy(F.lower(F.trim("Behaviour")).alias("value")).agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = collapse_runs(table(spark, folder, "bout_stream"))
    return runs.where("n_events >= 2").select("animal_id", "start_index", "stop_index")


def p3_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run, single bouts included, with its count and duration."""
    return collapse_runs(table(spark, folder, "bout_stream"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def _capacities(spark: SparkSession, folder: str) -> list[int]:
    """The capacities of token_bins, a small fixed table, in order."""
    return sorted(r[0] for r in table(spark, folder, "token_bins").select("capacity_tokens").distinct().collect())


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The containers of the largest capacity that hold the corpus."""
    return pack_items(count_tokens(table(spark, folder, "documents")), capacity=_capacities(spark, folder)[-1])


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    sizes = cut_lineage(count_tokens(table(spark, folder, "documents")))
    return reduce(DataFrame.union, [fill(pack_items(sizes, capacity=c), capacity=c) for c in _capacities(spark, folder)])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return text_types(table(spark, folder, "documents")).where("text_type = 'other'").select("doc_id")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_types(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (p2_found, p2_unmatched, p3_found, p3_runs, p6_ids, p7_containers, p7_fill, p8_found, p8_statistics)
    return {f.__name__: f for f in names}


_RUNS = """
WITH one AS (
  SELECT DISTINCT bout_id, animal_id, labels, start_index, coalesce(lengths, 0) AS lengths FROM bout_stream
  WHERE bout_id IS NOT NULL AND animal_id IS NOT NULL AND start_index IS NOT NULL),
a AS (SELECT *, start_index + lengths AS stop,
  CASE WHEN labels IS NOT DISTINCT FROM lag(labels) OVER w AND lag(bout_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new
  FROM one WINDOW w AS (PARTITION BY animal_id ORDER BY start_index, bout_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY animal_id ORDER BY start_index, bout_id) AS stretch FROM a),
c AS (SELECT *, max(stop) OVER (PARTITION BY animal_id, stretch ORDER BY start_index, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
d AS (SELECT *, sum(CASE WHEN labels IS NOT NULL AND start_index <= reach + 5 THEN 0 ELSE 1 END)
  OVER (PARTITION BY animal_id, stretch ORDER BY start_index, bout_id) AS run FROM c),
r AS (SELECT animal_id, any_value(labels) AS labels, min(start_index) AS start_index, max(stop) AS stop_index,
  count(*) AS n_events, CAST(sum(lengths) AS BIGINT) AS duration FROM d GROUP BY animal_id, stretch, run)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _RUNS + "SELECT animal_id, start_index, stop_index FROM r WHERE n_events >= 2",
        "p3_runs": _RUNS + "SELECT animal_id, labels, start_index, stop_index, n_events, duration FROM r",
    }

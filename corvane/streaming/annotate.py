"""The concordance of documents as they arrive: extraction and linear annotation keep no state, so a stream needs none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import contexts as X
from corvane.operators import near as N
from corvane.operators.syntax import heuristic_table


def annotated(docs: DataFrame, nodes: list[str], field: dict[str, list[str]], near: int, band: int, **lists) -> DataFrame:
    """Hits of a stream (or table) of documents (doc_id, text, source, lang), as the concordance shows them."""
    h = N.hit_table(N.windows(X.contexts(docs), nodes, field, near, band), field, near)
    return heuristic_table(N.linear_flags(h, **lists)).drop("tok")


def unique_hits(h: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Hits of a stream without repeats of one place (doc_id, line, idx), as far back as late data may come."""
    return h.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc_id", "line", "idx"])


def term_counts(h: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, term, n): hits of each term by arrival time."""
    return h.withWatermark(time, late).groupBy(F.window(time, window), "term").agg(F.count(F.lit(1)).alias("n"))

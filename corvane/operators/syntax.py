"""The annotation of hits as the concordance shows it, from the heuristic relation or from parsed tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed


def orientation(relation: Column, nuclear: Column) -> Column:
    """Which of term and node is said of the other; of what is not nuclear, of something else."""
    return F.when(nuclear & relation.isin("nominal_composto", "nominal_genitiva", "adverbial"), "no_sobre_termo").when(nuclear, "termo_sobre_no").otherwise("termo_sobre_outro")


def governor(word: Column, form: Column, head: Column) -> Column:
    """The governor of a term, which is never the term itself: then the head of the property."""
    return F.when((word != "") & (F.lower(word) == F.lower(form)), F.coalesce(head, F.lit(""))).otherwise(F.coalesce(word, F.lit("")))


def heuristic_table(h: DataFrame) -> DataFrame:
    """h (relation, node, negated) with nuclear, motive, orientation, governor, path and negation."""
    nuclear = F.col("relation").isin(fixed.NUCLEAR)
    return h.withColumns(
        {
            "nuclear": nuclear,
            "motive": F.when(nuclear, "").otherwise(F.col("relation")),
            "orientation": F.when(nuclear, "termo_sobre_no").otherwise(""),
            "governor": F.when(nuclear, F.col("node")).otherwise(""),
            "path": F.lit(""),
            "negation": F.when(F.col("negated"), "directo").otherwise("nao"),
            "classified_by": F.lit("heuristica"),
        }
    )

"""Writing results: Parquet tables are the record; TSV, Markdown and term files are for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One Parquet table for each result; a name is a table's folder."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8, tabs, a header in each part; arrays are joined by semicolons, tabs and line ends in texts are blanks."""
    flat = [F.array_join(F.col(f"`{f.name}`").cast("array<string>"), "; ").alias(f.name) if f.dataType.typeName() == "array" else F.regexp_replace(F.col(f"`{f.name}`").cast("string"), r"[\t\r\n]+", " ").alias(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """(value): the lines of a Markdown table, in an order; the header comes first.

    Lines are rows, so a long table is written in parts and never gathered.
    """
    cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|") for c in df.columns]
    body = df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    head = df.sparkSession.createDataFrame([(f"| {' | '.join(df.columns)} |",), ("|" + "-|" * len(df.columns),)], "value string")
    return head.coalesce(1).unionByName(body)


def write_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("value").write.mode(mode).text(path)

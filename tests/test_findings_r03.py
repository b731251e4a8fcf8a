from corvane.operators import biblio as B
from pyspark.sql import functions as F


def test_year_suffixes_go_on_by_code_point(spark):
    works = spark.range(1, 401).select(F.col("id").alias("doc_id"), F.lit("Silva, A.").alias("autores"), F.lit("1999").alias("ano"), F.lit("t").alias("titulo"), F.lit("p").alias("path"))
    got = {r.doc_id: r.suffix for r in B.with_year_suffixes(works).collect()}
    assert got == {i: chr(96 + i) for i in range(1, 401)}
    far = spark.createDataFrame([(55199,), (55200,), (57248,), (70000,), (2_000_000,)], "n int").select(B.nth_letter(F.col("n"))).collect()
    assert [r[0] for r in far] == ["퟿", "-55200", "", chr(70096), "-2000000"]

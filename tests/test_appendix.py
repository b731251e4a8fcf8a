import pytest
from corvane.operators import appendix as E
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,form,want",
    [
        ("the texture is uniform, in ora", "uniform", "the texture is uniform"), ("the texture is, very uniform", "uniform", "the texture is, very uniform"), ("a whole sentence, it ends.", "x", "a whole sentence, it ends."),
        ("the uniform texture of the", "texture", "the uniform texture"), ("the uniform texture spr", "texture", "the uniform texture"), ("a uniform texture of the and in on", "texture", "a uniform texture of the"), ("one of the", "the", "one of the"),
        ("", "x", ""), ("texture: one two three four", "x", "texture: one two three four"), ("some texture, and", "and", "some texture, and"),
    ],
)
def test_excerpts_are_cleaned(spark, text, form, want):
    assert one(spark, E.cleaned(F.col("t"), E.protected(F.col("f"))), t=text, f=form) == want


def test_excerpts_and_probes(spark):
    assert one(spark, E.unwrapped(F.col("t")), t="«...  – The texture» ...") == "The texture"
    assert one(spark, E.excerpt(F.col("t"), F.lit("12"), F.col("f")), t="... the uniform texture of the", f="texture") == '"… the uniform texture…" (p. 12)'
    assert one(spark, E.excerpt(F.col("t"), F.lit(None).cast("string"), F.col("f")), t=None, f="x") == '"… …"'
    text = " ".join(f"wordy{c}" for c in "abcdefghijklmnopqrst")
    got = one(spark, E.probes(F.col("t")), t=text)
    n = len(text)
    assert got[0] in (text[:80].strip(), text[-80:].strip()) and text[n // 4 : 3 * n // 4].strip() in got and sorted(map(len, got), reverse=True) == list(map(len, got))
    assert "wordyj wordyk wordyl" in got and one(spark, E.probes(F.col("t")), t="short") == []

import random

from corvane.functions import text as T
from corvane.operators import near as N
from pyspark.sql import functions as F

NODES = ["the", "la", "être"]
FIELD = {"ther": ["ther*"], "pair": ["of this", "with th*"], "form": ["*form"], "erti": ["*erti*"]}
PIECES = ["the", "The", "LA", "être", "ÊTRE", "ther", "therm-ic", "of", "this", "with", "than", "uni-form", "form", "conform", "inertia", "x-erti", "the's", "the-", "l'the", "word", "d’un", "kΩthe", "12", "the1", "Kthe"]
BREAKS = [" ", " ", " ", " ", "  ", ", ", ". ", "; ", " - ", "- ", "' ", "\t", " ", "\r", "_", "￿", " ... ", "—"]


def lines(n):
    rnd = random.Random(5)
    return ["".join(rnd.choice(PIECES) + rnd.choice(BREAKS) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_only_rows_without_hits_are_left_out(spark):
    ctx = spark.createDataFrame([(i, 0, "s", "en", t) for i, t in enumerate(lines(3000))], "doc_id long, line int, source string, lang string, context string")
    whole = N.hits(N.windows(ctx, NODES, FIELD, 4, 12), "ref", "far", "near_tokens").collect()
    close = N.windows(ctx, NODES, FIELD, 4, 12, only_hits=True)
    assert len(whole) > 500 and sorted(map(tuple, N.hits(close, "ref", "far", "near_tokens").collect())) == sorted(map(tuple, whole))
    assert close.select("doc_id").count() < N.windows(ctx, NODES, FIELD, 4, 12).select("doc_id").count()


def test_shortcuts_leave_texts_as_the_plain_rules_do(spark):
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in lines(3000)] + [(None,), ("",), (" a",), ("a\n",), ("a- b- c",), ("é  è",)], "t string")
    glued = F.regexp_replace(F.regexp_replace(t, r"[\n\r]", " "), rf"({T.ANY_WORD})-{T.SPACE}+({T.ANY_WORD})", "$1$2")
    plain = F.regexp_replace(glued, f"{T.SPACE}+", " ")
    cut = lambda s, p: F.transform(F.regexp_extract_all(s, F.lit(p), F.lit(0)), lambda x: F.lower(x))
    sents = F.transform(F.split(F.concat(t, F.lit(" ")), T.boundary()), lambda s: cut(s, T.TOKEN))
    assert df.where(~T.normalise(t, False).eqNullSafe(plain) | ~T.sentences(t).eqNullSafe(sents) | ~T.gaps(t).eqNullSafe(F.split(t, T.TOKEN)) | ~T.tokens(t, T.QUERY_TOKEN).eqNullSafe(cut(t, T.QUERY_TOKEN))).count() == 0

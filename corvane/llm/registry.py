"""The queries of this subpackage, and the SQL of those that SQL can express."""

from corvane.llm import ans, bpe, decontaminate, langid, lm, neardup, quality, sharding, substring, topk

QUERIES = {
    "op1_topk": topk.query,
    "op2_decontaminate": decontaminate.query,
    "op3_bpe": bpe.query,
    "op4_quality": quality.query,
    "op5_token_files": ans.query,
    "op6_neardup": neardup.query,
    "op7_sharding": sharding.query,
    "op8_langid": langid.query,
    "op9_substring": substring.query,
    "op10_lm": lm.query,
}


def sql() -> dict[str, str]:
    return {"op1_topk": topk.SQL, "op2_decontaminate": decontaminate.SQL, "op7_sharding": sharding.sql(), "op9_substring": substring.SQL}

import math

import duckdb
import pytest
from corvane.plans import profile as P
from corvane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events lineitem orders customer part supplier nation region".split()


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["t_tokens", "t_sentences", "m_richness_docs"])
def test_lines_without_a_node_count(spark, duck, name):
    docs = duck.execute(f"WITH {registry.LINES} SELECT count(DISTINCT doc_id) FROM ctx WHERE regexp_matches(context, '[A-Za-z]')").fetchone()[0]
    assert registry.QUERIES[name](spark, SF).select("doc_id").distinct().count() >= docs


def test_lines_without_a_node_link_documents(spark, tmp_path):
    line = "one two three four five six seven eight nine"
    assert "|".join(P.NODES) not in line and not any(n in line for n in P.NODES)
    spark.createDataFrame([(1, line, "s", "en"), (2, line, "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in registry.QUERIES["d_citations"](spark, str(tmp_path)).collect()] == [(1, 2)]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_the_cap_on_rows_of_a_gram_has_an_uncapped_form(spark):
    from corvane.operators import dedupe as D

    line = "one two three four five six seven eight".split()
    rows = spark.createDataFrame([(i, 0, line) for i in range(40)], "doc_id long, line int, tok array<string>")
    assert D.citation_pairs(rows).count() == 0 and D.citation_pairs(rows, most=None).count() == 39

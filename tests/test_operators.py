import math

import numpy as np
import pytest
from corvane.functions import text as T
from corvane.operators import query as Q
from corvane.operators import stats as S
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "query,tree",
    [
        ("a AND b OR c", Q.Op("OR", (Q.Op("AND", (Q.Term(("a",)), Q.Term(("b",)))), Q.Term(("c",))))),
        ("orchestral*", Q.Term(("orchestral*",))),
        ("notable", Q.Term(("notable",))),
        ("text*AND b", Q.Op("AND", (Q.Term(("text*",)), Q.Term(("b",))))),
        ('"AND" NEAR/3 x', Q.Op("NEAR", (Q.Term(("and",)), Q.Term(("x",))), 3)),
        ("very even NOR b", Q.Op("NOR", (Q.Term(("very", "even")), Q.Term(("b",))))),
    ],
)
def test_parser(query, tree):
    assert Q.parse(query) == tree


@pytest.mark.parametrize("query", ["", "(a", "a )", "AND a", "a NEAR/2", 'x "open'])
def test_parser_errors(query):
    with pytest.raises(ValueError):
        Q.parse(query)


def test_search_spans_and_forms(spark):
    ctx = spark.createDataFrame([(1, 0, "The even texture is not even"), (2, 0, "smooth, uniform texture")], "doc_id long, line int, context string")
    rows = Q.search(ctx, "textur* NEAR/1 (even OR uniform)").orderBy("doc_id").collect()
    assert [(r.doc_id, sorted(r.forms)) for r in rows] == [(1, ["even", "texture"]), (2, ["texture", "uniform"])]
    assert Q.search(ctx, "textur* NEAR/2 NOT even").count() == 0


def test_patterns():
    import re

    assert re.match(T.extract_pattern("uniform*"), "uniformity") and not re.match(T.extract_pattern("uniform*"), "uniform-like")
    assert re.match(T.extract_pattern("*form"), "di-form") and not re.match(T.extract_pattern("*form"), "uniform")
    assert re.match(T.query_pattern("t?xt*"), "textural") and not re.match(T.query_pattern("t?xt"), "text2x")


def test_text_functions_on_nulls(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    out = df.select(T.normalise(F.col("t")).alias("n"), T.plain(F.col("t")).alias("p"), T.doi(F.col("t")).alias("d")).collect()
    assert tuple(out[0]) == (None, None, None) and tuple(out[1]) == ("", "", "")


def test_exact_tests():
    assert S.fisher_exact(5, 0, 1, 3) == pytest.approx(10 / 210, rel=1e-6)
    assert S.binomial_two_sided(5, 10, 0.5) == pytest.approx(1.0)
    assert S.bayes_factor(5, 10) == pytest.approx(0.3694, abs=1e-4)
    assert S.bayes_factor(1157, 1157) == math.inf and math.isnan(S.bayes_factor(3, 2))


def test_small_kernels():
    low, high = S.bootstrap_ci(np.arange(100.0), 500)
    assert low < 49.5 < high
    rows, cols, inertia = S.correspondence(np.array([[10.0, 2, 3], [1, 9, 4], [3, 3, 12]]))
    assert rows.shape == (3, 2) and inertia[0] >= inertia[1] > 0
    merges = S.ward(np.array([[0.0], [0.1], [5.0], [5.2]]))
    assert [m[:2] for m in merges[:2]] == [(0, 1), (2, 3)] and merges[-1][3] == 4


def test_logistic_recovers_coefficients(spark):
    df = spark.range(4000).select((F.rand(1) * 4 - 2).alias("x"), F.rand(2).alias("u"))
    df = df.select("x", (F.col("u") < 1 / (1 + F.exp(-(0.5 + 1.5 * F.col("x"))))).alias("y")).cache()
    got = S.logistic(df, "y", ["x"])
    assert got["intercept"] == pytest.approx(0.5, abs=0.2) and got["x"] == pytest.approx(1.5, abs=0.2)


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([("a", "x", 0.01), ("a", "y", 0.04), ("a", "z", 0.03), ("b", "w", 0.2)], "f string, name string, p double")
    got = {r.name: r.p_adj for r in S.adjusted(p, ["f"]).collect()}
    assert got == {"x": 0.03, "y": 0.04, "z": 0.04, "w": 0.2}


def test_permutation_test(spark):
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 9, 12), rnd.integers(2, 11, 15)
    rows = [(int(v), 1, 0) for v in a] + [(int(v), 0, 1) for v in b] + [(None, 1, 0)]
    difference, p = S.permutation_test(spark.createDataFrame(rows, "v int, a int, b int"), "v", "a", "b")
    both = np.concatenate([a, b])
    shuffled = [rnd.permutation(both) for _ in range(10000)]
    brute = np.mean([abs(s[:12].mean() - s[12:].mean()) >= abs(difference) - 1e-12 for s in shuffled])
    assert difference == pytest.approx(a.mean() - b.mean()) and p == pytest.approx(brute, abs=0.02)
    assert math.isnan(S.permutation_test(spark.createDataFrame(rows[:12], "v int, a int, b int"), "v", "a", "b")[1])


def test_monte_carlo():
    chi2, p, draws = S.monte_carlo(np.array([[5, 0], [1, 3]]))
    assert chi2 == pytest.approx(2.7563, abs=1e-3) and 0 < p < 0.2 and draws == 20000
    assert S.monte_carlo(np.array([[40, 2, 3], [2, 50, 4], [1, 3, 60]]))[1] == pytest.approx(1 / 20001)
    assert math.isnan(S.monte_carlo(np.array([[3, 4], [0, 0]]))[1])


def test_firth_is_finite_where_the_outcome_is_separated(spark):
    df = spark.createDataFrame([(float(v), v > 0) for v in (-3, -2, -1, 1, 2, 3)], "x double, y boolean").cache()
    got = S.logistic(df, "y", ["x"], firth=True)
    x, y = np.array([-3.0, -2, -1, 1, 2, 3]), np.array([0, 0, 0, 1, 1, 1])

    def penalised(b):
        p = 1 / (1 + np.exp(-b * x))
        w = p * (1 - p)
        return np.sum(np.log(np.where(y == 1, p, 1 - p))) + 0.5 * np.log(w.sum() * (w * x * x).sum() - (w * x).sum() ** 2)

    grid = np.linspace(0.01, 5, 4991)
    assert got["x"] == pytest.approx(grid[np.argmax([penalised(b) for b in grid])], abs=2e-3)
    assert got["intercept"] == pytest.approx(0, abs=1e-6)

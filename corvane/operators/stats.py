"""Statistics: closed forms as expressions, and small numpy kernels on aggregated tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import fixed


def association(o11: Column, o12: Column, r1: Column, r2: Column, windows: Column) -> dict[str, Column]:
    """Measures of a 2x2 table: o11 of r1 near tokens, o12 of r2 tokens farther off; windows are those with a node.

    All are null without tokens or without the term.
    """
    a, b, n1, n2, w = (c.cast("double") for c in (o11, o12, r1, r2, windows))
    n, k = n1 + n2, a + b
    c, d = n1 - a, n2 - b
    e11, e12, e21, e22 = n1 * k / n, n2 * k / n, n1 * (c + d) / n, n2 * (c + d) / n
    part = lambda o, e: F.when((o > 0) & (e > 0), 2 * o * F.ln(o / e)).otherwise(0.0)
    g2 = part(a, e11) + part(b, e12) + part(c, e21) + part(d, e22)
    odds = ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))
    se = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5))
    dice = 2 * a / (w + k)
    some = (n > 0) & (k > 0)
    of = lambda when, value, digits: F.round(F.when(some & when, value), digits)
    yes = F.lit(True)
    return {
        "e11": of(yes, e11, 3),
        "g2": of(yes, F.when(a >= e11, g2).otherwise(-g2), 3),
        "mi": of((a > 0) & (e11 > 0), F.log2(a / e11), 3),
        "mi3": of((a > 0) & (e11 > 0), F.log2(a * a * a / e11), 3),
        "t": of(a > 0, (a - e11) / F.sqrt(a), 3),
        "z": of(e11 > 0, (a - e11) / F.sqrt(e11), 3),
        "log_dice": of((w + k > 0) & (a > 0), 14 + F.log2(dice), 3),
        "delta_p": of((n1 > 0) & (n2 > 0), a / n1 - b / n2, 5),
        "odds": of(yes, odds, 3),
        "ci_low": of(yes, F.exp(F.ln(odds) - 1.96 * se), 3),
        "ci_high": of(yes, F.exp(F.ln(odds) + 1.96 * se), 3),
    }


MEASURES = ["e11", "g2", "mi", "mi3", "t", "z", "log_dice", "delta_p", "odds", "ci_low", "ci_high"]


def association_sheet(nuclear: DataFrame, band: DataFrame, mass: DataFrame, least_docs: int = 5) -> DataFrame:
    """One row a term: counts, measures, documents, and dispersion where it has at least least_docs of them; by odds.

    nuclear (doc_id, term) are reviewed hits, band (term, n) those of the band, mass
    (r1, r2, windows) one row.  Without tokens counted, r1 is three a window and r2 is r1.
    """
    counts = nuclear.groupBy("term").agg(F.count(F.lit(1)).alias("o11"), F.countDistinct("doc_id").alias("docs"))
    both = counts.join(band.select("term", F.col("n").alias("o12")), "term", "left").join(F.broadcast(mass), F.lit(True))  # mass is one row
    r1 = F.when(F.col("r1") > 0, F.col("r1")).otherwise(F.greatest(F.col("windows") * 3, F.lit(1)))
    both = both.withColumn("o12", F.coalesce("o12", F.lit(0).cast("long"))).withColumn("n1", r1).withColumn("n2", F.when(F.col("r2") > 0, F.col("r2")).otherwise(F.col("n1")))
    m = association(F.col("o11"), F.col("o12"), F.col("n1"), F.col("n2"), F.col("windows"))
    spread = dispersion(nuclear.groupBy("term", F.col("doc_id").alias("part")).agg(F.count(F.lit(1)).alias("n")), nuclear.groupBy(F.col("doc_id").alias("part")).agg(F.count(F.lit(1)).alias("size")))
    out = both.select("term", "o11", "o12", F.col("n1").alias("r1"), F.col("n2").alias("r2"), "windows", "docs", *[m[c].alias(c) for c in MEASURES]).join(spread, "term", "left")
    shown = lambda c: F.when(F.col("docs") >= least_docs, F.col(c)).alias(c)
    return out.select(*[c for c in out.columns if c not in ("dp", "juilland")], shown("dp"), shown("juilland")).orderBy(F.desc("odds"), "term")


def null_pole(band: DataFrame, labels: list[str], stable: list[str]) -> DataFrame:
    """(p0): the stable share of the band's terms, or of the labels where the band has none."""
    share = sum(x in stable for x in labels) / max(1, len(labels))
    n = band.where(F.col("term").isin(labels)).agg(F.sum(F.when(F.col("term").isin(stable), F.col("n")).otherwise(0)).alias("e"), F.sum("n").alias("t"))
    return n.select(F.round(F.when(F.col("t") > 0, F.col("e") / F.col("t")).otherwise(share), 6).alias("p0"))


def log_ratio(o1: Column, n1: Column, o2: Column, n2: Column, k: float = 0.5) -> Column:
    return F.round(F.when((n1 > 0) & (n2 > 0), F.log2(((o1 + k) / (n1 + 2 * k)) / ((o2 + k) / (n2 + 2 * k)))), 4)


def diversity(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Shannon, Pielou and inverse Simpson of counts within each group of by; evenness of one type is null."""
    total = Window.partitionBy(*by)
    p = counts.withColumn("_p", F.col(n) / F.sum(n).over(total))
    out = p.groupBy(*by).agg(F.sum(-F.col("_p") * F.ln("_p")).alias("h"), F.count(F.lit(1)).alias("types"), (1 / F.sum(F.col("_p") * F.col("_p"))).alias("d"))
    return out.select(*by, "types", F.round("h", 4).alias("shannon"), F.round(F.when(F.col("types") > 1, F.col("h") / F.ln("types")), 4).alias("pielou"), F.round("d", 4).alias("inv_simpson"))


def dispersion(counts: DataFrame, parts: DataFrame) -> DataFrame:
    """Gries' DP and Juilland's D of each term over all parts; counts (term, part, n), parts (part, size).

    Totals are one row each and parts meet counts on their keys: nothing is gathered.
    """
    whole = parts.agg(F.sum("size").alias("whole"), F.count(F.lit(1)).alias("k"))
    terms = counts.groupBy("term").agg(F.sum("n").alias("of_term"))
    met = counts.join(parts, "part").join(terms, "term").join(F.broadcast(whole), F.lit(True))
    share, obs = F.col("size") / F.col("whole"), F.col("n") / F.col("of_term")
    out = met.groupBy("term").agg(F.sum(F.abs(obs - share) - share).alias("s"), F.sum("n").alias("sx"), F.sum(F.col("n") * F.col("n")).alias("sxx"), F.first("k").alias("k"))
    mean, k = F.col("sx") / F.col("k"), F.col("k")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("sxx") / k - mean * mean))
    return out.select("term", F.round((F.col("s") + 1) / 2, 4).alias("dp"), F.round(F.when(k > 1, 1 - sd / mean / F.sqrt(k - 1)), 4).alias("juilland"))


def adjusted(p: DataFrame, family: list[str]) -> DataFrame:
    """Benjamini-Hochberg within each family: p (family.., name, p) with p_adj."""
    by = Window.partitionBy(*family)
    ranked = p.withColumns({"_m": F.count(F.lit(1)).over(by), "_r": F.row_number().over(by.orderBy("p", "name"))})
    back = by.orderBy(F.col("p").desc(), F.col("name").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_adj", F.round(F.least(F.lit(1.0), F.min(F.col("p") * F.col("_m") / F.col("_r")).over(back)), 6)).drop("_m", "_r")


def richness(counts: DataFrame, by: list[str]) -> DataFrame:
    """TTR, Herdan's C, Guiraud's R and hapax count from (by.., tok, n)."""
    out = counts.groupBy(*by).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.sum((F.col("n") == 1).cast("int")).cast("long").alias("hapax"))
    v, n = F.col("types"), F.col("tokens")
    return out.select(*by, "tokens", "types", "hapax", F.round(v / n, 4).alias("ttr"), F.round(F.when(n > 1, F.ln(v) / F.ln(n)), 4).alias("herdan"), F.round(v / F.sqrt(n), 4).alias("guiraud"))


def chi_square(table: DataFrame, a: str, b: str, n: str = "n", by: list[str] = (), corrected: bool = False) -> DataFrame:
    """Pearson's statistic, degrees of freedom and Cramer's V of a table (by.., a, b, n), for each group of by.

    corrected: 2x2 tables with Yates' correction.  least_e is the least expected
    count; determined says that a settles b (one column a row, or V of 0.999 and more).
    Without two rows and columns statistic and V are null.
    """
    by = list(by)
    key = [F.lit(1).alias("_g")] if not by else []
    table = table.select(*by, *key, a, b, F.col(n).alias("_n")).where("_n > 0")
    g = by or ["_g"]
    rows = table.groupBy(*g, a).agg(F.sum("_n").alias("ra"), F.count(F.lit(1)).alias("cols"))
    cols, total = table.groupBy(*g, b).agg(F.sum("_n").alias("cb")), table.groupBy(*g).agg(F.sum("_n").alias("t"), F.countDistinct(a).alias("i"), F.countDistinct(b).alias("j"))
    cells = rows.join(cols, g).join(total, g).join(table, [*g, a, b], "left")
    e = F.col("ra") * F.col("cb") / F.col("t")
    gap = F.abs(F.coalesce(F.col("_n"), F.lit(0)) - e)
    if corrected:
        gap = F.when((F.col("i") == 2) & (F.col("j") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = cells.groupBy(*g).agg(F.sum(gap * gap / e).alias("x"), F.min(e).alias("least"), F.max("cols").alias("most"), F.first("i").alias("i"), F.first("j").alias("j"), F.first("t").alias("t"))
    fits = F.least("i", "j") > 1
    v = F.when(fits, F.sqrt(F.col("x") / F.col("t") / (F.least("i", "j") - 1)))
    return out.select(*by, F.round(F.when(fits, F.col("x")), 4).alias("chi2"), ((F.col("i") - 1) * (F.col("j") - 1)).alias("df"), F.round(v, 4).alias("cramers_v"), F.round("least", 4).alias("least_e"), ((F.col("most") <= 1) | F.coalesce(v >= 0.999, F.lit(False))).alias("determined"))


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def log_factorials(n: int) -> np.ndarray:
    """Of 0 .. n."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the tables with these margins that are no more likely than this one."""
    r, k, n = a + b, a + c, a + b + c + d
    x = np.arange(max(0, k - (n - r)), min(r, k) + 1)
    f = log_factorials(n)
    logs = f[r] - f[x] - f[r - x] + f[n - r] - f[k - x] - f[n - r - k + x] - (f[n] - f[k] - f[n - k])
    return float(min(1.0, np.exp(logs[logs <= logs[a - x[0]] + 1e-7]).sum()))


def log_binomial(k: float, n: float, p: float) -> float:
    return log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x) if front else 1.0
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    out = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out / a


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """The outcomes that are no more likely than k; each tail is summed by a closed form, its end found by halving."""
    if not 0 < p < 1:
        return 1.0 if k == n * p else 0.0
    at_most = lambda j: 0.0 if j < 0 else 1.0 if j >= n else incomplete_beta(n - j, j + 1, 1 - p)
    at_least = lambda j: 1.0 if j <= 0 else 0.0 if j > n else incomplete_beta(j, n - j + 1, p)
    bar = log_binomial(k, n, p) + 1e-7
    mode = min(n, int((n + 1) * p))
    if log_binomial(mode, n, p) <= bar:
        return 1.0
    rare = lambda j: log_binomial(j, n, p) <= bar
    if k < mode:  # the least rare outcome above the mode; n + 1 if there is none
        low, high = mode, n + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if rare(mid) else (mid, high)
        return min(1.0, at_most(k) + at_least(high))
    low, high = -1, mode
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if rare(mid) else (low, mid)
    return min(1.0, at_most(low) + at_least(k))


def chi_square_tail(x: float, df: float) -> float:
    """The upper tail of a chi-square distribution: a series for small x, else a continued fraction."""
    a, x = df / 2, x / 2
    if not x > 0 or df <= 0:
        return 1.0 if x <= 0 else math.nan
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = out = 1 / a
        for i in range(1, 10_000):
            term *= x / (a + i)
            out += term
            if term < out * 1e-16:
                break
        return 1.0 - front * out
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 10_000):
        t = -i * (i - a)
        b += 2
        d = 1 / (t * d + b or 1e-300)
        c = b + t / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def bayes_factor(k: float, n: float, p0: float = 0.5) -> float:
    """Evidence for an unknown share (uniform) against p0."""
    if n is None or k is None or not n > 0 or not 0 <= k <= n or not 0 < p0 < 1:
        return math.nan
    log = math.lgamma(k + 1) + math.lgamma(n - k + 1) - math.lgamma(n + 2) - k * math.log(p0) - (n - k) * math.log(1 - p0)
    return math.inf if log >= 700 else 0.0 if log <= -700 else round(math.exp(log), 4)


def kernel(df: DataFrame, name: str, function, *columns: str) -> DataFrame:
    """function over columns of an aggregated table, Arrow batches at a time."""

    @F.pandas_udf("double")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([float(function(*row)) for row in zip(*values)], dtype="float64")

    return df.withColumn(name, F.round(run(*columns), 6))


def bootstrap_ci(values: np.ndarray, reps: int = 5000, seed: int = 20260724) -> tuple[float, float]:
    """Percentile interval of the mean, in chunks so memory follows the sample."""
    rng = np.random.default_rng(seed)
    step = max(1, (1 << 22) // max(1, len(values)))
    means = np.concatenate([values[rng.integers(0, len(values), (min(step, reps - i), len(values)))].mean(1) for i in range(0, reps, step)])
    return tuple(np.percentile(means, [2.5, 97.5]))


def share_interval(df: DataFrame, k: str, n: str, reps: int = 5000, seed: int = 20260724) -> DataFrame:
    """df with low and high: the percentile interval of a share k / n by resampling.

    A sample of n draws has a binomial number of successes, so counts are drawn, not rows.
    """

    @F.pandas_udf("low double, high double")
    def run(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(k, n):
            shares = np.random.default_rng(seed).binomial(int(b), a / b, reps) / b if b else np.array([np.nan])
            out.append(tuple(np.round(np.percentile(shares, [2.5, 97.5]), 4)))
        return pd.DataFrame(out, columns=["low", "high"])

    return df.withColumn("_ci", run(k, n)).select(*df.columns, "_ci.low", "_ci.high")


def correspondence(table: np.ndarray, dims: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column coordinates and inertias of a small table; axes signed by their largest row."""
    p = table / table.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, vt = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    u, v = u * sign, vt.T * sign
    return (u * s / np.sqrt(r)[:, None])[:, :dims], (v * s / np.sqrt(c)[:, None])[:, :dims], s[:dims] ** 2


def ward(x: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Ward's merges of a few rows by the Lance-Williams rule: (a, b, height, size)."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    size, live, out, dist = {i: 1 for i in range(n)}, list(range(n)), [], {(i, j): d[i, j] for i in range(n) for j in range(i + 1, n)}
    for new in range(n, 2 * n - 1):
        a, b = min(((i, j) for k, i in enumerate(live) for j in live[k + 1 :]), key=lambda p: (dist[p], p))
        h = dist[a, b]
        out.append((a, b, math.sqrt(h), size[a] + size[b]))
        live = [k for k in live if k not in (a, b)]
        for k in live:
            ka, kb, s = dist[min(a, k), max(a, k)], dist[min(b, k), max(b, k)], size[a] + size[b] + size[k]
            dist[k, new] = ((size[a] + size[k]) * ka + (size[b] + size[k]) * kb - size[k] * h) / s
        size[new] = size[a] + size[b]
        live.append(new)
    return out


def shuffled_difference(x: np.ndarray, a: np.ndarray, b: np.ndarray, reps: int, seed: int) -> tuple[float, float]:
    """Difference of the means of two groups of values x counted by a and b, and its two-sided p by shuffling.

    A shuffle deals values without replacement, so it is drawn from the counts;
    memory follows the distinct values, not the rows.
    """
    if not a.sum() or not b.sum():
        return math.nan, math.nan
    both, n_a, n_b = (a + b).astype(np.int64), int(a.sum()), int(b.sum())
    seen = float(x @ a / n_a - x @ b / n_b)
    rng, hits, step = np.random.default_rng(seed), 0, max(1, (1 << 22) // len(x))
    for i in range(0, reps, step):
        drawn = rng.multivariate_hypergeometric(both, n_a, min(step, reps - i), method="marginals") @ x
        hits += int((np.abs(drawn / n_a - (x @ both - drawn) / n_b) >= abs(seen) - 1e-12).sum())
    return seen, (hits + 1) / (reps + 1)


def permutation(groups: DataFrame, value: str, first: str, second: str, reps: int = 10000, seed: int = 20260724) -> DataFrame:
    """(difference, p) of groups (value, first, second), which count rows by value; run when the result is read."""
    counted = groups.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(first).cast("double").alias("a"), F.sum(second).cast("double").alias("b"))

    def run(batches):
        t = pd.concat([pd.DataFrame(columns=["x", "a", "b"], dtype=float), *batches])
        t = t.sort_values("x")
        yield pd.DataFrame([shuffled_difference(*(t[c].to_numpy(float) for c in ("x", "a", "b")), reps, seed)], columns=["difference", "p"])

    return counted.select(F.col(value).cast("double").alias("x"), "a", "b").coalesce(1).mapInPandas(run, "difference double, p double")


def permutation_test(groups: DataFrame, value: str, first: str, second: str, reps: int = 10000, seed: int = 20260724) -> tuple[float, float]:
    """permutation, as two numbers."""
    r = permutation(groups, value, first, second, reps, seed).first()
    return tuple(math.nan if v is None else v for v in (r.difference, r.p))


def monte_carlo(table: np.ndarray, draws: int = 20000, tries: int = 20, least: int = 200, seed: int = 20260724) -> tuple[float, float, int]:
    """Chi-square of a small table (2x2: corrected for continuity), its p by tables drawn from its margins, and the draws used.

    Draws with an empty row or column do not count; if too few are left, a 2x2
    table has Fisher's p and a larger one has none.
    """
    table = np.asarray(table, float)
    total, e = table.sum(), np.outer(table.sum(1), table.sum(0)) / max(1.0, table.sum())
    if min(table.shape) < 2 or not e.all():
        return math.nan, math.nan, 0
    gap = np.abs(table - e)
    if table.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    seen, rng, hits, used = float((gap**2 / e).sum()), np.random.default_rng(seed), 0, 0
    for _ in range(tries):
        drawn = rng.multinomial(int(total), (e / total).ravel(), draws).reshape(draws, *table.shape).astype(float)
        expected = drawn.sum(2)[:, :, None] * drawn.sum(1)[:, None, :] / total
        good = np.flatnonzero(expected.all((1, 2)))[: draws - used]
        chi = ((drawn[good] - expected[good]) ** 2 / expected[good]).sum((1, 2))
        hits, used = hits + int((chi >= seen - 1e-12).sum()), used + len(good)
        if used >= draws:
            break
    if used >= least:
        return seen, (hits + 1) / (used + 1), used
    return seen, fisher_exact(*table.astype(int).ravel().tolist()) if table.shape == (2, 2) else math.nan, used


def contingency(table: np.ndarray, draws: int = 20000, least: int = 200, seed: int = 20260725) -> dict:
    """The test of a table: chi-square by its distribution, or by drawn tables where a cell expects under 5.

    A table with fewer than two rows or columns that hold anything has no test.
    """
    table = np.asarray(table, float)
    table = table[table.sum(1) > 0][:, table.sum(0) > 0] if table.size else table
    if table.ndim < 2 or min(table.shape) < 2:
        return {"method": "inaplicavel", "chi2": math.nan, "p": math.nan, "cramers_v": math.nan, "draws": 0}
    total = table.sum()
    e = np.outer(table.sum(1), table.sum(0)) / total
    gap = np.abs(table - e)
    if table.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    x = float((gap**2 / e).sum())
    v = math.sqrt(x / (total * (min(table.shape) - 1)))
    if (e >= 5).all():
        return {"method": "assintotico", "chi2": x, "p": chi_square_tail(x, (table.shape[0] - 1) * (table.shape[1] - 1)), "cramers_v": v, "draws": None}
    _, p, used = monte_carlo(table, draws, least=least, seed=seed)
    method = "Monte Carlo" if used >= least else "Fisher exacto" if table.shape == (2, 2) else "Monte Carlo"
    return {"method": method, "chi2": x, "p": p, "cramers_v": v, "draws": used}


def contingency_tests(table: DataFrame, by: str, a: str, b: str, n: str = "n") -> DataFrame:
    """(by, method, chi2, p, cramers_v, draws) of the table of each group; a group is as large as its table of counts."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        got = contingency(t.pivot_table(index=a, columns=b, values=n, aggfunc="sum", fill_value=0).to_numpy())
        row = {by: t[by].iloc[0], **got, "draws": -1 if got["draws"] is None else got["draws"]}
        return pd.DataFrame([row])[[by, "method", "chi2", "p", "cramers_v", "draws"]]

    return table.select(by, a, b, n).groupBy(by).applyInPandas(run, f"{by} {dict(table.dtypes)[by]}, method string, chi2 double, p double, cramers_v double, draws long")


def profiles(h: DataFrame, term: str = "term", least: int = 1, relations: list[str] = tuple(fixed.NUCLEAR + fixed.NOT_NUCLEAR)) -> DataFrame:
    """Of each term with enough hits: shares of left side, negation, modality and each relation, and the mean distance."""
    mean = lambda c: F.round(F.avg(c.cast("double")), 4)
    out = h.groupBy(F.col(term).alias("term")).agg(
        F.count(F.lit(1)).alias("n"),
        mean(F.col("side") == "esq").alias("left"),
        mean(F.col("distance")).alias("distance"),
        mean(F.col("negated")).alias("negated"),
        mean(F.col("modal")).alias("modal"),
        *[mean(F.col("relation") == r).alias(f"rel_{r}") for r in relations],
    )
    return out.where(F.col("n") >= least)


def dendrogram(profile: DataFrame) -> DataFrame:
    """(step, a, b, height, size): Ward's merges of standardised profiles, one row a term; terms are numbered by name."""

    def run(batches):
        t = pd.concat(list(batches) or [pd.DataFrame({"term": []})]).sort_values("term")
        x = t.drop(columns=["term", "n"], errors="ignore").to_numpy(float)
        if len(x) < 3:
            return
        sd = x.std(0)
        merges = ward((x - x.mean(0)) / np.where(sd == 0, 1, sd))
        yield pd.DataFrame([(i, *m) for i, m in enumerate(merges)], columns=["step", "a", "b", "height", "size"])

    return profile.coalesce(1).mapInPandas(run, "step long, a long, b long, height double, size long")


def correspondence_plane(table: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """(kind, name, dim1, dim2) of rows and columns of a small table of counts (a, b, n)."""

    def run(batches):
        t = pd.concat(list(batches) or [pd.DataFrame({a: [], b: [], n: []})])
        wide = t.pivot_table(index=a, columns=b, values=n, aggfunc="sum", fill_value=0)
        if min(wide.shape) < 2:
            return
        rows, cols, _ = correspondence(wide.to_numpy(float))
        both = [("row", wide.index, rows), ("column", wide.columns, cols)]
        yield pd.DataFrame([(k, str(name), round(float(c[0]), 4), round(float(c[1]) if len(c) > 1 else 0.0, 4)) for k, names, xs in both for name, c in zip(names, xs)], columns=["kind", "name", "dim1", "dim2"])

    return table.select(a, b, n).coalesce(1).mapInPandas(run, "kind string, name string, dim1 double, dim2 double")


def design(df: DataFrame, numeric: list[str], categories: list[str], least: int = 10) -> tuple[DataFrame, list[str], list[str]]:
    """df with columns x0, x1 ... of a model, their names, and the levels pooled.

    Numbers are standardised; levels of fewer than least rows are pooled; the most
    frequent level (ties: the first by name) is the reference.
    """
    moments = df.agg(*[f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if numeric else None
    columns, names, pooled = [F.lit(1.0).alias("x0")], ["intercept"], []
    for c in numeric:
        columns.append(((F.col(c) - F.lit(moments[f"m_{c}"])) / F.lit(moments[f"s_{c}"] or 1.0)).cast("double").alias(f"x{len(columns)}"))
        names.append(f"{c} (standardised)")
    for c in categories:
        value = F.coalesce(F.col(c).cast("string"), F.lit("null"))
        counts = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("k"))
        frequent = counts.where(F.col("k") >= least).orderBy(F.desc("k"), "v").collect()  # a level is least rows at the least
        rare = counts.where(F.col("k") < least).agg(F.sum("k").alias("k"), F.sort_array(F.collect_list("v")).alias("v")).first()
        levels = [(r.v, r.k) for r in frequent] + ([("outras", rare.k)] if rare.k else [])
        pooled += [f"{c}:{v}" for v in rare.v or []]
        levels.sort(key=lambda x: (-x[1], x[0]))
        known = [v for v, _ in levels if v != "outras"]
        level = F.when(value.isin(known), value).otherwise("outras")
        for v, _ in levels[1:]:
            columns.append((level == v).cast("double").alias(f"x{len(columns)}"))
            names.append(f"{c}: {v} vs {levels[0][0]}")
    return df.select("*", *columns), names, pooled


def regression(df: DataFrame, y: str, numeric: list[str], categories: list[str], least: int = 10, cluster: str | None = None) -> tuple[list[dict], dict]:
    """A logistic model of y (boolean): its terms and its fit; Firth's penalty where coefficients run away, CR1 errors by cluster.

    Every sum over rows is Spark's; only vectors and matrices as wide as the model come here.
    """
    df = df.where(F.col(y).isNotNull())
    n, k = df.agg(F.count(F.lit(1)), F.sum(F.col(y).cast("long"))).first()
    if not n or k in (0, n):
        return [], {"warning": "constant response"}
    rows, names, pooled = design(df, numeric, categories, least)
    x = [f"x{i}" for i in range(len(names))]
    beta = np.array(list(logistic(rows, y, x[1:]).values()))
    p = lambda b: 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), sum((F.lit(float(v)) * F.col(c) for v, c in zip(b, x)), F.lit(0.0))))))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]

    def information(b):
        w = F.greatest(F.lit(1e-9), p(b) * (1 - p(b)))
        h = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, rows.agg(*[F.sum(w * F.col(x[i]) * F.col(x[j])) for i, j in pairs]).first()):
            h[i, j] = h[j, i] = v
        return np.linalg.pinv(h)

    cov = information(beta)
    firth = bool((np.abs(beta) > 10).any() or (np.sqrt(np.clip(np.diag(cov), 0, None)) > 100).any())
    if firth:
        beta = np.array(list(logistic(rows, y, x[1:], firth=True).values()))
        cov = information(beta)
    se = np.sqrt(np.clip(np.diag(cov), 0, None))
    if cluster:
        scores = rows.groupBy(cluster).agg(*[F.sum(F.col(c) * (F.col(y).cast("double") - p(beta))).alias(c) for c in x])
        got = scores.agg(F.count(F.lit(1)), *[F.sum(F.col(x[i]) * F.col(x[j])) for i, j in pairs]).first()
        meat = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, got[1:]):
            meat[i, j] = meat[j, i] = v
        scale = got[0] / max(1, got[0] - 1) * (n - 1) / max(1, n - len(x))
        se = np.sqrt(np.clip(np.diag(scale * cov @ meat @ cov), 0, None))
    ll = F.sum(F.when(F.col(y), F.ln(F.greatest(F.lit(1e-12), p(beta)))).otherwise(F.ln(F.greatest(F.lit(1e-12), 1 - p(beta)))))
    loglik, right = rows.agg(ll, F.avg(((p(beta) > 0.5) == F.col(y)).cast("double"))).first()
    share = k / n
    base = n * (share * math.log(share) + (1 - share) * math.log(1 - share))
    z = np.divide(beta, se, out=np.zeros_like(beta), where=se > 0)
    bound = lambda v: math.exp(min(50.0, max(-50.0, v)))
    terms = [{"term": t, "coef": round(b, 4), "se": round(s, 4), "odds": round(bound(b), 4), "ci_low": round(bound(b - 1.96 * s), 4), "ci_high": round(bound(b + 1.96 * s), 4), "z": round(v, 3), "p": math.erfc(abs(v) / math.sqrt(2))} for t, b, s, v in zip(names, beta.tolist(), se.tolist(), z.tolist())]
    fit = {"n": n, "log_likelihood": round(loglik, 3), "mcfadden": round(1 - loglik / base, 4), "aic": round(-2 * loglik + 2 * len(x), 3), "accuracy": round(right, 4), "base_rate": round(max(share, 1 - share), 4), "errors": f"CR1 ({cluster})" if cluster else "model", "firth": firth, "pooled": pooled}
    return terms, fit


def logistic(df: DataFrame, y: str, numeric: list[str], rounds: int = 60, tolerance: float = 1e-9, firth: bool = False) -> dict[str, float]:
    """Newton's method; each round sums the normal equations over all rows, and a small system is solved here.

    firth adds Firth's penalty, which keeps coefficients finite where the outcome is separated.
    """
    names = ["intercept", *numeric]
    beta = np.zeros(len(names))
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in numeric]]
    for _ in range(rounds):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        w = p * (1 - p)
        pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        rest = F.col(y).cast("double") - p
        got = df.agg(*[F.sum(w * x[i] * x[j]) for i, j in pairs], *[F.sum(rest * c) for c in x]).first()
        h = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, got):
            h[i, j] = h[j, i] = v
        score = np.array(got[len(pairs) :], float)
        if firth:  # each row's leverage needs the information of all rows first
            inverse = np.linalg.inv(h)
            leverage = w * sum((F.lit(float(inverse[i, j])) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
            score = score + np.array(df.agg(*[F.sum(leverage * (0.5 - p) * c) for c in x]).first(), float)
        step = np.linalg.solve(h, score)
        if firth:
            step = step / max(1.0, float(np.abs(step).max()) / 5)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return dict(zip(names, beta.tolist()))

"""Frequencies and statistics over the concordance and the driver's other tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import contexts as X
from corvane.operators import near as N
from corvane.operators import stats as S
from corvane.operators import triage as G
from corvane.plans import profile as P
from corvane.plans.base import AGREED, BAND, FLAGS, HITS, MASS, REF, TOKENS, TRIAGED, agreed, close, ctx, flagged, hits, quoted, register, table, triaged, windows, file_path



def rows():
    return F.count(F.lit(1)).alias("n")


@register("g_cooccurrence", f"WITH {HITS} SELECT a.term AS term_a, b.term AS term_b, count(*) AS n FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.line = b.line AND a.term < b.term GROUP BY ALL ORDER BY n DESC, term_a, term_b LIMIT 200")
def g_cooccurrence(spark, sf_dir):
    """Pairs of terms within a row, made in the row: it has one hit a term."""
    sets = close(spark, sf_dir).select(F.array_sort(F.col("found.term")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice(F.col("t"), i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("term_a"), b.alias("term_b")))))
    found = sets.select(F.explode_outer(pairs).alias("p")).where("p is not null")
    return found.groupBy("p.term_a", "p.term_b").agg(rows()).orderBy(F.desc("n"), "term_a", "term_b").limit(200)


@register("g_crosstab", f"WITH {FLAGS} SELECT relation, CASE WHEN term IN {quoted(P.STABLE)} THEN 'E' WHEN term IN {quoted(P.VARIABLE)} THEN 'V' END AS pole, count(*) AS n FROM flagged GROUP BY ALL")
def g_crosstab(spark, sf_dir):
    return flagged(spark, sf_dir).groupBy("relation", T.pole(F.col("term"), P.STABLE, P.VARIABLE).alias("pole")).agg(rows())


@register("g_crosstab_terms", f"WITH {FLAGS} SELECT term, count(*) FILTER (relation = 'predicativa') AS predicativa, count(*) FILTER (relation = 'atributiva') AS atributiva, count(*) FILTER (relation = 'indeterminada') AS indeterminada FROM flagged GROUP BY term")
def g_crosstab_terms(spark, sf_dir):
    """Terms against relations, relations side by side."""
    out = flagged(spark, sf_dir).groupBy("term").pivot("relation", ["predicativa", "atributiva", "indeterminada"]).agg(F.count(F.lit(1)))
    return out.na.fill(0)


@register("g_crosstab_axes", f"WITH {FLAGS} SELECT relation, CASE WHEN term IN {quoted(P.SYNCHRONIC)} AND term NOT IN {quoted(P.DIACHRONIC)} THEN 'sincronico' WHEN term IN {quoted(P.DIACHRONIC)} AND term NOT IN {quoted(P.SYNCHRONIC)} THEN 'diacronico' ELSE 'ambos' END AS axis, count(*) AS n FROM flagged GROUP BY ALL")
def g_crosstab_axes(spark, sf_dir):
    return flagged(spark, sf_dir).groupBy("relation", T.axis(F.col("term"), P.SYNCHRONIC, P.DIACHRONIC).alias("axis")).agg(rows())


@register("g_forms", f"WITH {HITS} SELECT term, form, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY ALL")
def g_forms(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("term", "form").agg(rows(), F.countDistinct("doc_id").alias("n_docs"))


@register("g_distance", f"WITH {HITS} SELECT side, distance, count(*) AS n FROM hits GROUP BY ALL")
def g_distance(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("side", "distance").agg(rows())


@register("g_copresence", f"WITH {HITS}, d AS (SELECT DISTINCT doc_id, term FROM hits), m AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n FROM d a JOIN d b USING (doc_id) GROUP BY ALL) SELECT * FROM m WHERE EXISTS (SELECT 1 FROM m WHERE term_a <> term_b)")
def g_copresence(spark, sf_dir):
    """Terms found in one work; none where the matrix is diagonal. A work has one set of terms, no longer than the field."""
    sets = hits(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("term").alias("t"))
    pairs = F.flatten(F.transform("t", lambda a: F.transform("t", lambda b: F.struct(a.alias("term_a"), b.alias("term_b")))))
    m = sets.select(F.explode_outer(pairs).alias("p")).groupBy("p.term_a", "p.term_b").agg(rows())
    return m.withColumn("_off", F.max(F.col("term_a") != F.col("term_b")).over(Window.partitionBy())).where("_off").drop("_off")  # as many rows as pairs of labels


@register("g_flow", f"WITH {HITS} SELECT form AS origin, CAST(doc_id AS VARCHAR) AS target, count(*) AS n FROM hits GROUP BY ALL ORDER BY n DESC, origin, target LIMIT 80")
def g_flow(spark, sf_dir):
    return hits(spark, sf_dir).groupBy(F.col("form").alias("origin"), F.col("doc_id").cast("string").alias("target")).agg(rows()).orderBy(F.desc("n"), "origin", "target").limit(80)


@register("g_flow_relations", f"WITH {FLAGS}, f AS (SELECT term AS origin, relation AS target FROM flagged UNION ALL SELECT relation, {('CASE WHEN term IN ' + quoted(P.STABLE) + ' THEN ' + chr(39) + 'E' + chr(39) + ' ELSE ' + chr(39) + 'V' + chr(39) + ' END')} FROM flagged) SELECT origin, target, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, origin, target LIMIT 120")
def g_flow_relations(spark, sf_dir):
    """Term to relation, and relation to pole: both steps come from one pass over hits."""
    pole = F.when(F.col("term").isin(P.STABLE), "E").otherwise("V")
    steps = F.array(F.struct(F.col("term").alias("origin"), F.col("relation").alias("target")), F.struct(F.col("relation").alias("origin"), pole.alias("target")))
    f = flagged(spark, sf_dir).select(F.explode_outer(steps).alias("s"))
    return f.groupBy("s.origin", "s.target").agg(rows()).orderBy(F.desc("n"), "origin", "target").limit(120)


@register(
    "g_summary",
    f"WITH {AGREED} SELECT count(*) AS hits, count(*) FILTER (nuclear) AS nuclear, count(DISTINCT (doc_id, line)) AS contexts, count(DISTINCT (doc_id, line)) FILTER (nuclear) AS nuclear_contexts, count(DISTINCT doc_id) AS docs, count(DISTINCT (doc_id, term)) FILTER (nuclear) AS work_terms, round(avg(distance), 4) AS mean_distance, quantile_cont(distance, 0.5) AS median_distance FROM agreed",
)
def g_summary(spark, sf_dir):
    """The cascade from hits to works."""
    n = F.col("nuclear")
    return agreed(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum(n.cast("long")).alias("nuclear"),
        F.countDistinct("doc_id", "line").alias("contexts"),
        F.countDistinct(F.when(n, F.struct("doc_id", "line"))).alias("nuclear_contexts"),
        F.countDistinct("doc_id").alias("docs"),
        F.countDistinct(F.when(n, F.struct("doc_id", "term"))).alias("work_terms"),
        F.round(F.avg("distance"), 4).alias("mean_distance"),
        F.percentile("distance", 0.5).alias("median_distance"),
    )


@register("g_to_review", f"WITH {TRIAGED} SELECT source || '/' || doc_id || '.txt' AS path, count(*) AS n_hits, count(*) FILTER (nuclear) AS n_nuclear FROM triaged WHERE domain = 'por_rever' GROUP BY path")
def g_to_review(spark, sf_dir):
    return G.to_review(triaged(spark, sf_dir), file_path())


@register(
    "g_checklist",
    f"""WITH {TRIAGED}, c AS (SELECT count(*) AS n, count(*) FILTER (nuclear) AS n_nuclear, count(*) FILTER (nuclear AND relation NOT IN ('atributiva', 'predicativa')) AS bad_relation, count(*) FILTER (nuclear AND form IN {quoted(P.FRIENDS)}) AS false_friends,
  count(*) FILTER (nuclear AND term NOT IN {quoted(P.STABLE + P.VARIABLE)}) AS no_pole, CAST(0 AS BIGINT) AS no_axis, count(*) FILTER (nuclear AND domain = 'por_rever') AS open_domain, count(*) FILTER (doc_id % 2 = 0) AS reviewed FROM triaged),
w AS (SELECT *, CAST(false_friends > 0 AS INTEGER) + CAST(no_pole > 0 AS INTEGER) + CAST(no_axis > 0 AS INTEGER) + CAST(open_domain > 0 AS INTEGER) + CAST(reviewed < n AS INTEGER) AS warnings, CAST(bad_relation > 0 AS INTEGER) + CAST(n_nuclear = 0 AS INTEGER) AS errors FROM c)
SELECT *, greatest(0, least(100, 100 - 25 * CAST(bad_relation > 0 AS INTEGER) - 8 * warnings - CASE WHEN n_nuclear = 0 THEN 30 ELSE 0 END)) AS score FROM w""",
)
def g_checklist(spark, sf_dir):
    """The state of a concordance of which documents with even ids are reviewed."""
    h = triaged(spark, sf_dir).withColumns({"pole": T.pole(F.col("term"), P.STABLE, P.VARIABLE), "axis": T.axis(F.col("term"), P.SYNCHRONIC, P.DIACHRONIC), "reviewed": F.when(F.col("doc_id") % 2 == 0, "sim")})
    return G.checklist(h, P.FRIENDS)


@register("g_revision_rate", f"WITH {AGREED}, t AS (SELECT doc_id, line, idx, nuclear AS before FROM triaged) SELECT round(avg(CAST(before <> nuclear AS INTEGER)), 6) AS changed FROM agreed a JOIN t USING (doc_id, line, idx)")
def g_revision_rate(spark, sf_dir):
    """The share of hits whose nuclear a later stage changed."""
    key = ["doc_id", "line", "idx"]
    before = triaged(spark, sf_dir).select(*key, F.col("nuclear").alias("before"))
    return agreed(spark, sf_dir).join(before, key).agg(F.round(F.avg((F.col("before") != F.col("nuclear")).cast("int")), 6).alias("changed"))


LEXICON = [(k, v) for k, v in P.FIELD.items()]


@register("g_lexicon", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{', '.join(v)}', {repr('estabilidade') if k in P.STABLE else repr('variabilidade') if k in P.VARIABLE else repr('')}, {repr('homogeneidade_sincronica') if k in P.SYNCHRONIC and k not in P.DIACHRONIC else repr('invariancia_diacronica') if k in P.DIACHRONIC and k not in P.SYNCHRONIC else repr('ambos')})" for k, v in LEXICON) + ") t(label, patterns, pole, axis)")
def g_lexicon(spark, sf_dir):
    """The field as run."""
    from corvane.sources.lexicon import effective

    return spark.createDataFrame(effective(P.FIELD, P.STABLE, P.VARIABLE, P.SYNCHRONIC, P.DIACHRONIC), "label string, patterns string, pole string, axis string")


VALUES = f"""{HITS}, {REF}, {BAND}, {MASS}, c AS (SELECT term, sum(a) AS a, sum(b) AS b FROM (SELECT term, count(*) AS a, 0 AS b FROM hits GROUP BY term UNION ALL SELECT term, 0, count(*) FROM far GROUP BY term) GROUP BY term),
v AS (SELECT term, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(r1 AS DOUBLE) AS n1, CAST(r2 AS DOUBLE) AS n2, CAST(windows AS DOUBLE) AS w FROM c, mass)"""


def part(o: str, e: str) -> str:
    return f"CASE WHEN {o} > 0 AND {e} > 0 THEN 2 * {o} * ln({o} / ({e})) ELSE 0 END"


E = {"11": "n1 * (a + b) / (n1 + n2)", "12": "n2 * (a + b) / (n1 + n2)", "21": "n1 * (n1 - a + n2 - b) / (n1 + n2)", "22": "n2 * (n1 - a + n2 - b) / (n1 + n2)"}
G2 = f"({part('a', E['11'])} + {part('b', E['12'])} + {part('(n1 - a)', E['21'])} + {part('(n2 - b)', E['22'])})"
ODDS = "((a + .5) * (n2 - b + .5)) / ((b + .5) * (n1 - a + .5))"
SE = "sqrt(1 / (a + .5) + 1 / (b + .5) + 1 / (n1 - a + .5) + 1 / (n2 - b + .5))"
MEASURES_SQL = f"""round({E["11"]}, 3) AS e11, round(CASE WHEN a >= {E["11"]} THEN {G2} ELSE -{G2} END, 3) AS g2, round(CASE WHEN a > 0 THEN log2(a / ({E["11"]})) END, 3) AS mi, round(CASE WHEN a > 0 THEN log2(a * a * a / ({E["11"]})) END, 3) AS mi3,
  round(CASE WHEN a > 0 THEN (a - {E["11"]}) / sqrt(a) END, 3) AS t, round((a - {E["11"]}) / sqrt({E["11"]}), 3) AS z, round(CASE WHEN a > 0 THEN 14 + log2(2 * a / (w + a + b)) END, 3) AS log_dice, round(a / n1 - b / n2, 5) AS delta_p, round({ODDS}, 3) AS odds,
  round(exp(ln({ODDS}) - 1.96 * {SE}), 3) AS ci_low, round(exp(ln({ODDS}) + 1.96 * {SE}), 3) AS ci_high"""


@register("m_association", f"WITH {VALUES} SELECT term, CAST(a AS BIGINT) AS o11, CAST(b AS BIGINT) AS o12, {MEASURES_SQL} FROM v")
def m_association(spark, sf_dir):
    """Terms near the node against the band beyond: counts of both come from one pass over rows."""
    own = windows(spark, sf_dir).select("found.term", F.col("far.term").alias("far"), "near_tokens", "band_tokens")
    steps = F.concat(F.transform("term", lambda t: F.struct(t.alias("t"), F.lit(1).alias("a"))), F.transform("far", lambda t: F.struct(t.alias("t"), F.lit(0).alias("a"))))
    mass = F.struct(F.lit(None).cast("string").alias("t"), F.lit(2).alias("a"))
    flat = own.select("near_tokens", "band_tokens", F.explode(F.concat(steps, F.array(mass))).alias("s"))
    one = lambda a: F.sum((F.col("s.a") == a).cast("long"))
    whole = lambda c: F.sum(F.when(F.col("s.a") == 2, F.col(c)))
    g = flat.groupBy(F.col("s.t").alias("term")).agg(one(1).alias("o11"), one(0).alias("o12"), whole("near_tokens").alias("r1"), whole("band_tokens").alias("r2"), one(2).alias("windows"))
    every = Window.partitionBy()  # one row a label, and one of totals
    g = g.withColumns({c: F.max(c).over(every) for c in ("r1", "r2", "windows")}).where("term is not null")
    m = S.association(F.col("o11"), F.col("o12"), F.col("r1"), F.col("r2"), F.col("windows"))
    return g.select("term", "o11", "o12", *[m[c].alias(c) for c in S.MEASURES])


@register(
    "m_association_sheet",
    f"""WITH {AGREED}, {BAND}, {MASS}, nuc AS (SELECT doc_id, term FROM agreed WHERE nuclear), k AS (SELECT term, count(*) AS o11, count(DISTINCT doc_id) AS docs FROM nuc GROUP BY term), fb AS (SELECT term, count(*) AS n FROM far GROUP BY term),
v AS (SELECT k.*, CAST(o11 AS DOUBLE) AS a, CAST(coalesce(n, 0) AS DOUBLE) AS b, CAST(r1 AS DOUBLE) AS n1, CAST(r2 AS DOUBLE) AS n2, CAST(windows AS DOUBLE) AS w FROM k LEFT JOIN fb USING (term), mass),
sized AS (SELECT doc_id, count(*) AS size FROM nuc GROUP BY doc_id), grid AS (SELECT term, coalesce(count(nuc.doc_id), 0) AS n, any_value(size) AS size FROM (SELECT term, doc_id, size FROM k, sized) g LEFT JOIN nuc USING (term, doc_id) GROUP BY term, doc_id),
d AS (SELECT term, round(sum(abs(n / t - size / z)) / 2, 4) AS dp, round(1 - stddev_pop(n) / avg(n) / sqrt(count(*) - 1), 4) AS juilland FROM (SELECT *, sum(n) OVER (PARTITION BY term) AS t, sum(size) OVER (PARTITION BY term) AS z FROM grid) GROUP BY term)
SELECT term, o11, CAST(b AS BIGINT) AS o12, CAST(n1 AS BIGINT) AS r1, CAST(n2 AS BIGINT) AS r2, CAST(w AS BIGINT) AS windows, docs, {MEASURES_SQL}, CASE WHEN docs >= 5 THEN dp END AS dp, CASE WHEN docs >= 5 THEN juilland END AS juilland FROM v JOIN d USING (term)""",
)
def m_association_sheet(spark, sf_dir):
    """The association of nuclear hits, with dispersion over works."""
    from corvane.operators.tables import settle

    own = windows(spark, sf_dir)
    nuclear = settle(agreed(spark, sf_dir).where("nuclear").select("doc_id", "term"), "nuclear")
    return S.association_sheet(nuclear, N.band_hits(own), N.token_mass(own))


@register("m_fisher", "WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels JOIN documents USING (doc_id) GROUP BY lang), l AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS m FROM c), x AS (SELECT lang, a, b, c, d, x, m - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lp, m - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS own FROM l, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS u(x)) SELECT lang, a, b, c, d, round(least(1, sum(exp(lp)) FILTER (lp <= own + 1e-7)), 6) AS p FROM x GROUP BY ALL")
def m_fisher(spark, sf_dir):
    """Quality against toxicity in each language, exactly."""
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    on = lambda q, t: F.sum(((F.col("quality") == q) & (F.col("toxic") == t)).cast("long"))
    c = docs.groupBy("lang").agg(on(1, 1).alias("a"), on(1, 0).alias("b"), on(0, 1).alias("c"), on(0, 0).alias("d"))
    return S.kernel(c, "p", lambda *x: S.fisher_exact(*map(int, x)), "a", "b", "c", "d")


@register("m_diversity", "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT lang, count(*) AS types, round(sum(-p * ln(p)), 4) AS shannon, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) END, 4) AS pielou, round(1 / sum(p * p), 4) AS inv_simpson FROM p GROUP BY lang")
def m_diversity(spark, sf_dir):
    return S.diversity(table(spark, sf_dir, "documents").groupBy("lang", "source").agg(rows()), ["lang"])


@register("m_dispersion", """WITH c AS (SELECT event_type AS term, user_id % 20 AS part, count(*) AS n FROM events GROUP BY ALL), parts AS (SELECT user_id % 20 AS part, count(*) AS size FROM events GROUP BY ALL),
g AS (SELECT term, p.part, coalesce(n, 0) AS n, size / sum(size) OVER (PARTITION BY term) AS share FROM (SELECT DISTINCT term FROM c) t CROSS JOIN parts p LEFT JOIN c USING (term, part))
SELECT term, round(sum(abs(n / s - share)) / 2, 4) AS dp, round(1 - stddev_pop(n) / avg(n) / sqrt(count(*) - 1), 4) AS juilland FROM (SELECT *, sum(n) OVER (PARTITION BY term) AS s FROM g) GROUP BY term""")
def m_dispersion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("term"), (F.col("user_id") % 20).alias("part"))
    return S.dispersion(e.groupBy("term", "part").agg(rows()), e.groupBy("part").agg(F.count(F.lit(1)).alias("size")))


@register("m_chi_square", """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT x.a, y.b, x.ra * y.cb / CAST(t AS DOUBLE) AS e, coalesce(n, 0) AS n, t FROM (SELECT a, sum(n) AS ra FROM c GROUP BY a) x CROSS JOIN (SELECT b, sum(n) AS cb FROM c GROUP BY b) y CROSS JOIN (SELECT sum(n) AS t FROM c) LEFT JOIN c USING (a, b))
SELECT round(sum((n - e) ** 2 / e), 4) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, round(sqrt(sum((n - e) ** 2 / e) / any_value(t) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 4) AS cramers_v FROM g""")
def m_chi_square(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(rows())
    return S.chi_square(c, "a", "b").select("chi2", "df", "cramers_v")


YATES = """WITH c AS (SELECT lang, quality AS a, toxic AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IN (0, 1) AND toxic IN (0, 1) GROUP BY ALL),
g AS (SELECT r.lang, r.a, k.b, ra * cb / CAST(t AS DOUBLE) AS e, coalesce(n, 0) AS n, t FROM (SELECT lang, a, sum(n) AS ra FROM c GROUP BY ALL) r JOIN (SELECT lang, b, sum(n) AS cb FROM c GROUP BY ALL) k USING (lang) JOIN (SELECT lang, sum(n) AS t FROM c GROUP BY lang) USING (lang) LEFT JOIN c ON c.lang = r.lang AND c.a = r.a AND c.b = k.b),
s AS (SELECT lang, sum((abs(n - e) - least(0.5, abs(n - e))) ** 2 / e) AS x, min(e) AS least, any_value(t) AS t, count(*) AS cells FROM g GROUP BY lang)"""


@register("m_contingency", f"{YATES} SELECT lang, round(CASE WHEN cells = 4 THEN x END, 4) AS chi2, round(CASE WHEN cells = 4 THEN sqrt(x / t) END, 4) AS cramers_v, round(least, 4) AS least_e, CASE WHEN cells < 4 THEN 'inaplicavel' WHEN least < 5 THEN 'Monte Carlo' ELSE 'assintotico' END AS method FROM s")
def m_contingency(spark, sf_dir):
    """Quality against toxicity in each language: the statistic, the effect, and the test that applies."""
    c = quality_by_language(spark, sf_dir)
    out = S.chi_square(c, "quality", "toxic", by=["lang"], corrected=True)
    method = F.when(F.col("chi2").isNull(), "inaplicavel").when(F.col("least_e") < 5, "Monte Carlo").otherwise("assintotico")
    return out.select("lang", "chi2", "cramers_v", "least_e", method.alias("method"))


def quality_by_language(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").where("quality in (0, 1) and toxic in (0, 1)").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return docs.groupBy("lang", "quality", "toxic").agg(rows())


@register("m_contingency_tests")
def m_contingency_tests(spark, sf_dir):
    """The same tests with their p, drawn by simulation where a cell expects under 5."""
    return S.contingency_tests(quality_by_language(spark, sf_dir), "lang", "quality", "toxic")


@register("m_log_ratio", "WITH c AS (SELECT toxic, count(*) FILTER (quality = 1) AS o, count(*) AS n FROM labels GROUP BY toxic) SELECT round(log2(((a.o + .5) / (a.n + 1)) / ((b.o + .5) / (b.n + 1))), 4) AS log_ratio FROM c a, c b WHERE a.toxic = 1 AND b.toxic = 0")
def m_log_ratio(spark, sf_dir):
    on = lambda t, q=None: F.sum(((F.col("toxic") == t) & (F.lit(True) if q is None else F.col("quality") == q)).cast("int"))
    return table(spark, sf_dir, "labels").agg(S.log_ratio(on(1, 1), on(1), on(0, 1), on(0)).alias("log_ratio"))


RICH = "CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS hapax"
RATIOS = "round(types / tokens, 4) AS ttr, round(CASE WHEN tokens > 1 THEN ln(types) / ln(tokens) END, 4) AS herdan, round(types / sqrt(tokens), 4) AS guiraud"


@register("m_richness", f"WITH {HITS}, c AS (SELECT form, count(*) AS n FROM hits GROUP BY form), v AS (SELECT {RICH} FROM c) SELECT *, {RATIOS} FROM v")
def m_richness(spark, sf_dir):
    """Lexical richness of the hits' forms."""
    return S.richness(hits(spark, sf_dir).groupBy("form").agg(rows()), [])


@register("m_richness_docs", f"WITH {TOKENS}, c AS (SELECT doc_id, tok, count(*) AS n FROM tok GROUP BY ALL), v AS (SELECT doc_id, {RICH} FROM c GROUP BY doc_id) SELECT *, {RATIOS} FROM v")
def m_richness_docs(spark, sf_dir):
    """Lexical richness of the tokens of each document, of all lines."""
    return S.richness(X.token_rows(ctx(spark, sf_dir)).groupBy("doc_id", "tok").agg(rows()), ["doc_id"])


@register("m_bayes", "WITH c AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS k, count(*) AS n FROM events GROUP BY event_type), l AS (SELECT *, -ln(n + 1) - (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) + n * ln(2) AS b FROM c) SELECT event_type, k, n, CASE WHEN b > 700 THEN CAST('inf' AS DOUBLE) ELSE round(round(exp(greatest(b, -700)), 4), 6) END AS bayes FROM l")
def m_bayes(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum((F.col("user_id") % 2 == 0).cast("long")).alias("k"), rows())
    return S.kernel(c, "bayes", S.bayes_factor, "k", "n")


@register("m_null_pole", f"WITH {HITS}, {REF}, {BAND} SELECT round(count(*) FILTER (term IN {quoted(P.STABLE)}) / CAST(count(*) AS DOUBLE), 6) AS p0 FROM far WHERE term IN {quoted(P.FIELD)}")
def m_null_pole(spark, sf_dir):
    """The stable share that the band would lead one to expect."""
    return S.null_pole(N.band_hits(windows(spark, sf_dir)), list(P.FIELD), P.STABLE)


@register("m_difference", "SELECT round(avg(n_chars) FILTER (toxic = 1) - avg(n_chars) FILTER (toxic = 0), 4) AS difference FROM documents JOIN labels USING (doc_id)")
def m_difference(spark, sf_dir):
    """Difference in mean length between toxic and other documents."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    mean = lambda t: F.avg(F.when(F.col("toxic") == t, F.col("n_chars")))
    return docs.agg(F.round(mean(1) - mean(0), 4).alias("difference"))


@register("m_permutation")
def m_permutation(spark, sf_dir):
    """The same difference, with its p by shuffling."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    on = lambda t: F.sum((F.col("toxic") == t).cast("long"))
    counts = docs.groupBy(F.col("n_chars").alias("value")).agg(on(1).alias("toxic"), on(0).alias("other"))
    return S.permutation(counts, "value", "toxic", "other")


@register("m_bootstrap")
def m_bootstrap(spark, sf_dir):
    """The interval of the share of good documents in each language."""
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    c = docs.groupBy("lang").agg(F.sum(F.col("quality").cast("long")).alias("k"), rows())
    return S.share_interval(c, "k", "n")


BINOMIAL = "exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(0.8) + (n - x) * ln(0.2))"


@register("m_tests", f"WITH c AS (SELECT lang, source AS name, CAST(sum(quality) AS BIGINT) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL), x AS (SELECT *, {BINOMIAL} AS pmf, {BINOMIAL.replace('x', 'k').replace('ekp', 'exp')} AS own FROM c, unnest(range(0, n + 1)) AS u(x)), p AS (SELECT lang, name, k, n, round(least(1, sum(pmf) FILTER (pmf <= own * (1 + 1e-7))), 6) AS p FROM x GROUP BY ALL), r AS (SELECT *, count(*) OVER (PARTITION BY lang) AS m, row_number() OVER (PARTITION BY lang ORDER BY p, name) AS r FROM p) SELECT lang, name, k, n, p, round(least(1, min(p * m / r) OVER (PARTITION BY lang ORDER BY r DESC)), 6) AS p_adj FROM r")
def m_tests(spark, sf_dir):
    """Exact binomial tests by source, adjusted within each language."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    c = docs.groupBy("lang", F.col("source").alias("name")).agg(F.sum("quality").cast("long").alias("k"), rows())
    return S.adjusted(S.kernel(c, "p", lambda k, n: S.binomial_two_sided(int(k), int(n), 0.8), "k", "n"), ["lang"])


@register("m_profiles", f"WITH {FLAGS} SELECT term, count(*) AS n, round(avg(CAST(side = 'esq' AS INTEGER)), 4) AS \"left\", round(avg(distance), 4) AS distance, round(avg(CAST(negated AS INTEGER)), 4) AS negated, round(avg(CAST(modal AS INTEGER)), 4) AS modal, round(avg(CAST(relation = 'atributiva' AS INTEGER)), 4) AS rel_atributiva, round(avg(CAST(relation = 'predicativa' AS INTEGER)), 4) AS rel_predicativa, round(avg(CAST(relation = 'indeterminada' AS INTEGER)), 4) AS rel_indeterminada FROM flagged GROUP BY term")
def m_profiles(spark, sf_dir):
    return S.profiles(flagged(spark, sf_dir), relations=["atributiva", "predicativa", "indeterminada"])


@register("m_dendrogram")
def m_dendrogram(spark, sf_dir):
    """Terms grouped by their profiles."""
    return S.dendrogram(S.profiles(flagged(spark, sf_dir)))


@register("m_correspondence")
def m_correspondence(spark, sf_dir):
    """Terms and relations in one plane."""
    return S.correspondence_plane(flagged(spark, sf_dir).groupBy("term", "relation").agg(rows()), "term", "relation")


@register("m_regression")
def m_regression(spark, sf_dir):
    """Nuclear hits by distance, side and censoring, with errors by work."""
    from corvane.operators.tables import settle

    h = settle(flagged(spark, sf_dir).select("doc_id", "nuclear", "distance", "side", "cens_left", "cens_right"), "hits")
    terms, _ = S.regression(h, "nuclear", ["distance"], ["side", "cens_left", "cens_right"], cluster="doc_id")
    return spark.createDataFrame(terms or [], "term string, coef double, se double, odds double, ci_low double, ci_high double, z double, p double")

"""The second opinion on the concordance, and review passes over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions import text as T
from corvane.operators import dedupe as D
from corvane.operators import near as N
from corvane.operators import qa as A
from corvane.operators import review as V
from corvane.operators.tables import settle
from corvane.plans import profile as P
from corvane.plans.base import AGREED, FLAGS, FUSED, METATEXT, agreed, close, fold_sql, long_line, quoted, register, file_path
from corvane.plans.concordance import whole

SIG = f"""{AGREED},
q0 AS (SELECT *, doc_id * 1000000000 + line * 10000 + idx AS id, string_split({fold_sql("context")}, ' ') AS w FROM agreed),
q1 AS (SELECT *, array_to_string(w, '') AS s, len(w) AS nw FROM q0 WHERE w <> ['']),
sigs AS (SELECT id, list_distinct(CASE WHEN nw >= 8 THEN list_transform(range(1, nw - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN length(s) >= 24 THEN list_transform(range(1, length(s) - 22), lambda i: substr(s, i, 24)) ELSE [s] END) AS sig FROM q1),
qg AS (SELECT id, unnest(sig) AS gram FROM sigs),
qf AS (SELECT gram FROM qg GROUP BY gram HAVING count(*) BETWEEN 2 AND 25),
qp AS (SELECT a.id AS a, b.id AS b FROM qg a JOIN qf USING (gram) JOIN qg b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL HAVING count(*) >= 2),
qe AS (SELECT a, b FROM (SELECT a, b, len(list_intersect(x.sig, y.sig)) AS i, len(x.sig) AS n, len(y.sig) AS m FROM qp JOIN sigs x ON qp.a = x.id JOIN sigs y ON qp.b = y.id) WHERE i / CAST(n + m - i AS DOUBLE) >= 0.45 OR i / CAST(least(n, m) AS DOUBLE) >= 0.8),
qr(a, b) AS (SELECT a, a FROM (SELECT a FROM qe UNION SELECT b FROM qe) UNION SELECT r.a, e.b FROM qr r JOIN (SELECT a, b FROM qe UNION SELECT b, a FROM qe) e ON r.b = e.a),
near_dup AS (SELECT a AS id, min(b) AS first FROM qr GROUP BY a)"""


#: d_keeper looks at grams of any number of rows.
SIG_WHOLE = SIG.replace("HAVING count(*) BETWEEN 2 AND 25", "HAVING count(*) >= 2")


def second(spark, sf_dir, most=None):
    """Hits with the groups of near-equal windows."""
    h = settle(agreed(spark, sf_dir).withColumn("id", F.struct("doc_id", "line", "idx")).withColumn("passage", F.lit(None).cast("string")).withColumn("path", file_path()), "hits")
    return h, A.duplicate_groups(h, most=most)


@register("d_near_duplicates", f"WITH RECURSIVE {SIG} SELECT q0.doc_id, q0.line, q0.idx, f.doc_id AS first_doc, f.line AS first_line FROM near_dup d JOIN q0 USING (id) JOIN q0 f ON f.id = d.first")
def d_near_duplicates(spark, sf_dir):
    """Groups of near-equal windows."""
    _, groups = second(spark, sf_dir, A.MOST)
    line = lambda c: F.col(c).cast("long")
    return groups.select("id.doc_id", line("id.line").alias("line"), "id.idx", F.col("first.doc_id").alias("first_doc"), line("first.line").alias("first_line"))


@register("d_keeper", f"WITH RECURSIVE {SIG_WHOLE}, k AS (SELECT q0.*, first, row_number() OVER (PARTITION BY first, nuclear ORDER BY length(context) DESC, id) AS r FROM q0 JOIN near_dup USING (id)) SELECT doc_id, line, idx, NOT (nuclear AND r > 1) AS kept FROM k")
def d_keeper(spark, sf_dir):
    """Of each group of near-equal windows, the nuclear one that stays."""
    h, groups = second(spark, sf_dir)
    return long_line(A.grouped(h, groups).where("first is not null")).select("doc_id", "line", "idx", "kept")


NODE = r"(?:thing|nicht|the|der|la)"
GAP = r"(?:\w+\s+){0,3}"
COORDINATED = [
    ("t", rf"\s+of\s+(?:\w+\s+){{0,6}}?{NODE}\s+(?:and|e|,)\s+((?:\w+\s*){{1,3}})"),
    ("t", rf"s?\s+of\s+((?:\w+\s*,?\s*){{1,6}})\band\s+{GAP}{NODE}"),
    (rf"{NODE}\s+(?:is|are|was|were)?\s*", r"(?:ed|d|s)?\s+with\s+((?:\w+\s*){1,4})"),
    ("t", rf"(?:ed|d|s|ing)?\s+(?:\w+\s+){{0,2}}with\s+(?:\w+\s+){{0,2}}{NODE}\s+and\s+((?:\w+\s*){{1,3}})"),
]
LATER = [
    ("into_texture", "t", rf"(?:ed|s)?\s+(?:in)?to\s+(?:a|an|the|one)?\s*{GAP}{NODE}"),
    ("with_texture", "t", rf"(?:ed|s)?\s+with\s+(?:a|an|the)?\s*{GAP}{NODE}"),
    ("direct", "t", rf"\s+(?:of|de|d)\s+{GAP}{NODE}"),
    ("direct", rf"{NODE}\s+{GAP}", ""),
    ("direct", "t", rf"\s+{GAP}{NODE}"),
    ("direct", rf"{NODE}\s+(?:is|are|as)\s+(?:\w+\s+){{0,2}}", ""),
]
HEADS = ["for", "in", "to", "of", "this"]


def joined_pattern(a: str, b: str) -> str:
    return f"(t || '{b}')" if a == "t" else f"('{a}' || t || '{b}')"


def opinion_sql() -> str:
    cases = ["WHEN t = '' OR NOT contains(c, t) THEN struct_pack(r := 'absent', e := 'matched form not found in window')"]
    for a, b in COORDINATED:
        p = joined_pattern(a, b)
        cases.append(f"WHEN regexp_matches(c, {p}) AND list_has_any(regexp_split_to_array(trim(regexp_extract(c, {p}, 1)), '\\s+'), [{', '.join(repr(h) for h in HEADS)}]) THEN struct_pack(r := 'coord_heterog', e := trim(regexp_extract(c, {p}, 0)))")
    for name, a, b in LATER:
        p = joined_pattern(a, b)
        cases.append(f"WHEN regexp_matches(c, {p}) THEN struct_pack(r := '{name}', e := trim(regexp_extract(c, {p}, 0)))")
    cases.append(f"WHEN NOT regexp_matches(c, '{NODE}') THEN struct_pack(r := 'absent', e := 'no texture token in window')")
    return "CASE " + " ".join(cases) + " ELSE struct_pack(r := 'unresolved', e := '') END"


OPINION = f"""{AGREED}, folded AS (SELECT *, ' ' || {fold_sql("context")} || ' ' AS c, {fold_sql("form")} AS t FROM agreed), opinion AS (SELECT *, {opinion_sql()} AS o FROM folded)"""


@register("a_second_opinion", f"WITH {OPINION} SELECT doc_id, line, idx, o.r AS relation, o.e AS evidence FROM opinion")
def a_second_opinion(spark, sf_dir):
    """The link of term and node by patterns on the folded window."""
    h = agreed(spark, sf_dir).withColumn("o", A.classify(F.col("context"), F.col("form"), NODE, HEADS))
    return long_line(h).select("doc_id", "line", "idx", "o.relation", "o.evidence")


CUE = "CASE " + " ".join(f"WHEN contains(trim(c), '{w}') THEN '{d}'" for d, ws in {"legal": ["license", "copyright"], "common": ["with", "from"]}.items() for w in ws) + " END"


@register(
    "g_qa_report",
    f"""WITH {OPINION}, r AS (SELECT *, {CUE} AS d FROM opinion)
SELECT 'relation' AS measure, o.r AS key, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'domain', d, count(*) FROM r WHERE d IS NOT NULL GROUP BY d UNION ALL SELECT 'nuclear_but_suspect', '', count(*) FILTER (nuclear AND o.r IN ('absent', 'coord_heterog')) FROM r""",
)
def g_qa_report(spark, sf_dir):
    """What the second opinion found (groups of windows are d_near_duplicates)."""
    h = agreed(spark, sf_dir).withColumn("o", A.classify(F.col("context"), F.col("form"), NODE, HEADS))
    h = h.withColumn("qa_domain", A.domain_cue(F.col("context"), {"legal": ["license", "copyright"], "common": ["with", "from"]})["domain"])
    h = h.select("doc_id", "nuclear", F.col("o.relation").alias("qa_relation"), "qa_domain", F.lit(None).cast("string").alias("first"), F.lit(False).alias("tracked"))
    return A.report(settle(h, "opinion"))


MOTIVES = {"onin": "fora_da_classe", "therin": "fora_de_dominio"}
POLES = {k: "estabilidade" for k in P.STABLE} | {k: "variabilidade" for k in P.VARIABLE}
AXES = {k: "homogeneidade_sincronica" for k in ("erble", "attion")}


def case(c: str, pairs: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


@register(
    "x_review",
    f"""WITH RECURSIVE {FUSED},
v1 AS (SELECT * REPLACE (nuclear AND relation NOT IN {quoted(fixed.NOT_NUCLEAR)} AS nuclear, CASE WHEN relation IN {quoted(fixed.NOT_NUCLEAR)} AND motive = '' THEN relation ELSE motive END AS motive) FROM fused),
v2 AS (SELECT *, row_number() OVER (PARTITION BY passage, term, nuclear ORDER BY length(form) DESC, distance, doc_id, line, idx) AS vr FROM v1),
v3 AS (SELECT * REPLACE (nuclear AND NOT (passage IS NOT NULL AND vr > 1) AS nuclear, CASE WHEN nuclear AND passage IS NOT NULL AND vr > 1 THEN 'janela_sobreposta' ELSE motive END AS motive, CASE WHEN domain = 'por_rever' THEN 'musicologia' ELSE domain END AS domain) FROM v2),
v4 AS (SELECT * REPLACE (nuclear AND {case("form", MOTIVES)} IS NULL AS nuclear, CASE WHEN nuclear THEN coalesce({case("form", MOTIVES)}, motive) ELSE motive END AS motive) FROM v3),
v5 AS (SELECT * REPLACE (nuclear AND NOT {METATEXT} AS nuclear, CASE WHEN nuclear AND {METATEXT} THEN 'metatexto' ELSE motive END AS motive) FROM v4)
SELECT doc_id, line, idx, nuclear, motive, domain, CASE WHEN nuclear THEN coalesce({case("term", POLES)}, 'estabilidade') ELSE '' END AS pole, CASE WHEN nuclear THEN coalesce({case("term", AXES)}, 'ambos') ELSE '' END AS axis FROM v5""",
)
def x_review(spark, sf_dir):
    """The review passes, one after the other."""
    h = settle(whole(spark, sf_dir).withColumns({"pole": F.lit(""), "axis": F.lit("")}), "fused")
    return long_line(V.auto_review(h, MOTIVES, POLES, AXES)).select("doc_id", "line", "idx", "nuclear", "motive", "domain", "pole", "axis")


@register("x_carried", f"WITH {FLAGS}, old AS (SELECT doc_id, line, idx, 'metatexto' AS m FROM flagged WHERE doc_id % 7 = 0) SELECT f.doc_id, f.line, f.idx, f.nuclear AND m IS NULL AS nuclear, CASE WHEN m IS NOT NULL AND (f.nuclear OR motive = '') THEN m ELSE motive END AS motive FROM flagged f LEFT JOIN old USING (doc_id, line, idx)")
def x_carried(spark, sf_dir):
    """Motives of an earlier review of every seventh document, carried over by hit_key."""
    h = N.linear_flags(D.hit_keys(N.hit_table(close(spark, sf_dir), P.FIELD, P.NEAR), T.doc_key(file_path())), P.COPULAS, P.DEGREES, P.MODALS, P.NEGATIONS)
    h = h.withColumn("motive", F.when(F.col("nuclear"), "").otherwise(F.col("relation")))
    prior = h.where("doc_id % 7 = 0").select("hit_key", F.lit("metatexto").alias("motive"))
    return long_line(V.carried(h, prior)).select("doc_id", "line", "idx", "nuclear", "motive")


FEW = {"erble": ["erbles", "erbl?"], "ther": ["ther*"], "onin": ["onin*"]}


@register("x_unknown", f"""WITH {FLAGS}, q AS (SELECT *, {case("canonical_term", {k: v[0] for k, v in P.FIELD.items()})} AS pattern FROM flagged)
SELECT DISTINCT 'pattern' AS kind, coalesce(pattern, form) AS value FROM q WHERE coalesce(pattern, form) NOT IN {quoted([p for v in FEW.values() for p in v])} UNION SELECT DISTINCT 'term', canonical_term FROM q WHERE canonical_term NOT IN {quoted(FEW)}
UNION SELECT DISTINCT 'form', form FROM q WHERE NOT (canonical_term = 'erble' AND form = 'erbles' OR canonical_term = 'ther' AND regexp_matches(form, '^ther[{T.WORD}]{{0,14}}$') OR canonical_term = 'onin' AND regexp_matches(form, '^onin[{T.WORD}]{{0,14}}$'))""")
def x_unknown(spark, sf_dir):
    """Patterns, terms and forms that a smaller field does not map."""
    return V.unknown_patterns(N.hit_table(close(spark, sf_dir), P.FIELD, P.NEAR), FEW)


@register("x_accounting", f"WITH {AGREED} SELECT 'polaridade' AS test, count(*) FILTER (nuclear) AS n_eligible, count(*) FILTER (NOT nuclear) AS n_excluded, round(100.0 * count(*) FILTER (NOT nuclear) / count(*), 2) AS percent, 'nenhuma' AS rule FROM agreed")
def x_accounting(spark, sf_dir):
    return V.accounting(agreed(spark, sf_dir), "polaridade", F.col("nuclear"), "nenhuma")


TAGS = ["atributiva_via_conj", "dominio_janela:fala", "dominio_janela:", "x"]


@register("t_review_tags", f"WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '{TAGS[0]}' WHEN 2 THEN '{TAGS[0]};{TAGS[1]}' WHEN 3 THEN '{TAGS[2]} ; {TAGS[3]}' ELSE '{TAGS[1]}; {TAGS[3]}' END AS tags FROM documents) SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN '{TAGS[2]},{TAGS[3]}' WHEN 4 THEN '{TAGS[3]}' ELSE '' END AS bad, CASE WHEN tags = '' THEN 'y' ELSE tags || '; y' END AS more FROM t")
def t_review_tags(spark, sf_dir):
    """Review tags outside the vocabulary, and tags joined."""
    m = F.col("doc_id") % 5
    tags = F.when(m == 0, "").when(m == 1, TAGS[0]).when(m == 2, f"{TAGS[0]};{TAGS[1]}").when(m == 3, f"{TAGS[2]} ; {TAGS[3]}").otherwise(f"{TAGS[1]}; {TAGS[3]}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tags.alias("tags"))
    return docs.select("doc_id", F.array_join(T.bad_tags(F.col("tags")), ",").alias("bad"), T.join_tags(F.col("tags"), F.lit("y")).alias("more"))

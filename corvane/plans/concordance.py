"""Text, extraction, annotation, triage and duplicates over the driver's documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions import text as T
from corvane.operators import contexts as X
from corvane.operators import dedupe as D
from corvane.operators import near as N
from corvane.operators import triage as G
from corvane.plans import profile as P
from corvane.plans.base import AGREED, BAND, CUES_SQL, FLAGS, FULL, FUSED, HITS, LINES, MASS, METATEXT, NEAR, QTOKEN, REF, TOKENS, TRIAGED, file_path
from corvane.plans.base import agreed, canonical_sql, close, ctx, flagged, fold_sql, hits, literal, long_line, quoted, register, table, triaged, windows, words_sql


@register("term_frequency", f"WITH {HITS} SELECT term, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 4) AS share FROM hits GROUP BY term")
def term_frequency(spark, sf_dir):
    """Hits and documents of each term of the field."""
    counts = hits(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"))
    return counts.withColumn("share", F.round(F.col("n_hits") / F.sum("n_hits").over(Window.partitionBy()), 4))


def entry(spark, sf_dir):
    return term_frequency(spark, sf_dir)


@register("t_normalise", f"WITH {LINES} SELECT doc_id, line, context FROM ctx")
def t_normalise(spark, sf_dir):
    return long_line(ctx(spark, sf_dir)).select("doc_id", "line", "context")


@register("t_tokens", f"WITH {TOKENS} SELECT doc_id, line, idx, tok, sent FROM tok")
def t_tokens(spark, sf_dir):
    """Every token of every line, with its sentence."""
    return long_line(X.token_rows(ctx(spark, sf_dir)))


@register("t_sentences", f"WITH {TOKENS} SELECT doc_id, line, max(sent) + 1 AS sentences, count(*) AS tokens FROM tok GROUP BY doc_id, line")
def t_sentences(spark, sf_dir):
    rows = X.words(ctx(spark, sf_dir)).where(F.size("tok") > 0)
    return long_line(rows.select("doc_id", "line", (F.element_at("sent", -1) + 1).alias("sentences"), F.size("tok").cast("long").alias("tokens")))


@register("t_query_tokens", f"WITH {LINES}, {words_sql(QTOKEN)} SELECT doc_id, count(*) AS n, count(*) FILTER (contains(tok, '''')) AS apostrophes, max(sent) + 1 AS most_sentences FROM tok GROUP BY doc_id")
def t_query_tokens(spark, sf_dir):
    """The search's tokens, which end at hyphens."""
    rows = X.token_rows(ctx(spark, sf_dir), T.QUERY_TOKEN)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("tok").contains("'").cast("long")).alias("apostrophes"), (F.max("sent") + 1).alias("most_sentences"))


@register("t_doc_key", "SELECT doc_id, substr(sha256(lower(CAST(doc_id AS VARCHAR) || '.TXT')), 1, 16) AS doc_key, doc_id || '.TXT' AS base, 'file:///' || source || '/' || doc_id || '.TXT' AS link FROM documents")
def t_doc_key(spark, sf_dir):
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".TXT")))
    return table(spark, sf_dir, "documents").select("doc_id", T.doc_key(path).alias("doc_key"), T.basename(path).alias("base"), T.hyperlink(F.lit(""), path).alias("link"))


FOLD = fold_sql("context")


@register("t_fold", f"WITH {LINES} SELECT doc_id, line, {FOLD} AS plain, replace({FOLD}, ' ', '') AS fused FROM ctx")
def t_fold(spark, sf_dir):
    return long_line(ctx(spark, sf_dir)).select("doc_id", "line", T.plain(F.col("context")).alias("plain"), T.fused(F.col("context")).alias("fused"))


WORDS = ["th*", "t?e", "*ing", "*er*", "of", "an?*"]


@register(
    "t_patterns",
    f"""WITH {TOKENS}, f AS (SELECT tok, count(*) AS n FROM tok GROUP BY tok)
SELECT tok, n, {", ".join(f"regexp_matches(tok, '{literal(T.extract_pattern(p))}') AS e{i}, regexp_matches(tok, '{literal(T.query_pattern(p))}') AS q{i}" for i, p in enumerate(WORDS))},
  length(tok) > 22 OR (length(tok) >= 10 AND regexp_matches(tok, '({"|".join(fixed.GLUED_ENDS)})$')) AS glued, starts_with(tok, 'th') OR tok IN {quoted(P.NODES)} AS is_node, {canonical_sql("tok", P.FIELD)} AS canonical FROM f""",
)
def t_patterns(spark, sf_dir):
    """Distinct tokens against truncated patterns of both kinds, the guard for words run together, node words and labels."""
    f = X.token_rows(ctx(spark, sf_dir)).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    tok = F.col("tok")
    both = [c for i, p in enumerate(WORDS) for c in (tok.rlike(T.extract_pattern(p)).alias(f"e{i}"), tok.rlike(T.query_pattern(p)).alias(f"q{i}"))]
    return f.select("tok", "n", *both, T.glued(tok).alias("glued"), T.is_node(tok, P.NODES, "th").alias("is_node"), T.canonical(tok, P.FIELD).alias("canonical"))


@register("t_stem", "SELECT DISTINCT p.s AS pattern, CASE WHEN p.s LIKE '*%' THEN regexp_replace(regexp_replace(lower(p.s), '^[*]', ''), '[*]$', '') ELSE regexp_replace(lower(p.s), '[*]$', '') END AS stem FROM (SELECT unnest([event_type || '*', '*' || event_type, '*' || event_type || '*', event_type]) AS s FROM events) p")
def t_stem(spark, sf_dir):
    """Patterns without their truncation marks."""
    e, star = F.col("event_type"), F.lit("*")
    p = table(spark, sf_dir, "events").select(F.explode(F.array(F.concat(e, star), F.concat(star, e), F.concat(star, e, star), e)).alias("pattern")).distinct()
    return p.select("pattern", T.stem(F.col("pattern")).alias("stem"))


POLE = f"CASE WHEN term IN {quoted(P.STABLE)} THEN 'E' WHEN term IN {quoted(P.VARIABLE)} THEN 'V' END"
AXIS = f"CASE WHEN term IN {quoted(P.SYNCHRONIC)} AND term IN {quoted(P.DIACHRONIC)} THEN 'ambos' WHEN term IN {quoted(P.SYNCHRONIC)} THEN 'sincronico' WHEN term IN {quoted(P.DIACHRONIC)} THEN 'diacronico' ELSE 'ambos' END"


@register("t_poles_axes", f"WITH {FLAGS} SELECT term, negated, {POLE} AS pole, CASE WHEN negated THEN CASE {POLE} WHEN 'E' THEN 'V' WHEN 'V' THEN 'E' END ELSE {POLE} END AS turned, {AXIS} AS axis, count(*) AS n FROM flagged GROUP BY ALL")
def t_poles_axes(spark, sf_dir):
    """Pole, pole turned by direct negation, and axis of hits."""
    t = F.col("term")
    turned = T.pole(t, P.STABLE, P.VARIABLE, F.col("negated"))
    marked = flagged(spark, sf_dir).select("term", "negated", T.pole(t, P.STABLE, P.VARIABLE).alias("pole"), turned.alias("turned"), T.axis(t, P.SYNCHRONIC, P.DIACHRONIC).alias("axis"))
    return marked.groupBy("term", "negated", "pole", "turned", "axis").agg(F.count(F.lit(1)).alias("n"))


@register("t_window_domain", f"WITH {LINES} SELECT doc_id, line, {CUES_SQL} AS domain FROM ctx")
def t_window_domain(spark, sf_dir):
    return long_line(ctx(spark, sf_dir)).select("doc_id", "line", T.first_contained(F.col("context"), P.CUES).alias("domain"))


@register("s_matrix", f"WITH {LINES}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS source_matrix_row FROM ctx) SELECT source_matrix_row, doc_id, line, source || '/' || doc_id || '.txt' AS path FROM r")
def s_matrix(spark, sf_dir):
    """The matrix of contexts with its row numbers."""
    from corvane.sources.matrix import with_row_numbers

    return long_line(with_row_numbers(ctx(spark, sf_dir), ["doc_id", "line"])).select("source_matrix_row", "doc_id", "line", file_path().alias("path"))


@register("s_source_column", f"WITH v AS (SELECT lang AS a, source || '/' || doc_id || '.txt' AS b, source AS c FROM documents) SELECT col, round(avg(CAST(regexp_matches(val, '(?i)[.](pdf|txt|docx?|html?|xhtml|rtf|odt|epub|xml|tei)') AS DOUBLE)), 6) AS share FROM (UNPIVOT v ON a, b, c INTO NAME col VALUE val) GROUP BY col")
def s_source_column(spark, sf_dir):
    """The share of file names in each column, by which the source column is chosen."""
    from corvane.sources.matrix import file_shares

    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("a"), file_path().alias("b"), F.col("source").alias("c"))
    return file_shares(docs, ["a", "b", "c"])


@register("f_domain", "SELECT doc_id, substr(sha256(doc_id || '.txt'), 1, 16) AS doc_key, CASE WHEN regexp_matches(source || '/' || doc_id || '.txt', '^src0/') THEN 'core' WHEN regexp_matches(source || '/' || doc_id || '.txt', '^src1[0-9]/') THEN 'edge' ELSE 'other' END AS domain FROM documents")
def f_domain(spark, sf_dir):
    return D.domains(table(spark, sf_dir, "documents"), {"^src0/": "core", "^src1[0-9]/": "edge"}, "other")


@register("f_metatext", f"WITH {LINES} SELECT doc_id, line, {METATEXT} AS metatext FROM ctx")
def f_metatext(spark, sf_dir):
    return long_line(ctx(spark, sf_dir)).select("doc_id", "line", G.is_metatext(F.col("context")).alias("metatext"))


@register("f_censored", f"WITH {FULL} SELECT doc_id, line, term, cens_left, cens_right FROM hit")
def f_censored(spark, sf_dir):
    """Hits of rows whose reference node lies too near an edge for a whole window."""
    return long_line(N.hit_table(close(spark, sf_dir), P.FIELD, P.NEAR)).select("doc_id", "line", "term", "cens_left", "cens_right")


@register("f_triage", f"WITH {TRIAGED} SELECT doc_id, line, term, domain, nuclear, motive FROM triaged")
def f_triage(spark, sf_dir):
    """Domain, metatext, false friends and noise, one after the other."""
    return long_line(triaged(spark, sf_dir)).select("doc_id", "line", "term", "domain", "nuclear", "motive")


@register("f_relations", f"WITH {FLAGS} SELECT relation, count(*) AS n FROM flagged WHERE relation IN ('atributiva', 'predicativa') AND nuclear GROUP BY relation")
def f_relations(spark, sf_dir):
    """Nuclear hits of chosen relations."""
    return G.genuine(G.of_relations(flagged(spark, sf_dir), ["Atributiva ", "predicativa"])).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@register("f_noise", f"WITH {FLAGS} SELECT term, count(*) FILTER (noise) AS noisy, count(*) AS n FROM flagged GROUP BY term")
def f_noise(spark, sf_dir):
    noise = G.is_noise(F.col("tok"), F.col("idx"), F.col("node_idx"))
    return flagged(spark, sf_dir).groupBy("term").agg(F.sum(noise.cast("long")).alias("noisy"), F.count(F.lit(1)).alias("n"))


@register("n_nearest", f"WITH {NEAR} SELECT doc_id, line, idx, n, term, form, distance, node_idx, node, side FROM near")
def n_nearest(spark, sf_dir):
    return long_line(N.pairs(windows(spark, sf_dir)))


@register("n_hits", f"WITH {HITS} SELECT doc_id, line, idx, n, term, form, distance, node_idx, node, side FROM hits")
def n_hits(spark, sf_dir):
    return long_line(hits(spark, sf_dir))


@register("n_hit_table", f"WITH {FULL} SELECT h.doc_id, h.line, term, canonical_term, CASE canonical_term {' '.join(f'''WHEN '{k}' THEN '{v[0]}' ''' for k, v in P.FIELD.items())} ELSE form END AS query_pattern, off_node, off_term, compound, n_nodes FROM hit h")
def n_hit_table(spark, sf_dir):
    """What the concordance keeps of a hit: canonical term, pattern, character offsets, compounds, nodes in its row."""
    h = long_line(N.hit_table(close(spark, sf_dir), P.FIELD, P.NEAR))
    return h.select("doc_id", "line", "term", "canonical_term", "query_pattern", "off_node", "off_term", "compound", F.col("n_nodes").cast("long").alias("n_nodes"))


@register("n_rows", f"WITH {HITS}, {REF}, x AS (SELECT doc_id, line, count(*) AS k FROM term t ANTI JOIN near m ON t.doc_id = m.doc_id AND t.line = m.line AND t.idx = m.idx GROUP BY ALL) SELECT r.doc_id, r.line, ref, n_nodes, size AS n_tokens, coalesce(k, 0) AS excluded FROM ref r LEFT JOIN x USING (doc_id, line)")
def n_rows(spark, sf_dir):
    """Of each row with a node: its reference node, nodes, tokens, and terms shut off from every node."""
    long = lambda c: F.col(c).cast("long").alias(c)
    return windows(spark, sf_dir).select("doc_id", long("line"), "ref", F.size("nodes").cast("long").alias("n_nodes"), F.size("tok").cast("long").alias("n_tokens"), long("excluded"))


@register("n_band", f"WITH {HITS}, {REF}, {BAND} SELECT term, count(*) AS n FROM far GROUP BY term")
def n_band(spark, sf_dir):
    return N.band_hits(windows(spark, sf_dir))


@register("n_token_mass", f"WITH {HITS}, {REF}, {MASS} SELECT * FROM mass")
def n_token_mass(spark, sf_dir):
    return N.token_mass(windows(spark, sf_dir))


@register("n_recomputed", f"WITH {HITS}, a AS (SELECT h.doc_id, h.line, h.term, arg_min(struct_pack(d := m.distance, s := m.side), struct_pack(d := m.distance, l := m.leftmost, i := m.idx)) AS a FROM hits h JOIN near m ON m.doc_id = h.doc_id AND m.line = h.line AND m.form = h.form GROUP BY ALL) SELECT doc_id, line, term, a.d AS distance2, a.s AS side2 FROM a")
def n_recomputed(spark, sf_dir):
    """Distance and side of hits, found anew from context, form and node words alone."""
    h = N.hits(close(spark, sf_dir), "context")
    return long_line(N.recomputed(h, P.NODES)).select("doc_id", "line", "term", "distance2", "side2")


@register("n_manifest", "SELECT sha256(string_agg(p, chr(10) ORDER BY p)) AS manifest_sha256 FROM (SELECT DISTINCT source || '/' || doc_id || '.txt' AS p FROM documents)")
def n_manifest(spark, sf_dir):
    return N.manifest_hash(table(spark, sf_dir, "documents").select(file_path().alias("path")))


@register("a_linear", f"WITH {FLAGS} SELECT doc_id, line, idx, term, form, node_idx, node, distance, side, graded, modal, negated, relation, nuclear FROM flagged")
def a_linear(spark, sf_dir):
    return long_line(flagged(spark, sf_dir)).select("doc_id", "line", "idx", "term", "form", "node_idx", "node", "distance", "side", "graded", "modal", "negated", "relation", "nuclear")


@register("a_table", f"WITH {FLAGS} SELECT doc_id, line, term, relation, nuclear, motive, CASE WHEN nuclear THEN 'termo_sobre_no' ELSE '' END AS orientation, CASE WHEN nuclear THEN node ELSE '' END AS governor, CASE WHEN negated THEN 'directo' ELSE 'nao' END AS negation FROM flagged")
def a_table(spark, sf_dir):
    """The heuristic annotation as the concordance shows it."""
    from corvane.operators.syntax import heuristic_table

    return long_line(heuristic_table(flagged(spark, sf_dir))).select("doc_id", "line", "term", "relation", "nuclear", "motive", "orientation", "governor", "negation")


@register("a_consensus", f"WITH {AGREED} SELECT doc_id, line, term, nuclear, motive FROM agreed")
def a_consensus(spark, sf_dir):
    return long_line(agreed(spark, sf_dir)).select("doc_id", "line", "term", "nuclear", "motive")


@register("d_match_ids", f"WITH {HITS} SELECT doc_id, line, idx, term, 'M' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, line ORDER BY idx, term, form) AS VARCHAR), 3, '0') AS match_id FROM hits")
def d_match_ids(spark, sf_dir):
    return long_line(D.match_ids(hits(spark, sf_dir))).select("doc_id", "line", "idx", "term", "match_id")


def keyed(spark, sf_dir):
    return D.hit_keys(N.hit_table(close(spark, sf_dir), P.FIELD, P.NEAR), T.doc_key(file_path()))


@register("d_exact", f"WITH {FULL} SELECT DISTINCT substr(sha256(doc_id || '.txt'), 1, 16) || '::ROW_' || line || '|' || canonical_term || '|' || form || '|' || off_node || '|' || off_term AS hit_key FROM hit")
def d_exact(spark, sf_dir):
    """Keys of hits; of equal hits, as from a row that stands twice, the first stays."""
    h = keyed(spark, sf_dir)
    return D.exact(h.unionByName(h.where("line % 3 = 0"))).select("hit_key")


@register("d_contexts", f"WITH {LINES} SELECT f.d AS doc_id, f.l AS line, context, times FROM (SELECT context, min(struct_pack(d := doc_id, l := line)) AS f, count(*) AS times FROM ctx GROUP BY context)")
def d_contexts(spark, sf_dir):
    return long_line(D.first_of_context(ctx(spark, sf_dir)))


@register(
    "d_rollup",
    f"""WITH {TRIAGED}, m AS (SELECT *, 'M' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, line ORDER BY idx, term, form) AS VARCHAR), 3, '0') AS match_id FROM triaged)
SELECT doc_id, line, count(*) AS n_hits, count(*) FILTER (nuclear) AS n_nuclear, string_agg(DISTINCT term, '; ' ORDER BY term) AS terms, string_agg(DISTINCT form, '; ' ORDER BY form) AS forms, bool_or(nuclear) AS any_nuclear,
  coalesce(string_agg(DISTINCT motive, '; ' ORDER BY motive) FILTER (motive <> ''), '') AS motives, string_agg(match_id, '; ' ORDER BY match_id) AS match_ids, min(context) AS canonical_context FROM m GROUP BY doc_id, line""",
)
def d_rollup(spark, sf_dir):
    return long_line(D.rollup(D.match_ids(triaged(spark, sf_dir))))


def first_sql(keys: str) -> str:
    return f"WITH {FLAGS} SELECT doc_id, line, idx, term FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id, line, idx, term) AS r FROM flagged f JOIN ctx USING (doc_id, line)) WHERE r = 1"


for _mode, _keys in {"ocorrencia": "doc_id, line", "ocorrencia_termo": "doc_id, line, canonical_term", "obra_termo": "doc_id, canonical_term", "contexto": "trim(context)"}.items():

    def _run(spark, sf_dir, mode=_mode):
        """The first hit by mode."""
        return long_line(D.dedupe_mode(flagged(spark, sf_dir), mode)).select("doc_id", "line", "idx", "term")

    register(f"d_mode_{_mode}", first_sql(_keys))(_run)


@register("d_mode_candidatos", f"WITH RECURSIVE {FUSED} SELECT doc_id, line, idx, term FROM (SELECT *, citation IS NOT NULL OR passage IS NOT NULL AS flag, row_number() OVER (PARTITION BY citation IS NOT NULL OR passage IS NOT NULL, trim(context) ORDER BY doc_id, line, idx, term) AS r FROM fused) WHERE NOT flag OR r = 1")
def d_mode_candidatos(spark, sf_dir):
    """Of flagged duplicates one a context, and all others."""
    return long_line(D.dedupe_mode(whole(spark, sf_dir), "candidatos")).select("doc_id", "line", "idx", "term")


def cited(spark, sf_dir, most=30):
    from corvane.operators.tables import settle

    return D.with_citations(settle(agreed(spark, sf_dir), "agreed"), file_path(), most=most)


def whole(spark, sf_dir):
    """Hits after all stages of the extraction."""
    from corvane.operators.tables import settle

    return D.fused(settle(cited(spark, sf_dir), "cited"))


CITED_DOCS = """g AS (SELECT DISTINCT doc_id, line, array_to_string(list(tok) OVER w, ' ') AS gram, count(*) OVER w AS k FROM tok WINDOW w AS (PARTITION BY doc_id, line ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
s AS (SELECT gram, min(doc_id) AS a_doc FROM g WHERE k = 8 GROUP BY gram HAVING count(*) >= 2{most})
SELECT DISTINCT a_doc, doc_id AS b_doc FROM g JOIN s USING (gram) WHERE k = 8 AND doc_id <> a_doc"""


@register("d_citations", f"WITH {TOKENS}, {CITED_DOCS.format(most=' AND count(*) <= 30')}")
def d_citations(spark, sf_dir):
    """Documents linked by 8-grams of 2 to 30 rows."""
    return D.citation_pairs(X.words(ctx(spark, sf_dir)))


@register("d_citations_uncapped", f"WITH {TOKENS}, {CITED_DOCS.format(most='')}")
def d_citations_uncapped(spark, sf_dir):
    """Documents linked by 8-grams of any number of rows."""
    return D.citation_pairs(X.words(ctx(spark, sf_dir)), most=None)


#: d_citation_groups links by grams of any number of hits.
CITED_WHOLE = FUSED.replace("HAVING count(*) > 1 AND sum(weight) BETWEEN 2 AND 30", "HAVING count(*) > 1 AND sum(weight) >= 2")


@register("d_citation_groups", f"WITH RECURSIVE {CITED_WHOLE} SELECT doc_id, line, term, citation, nuclear, motive FROM cited")
def d_citation_groups(spark, sf_dir):
    """Groups of rows that cite one another across documents, and what stays nuclear of each."""
    return long_line(cited(spark, sf_dir, None)).select("doc_id", "line", "term", "citation", "nuclear", "motive")


@register("d_passages", f"WITH RECURSIVE {FUSED} SELECT doc_id, line, term, passage, CASE WHEN fno IS NOT NULL AND fr = 1 THEN fk ELSE 1 END AS merged, CASE WHEN fno IS NOT NULL THEN 'J' || lpad(CAST(fno AS VARCHAR), 4, '0') END AS fusion, nuclear, motive FROM fused")
def d_passages(spark, sf_dir):
    """Passages repeated within a document, and windows of one hit fused in them."""
    return long_line(whole(spark, sf_dir)).select("doc_id", "line", "term", "passage", "merged", "fusion", "nuclear", "motive")


@register(
    "d_report",
    f"""WITH RECURSIVE {FUSED} SELECT 'passagem_sobreposta' AS kind, passage AS key, count(*) AS n, count(*) FILTER (motive = 'janela_sobreposta') AS fused, string_agg(DISTINCT canonical_term, '; ' ORDER BY canonical_term) AS detail FROM fused WHERE passage IS NOT NULL GROUP BY passage
UNION ALL SELECT 'mesmo_doc_id_varios_caminhos', CAST(source AS VARCHAR), count(DISTINCT doc_id), 0, string_agg(DISTINCT source || '/' || doc_id || '.txt', ' | ' ORDER BY source || '/' || doc_id || '.txt') FROM fused GROUP BY source HAVING count(DISTINCT doc_id) > 1""",
)
def d_report(spark, sf_dir):
    """Passages, and (with sources for documents) documents known by several paths."""
    return D.duplicates_report(whole(spark, sf_dir), F.col("source"), file_path())

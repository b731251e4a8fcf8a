"""What the registered queries share: the tables, the concordance over the driver's documents, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions import text as T
from corvane.operators import contexts as X
from corvane.operators import dedupe as D
from corvane.operators import near as N
from corvane.operators import triage as G
from corvane.plans import profile as P

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctx(spark, sf_dir):
    return X.contexts(table(spark, sf_dir, "documents"))


def windows(spark, sf_dir):
    return N.windows(ctx(spark, sf_dir), P.NODES, P.FIELD, P.NEAR, P.BAND)


def close(spark, sf_dir):
    """windows of the rows that may have a hit; the others have none to give."""
    return N.windows(ctx(spark, sf_dir), P.NODES, P.FIELD, P.NEAR, P.BAND, only_hits=True)


def hits(spark, sf_dir):
    return N.hits(close(spark, sf_dir))


def flagged(spark, sf_dir):
    """Hits with the linear annotation and what the later stages read."""
    h = N.hit_table(close(spark, sf_dir), P.FIELD, P.NEAR)
    h = N.linear_flags(h, P.COPULAS, P.DEGREES, P.MODALS, P.NEGATIONS)
    return h.withColumn("motive", F.when(F.col("nuclear"), "").otherwise(F.col("relation")))


def file_path():
    """The path that stands for a document's file."""
    return F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def triaged(spark, sf_dir):
    return G.triage(flagged(spark, sf_dir), file_path(), P.RULES, P.INCLUDED, P.DEFAULT_DOMAIN, P.FRIENDS)


def agreed(spark, sf_dir):
    """Hits after triage and consensus; places of characters, which cost most, are left out, as nothing reads them here."""
    return D.consensus(triaged(spark, sf_dir).drop("off_node", "off_term", "query_pattern"))


def long_line(df):
    return df.withColumn("line", F.col("line").cast("long"))


def quoted(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def literal(s: str) -> str:
    return s.replace("'", "''")


LETTER, ANY, SPACE = T.LETTER, T.ANY_WORD, T.SPACE
TOKEN, QTOKEN, STOPS = (literal(x) for x in (T.TOKEN, T.QUERY_TOKEN, T.STOPS))
LINES = rf"""lines AS (SELECT doc_id, i - 1 AS line, source, lang, trim(regexp_replace(regexp_replace(regexp_replace(p[i], '[\n\r]', ' ', 'g'), '({ANY})-{SPACE}+({ANY})', '\1\2', 'g'), '{SPACE}+', ' ', 'g')) AS context
  FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL), unnest(range(1, len(p) + 1)) AS u(i)),
ctx AS (SELECT * FROM lines WHERE context <> '')"""


def words_sql(token: str = TOKEN, of: str = "ctx") -> str:
    """tok (doc_id, line, idx, tok, off, sent) by character offsets: sent counts the sentence ends that start before a token."""
    return rf"""cuts AS (SELECT doc_id, line, regexp_split_to_array(context || ' ', '{STOPS}') AS s, regexp_extract_all(context || ' ', '{STOPS}') AS m FROM {of}),
marks AS (SELECT doc_id, line, list_sum(list_transform(s[: k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[: k - 1], lambda x: length(x))), 0) AS off,
  rtrim(lower(regexp_extract(right(s[k], 30), '([A-Za-zÀ-ÿ.]+)$', 1)), '.') AS before, m[k] AS mark FROM cuts, unnest(range(1, len(m) + 1)) AS u(k)),
ends AS (SELECT doc_id, line, list(off) AS offs FROM marks WHERE before NOT IN {quoted(fixed.ABBREVIATIONS)} AND NOT starts_with(mark, '...') GROUP BY ALL),
parts AS (SELECT doc_id, line, regexp_extract_all(context, '{token}') AS t, regexp_split_to_array(context, '{token}') AS g FROM {of}),
raw AS (SELECT doc_id, line, i, t[i] AS t, length(g[i]) AS gap FROM parts, unnest(range(1, len(t) + 1)) AS u(i)),
placed AS (SELECT doc_id, line, i, t, CAST(sum(gap + length(t)) OVER (PARTITION BY doc_id, line ORDER BY i) - length(t) AS INTEGER) AS off FROM raw),
tok AS (SELECT p.doc_id, p.line, CAST(i - 1 AS INTEGER) AS idx, lower(t) AS tok, off, CAST(len(list_filter(coalesce(offs, []), lambda x: x < off)) AS INTEGER) AS sent FROM placed p LEFT JOIN ends e ON p.doc_id = e.doc_id AND p.line = e.line)"""


TOKENS = f"{LINES},\n{words_sql()}"


def pattern_sql(p: str) -> tuple[str, int]:
    words = p.split()
    names = ["tok", *(f"t{k}" for k in range(1, len(words)))]
    return " AND ".join(f"regexp_matches({n}, '{literal(T.extract_pattern(w))}')" for n, w in zip(names, words)), len(words)


def term_cases(field: dict[str, list[str]]) -> str:
    """Places whose first matching label, by its longest pattern, is struct(term, n)."""
    cases = []
    for label, patterns in field.items():
        for p in sorted(patterns, key=lambda x: len(x.split()), reverse=True):
            test, n = pattern_sql(p)
            cases.append(f"WHEN {test} THEN struct_pack(term := '{label}', n := {n})")
    return "CASE " + " ".join(cases) + " END"


def canonical_sql(form: str, field: dict[str, list[str]]) -> str:
    cases = []
    for label, patterns in field.items():
        for p in patterns:
            cases.append(f"WHEN {form} = '{literal(p.lower())}' THEN '{label}'" if len(p.split()) > 1 else f"WHEN regexp_matches({form}, '{literal(T.extract_pattern(p))}') THEN '{label}'")
    return "CASE " + " ".join(cases) + f" ELSE regexp_replace({form}, '^[*]+|[*]+$', '', 'g') END"


NEAR = rf"""{TOKENS},
node AS (SELECT doc_id, line, sent, idx AS node_idx, tok AS node, off AS off_node FROM tok WHERE tok IN {quoted(P.NODES)}),
noded AS (SELECT doc_id, line, count(*) AS n_nodes, min(node_idx) AS first_node FROM node GROUP BY ALL),
ahead AS (SELECT *, lead(tok) OVER w AS t1, lead(sent) OVER w AS s1 FROM tok SEMI JOIN noded USING (doc_id, line) WINDOW w AS (PARTITION BY doc_id, line ORDER BY idx)),
term AS (SELECT doc_id, line, sent, idx, off AS off_term, m.term AS term, m.n AS n, CASE m.n WHEN 1 THEN tok ELSE tok || ' ' || t1 END AS form, CASE m.n WHEN 1 THEN sent ELSE s1 END AS sent_end FROM (SELECT *, {term_cases(P.FIELD)} AS m FROM ahead) WHERE m IS NOT NULL),
gaps AS (SELECT t.*, node_idx, node, off_node, CASE WHEN node_idx < idx THEN idx - node_idx ELSE node_idx - (idx + n - 1) END AS distance, least(idx, node_idx) AS leftmost FROM term t JOIN node m ON t.doc_id = m.doc_id AND t.line = m.line AND t.sent = m.sent AND t.sent_end = m.sent WHERE node_idx < idx OR node_idx >= idx + n),
near AS (SELECT *, CASE WHEN idx < node_idx THEN 'esq' ELSE 'dir' END AS side FROM gaps QUALIFY row_number() OVER (PARTITION BY doc_id, line, idx ORDER BY distance, leftmost, node_idx) = 1)"""
HITS = rf"""{NEAR},
hits AS (SELECT *, min(idx) OVER (PARTITION BY doc_id, line, term) AS first_idx FROM near WHERE distance <= {P.NEAR} QUALIFY row_number() OVER (PARTITION BY doc_id, line, term ORDER BY distance, leftmost, idx) = 1)"""
REF = rf"""votes AS (SELECT doc_id, line, node_idx, count(*) AS k, min(first_idx) AS f FROM hits GROUP BY ALL),
won AS (SELECT doc_id, line, node_idx FROM votes QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY k DESC, f) = 1),
ref AS (SELECT n.doc_id, n.line, coalesce(node_idx, first_node) AS ref, t.sent, n_nodes, size FROM noded n LEFT JOIN won USING (doc_id, line) JOIN tok t ON t.doc_id = n.doc_id AND t.line = n.line AND t.idx = coalesce(node_idx, first_node) JOIN (SELECT doc_id, line, count(*) AS size FROM tok GROUP BY ALL) z ON z.doc_id = n.doc_id AND z.line = n.line)"""
BAND = rf"""far AS (SELECT t.* FROM term t JOIN ref r ON t.doc_id = r.doc_id AND t.line = r.line AND t.sent = r.sent AND t.sent_end = r.sent ANTI JOIN hits h ON t.doc_id = h.doc_id AND t.line = h.line AND t.term = h.term
  WHERE (ref < idx OR ref >= idx + n) AND CASE WHEN ref < idx THEN idx - ref ELSE ref - (idx + n - 1) END BETWEEN {P.NEAR + 1} AND {P.BAND})"""
MASS = rf"""mass AS (SELECT count(*) FILTER (abs(idx - ref) BETWEEN 1 AND {P.NEAR}) AS r1, count(*) FILTER (abs(idx - ref) BETWEEN {P.NEAR + 1} AND {P.BAND}) AS r2, (SELECT count(*) FROM noded) AS windows FROM tok t JOIN ref r ON t.doc_id = r.doc_id AND t.line = r.line AND t.sent = r.sent)"""
FULL = rf"""{HITS},
{REF},
hit AS (SELECT h.doc_id, h.line, h.idx, h.n, h.term, h.form, h.distance, h.node_idx, h.node, h.side, h.off_node, h.off_term, {canonical_sql("h.form", P.FIELD)} AS canonical_term, contains(h.form, '-') AS compound, r.n_nodes, ref < {P.NEAR} AS cens_left, size - 1 - ref < {P.NEAR} AS cens_right
  FROM hits h JOIN ref r ON h.doc_id = r.doc_id AND h.line = r.line)"""
FLAGS = rf"""{FULL},
flags AS (SELECT h.doc_id, h.line, h.idx, bool_or(h.idx - t.idx BETWEEN 1 AND 3 AND tok IN {quoted(P.DEGREES)}) AS graded, bool_or(abs(h.idx - t.idx) <= 4 AND tok IN {quoted(P.MODALS)}) AS modal,
  bool_or(h.idx - t.idx BETWEEN 1 AND 3 AND tok IN {quoted([w for w in P.NEGATIONS if w not in ("no", "nos")])}) AS negated,
  CASE WHEN bool_or(t.idx > least(h.idx, node_idx) AND t.idx < greatest(h.idx, node_idx) AND tok IN {quoted(P.COPULAS)}) THEN 'predicativa' WHEN abs(h.idx - node_idx) = 1 THEN 'atributiva' ELSE 'indeterminada' END AS relation,
  bool_or(t.idx > least(h.idx, node_idx) AND t.idx < greatest(h.idx, node_idx) AND length(tok) > 3 AND NOT regexp_matches(tok, '[{fixed.VOWELS}]')) AS noise
  FROM hit h JOIN tok t ON h.doc_id = t.doc_id AND h.line = t.line GROUP BY h.doc_id, h.line, h.idx, h.node_idx),
flagged AS (SELECT h.*, graded, modal, negated, relation, noise, relation IN {quoted(fixed.NUCLEAR)} AS nuclear, CASE WHEN relation IN {quoted(fixed.NUCLEAR)} THEN '' ELSE relation END AS motive FROM hit h JOIN flags f ON h.doc_id = f.doc_id AND h.line = f.line AND h.idx = f.idx)"""


def domain_cases(path: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({path}, '(?i){literal(rx)}') THEN '{d}'" for rx, d in P.RULES) + " END"


def stage(name: str, of: str, when: str, motive: str) -> str:
    return f"{name} AS (SELECT * REPLACE (nuclear AND NOT coalesce({when}, false) AS nuclear, CASE WHEN coalesce({when}, false) AND motive = '' THEN {motive} ELSE motive END AS motive) FROM {of})"


BORDER = (r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)")
METATEXT = rf"(regexp_matches(context, '{fixed.CAPTION}') OR regexp_matches(context, '{fixed.HEADING}') OR regexp_matches(context, '(?i){BORDER[0]}(?:{fixed.METATEXT_WORDS}){BORDER[1]}') OR regexp_matches(context, '(?i){BORDER[0]}(?:{fixed.METATEXT_MARKS})[\p{{L}}\p{{N}}_]') OR len(regexp_extract_all(context, '{fixed.INITIALS}')) >= 2)"
FRIEND = "CASE form " + " ".join(f"WHEN '{f}' THEN '{m}'" for f, m in P.FRIENDS.items()) + " END"
TRIAGED = rf"""{FLAGS},
s0 AS (SELECT f.*, source, context, coalesce({domain_cases("source || '/' || f.doc_id || '.txt'")}, 'por_rever') AS domain FROM flagged f JOIN ctx c ON f.doc_id = c.doc_id AND f.line = c.line),
{stage("s1", "s0", f"domain <> 'por_rever' AND domain NOT IN {quoted(P.INCLUDED)}", "'dominio:' || domain")},
{stage("s2", "s1", METATEXT, "'metatexto'")},
{stage("s3", "s2", f"nuclear AND ({FRIEND}) IS NOT NULL", FRIEND)},
{stage("triaged", "s3", "noise", "'ruido_ocr'")}"""
AGREED = rf"""{TRIAGED},
sig AS (SELECT doc_id, line, string_agg(tok, ' ' ORDER BY idx) AS sig FROM tok SEMI JOIN noded USING (doc_id, line) GROUP BY ALL),
signed AS (SELECT t.*, sig FROM triaged t JOIN sig s ON t.doc_id = s.doc_id AND t.line = s.line),
split AS (SELECT sig, count(*) AS k, count(*) FILTER (nuclear) AS yes, arg_min(motive, (doc_id, line, idx)) FILTER (NOT nuclear) AS lost FROM signed GROUP BY sig HAVING count(*) FILTER (nuclear) BETWEEN 1 AND count(*) - 1),
agreed AS (SELECT t.* EXCLUDE (sig) REPLACE (coalesce(2 * yes > k, nuclear) AS nuclear, CASE WHEN yes IS NULL THEN motive WHEN 2 * yes > k THEN '' WHEN motive <> '' THEN motive WHEN lost <> '' THEN lost ELSE 'indeterminada' END AS motive) FROM signed t LEFT JOIN split USING (sig))"""


def groups_sql(name: str, edges: str, nodes: str, letter: str, docs: int) -> str:
    """Components of edges (a, b), ids being doc_id * 1000000 + line: name (id, {name}) numbered by their first rows."""
    return rf"""{name}_e AS ({edges}),
{name}_n AS ({nodes}),
{name}_r(a, b) AS (SELECT id, id FROM {name}_n UNION SELECT r.a, e.b FROM {name}_r r JOIN (SELECT a, b FROM {name}_e UNION SELECT b, a FROM {name}_e) e ON r.b = e.a),
{name}_c AS (SELECT a AS id, min(b) AS first FROM {name}_r GROUP BY a),
{name}_k AS (SELECT first, '{letter}' || lpad(CAST(row_number() OVER (ORDER BY first) AS VARCHAR), 4, '0') AS {name} FROM {name}_c GROUP BY first HAVING count(*) > 1 AND count(DISTINCT id // 1000000) >= {docs}),
{name} AS (SELECT id, {name} FROM {name}_c JOIN {name}_k USING (first))"""


GRAMS = r"""rowed AS (SELECT doc_id, line, doc_id * 1000000 + line AS id, count(*) AS weight FROM agreed GROUP BY ALL),
gram AS (SELECT DISTINCT id, doc_id, weight, gram FROM (SELECT r.id, r.doc_id, weight, array_to_string(list(tok) OVER w, ' ') AS gram, count(*) OVER w AS k FROM tok t JOIN rowed r ON t.doc_id = r.doc_id AND t.line = r.line WINDOW w AS (PARTITION BY t.doc_id, t.line ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE k = 8)"""
GROUPS = rf"""{AGREED},
{GRAMS},
{groups_sql("citation", "SELECT s.a, g.id AS b FROM gram g JOIN (SELECT gram, min(id) AS a FROM gram GROUP BY gram HAVING count(*) > 1 AND sum(weight) BETWEEN 2 AND 30) s USING (gram) WHERE s.a <> g.id", "SELECT id FROM rowed", "C", 2)},
{groups_sql("passage", "SELECT s.a, g.id AS b FROM gram g JOIN (SELECT doc_id, gram, min(id) AS a FROM gram GROUP BY ALL HAVING count(*) > 1) s USING (doc_id, gram) WHERE s.a <> g.id", "SELECT id FROM rowed", "P", 1)}"""
FUSED = rf"""{GROUPS},
c0 AS (SELECT h.*, citation, passage FROM agreed h LEFT JOIN citation c ON h.doc_id * 1000000 + h.line = c.id LEFT JOIN passage p ON h.doc_id * 1000000 + h.line = p.id),
c1 AS (SELECT *, row_number() OVER (PARTITION BY citation, canonical_term, form ORDER BY nuclear DESC, length(context) DESC, doc_id, line, idx) AS cr, min(doc_id) OVER (PARTITION BY citation, canonical_term, form) <> max(doc_id) OVER (PARTITION BY citation, canonical_term, form) AS several FROM c0),
{stage("cited", "c1", "citation IS NOT NULL AND several AND cr > 1", "'citacao_repetida'")},
f1 AS (SELECT *, row_number() OVER w AS fr, count(*) OVER (PARTITION BY passage, canonical_term, form) AS fk, min((doc_id, line, idx)) OVER (PARTITION BY passage, canonical_term, form) AS fo FROM cited WINDOW w AS (PARTITION BY passage, canonical_term, form ORDER BY nuclear DESC, length(context) DESC, doc_id, line, idx)),
f2 AS (SELECT *, CASE WHEN passage IS NOT NULL AND fk > 1 THEN dense_rank() OVER (PARTITION BY passage IS NOT NULL AND fk > 1 ORDER BY passage, fo) END AS fno FROM f1),
{stage("fused", "f2", "fno IS NOT NULL AND fr > 1", "'janela_sobreposta'")}"""

CUES_SQL = "CASE " + " ".join(f"WHEN contains(lower(context), '{literal(c)}') THEN '{d}'" for d, cs in P.CUES.items() for c in cs) + " ELSE '' END"


def fold_sql(text: str) -> str:
    """As text.plain."""
    for c, flat in T.SEVERAL.items():
        text = f"replace({text}, '{c}', '{flat}')"
    return f"trim(regexp_replace(lower(regexp_replace(translate({text}, '{literal(T.PLAIN[0])}', '{literal(T.PLAIN[1])}'), '[^\\x00-\\x7F]+', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"

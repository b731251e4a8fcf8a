"""Tokens, sentences and pairs against plain Python on the same strings."""

import random
import re

import pytest
from corvane.functions import fixed
from corvane.functions import text as T
from corvane.operators import contexts as X
from corvane.operators import near as N
from corvane.operators import query as Q
from corvane.operators import triage as G
from pyspark.sql import functions as F

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
TOKEN = re.compile(rf"[{LETTER}](?:[{LETTER}'’]|-(?=[{LETTER}]))*")
END = re.compile(r"""[.!?;]+["'”’)\]]*\s""")


def plain_tokens(s):
    return [(m[0].lower(), m.start()) for m in TOKEN.finditer(s)]


def plain_ends(s):
    out = []
    for m in END.finditer(s + " "):
        word = re.search(r"([A-Za-zÀ-ÿ.]+)$", s[max(0, m.start() - 30) : m.start()])
        if (word and word[1].lower().rstrip(".") in fixed.ABBREVIATIONS) or s[m.start() : m.start() + 3] == "...":
            continue
        out.append(m.start())
    return out


def contexts(spark, lines):
    return spark.createDataFrame([(i, 0, "s", "en", x) for i, x in enumerate(lines)], "doc_id long, line int, source string, lang string, context string")


SENTENCES = [
    "see vol 3. The next", "a thing... and", "as e.g. the", "cf. the; no! yes?) ok", "x. y", "U.S.A. the", "no. 3 the", "Prof. A. B. (ed.) said 'it ends.' Then", "a.b. c", "é.g. the", "end.’ Next", "", "...", "a ... b. c", "Op. 3; op. 4", "the end.\tnew", "«fin.» the", "[so.] the",
]


def odd(n, seed):
    rnd = random.Random(seed)
    parts = ["the", "e.g", "vol", ".", "...", "!?", ";", " ", "  ", "’", "'", ")", "-", "É", "thing", "di-uniform", "x'y", "3", "etc", " ", "no", "İ", "œ", "]"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


def test_tokens_and_sentences_as_plain_python(spark):
    lines = [*SENTENCES, *odd(400, 1)]
    got = {r.doc_id: r for r in X.words(contexts(spark, lines)).collect()}
    for i, s in enumerate(lines):
        want, ends = plain_tokens(s), plain_ends(s)
        assert got[i].tok == [t for t, _ in want], s
        assert got[i].sent == [sum(e < at for e in ends) for _, at in want], s


def test_normalise_as_plain_python(spark):
    lines = [*odd(200, 2), "propor- tions", "a-\n b", "é- É", "x-  1", "_- _", " a　b\x1cc ", "-- a"]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, t string")
    for r in df.select("i", T.normalise(F.col("t"), trim=False).alias("n")).collect():
        s = re.sub(r"(\w)-\s+(\w)", r"\1\2", lines[r.i].replace("\n", " ").replace("\r", " "))
        assert r.n == re.sub(r"\s+", " ", s), lines[r.i]


FIELD = {"uni": ["uniform*"], "pair": ["very even", "even"], "comp": ["*like"]}
NODES = ["texture", "textures"]


def brute(s, near=4, band=12):
    """Nodes, terms, hits, reference node, band and masses of a line."""
    toks, ends = plain_tokens(s), plain_ends(s)
    sent = [sum(e < at for e in ends) for _, at in toks]
    words = [t for t, _ in toks]
    nodes = [i for i, w in enumerate(words) if w in NODES]
    if not nodes:
        return None
    found, terms, excluded = {}, [], 0
    for j in range(len(words)):
        for label, patterns in FIELD.items():
            n = max((len(p.split()) for p in patterns if len(words) >= j + len(p.split()) and all(re.match(T.extract_pattern(q), words[j + k]) for k, q in enumerate(p.split()))), default=0)
            if n:
                terms.append((j, n, label))
                break
    gap = lambda j, n, i: min(abs(k - i) for k in range(j, j + n))
    fits = lambda j, n, i: not j <= i < j + n and all(sent[k] == sent[i] for k in range(j, j + n))
    for j, n, label in terms:
        best = min(((gap(j, n, i), min(i, j), i) for i in nodes if fits(j, n, i)), default=None)
        excluded += best is None
        if best and best[0] <= near:
            old = found.get(label)
            if old is None or best[:2] < old[0][:2]:
                found[label] = (best, j, n)
    order = [x[0][2] for x in found.values()]
    ref = max(order, key=lambda i: (order.count(i), -order.index(i))) if order else nodes[0]
    far = [(j, label) for j, n, label in terms if fits(j, n, ref) and near < gap(j, n, ref) <= band and label not in found]
    mass = lambda lo, hi: sum(lo < abs(k - ref) <= hi and sent[k] == sent[ref] for k in range(len(words)))
    return {k: (v[1], v[2], v[0][0], v[0][2]) for k, v in found.items()}, excluded, ref, far, mass(0, near), mass(near, band)


def lines_with_nodes(n, seed):
    rnd = random.Random(seed)
    vocab = ["texture", "textures", "uniform", "uniformly", "very", "even", "very even", "glass-like", "a", "of", "is", "and", ".", ";", "e.g.", "x", "x", "x"]
    return [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 20, 60]))) for _ in range(n)]


def test_windows_as_plain_python(spark):
    lines = [*lines_with_nodes(400, 3), " ".join(["uniform", *["x"] * 40, "texture", "even"]), " ".join(["texture"] * 30 + ["x"] * 30 + ["uniform"])]
    got = {r.doc_id: r for r in N.windows(contexts(spark, lines), NODES, FIELD, 4, 12).collect()}
    for i, s in enumerate(lines):
        want = brute(s)
        if want is None:
            assert i not in got
            continue
        r = got[i]
        assert {h.term: (h.idx, h.n, h.distance, h.node_idx) for h in r.found} == want[0], s
        assert (r.excluded, r.ref, [(t.idx, t.term) for t in r.far], r.near_tokens, r.band_tokens) == want[1:], s


def test_offsets_and_recomputed_distances(spark):
    lines = lines_with_nodes(120, 4)
    h = N.hit_table(N.windows(contexts(spark, lines), NODES, FIELD, 4, 12), FIELD, 4)
    for r in h.collect():
        toks = plain_tokens(lines[r.doc_id])
        assert (r.off_term, r.off_node) == (toks[r.idx][1], toks[r.node_idx][1])
    again = N.recomputed(h, NODES)
    assert again.where("distance2 > distance").count() == 0 and again.where("distance2 is null").count() == 0


def test_linear_annotation(spark):
    lines = ["the texture is not very uniform", "no uniform texture", "uniform texture may", "texture seems quite uniform", "texture with uniform"]
    h = N.linear_flags(N.hits(N.windows(contexts(spark, lines), NODES, FIELD, 4, 12), "tok"))
    got = {r.doc_id: (r.negated, r.graded, r.modal, r.relation, r.nuclear) for r in h.collect()}
    assert got == {0: (True, True, False, "predicativa", True), 1: (False, False, False, "atributiva", True), 2: (False, False, True, "atributiva", True), 3: (False, True, True, "predicativa", True), 4: (False, False, False, "indeterminada", False)}


@pytest.mark.parametrize(
    "text,want",
    [("Figure 3 shows", True), ("see Figure 3", False), ("2.1.2 Results", True), ("2 Results", False), ("in the IEEE and", True), ("ieeex", False), ("pp. 12", False), ("pp.x", True), ("A.B. and C.D. say", True), ("A.B. says", False), ("Table. 2", True), ("copyright ©a", True)],
)
def test_metatext(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(G.is_metatext(F.col("t"))).first()[0] is want


def evaluate(spark, query, line, **flags):
    return Q.search(contexts(spark, [line]).drop("source", "lang"), query, **flags).collect()


def test_and_and_near_need_a_sentence_and_a_relation(spark):
    apart = "The texture ends here. Something else is uniform"
    for query in ("texture AND uniform", "texture NEAR/8 uniform", "texture near/8 uniform", "texture and uniform"):
        assert not evaluate(spark, query, apart)
        assert evaluate(spark, query, apart, same_sentence=False, need_syntax=False)
    (r,) = evaluate(spark, "texture NEAR/3 uniform", "the texture is uniform")
    assert r.dists == [2] and r.rels == ["caracterizacao_predicativa"] and r.forms == ["texture", "uniform"]


@pytest.mark.parametrize(
    "line,want",
    [
        ("uniform texture", "caracterizacao_atributiva"), ("texture the very uniform", "caracterizacao_atributiva"), ("texture here remains uniform", "caracterizacao_predicativa"), ("texture of uniform", "especificacao_preposicional"),
        ("texture often described as uniform", "definicao_metalinguistica"), ("texture now then is uniform", None), ("texture cut uniform", None),
    ],
)
def test_relations(spark, line, want):
    rows = evaluate(spark, "texture AND uniform", line)
    assert (rows[0].rels if rows else None) == ([want] if want else None)


def test_lexer_splits_glued_operators_only_where_meant():
    assert Q.parse("uniform*OR x") == Q.Op("OR", (Q.Term(("uniform*",)), Q.Term(("x",))))
    assert Q.parse("x ORuniform*") == Q.Op("OR", (Q.Term(("x",)), Q.Term(("uniform*",))))
    assert Q.parse("notable") == Q.Term(("notable",)) and Q.parse("orchestral*") == Q.Term(("orchestral*",))
    assert Q.first_near(Q.parse("a AND (b NEAR/3 c)")) == 3 and Q.patterns(Q.parse("a OR b c OR a")) == ["a", "b c"]
    assert Q.field_of(["uni*", "*uni"]) == {"uni": ["uni*"], "uni_2": ["*uni"]}
    assert Q.split_nodes(["textur*", "uniform*"], ["textur*"]) == (["textur*"], ["uniform*"])


def test_label_query(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, [])], "i long, l array<string>")
    assert [r.i for r in df.where(Q.label_query("a AND NOT (b OR c)", ["a", "b", "c"], F.col("l"))).collect()] == [1]
    for bad in ("a AND", "(a", "z", "a )"):
        with pytest.raises(ValueError):
            Q.label_query(bad, ["a", "b"], F.col("l"))

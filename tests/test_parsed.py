"""Hand-built dependency trees: words as text/dep/pos/head."""

import pytest
from corvane.operators import parsed as D
from pyspark.sql import functions as F


def tree(spec):
    out, off = [], 0
    for w in spec.split():
        text, dep, pos, head = w.split("/")
        out.append({"text": text, "off": off, "dep": dep, "pos": pos, "head": int(head)})
        off += len(text) + 1
    return out


def shown(spec, node, term):
    tokens = tree(spec)
    return D.annotate(tokens, tokens[node]["off"], tokens[term]["off"])


IS = "the/det/DET/1 texture/nsubj/NOUN/2 is/ROOT/AUX/2 uniform/acomp/ADJ/2"
CASES = [
    (IS, 1, 3, "predicativa"),
    ("uniform/amod/ADJ/1 texture/ROOT/NOUN/1", 1, 0, "atributiva"),
    ("dense/amod/ADJ/3 and/cc/CCONJ/0 uniform/conj/ADJ/0 texture/ROOT/NOUN/3", 3, 2, "atributiva"),
    ("uniformity/ROOT/NOUN/0 of/prep/ADP/0 texture/pobj/NOUN/1", 2, 0, "nominal_genitiva"),
    ("texturally/advmod/ADV/1 uniform/ROOT/ADJ/1", 0, 1, "adverbial"),
    ("uniformly/advmod/ADV/1 dense/amod/ADJ/2 texture/ROOT/NOUN/2", 2, 0, "adverbial_de_grau"),
    ("texture/nsubj/NOUN/1 moves/ROOT/VERB/1 uniformly/advmod/ADV/1", 0, 2, "adverbial_verbal"),
    ("textural/amod/ADJ/1 diversity/ROOT/NOUN/1", 0, 1, "nominal_composto"),
    ("they/nsubj/PRON/1 keep/ROOT/VERB/1 texture/dobj/NOUN/1 uniform/oprd/ADJ/1", 2, 3, "predicativa_secundaria"),
    ("rhythm/nsubj/NOUN/1 is/ROOT/AUX/1 uniform/acomp/ADJ/1 while/mark/SCONJ/5 texture/nsubj/NOUN/5 changes/advcl/VERB/1", 4, 2, "incidental"),
]


@pytest.mark.parametrize("spec,node,term,want", CASES)
def test_relations(spec, node, term, want):
    got = shown(spec, node, term)
    assert got["relation"] == want and got["nuclear"] == (want in D.fixed.NUCLEAR) and got["motive"] == ("" if got["nuclear"] else want)
    assert got["governor"].lower() != tree(spec)[term]["text"].lower()


def test_tags_negation_and_modality():
    both = shown("uniformity/ROOT/NOUN/0 of/prep/ADP/0 texture/pobj/NOUN/1 and/cc/CCONJ/2 dynamics/conj/NOUN/2", 2, 0)
    assert both["tags"] == "genitiva_por_complemento; coordenacao_heterogenea:dynamics" and both["orientation"] == "no_sobre_termo"
    assert shown("the/det/DET/1 texture/nsubj/NOUN/2 is/ROOT/AUX/2 not/neg/PART/2 uniform/acomp/ADJ/2", 1, 4)["negation"] == "directo"
    assert shown("it/nsubj/PRON/3 does/aux/AUX/3 not/neg/PART/3 create/ROOT/VERB/3 uniform/amod/ADJ/5 texture/dobj/NOUN/3", 5, 4)["negation"] == "indirecto"
    assert shown(IS, 1, 3)["negation"] == "nao" and not shown(IS, 1, 3)["modal"]
    assert shown("texture/nsubj/NOUN/2 may/aux/AUX/2 be/ROOT/AUX/2 uniform/acomp/ADJ/2", 0, 3)["modal"]
    assert D.annotate([], 0, 5)["relation"] == "indeterminada"


def test_contexts_are_parsed_once(spark):
    known = {"the texture is uniform": tree(IS), "uniform texture": tree(CASES[1][0])}
    rows = [(1, "the texture is uniform", 4, 15), (2, "the texture is uniform", 4, 15), (3, "uniform texture", 8, 0), (4, "no parse", 0, 3)]
    h = spark.createDataFrame(rows, "id int, context string, off_node int, off_term int")
    parses = D.parsed_contexts(h, lambda part: [known.get(t, []) for t in part])
    assert parses.count() == 3
    got = {r.id: r.relation for r in D.with_dependencies(h, parses).collect()}
    assert got == {1: "predicativa", 2: "predicativa", 3: "atributiva", 4: "indeterminada"}
    assert D.with_dependencies(h, parses.limit(0)).where(F.col("relation") != "indeterminada").count() == 0

import pytest
from corvane.functions import fixed
from corvane.operators import biblio as B
from corvane.operators import stats as S
from corvane.operators import triage as G
from corvane.sources import lexicon as L
from corvane.sources import matrix as M
from corvane.sources import sinks
from corvane.streaming import annotate
from pyspark.sql import functions as F


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return path


def test_word_lists(tmp_path):
    assert L.read_words(write(tmp_path / "a.tsv", "# x\ntoken\n\nb\na\nb\n")) == ["b", "a"]
    assert L.read_nodes(write(tmp_path / "n.tsv", "lingua\tforma\nEN\tTexture\nen\ttextures\n")) == {"en": ["texture", "textures"]}
    assert L.read_cues(write(tmp_path / "c.tsv", "dominio\tpista\nb\tX\na\ty\nb\tz\n")) == {"b": ["x", "z"], "a": ["y"]}
    assert L.read_friends(write(tmp_path / "f.tsv", "Even\tx y\n")) == {"even": "x y"}
    assert L.path_domains(L.read_domains(write(tmp_path / "d.tsv", "a\tpath\nb\tjanela\nc\tambos\n"))) == ["a", "c"]


@pytest.mark.parametrize("text,reader", [("", L.read_words), ("# only\n", L.read_words), ("token\n", L.read_words), ("a\tb\n", L.read_words), (b"\xff\xfe", L.read_words), ("en\n", L.read_nodes), ("en\t \n", L.read_nodes), ("a\twrong\n", L.read_domains), ("a\tb\tc\n", L.read_cues)])
def test_malformed_lists_are_errors(tmp_path, text, reader):
    with pytest.raises(L.LexiconError):
        reader(write(tmp_path / "x.tsv", text))
    with pytest.raises(L.LexiconError):
        reader(tmp_path / "missing.tsv")


def test_rule_files_have_one_that_counts(tmp_path):
    own, canonical = tmp_path / "own.tsv", tmp_path / "canonical.tsv"
    assert L.rules_path(own, canonical) == (canonical, None)
    write(own, "a.*\tX # note\nno tab\n")
    assert L.rules_path(own, canonical)[0] == own and L.read_rules(own) == [("a.*", "x")]
    write(canonical, "a.*\tx\n")
    assert L.rules_path(own, canonical)[0] == canonical
    write(canonical, "b.*\tx\n")
    with pytest.raises(L.LexiconError):
        L.rules_path(own, canonical)


def test_fields():
    field, poles, warnings = L.parse_field("# c\nuniform : E = uniform*, uniformly # x\nvaried:V=varied\nempty =\ntextur* = regular*, textural\n", {"regular": ["regular*"]})
    assert field == {"uniform": ["uniform*", "uniformly"], "varied": ["varied"], "regular": ["regular*"]} and poles == {"uniform": "E", "varied": "V"} and len(warnings) == 1
    assert L.parse_field(L.field_text(field, poles))[:2] == (field, poles)
    assert L.infer_pole("x", ["unif*"], fixed.STABLE, fixed.VARIABLE) == "E" and L.infer_pole("x", ["zzz"], fixed.STABLE, fixed.VARIABLE) is None
    assert L.language("todas")["nodes"] and L.language("pt")["nodes"] == fixed.NODES["pt"]
    with pytest.raises(L.LexiconError):
        L.language("xx")
    assert L.merged({"a": {"t": "of {query}", "u": 1}}, {"a": {"u": 2}}, "q") == {"a": {"t": "of q", "u": 2}}


def test_matrix_by_places(spark, tmp_path):
    rows = [tuple([""] * 5 + [f"node{i}"] + [""] * 5 + [f"(2001)_T{i}.pdf", "", "root", f"context {i}", str(i)]) for i in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(16)))
    df.write.parquet(str(tmp_path / "m"))
    got = M.read_matrix(spark, str(tmp_path / "m"), order="c15", limit=4).orderBy("source_matrix_row").collect()
    assert [(r.source_matrix_row, r.node, r.context) for r in got] == [(i + 1, f"node{i}", f"context {i}") for i in range(4)]
    with pytest.raises(ValueError):
        M.read_matrix(spark, str(tmp_path / "m"), {"node": 6, "path": 12, "context": 99})
    assert M.choose_source_column(df, "c11") == "c11" and M.choose_source_column(df, "c13") == "c11"
    with pytest.raises(ValueError):
        M.choose_source_column(df.select("c13", "c14"), "c13")


def test_concordances_catalogues_and_manifests(spark, tmp_path):
    write(tmp_path / "c.tsv", "A banner\t\nmore\t\nnuclear\tcontexto\nTRUE\tx y\nFALSE\tz\n")
    assert [tuple(r) for r in M.read_concordance(spark, str(tmp_path / "c.tsv")).collect()] == [("TRUE", "x y"), ("FALSE", "z")]
    write(tmp_path / "r.csv", "file;doc;apa\nA/One.pdf;d1;First\nTwo.pdf;d2;Second\none.pdf;d3;Third\nx;y;\n")
    got = {r.key: r.reference for r in M.read_catalogue(spark, str(tmp_path / "r.csv"), ["file", "doc"], "apa").collect()}
    assert got == {"one": "Third", "two": "Second", "d1": "First", "d2": "Second", "d3": "Third"}
    m = M.manifest(spark.createDataFrame([("X/a.pdf", "Silva, A.", "2001"), ("", "b", "c")], "Ficheiro string, author string, Year string")).collect()
    assert [(r.key, r.autores, r.ano, r.titulo) for r in m] == [("a", "Silva, A.", "2001", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "a|b\n", ["x", "y"]), (1, None, [])], "i long, t string, l array<string>")
    sinks.write_tables({"one": df}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "one")).count() == 2
    sinks.write_tsv(df.coalesce(1), str(tmp_path / "tsv"))
    text = "".join(p.read_text() for p in (tmp_path / "tsv").glob("part-*"))
    assert text.split("\n")[0] == "i\tt\tl" and "2\ta|b \tx; y" in text
    lines = [r.value for r in sinks.markdown(df.select("i", "t"), ["i"]).collect()]
    assert lines[:2] == ["| i | t |", "|-|-|"] and "| 1 |  |" in lines and len(lines) == 4
    sinks.write_text(sinks.markdown(df.select("i"), ["i"]), str(tmp_path / "md"))


def test_assertions_on_hits(spark):
    h = spark.createDataFrame([(i, "uniform", f"f{i}.pdf", "atributiva", True, "x") for i in range(8)], "doc_id long, canonical_term string, p string, relation string, nuclear boolean, form string")
    G.assert_hits(h, F.col("p"), ["texture"])
    G.assert_relations(h)
    for bad in (h.withColumn("canonical_term", F.lit("texture")), h.withColumn("p", F.lit("dir"))):
        with pytest.raises(ValueError):
            G.assert_hits(bad, F.col("p"), ["texture"])
    for bad in (h.drop("form"), h.withColumn("relation", F.lit("zzz"))):
        with pytest.raises(ValueError):
            G.assert_relations(bad)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_bibliographic_fields(spark):
    t = F.col("t")
    assert one(spark, B.doi(t), t="see https://doi.org/10.1000/ab.c).") == "10.1000/ab.c" and one(spark, B.doi(t), t="x") == ""
    assert one(spark, B.volume(t), t="Vol. 12a, no. 3, pp. 4–9 (1999)") == "12a" and one(spark, B.pages(t), t="pp. 4–9") == "4-9" and one(spark, B.issue(t), t="no. 3") == "3"
    assert tuple(one(spark, B.journal_line(t), t="x\nMusic Analysis, Vol. 3, No. 2, pp. 1-9, 1984")) == ("Music Analysis", "3", "2", "1-9", "1984")
    assert one(spark, B.sentence_case(t), t="The Music OF Many: a NEW DNA View") == "The music OF many: A NEW DNA view"
    assert one(spark, B.title_case(t), t="journal of the arts") == "Journal of the Arts"
    assert one(spark, B.join_authors(F.col("a")), a=["A, B.", "C, D.", "E, F."]) == "A, B., C, D., & E, F."
    assert one(spark, B.join_authors(F.col("a")), a=[f"A{i}" for i in range(21)]).endswith("A18, … A20")
    assert one(spark, B.short_citation(F.col("a"), F.col("y")), a="Silva, A.; Costa, B.; Dias, C.", y="2001") == "Silva et al., 2001"
    assert one(spark, B.kind(F.col("p"), t), p="a_tese.pdf", t="") == "tese" and one(spark, B.kind(F.col("p"), t), p="x.pdf", t="Grove Music Online") == "grove"
    assert one(spark, B.initialled(t), t="Jane Q. Smith") == "Smith, J. Q."


def test_crossref_and_references(spark):
    answer = '{"message": {"author": [{"family": "Silva", "given": "Ana Maria"}], "title": ["A Study OF Texture"], "container-title": ["music analysis"], "volume": "3", "issue": "2", "page": "1-9", "type": "journal-article", "issued": {"date-parts": [[1984, 5]]}}}'
    df = B.parse_crossref(spark.createDataFrame([(answer, "10.1/x", "u"), ("no json", "", "u")], "json string, doi string, url string"))
    good, bad = df.withColumn("r", B.reference(df)).collect()
    assert good.r == "Silva, A. M. (1984). A study OF texture. *Music Analysis*, *3*(2), 1–9. https://doi.org/10.1/x"
    assert bad.title == "" and bad.r.startswith("(n.d.).")
    row = {"autores": "Silva, A.", "ano": "2001", "titulo": "Texture", "tipo": "livro", "contentor": "", "volume": "", "numero": "", "paginas": "", "editora": "Press", "doi_ou_url": "10.1/x", "edicao": "2nd ed.", "path": "p.pdf"}
    d = spark.createDataFrame([row])
    assert d.select(B.draft_reference(d).alias("r")).first().r == "Silva, A. (2001). *Texture* (2nd ed.). Press. https://doi.org/10.1/x"


def test_drafts_keep_evidence(spark):
    rows = [
        (1, "(2001)_A_Study.pdf", "Title here\nSilva, A.\nMusic Analysis, Vol. 3, No. 2, pp. 1-9, 1984", "https://doi.org/10.1000/x", None, None),
        (2, "x.pdf", "Grove Music Online\nTexture\nDunsby, J.\nPublished online: 20 January 2001", None, None, None),
        (3, "dir/plain.txt", None, None, "A Study of Plain Things", "Ann Lee"),
    ]
    d = B.draft(spark.createDataFrame(rows, "doc_id long, path string, page1 string, footer string, meta_title string, meta_author string"))
    got = {r.doc_id: r for r in d.collect()}
    a = got[1]
    assert (a.titulo, a.evidencia_titulo, a.ano, a.evidencia_ano, a.contentor, a.doi_ou_url, a.evidencia_doi_ou_url) == ("A Study", "nome_ficheiro", "2001", "nome_ficheiro", "Music Analysis", "https://doi.org/10.1000/x", "rodape")
    assert (got[2].tipo, got[2].titulo, got[2].ano, got[2].editora) == ("verbete", "Texture", "2001", "Oxford University Press")
    assert (got[3].titulo, got[3].tipo, got[3].confianca) == ("", "desconhecido", "baixa")
    assert B.bad_evidence(d).count() == 0 and B.bad_evidence(d.withColumn("evidencia_tipo", F.lit("vazio"))).count() == 3
    assert B.counts(d).where("measure = 'tipo'").agg(F.sum("n")).first()[0] == 3


def test_contingency_and_regression_kernels(spark):
    import numpy as np

    small, large = S.contingency(np.array([[5, 0], [1, 3]])), S.contingency(np.array([[50, 30], [20, 60]]))
    assert small["method"] == "Monte Carlo" and large["method"] == "assintotico" and large["draws"] is None
    assert large["p"] == pytest.approx(S.chi_square_tail(large["chi2"], 1)) and 0 < small["p"] < 0.2
    assert S.contingency(np.array([[3, 4], [0, 0]]))["method"] == "inaplicavel"
    assert S.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and S.chi_square_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    rng = np.random.default_rng(1)
    side, distance = rng.integers(0, 3, 3000), rng.integers(1, 6, 3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-(1.0 - 0.5 * distance + 1.2 * (side == 1))))
    df = spark.createDataFrame([(int(d), "abc"[s], bool(v), int(i % 50)) for i, (d, s, v) in enumerate(zip(distance, side, y))], "d int, s string, y boolean, c int").cache()
    terms, fit = S.regression(df, "y", ["d"], ["s"])
    by = {t["term"]: t for t in terms}
    ref = max("abc", key=lambda c: int((side == "abc".index(c)).sum()))
    assert by["d (standardised)"]["coef"] == pytest.approx(-0.5 * distance.std(), abs=0.2) and fit["n"] == 3000 and 0 < fit["mcfadden"] < 1
    assert all(f" vs {ref}" in t for t in by if t.startswith("s:"))
    clustered, other = S.regression(df, "y", ["d"], ["s"], cluster="c")
    assert [t["coef"] for t in clustered] == [t["coef"] for t in terms] and other["errors"] == "CR1 (c)" and clustered[0]["se"] != terms[0]["se"]
    assert S.regression(df.withColumn("y", F.lit(True)), "y", ["d"], ["s"]) == ([], {"warning": "constant response"})


def test_stream_as_table(spark, tmp_path):
    schema = "doc_id long, text string, source string, lang string"
    docs = spark.createDataFrame([(i, "a very uniform texture\nno node here", "s", "en") for i in range(9)], schema)
    docs.repartition(3).write.json(str(tmp_path / "in"))
    field = {"uni": ["uniform*"]}
    stream = annotate.annotated(spark.readStream.schema(schema).json(str(tmp_path / "in")), ["texture"], field, 4, 12)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(map(str, df.select("doc_id", "line", "term", "relation", "graded").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(annotate.annotated(docs, ["texture"], field, 4, 12))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9

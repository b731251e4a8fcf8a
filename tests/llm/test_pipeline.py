import hashlib
import re

import corpus_pipeline
import numpy as np
from corvane.llm import _common as C
from corvane.llm import bpe

SF = "/root/testdata/sf0.001"


def words(text, lower=False):
    text = "".join(c.lower() if c.isascii() else c for c in text) if lower else text
    return text.encode().split()


def test_stages_one_by_one(spark):
    """Each stage against a plain version on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [set() for _ in range(1)]
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r.text))
        items[0].update(tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        kept = C.settle(stage(spark, kept, SF), "stage")
        after = {r.doc_id: r for r in kept.collect()}
        assert after and set(after) <= set(before)
        if name.startswith("bpe"):
            library = bpe.load(bpe.default_path()).library
            for d, r in after.items():
                ids = library.encode(before[d].text or "", add_special_tokens=False).ids
                assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
                assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
            assert set(after) == set(before)
            continue
        assert kept.columns == columns
        if name.startswith("quality"):
            known = [d for d in before if d in labels]
            right = sum((labels[d].quality == 1 and labels[d].toxic == 0) == (d in after) for d in known)
            assert right > 0.85 * len(known)
        elif name.startswith("minhash"):
            sets = {}
            for d in sorted(before):
                w = words(before[d].text, True)
                own = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
                near = [e for e, s in sets.items() if own and 100 * len(own & s) >= 80 * len(own | s)]
                assert not near or d not in after
                sets[d] = own
        elif name.startswith("substring"):
            seen = set()
            for d in sorted(before):  # every text, changed or not
                w = words(before[d].text)
                gone = set()
                for i in range(len(w) - 19):
                    window = tuple(w[i : i + 20])
                    gone |= set(range(i, i + 20)) if window in seen else set()
                    seen.add(window)
                left = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
                assert (d in after) == (not gone or left != "")
                assert d not in after or after[d].text == (left if gone else before[d].text)
        else:
            hit = lambda t: any(tuple(w[i : i + 10]) in items[0] for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))] for i in range(len(w) - 9))
            assert set(after) == {d for d, r in before.items() if not hit(r.text)}


def test_run_and_odd_rows(spark, tmp_path):
    docs = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "x y", "en", "s", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "q")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1) for r in out) == [-1, 1, 2, 3]


def test_unlike_texts_of_one_id_stay(spark, tmp_path):
    """Each loses only what is its own: copies go, and so do words that earlier texts have."""
    text = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(7, text("a")), (7, text("b")), (7, text("a")), (7, text("a", 59) + " z"), (7, ""), (7, ""), (8, text("c")), (9, text("q") + " " + text("r")), (9, text("c", 30) + " " + text("d")), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    spark.createDataFrame([(1, text("q", 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near = C.settle(corpus_pipeline.near_dedup(spark, docs, str(tmp_path)), "near")
    got = sorted((r.doc_id or -1, r.text) for r in near.collect())
    like = lambda t: "a" if t.startswith("a") else t
    assert sorted((i, like(t)) for i, t in got) == sorted([(-1, "x y"), (-1, "x y"), (7, ""), (7, "a"), (7, text("b")), (8, text("c")), (9, text("q") + " " + text("r")), (9, text("c", 30) + " " + text("d"))])
    cut = C.settle(corpus_pipeline.substring_dedup(spark, near, str(tmp_path)), "cut")
    assert {(r.doc_id, r.text) for r in cut.collect() if r.doc_id in (8, 9)} == {(8, text("c")), (9, text("q") + " " + text("r")), (9, text("d"))}
    clean = corpus_pipeline.decontaminated(spark, cut, str(tmp_path)).collect()
    assert {r.text for r in clean if r.doc_id == 9} == {text("d")} and len(clean) == 7


def test_clashing_columns_and_an_empty_table(spark, tmp_path):
    extra = "score double, p_text double, _gone long, salt int, row string, kept boolean, path string"
    docs = [(i, f"word{i} " * 30, "en", "s", 9, 0.5, 0.5, i, 1, "r", True, "p") for i in range(5)]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "q")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, []):
        kept = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = C.settle(stage(spark, kept, str(tmp_path)), "stage")
            assert kept.columns == spark.createDataFrame([], schema).columns
        assert kept.count() == len(rows) and all(r.score == 0.5 and r.row == "r" for r in kept.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() == len(rows)

import random
import zlib

import numpy as np
import pyarrow as pa
from corvane.llm import langid, quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.count() > 150 and out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    want = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1000)}
    assert all(r.held_out == want[r.doc_id] for r in langid.query(spark, SF).select("doc_id", "held_out").collect())


def test_viterbi_equals_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(0, 7, 5)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.normal(0, 3, (ends[-1], 3)).astype(np.float32)
        got = langid.viterbi(scores, ends, 2.0)
        value = lambda s, p: s[np.arange(len(p)), list(p)].sum() - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        for a, b in zip(ends, ends[1:]):
            paths = np.array(np.meshgrid(*[range(3)] * (b - a))).reshape(b - a, -1).T if b > a else []
            best = max((value(scores[a:b], p) for p in paths), default=0)
            assert abs(value(scores[a:b], got[a:b]) - best) < 1e-4 if b > a else True


def test_spans_scripts_and_texts_without_letters(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("кот и собака", "ru")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    texts = [(1, "the dog the cat the dog and the cat der hund und der hund und die katze und der hund"), (2, None), (3, ""), (4, "12 !?"), (5, "собака 7 кот"), (6, "漢字")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and sum(s.words for s in got[1].spans) == len(texts[0][1].split())
    assert [(got[i].lang_pred, got[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert (got[5].lang_pred, got[5].score) == ("ru", 1.0) and got[6].lang_pred in ("en", "de", "ru")
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.predict(docs.limit(2), langid.train(docs.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_quality_on_rows_that_were_not_used(spark):
    docs = quality.columns_of(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train(docs, labels.where(~held))
    out = quality.score(docs, model).join(labels.where(held), "doc_id").select(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), (F.col("score") >= 0.5).alias("ok"))
    assert out.agg(F.avg((F.col("good") == F.col("ok")).cast("int"))).first()[0] > 0.9


def test_quality_without_labels_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "s", "en", 0), (None, "x", "s", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == 3 and all(r.score == 1.0 for r in out)
    rnd = random.Random(1)
    rows = [(i, "bad awful " * rnd.randint(1, 3) if i % 3 == 0 else "fine good " * rnd.randint(1, 3), "s", "en", 9) for i in range(200)]
    many = spark.createDataFrame(rows, docs.schema)
    labelled = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(200)], labels.schema)
    model = quality.train(many, labelled)
    assert quality.score(docs, model).count() == 3 and quality.score(docs.limit(0), model).count() == 0
    assert all((r.score >= 0.5) == (r.doc_id % 3 != 0) for r in quality.score(many, model).collect())


def test_views_are_bounded_by_their_buckets():
    view = quality.text_view(pa.array(["a b a", None, "B!"]))
    assert len(view) == 3 and view.ends[1] == view.ends[2] and view.column.max() < quality.WORD_BUCKETS


def test_samples_of_the_first_classifier():
    assert quality.LABELLED >= 8000 and quality.POOL >= 4000


def plain_language_id(train, texts, switch=langid.SWITCH):
    """Trigram counts, script shares and the best labelling, in plain loops; (language, score) of each text."""
    langs = sorted({k for _, k in train if k is not None})

    def parts(word):
        low = "\n" + word.lower() + "\n"
        letters = [i for i in range(1, len(low) - 1) if low[i].isalpha()]
        shown = [ord(c) if c.isalpha() else 0 for c in low]
        tri = np.array([shown[i - 1] << 42 | shown[i] << 21 | shown[i + 1] for i in letters], np.uint64)
        script = [int(langid.scripts_of(np.array([ord(low[i])]))[0]) for i in letters]
        return (langid.C.mix(langid.C.mix(tri)) % np.uint64(langid.BUCKETS)).tolist(), script

    cache = {}
    words_of = lambda t: [w.decode() for w in (t or "").encode().split()]
    look = lambda w: cache.setdefault(w, None) or cache.update({w: parts(w)}) or cache[w]
    grams, scripts = {k: {} for k in langs}, {k: [0] * langid.N_SCRIPTS for k in langs}
    for text, k in train:
        for w in words_of(text) if k is not None else []:
            g, s = look(w)
            for x in g:
                grams[k][x] = grams[k].get(x, 0) + 1
            for x in s:
                scripts[k][x] += 1
    total = {k: sum(grams[k].values()) for k in langs}
    uses = {k: [n >= langid.LEAST_SHARE * max(1, sum(scripts[k])) for n in scripts[k]] for k in langs}
    out = []
    for text in texts:
        rows, letters = [], []
        for w in words_of(text):
            g, s = look(w)
            if not g:
                continue
            by = [s.count(i) for i in range(langid.N_SCRIPTS)]
            fits = [uses[k][by.index(max(by))] for k in langs]
            score = [sum(float(np.log((grams[k].get(x, 0) + langid.ALPHA) / (total[k] + langid.ALPHA * langid.BUCKETS))) for x in g) for k in langs]
            rows.append([v if ok or not any(fits) else min(score) - 1000 for v, ok in zip(score, fits)])
            letters.append(len(g))
        if not rows:
            out.append(("und", 0.0))
            continue
        value, back = rows[0], []
        for row in rows[1:]:
            top = max(range(len(langs)), key=lambda i: value[i])
            from_ = [i if value[i] >= value[top] - switch else top for i in range(len(langs))]
            back.append(from_)
            value = [max(value[i], value[top] - switch) + row[i] for i in range(len(langs))]
        at = max(range(len(langs)), key=lambda i: value[i])
        labels = [at]
        for from_ in reversed(back):
            at = from_[at]
            labels.append(at)
        held = [0] * len(langs)
        for i, n in zip(reversed(labels), letters):
            held[i] += n
        best = held.index(max(held))
        out.append((langs[best], held[best] / sum(held)))
    return out


def test_the_query_as_plain_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").orderBy("doc_id").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    want = plain_language_id([(r.text, r.lang) for r in rows if not held[r.doc_id]], [r.text for r in rows])
    got = {r.doc_id: r for r in langid.query_of(docs).collect()}
    for r, (lang, score) in zip(rows, want):
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 0.02, r.doc_id


def test_exchanged_labels_teach_a_view_and_the_views_together_beat_each():
    """Text and source tell apart good rows independently; two sources occur in the pool only."""
    rnd = random.Random(3)

    def rows(n, sources):
        texts, source, y = [], [], []
        for _ in range(n):
            good = rnd.random() < 0.6
            told = [good if rnd.random() < 0.85 else not good for _ in range(5)]
            texts.append(" ".join([*(("fine" if t else "poor") + str(i) for i, t in enumerate(told)), *(f"w{rnd.randrange(200)}" for _ in range(15))]))
            source.append(sources[good if rnd.random() < 0.8 else not good])
            y.append(float(good))
        return [quality.text_view(pa.array(texts)), quality.meta_view(pa.array(source), pa.array(["en"] * n), pa.array([100] * n))], np.array(y)

    labelled, y = rows(800, ["bad", "good"])
    pool, _ = rows(3000, ["new-bad", "new-good"])
    alone, together = quality.CoTrained(labelled, y, pool, rounds=0), quality.CoTrained(labelled, y, pool)
    assert not np.array_equal(alone.models[1].w, together.models[1].w)
    fresh, truth = rows(2000, ["new-bad", "new-good"])
    right = lambda m: ((m.view_logits(1, fresh[1]) > np.log(y.mean() / (1 - y.mean()))) == (truth > 0)).mean()
    assert right(alone) < 0.65 < 0.72 < right(together)
    known, truth = rows(3000, ["bad", "good"])
    loss = [-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean() for p in together.combine(known)]
    assert loss[2] < min(loss[:2]) - 0.01


def test_a_repeated_id_and_equal_rows_are_drawn_once(spark):
    """An id, or a text, that holds most rows does not flood the samples."""
    docs = spark.createDataFrame([(1, "same words", "s", "en", 9)] * 500 + [(None, "no id", "s", "en", 5)] * 500 + [(i, f"fine {i}", "s", "en", 9) for i in range(2, 60)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    seen = []
    made = quality.views_of_all
    try:
        quality.views_of_all = lambda t: seen.append(t.num_rows) or made(t)
        quality.train(docs, labels)
    finally:
        quality.views_of_all = made
    assert seen[0] <= 59 and seen[1] <= 60

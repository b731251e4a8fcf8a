import math
import random
import zlib
from collections import Counter

import numpy as np
from corvane.llm import bpe, lm


def brute(rows):
    words = {i: "".join(c.lower() if c.isascii() else c for c in t or "").encode().split() for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i in words if not held[i] for w in [*words[i], "end"])
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(w) + 1, sum(c[x] > 0 for x in [*w, "end"]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, "end"])) for i, w in words.items()}


def corpus(n=120):
    rnd = random.Random(2)
    vocab = ["the", "The", "a", "über", "ÉTÉ", "x y", *(f"w{i}" for i in range(200))]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 5, 40, 90])))) for i in range(n)]
    return [*rows, (500, None), (501, " \n"), (502, "the " * 4000)]


def test_base_and_counts_against_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    want = brute(corpus())
    rows = lm.query_of(docs_of(corpus()).repartition(3)).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_windows_score_each_position_once():
    model = object.__new__(lm.Model)
    model.end_id, model.start, model.input, model.cls = 9, 11, np.arange(10), np.zeros(10, int)
    ends = np.array([0, 0, 1, 31, 32, 100])
    x, y, real, doc, _ = model.windows(np.arange(100) % 9, ends)
    assert np.bincount(doc, real.sum(1)).tolist() == (np.diff(ends) + 1).tolist()
    for d, (a, b) in enumerate(zip(ends, ends[1:])):
        assert y[doc == d][real[doc == d]].tolist() == [*(np.arange(a, b) % 9).tolist(), 9]


def test_gradients():
    rng = np.random.default_rng(0)
    net = lm.Attention(7, 5, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.integers(0, 7, (3, 6)), rng.integers(0, 5, (3, 6)), np.ones((3, 6))
    g = net.gradients(x, y, w)
    for k, v in net.p.items():
        at = tuple(rng.integers(0, s) for s in v[: lm.WINDOW if k != "P" else 6].shape)
        loss = []
        for e in (1e-5, -1e-5):
            v[at] += e
            loss.append(-net.log_probs(x, y).mean())
            v[at] -= e
        assert abs((loss[0] - loss[1]) / 2e-5 - g[k][at]) < 1e-4


def test_classes_and_shares_form_a_distribution_and_beat_unigrams(monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 8)
    rng = np.random.default_rng(1)
    sample = [np.tile(rng.permutation(40)[:4], 30) for _ in range(40)]
    counts = np.bincount(np.concatenate(sample), minlength=51).astype(float)
    model = lm.Model(sample, counts, 50)
    for before in range(lm.CLASSES):
        by = np.bincount(model.cls, np.exp(model.log_share[before]), lm.CLASSES)
        assert np.allclose(by[np.unique(model.cls)], 1, atol=1e-4)
    got = model.score(np.concatenate(sample), np.arange(0, 41 * 120, 120))
    assert got.sum() > np.log10(counts / counts.sum())[np.concatenate(sample)].sum()


def test_nothing_to_learn_from(docs_of):
    assert lm.query_of(docs_of([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.query_of(docs_of([(held, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.score < 0
    assert bpe.load(bpe.default_path()).tokens


def test_context_of_the_first_model():
    assert lm.WINDOW >= 32 and lm.OVERLAP >= 4 and lm.STEPS >= 1000
    model = object.__new__(lm.Model)
    model.end_id, model.start, model.input, model.cls = 99, 101, np.arange(100), np.zeros(100, int)
    _, y, real, _, _ = model.windows(np.arange(90), np.array([0, 90]))
    assert real[1].argmax() >= 4 and y.shape[1] >= 32  # subwords seen before a later window's first score, and in all


def scored(docs_of, monkeypatch, rows, **bounds):
    """The scoring of rows, with what the model learned from them."""
    for k, v in {"STEPS": 5, "BATCH": 8, **bounds}.items():
        monkeypatch.setattr(lm, k, v)
    kept = []
    made = lm.Model.__init__

    def keep(self, source, counts, *more):
        kept.append((source, counts))
        made(self, source, counts, *more)
        kept.append(self)

    monkeypatch.setattr(lm.Model, "__init__", keep)
    lm.query_of(docs_of(rows)).collect()
    return kept[0][0], kept[0][1], kept[1]


def training(rows):
    texts = [bpe.load(bpe.default_path()).library_texts(lm.pa.array([(t or "").lower()]))[0].astype(int).tolist() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    return [x.tolist() if hasattr(x, "tolist") else x for x in texts]


def test_statistics_come_from_all_training_documents(docs_of, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.choice([0, 1, 3, 9])))) for i in range(4000)]
    source, counts, model = scored(docs_of, monkeypatch, rows, BLOCK_BYTES=4000)
    pairs = Counter(p for x in training(rows) for p in zip([source.end_id, *x], [*x, source.end_id]))
    want = Counter()
    for (a, b), n in pairs.items():
        want[int(model.cls[a]), b] += n
    got = source.table(lm.pair_keys, model.cls, lm.CLASSES)
    assert {(int(a), int(b)): int(got[a, b]) for a, b in np.argwhere(got)} == dict(want) and got.sum() == counts.sum()
    column = lm.frequent_column(counts)
    beside = source.table(lm.beside_keys, column, 2 * (lm.FREQUENT + 1))
    for (a, b), n in list(pairs.items())[:50]:
        assert column[a] == lm.FREQUENT or beside[column[a], b] == n
        assert column[b] == lm.FREQUENT or beside[column[b] + lm.FREQUENT + 1, a] == n
    assert beside.sum() == 2 * counts.sum()


def test_windows_drawn_grow_with_the_documents(docs_of, monkeypatch):
    rows = [(i, f"w{i} x{i}") for i in range(3000)]
    few, many = (scored(docs_of, monkeypatch, rows[:n], STEPS=1, BATCH=2)[0] for n in (750, 3000))
    assert many.steps > 3 * few.steps > 3 * lm.STEPS
    times = [sum(b[3].sum() for b in x.batches()) for x in (few, many)]
    assert times[1] > 3 * times[0] and abs(times[1] / (many.n * lm.SHARE) - 1) < 0.5


def test_the_network_is_fitted_on_every_window_where_it_lies(docs_of, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.choice([1, 3, 9, 60])))) for i in range(2000)]
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4000)
    source, _, model = scored(docs_of, monkeypatch, rows, STEPS=5, BATCH=8)
    windows = sum(int(lm.windows_in(np.array([len(x) + 1]))[0]) for x in training(rows))
    assert source.n == windows > 5 * 8 and source.used == windows
    texts = [np.array(x) for x in training(rows)[:200]]
    flat, ends = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    fitted = model.score(flat, ends).sum()
    model.net = lm.Attention(len(model.net.p["E"]), lm.CLASSES, np.random.default_rng(5))
    assert fitted > model.score(flat, ends).sum()


def test_rounds_take_each_window_once():
    assert sum(lm.ROUNDS) == 1
    for n in (0, 1, 5, 63, 64, 1000):
        taken = [lm.of_round(n, sum(lm.ROUNDS[:k]), sum(lm.ROUNDS[: k + 1])) for k in range(len(lm.ROUNDS))]
        assert sorted(np.concatenate(taken).tolist()) == list(range(n))


def test_windows_come_from_whole_documents(docs_of, monkeypatch):
    used = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(used, " ".join(f"w{i % 700}" for i in range(6000)))]
    (ids,) = training(rows)
    assert len(ids) > 9000
    source = scored(docs_of, monkeypatch, rows, STEPS=100, BATCH=128)[0]
    assert source.share == 1
    monkeypatch.setattr(lm, "STEPS", 0)  # each part once
    source.steps = 0
    scored_positions, ends = Counter(), 0
    for slices, begin, left, times in source.batches():
        real = lm.Model.positions(model_of(source.end_id), slices, begin, left)
        scored_positions.update(real[1][real[2]].tolist())
        ends += int((real[1][real[2]] == source.end_id).sum())
    assert ends == 1 and scored_positions == Counter([*ids, source.end_id])


def model_of(end_id):
    model = object.__new__(lm.Model)
    model.end_id, model.start, model.input, model.cls = end_id, end_id + 1, np.arange(end_id + 1), np.zeros(end_id + 1, int)
    return model

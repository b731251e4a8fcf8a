import random
import re

import numpy as np
import pytest
from corvane.llm import _graph, neardup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [str(i) for i in range(2000)] + ["É", "é", "A", "a"]
    rows, base = [], []
    for i in range(120):
        kind = rnd.random()
        if base and kind < 0.6:
            w = list(rnd.choice(base[-6:]))
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 4, 5, 6, 80, 120, 200]))]
        base.append(w)
        text = " ".join(w)
        rows.append((i, text.upper() if rnd.random() < 0.1 else text))
    return [*rows, (500, None), (501, ""), (502, " \n"), (503, "x y"), (504, "X  Y"), (505, rows[50][1])]


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80), (3, 85)])
def test_against_brute_force(docs_of, seed, percent):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.dedup(docs_of(rows).repartition(4), percent).collect()}
    assert got == brute(rows, percent)


def test_a_large_group_of_near_copies_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS_A_BLOCK", 8)
    rnd = random.Random(9)
    base = [str(rnd.randrange(5000)) for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(150)] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.dedup(docs_of(rows), 85).collect()}
    assert got == brute(rows, 85)


def test_empty_table_repeated_rows_null_ids(docs_of):
    assert neardup.dedup(docs_of([])).count() == 0
    rows = [(4, "a b c d e f", 1), (4, "a b c d e f", 1), (9, "a b c d e f", 2), (None, "a b c d e f", 3)]
    out = neardup.dedup(docs_of(rows, ", kept int")).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in out) == [(-1, None, True), (4, 4, True), (4, 4, True), (9, 4, False)]


def test_no_join_broadcasts_a_table_through_the_driver(docs_of, monkeypatch):
    plans = []
    settle = neardup.C.settle

    def keep(df, name):
        out = settle(df, name)
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(neardup.C, "settle", keep)
    docs = docs_of(corpus(1)).repartition(4)
    keep(neardup.dedup(docs, 85), "result")
    assert {"pairs", "links", "moved", "labels", "open", "rest", "result"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "Broadcast" in plan]


def test_components_of_a_long_path(spark):
    order = list(range(60))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (900, 901)], "a long, b long")
    got = {r.id: r.component for r in _graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 900: 900, 901: 900}


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 63, 900, np.uint64)
    miss = 0
    for _ in range(60):
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 75, np.uint64)])) for _ in range(2))
        s = neardup.odd_sketch(neardup.minhash([x, y], 128))
        miss += int(np.bitwise_count(s[0] ^ s[1]).sum()) > neardup.most_xor(0.85, 128, 512)
    assert not miss
    s = neardup.odd_sketch(neardup.minhash([rng.integers(0, 1 << 63, 900, np.uint64) for _ in range(2)], 128))
    assert int(np.bitwise_count(s[0] ^ s[1]).sum()) > neardup.most_xor(0.85, 128, 512)


def test_sketches_of_full_sets_only_refute_what_is_apart():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 3000, np.uint64)
    for n in (20, 255, 260, 3000):
        for extra in (0, 1, n // 12, n // 2):
            x, y = (np.unique(np.concatenate([common[:n], rng.integers(0, 1 << 63, extra, np.uint64)])) for _ in range(2))
            a, b = (np.frombuffer(neardup.whole_sketch(s), "<u8")[None, :] for s in (x, y))
            words = min(a.shape[1], b.shape[1])
            count = int(np.bitwise_count(neardup.fold(a, words) ^ neardup.fold(b, words)).sum())
            apart = len(np.setxor1d(x, y))
            assert 0.7 * apart <= count <= apart

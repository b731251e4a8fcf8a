import random

import pytest
from corvane.llm import substring


def brute(rows, window=20):
    """The contract, word for word, on (doc_id, text) rows with distinct ids."""
    words = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d in sorted(words):
        for s in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][s : s + window]), (d, s))
    out = {}
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (d, s):
                gone.update(range(s, s + window))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocab = ["a", "b", "the", "of", "Über", "x\u00a0y", *map(str, range(300))]
    word = lambda k: [rnd.choice(vocab) for _ in range(k)]
    shared = [word(rnd.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = word(rnd.randint(0, 50))
        for _ in range(rnd.randint(0, 3)):
            w += rnd.choice(shared)[rnd.randint(0, 8) :] + word(rnd.randint(0, 10))
        rows.append((i * 3, rnd.choice([" ", "\n", " \t"]).join(w)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, ""), (1004, " \n "), (1005, "z " * 90), (1006, "z " * 25), (1007, " ".join(word(3000)))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs_of, seed):
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(docs_of(rows).repartition(5)).collect()}
    assert got == brute(rows)


def test_empty_table_extra_columns_repeated_rows_and_null_ids(docs_of):
    assert substring.query_of(docs_of([])).count() == 0
    text = " ".join(map(str, range(30)))
    rows = [(7, text, 1), (7, text, 2), (9, text, 3), (None, text, 4)]
    out = substring.query_of(docs_of(rows, ", n_words int")).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in out) == [(-1, 30, 0), (7, 30, 0), (7, 30, 0), (9, 30, 30)]

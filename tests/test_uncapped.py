import random

from corvane.operators import dedupe as D
from corvane.operators import qa as A


def test_citations_link_rows_of_a_gram_that_many_hits_share(spark):
    line = "one two three four five six seven eight".split()
    rows = spark.createDataFrame([(i, 0, line) for i in range(40)], "doc_id long, line int, tok array<string>")
    assert {r.citation for r in D.citation_groups(rows).collect()} == {"C0001"} and D.citation_groups(rows).count() == 40
    assert D.citation_groups(rows, most=30).count() == 0


def groups(rows, most):
    """By brute force over all pairs."""
    sig = {i: frozenset(zip(*[(w := c.split())[k:] for k in range(5)])) for i, c in rows}
    n = {}
    for s in sig.values():
        for g in s:
            n[g] = n.get(g, 0) + 1
    first = {i: i for i in sig}
    linked = set()
    for a in sig:
        for b in sig:
            both = sig[a] & sig[b]
            if a < b and sum(1 < n[g] <= (most or 10**9) for g in both) >= 2 and (len(both) / len(sig[a] | sig[b]) >= 0.45 or len(both) / min(len(sig[a]), len(sig[b])) >= 0.8):
                linked |= {a, b}
                x, y = sorted((first[a], first[b]))
                first = {i: x if f == y else f for i, f in first.items()}
    return {(i, first[i]) for i in linked}


def test_near_equal_windows_meet_through_grams_of_many_rows(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(9, 30))] for _ in range(12)]
    rows = []
    for i in range(240):
        base = list(rnd.choice(bases))
        for _ in range(rnd.choice((0, 0, 1, 2, 4))):
            base[rnd.randrange(len(base))] = rnd.choice(words)
        lo, hi = rnd.choice(((0, 99), (0, 99), (0, 14), (3, 99)))
        rows.append((i, " ".join(base[lo:hi])))
    rows = [(i, c) for i, c in rows if len(c.split()) >= 8] + [(1000 + i, "one two three four five six seven eight nine") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, context string")
    for most in (None, 25, 4):
        assert {tuple(r) for r in A.duplicate_groups(df, most=most).collect()} == groups(rows, most)
    assert len(groups(rows, None)) > len(groups(rows, 25))

import hashlib
import random
import re

from corvane.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window=10):
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(len(v), window)
            own = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1 if v else 0):
                if tuple(w[i : i + n]) in own:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def run(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: tuple(r)[1:] for r in decontaminate.query_of(docs, items).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(6)
    vocab = ["Das", "é", "ÉA", "x1", *map(str, range(60))]
    take = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, ", ".join(take(rnd.choice([1, 2, 3, 9, 10, 11, 14, 40])))) for i in range(8)]
    items += [(20, items[6][1]), (21, None), (22, "?!"), (100, items[7][1].upper())]
    docs = []
    for i in range(60):
        w = take(rnd.randint(0, 30))
        if rnd.random() < 0.6:
            v = words(rnd.choice(items)[1])
            a = rnd.randint(0, max(0, len(v) - 8))
            w += v[a : a + rnd.randint(5, 30)] + take(rnd.randint(0, 5))
        docs.append((i, rnd.choice([" ", "-", "\n"]).join(w)))
    docs += [(70, None), (71, ""), (72, "..."), (73, " ".join(take(3000))), (74, items[7][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_items_only(spark):
    rnd = random.Random(7)
    item = [str(rnd.randrange(9)) for _ in range(60)]
    docs = [(i, " ".join(item[i : i + 9 + i % 4])) for i in range(40)]
    items = [(1, " ".join(item))]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (None, "a", 6), (1, "a b", 7)], "doc_id long, text string, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.query_of(docs, none).collect()
    assert len(out) == 3 and not any(r.contaminated for r in out)
    items = spark.createDataFrame([(3, "A"), (3, "a"), (None, "b")], "item_id long, text string")
    out = decontaminate.query_of(docs, items).collect()
    assert sorted((r.doc_id or -1, r.n_hit, r.n_items) for r in out) == [(-1, 1, 1), (1, 1, 1), (1, 1, 1)]
    assert decontaminate.query_of(docs.limit(0), items).count() == 0

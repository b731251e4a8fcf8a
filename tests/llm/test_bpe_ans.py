import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corvane.llm import ans, bpe

ALPHABET = "aBcs'tred <|>|1٣五äÅΣσςİﬁ  \x1c\x85\u200b!?.\n\t\U0001f600é"


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(n)]
    return [*out, None, "", " ", "<|endoftext|>", "a<|startoftext|>b", "x" * 5000, "The quick brown fox's " * 500, *out[:3]]


def test_ids_and_text_are_the_librarys(docs_of):
    texts = odd_texts(400)
    library = bpe.load(bpe.default_path()).library
    rows = {r.doc_id: r for r in bpe.encode(docs_of(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_query_digests(docs_of):
    library = bpe.load(bpe.default_path()).library
    row = bpe.query_of(docs_of([(1, "Hello, world")])).first()
    ids = library.encode("Hello, world", add_special_tokens=False).ids
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.query_of(docs_of([])).count() == 0


def test_segment_tree_merges_leftmost_lowest_rank():
    model = bpe.load(bpe.default_path())
    rnd = random.Random(5)
    symbols = list(model.inner.values())[:60]
    for n in [2, 3, 4, 5, 8, 9, 40]:
        for _ in range(50):
            word = [rnd.choice(symbols) for _ in range(n)]
            slow = list(word)
            while True:
                ranks = [(model.pairs.get(a << 24 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(slow, slow[1:]))]
                if not ranks or min(ranks)[0] == 1 << 40:
                    break
                rank, i = min(ranks)
                slow[i : i + 2] = [model.merged[rank]]
            assert model.merge(list(word)) == slow


@pytest.mark.parametrize("n", [0, 1, 31, 32, 8192, 8193, ans.BLOCK, ans.BLOCK + 1, 3 * ans.BLOCK - 5])
def test_blocks_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49000).astype(np.uint32)
    coder = ans.Coder(ans.frequencies(np.bincount(ids, minlength=49408)))
    assert (coder.decode(coder.encode(ids)) == ids).all()


def test_damage_is_noticed():
    ids = np.arange(5000, dtype=np.uint32) % 300
    coder = ans.Coder(ans.frequencies(np.bincount(ids)))
    block = bytearray(coder.encode(ids)[0])
    block[len(block) // 2] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        coder.decode([bytes(block)])


def test_frequencies():
    for counts in ([5], [1, 0, 10**12], [1] * 1000, np.arange(40000)):
        f = ans.frequencies(np.array(counts))
        assert f.sum() == 1 << ans.BITS and ((f > 0) == (np.array(counts) > 0)).all()


def test_files_hold_ids_in_order(docs_of):
    texts = odd_texts(300)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in ans.query_of(docs_of(rows).repartition(6)).collect()}
    library, start = bpe.load(bpe.default_path()).library, 0
    for doc_id, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_are_read_by_their_folder_alone(spark, docs_of, tmp_path):
    rows = [(i, "some words " * (i % 5)) for i in range(50)]
    ans.write(docs_of(rows), str(tmp_path / "f"), ids_a_file=100)
    assert ans.read(spark, str(tmp_path / "f")).count() == 50
    (t,) = spark.read.parquet(str(tmp_path / "f" / "table")).collect()
    assert (t.version, t.end_id, sum(t.freq)) == (ans.VERSION, ans.END_ID, 1 << t.bits)
    spark.createDataFrame([(99, 1, 20, [1], [1 << 20])], ans.TABLE_SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "f" / "table"))
    with pytest.raises(ValueError, match="version"):
        ans.read(spark, str(tmp_path / "f"))


def test_parts_of_whole_documents_as_the_library(spark):
    """A seeded sample of documents, whole, against the library on whole texts; both encoders."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").sample(0.05, seed=7).toPandas().text.tolist()
    model = bpe.load(bpe.default_path())
    whole = [e.ids for e in model.library.encode_batch_fast([t or "" for t in docs], add_special_tokens=False)]
    for encode in (model.library_texts, model.encode_texts):
        ids, ends = encode(pa.array(docs, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == whole


def test_files_of_an_empty_table_and_repeated_ids(docs_of):
    assert ans.query_of(docs_of([])).count() == 0
    out = ans.query_of(docs_of([(5, "a b"), (5, "a b"), (None, "c")])).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in out] == [(None, 0, 2), (5, 2, 3), (5, 5, 3)]


def test_library_parts_as_whole_texts():
    model = bpe.load(bpe.default_path())
    texts = ["", "<|endoftext|>.", "-<|STARTOFTEXT|>x", "=\u0338a \u2260a", "(don't) 's .'s x's,", "\u0130stanbul. \u0130", "(\u20ac5.)", "x\u0301. \u00c9\u0301,", "12,3.", "--a--", "\u00df. \u00ff \u0178 \u017f", "a<|endoftext|>b", "\u212a Kelvin", "<a> |>a<|", "\x00a. a\u200b.", "\u4e2d\u3002a. a..."]
    whole = [e.ids for e in model.library.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from what is remembered
        ids, ends = model.library_texts(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == whole

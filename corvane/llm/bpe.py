"""BPE encoding and decoding with a public vocabulary file.

Merging uses a segment tree over the ranks of adjacent pairs.  A leaf holds
(rank, position) of the pair that starts at a symbol, an inner node the least of
its children, so the root is the leftmost pair of the lowest rank.  A merge
changes three leaves, each in logarithmic time, until the root is empty.  The
trees of pieces of like length are kept in one array and merge in step.

White space separates pieces in this vocabulary, so distinct words of a slice are
encoded once and texts are gathered from them.  Normalisation and splitting of
words beyond ASCII are the library's; ASCII words take a shorter, equal path.
A very long text is one slice of its own: memory grows with the longest text.

A null text is empty; an empty text has no ids.  Repeated rows, and rows with a
null id, are encoded like any other.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _common as C

#: Pieces a worker remembers before it starts anew; this bounds memory, not results.
PIECES_KEPT = 200_000
NONE = 1 << 62
#: Leaves of segment trees that are merged side by side.
CELLS = 1 << 18
#: A word of these letters is one piece, and stays one when normalised.
ONE_PIECE = regex.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks that make pieces of their own around a core; not the apostrophe, nor those that special tokens start or end with.
AROUND = '!"#$%&()*+,-./:;=?@[\\]^_`{|}~'
CORE = "^[0-9A-Za-zÀ-ÖØ-öø-ÿ]([^\n]*[0-9A-Za-zÀ-ÖØ-öø-ÿ])?$"
#: How a file splits text for the above to hold.
SPLITS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBPE:
    """A tokenizers file whose model is byte-level BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.library = spec["model"], Tokenizer.from_file(path)
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        pairs = self.pairs = {}
        merged = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.setdefault(vocab[a] << 24 | vocab[b], rank)
            merged.append(vocab[a + b])
        self.merged, self.merged_ids = merged, np.array([*merged, -1], np.int32)
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)] or [NONE], np.int64)
        chars = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = {c: vocab[c] for c in chars}
        self.inner_ids, self.last_ids = np.array([vocab[c] for c in chars], np.int32), np.array([vocab[c + end] for c in chars], np.int32)
        self.token_array = pa.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], pa.large_string())
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.ascii = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.splits = bool(end) and self.ascii.pattern.endswith(SPLITS)
        self.ends_word = np.zeros(max(self.tokens) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if end and t.endswith(end)]] = True
        self.by_library: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where they have no merge, or one of them is no symbol."""
        key = left.astype(np.int64) << 24 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], NONE)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge one piece's symbols until no adjacent pair has a rank."""
        block = np.full((1, 2 + (1 << len(symbols).bit_length())), -1, np.int32)
        block[0, 1 : len(symbols) + 1] = symbols
        out = self.merge_all(block)
        return out[out >= 0].tolist()

    def merge_all(self, symbols: np.ndarray) -> np.ndarray:
        """Merge pieces side by side, each in a segment tree of its own; -1 stands where a symbol went.

        symbols has a row for each piece: a border, its symbols, then -1; their number
        less two is a power of two.  The tree's leaf of a column holds the rank and
        column of the pair that starts there.
        """
        m, size = len(symbols), symbols.shape[1] - 2
        column = np.arange(size, dtype=np.int64)
        tree = np.full((m, 2 * size), NONE, np.int64)
        rank = self.ranks(symbols[:, :size], symbols[:, 1 : size + 1])
        tree[:, size:] = np.where(rank < NONE, rank << 32 | column, NONE)
        for node in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        after = np.tile(np.arange(1, size + 3, dtype=np.int32), (m, 1))
        before = after - 2
        sym, tree, after, before = symbols.ravel(), tree.ravel(), after.ravel(), before.ravel()
        rows = np.arange(m)
        while True:
            top = tree[rows * 2 * size + 1]
            live = top < NONE
            rows, top = rows[live], top[live]
            if not len(rows):
                return sym.reshape(m, -1)
            base, root = rows * (size + 2), rows * 2 * size
            at = top & 0xFFFFFFFF
            gone = after[base + at]
            right, left = after[base + gone], before[base + at]
            sym[base + at] = self.merged_ids[top >> 32]
            sym[base + gone] = -1
            after[base + at] = right
            before[base + right] = at
            here = sym[base + at]
            for leaf, a, b in ((gone, None, None), (at, here, sym[base + right]), (left, sym[base + left], here)):
                rank = NONE if a is None else self.ranks(a, b)
                node = root + size + leaf
                tree[node] = rank if a is None else np.where(rank < NONE, rank << 32 | leaf, NONE)
                offset = size + leaf.astype(np.int64)
                for _ in range(size.bit_length() - 1):
                    offset >>= 1
                    pair = root + 2 * offset
                    tree[root + offset] = np.minimum(tree[pair], tree[pair + 1])

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and where each starts."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(n)
        symbols = self.inner_ids[flat]
        symbols[end - 1] = self.last_ids[flat[end - 1]]
        size = np.left_shift(np.int64(1), np.ceil(np.log2(n + 1)).astype(np.int64)).clip(2)  # leaf 0 is the border's
        many = np.zeros(len(n), np.int64)
        own: list[tuple[np.ndarray, np.ndarray]] = []
        for s in np.unique(size).tolist():
            alike = np.flatnonzero(size == s)
            step = max(1, CELLS // s)
            for a in range(0, len(alike), step):
                part = alike[a : a + step]
                block = np.full((len(part), s + 2), -1, np.int32)
                column = np.arange(1, s + 1)
                inside = column <= n[part, None]
                block[:, 1:-1][inside] = C.gather(symbols, np.concatenate([[0], end]), part)[0]
                block = self.merge_all(block)
                many[part] = (block >= 0).sum(1)
                own.append((part, block[block >= 0]))
        start = np.concatenate([[0], np.cumsum(many)])
        out = np.empty(start[-1], np.uint32)
        for part, ids in own:
            lengths = many[part]
            out[np.arange(len(ids)) + np.repeat(start[part] - (np.cumsum(lengths) - lengths), lengths)] = ids
        return out, start

    def split_plain(self, text: str) -> list[bytes]:
        """The pieces of a text without special tokens, as the library normalises and splits it."""
        if ONE_PIECE.fullmatch(text):
            return [text.lower().encode()]
        if text.isascii() and text.isprintable():
            return [p.encode() for p in self.ascii.findall(text.lower())]
        byte = self.byte_of
        return [bytes([byte[c] for c in p]) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def tree_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit by the segment tree; a distinct piece is merged once."""
        place: dict[bytes, int] = {}
        index: list[int] = []
        ends = [0]
        for unit in units:
            if self.split is not None and "<" in unit:
                for part in self.split.split(unit):
                    if part in self.specials:
                        index.append(-1 - self.specials[part])
                    elif part:
                        index += [place.setdefault(p, len(place)) for p in self.split_plain(part)]
            else:
                index += [place.setdefault(p, len(place)) for p in self.split_plain(unit)]
            ends.append(len(index))
        at = np.array(index, np.int64)
        special = np.unique(at[at < 0])
        ids, start = self.pieces(list(place)) if place else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        at[at < 0] = len(place) + np.searchsorted(special, at[at < 0])
        ids = np.concatenate([ids, (-1 - special).astype(np.uint32)])
        start = np.concatenate([start, start[-1] + 1 + np.arange(len(special))])
        ids, size = C.gather(ids, start, at)
        by_piece = np.concatenate([[0], np.cumsum(size)])
        return ids, by_piece[np.array(ends)]

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them without added special tokens."""
        return self.tree_ids([text])[0].tolist()

    def decode(self, ids) -> str:
        """The tokens joined by a space, as the library does for a file without a decoder."""
        return self.decode_all(np.asarray(ids, np.uint32), np.array([0, len(ids)]))[0].as_py()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """decode of each ids[ends[i] : ends[i + 1]]."""
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self.token_array.take(pa.array(ids, pa.uint32())))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())

    def encode_texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text starts."""
        return gather_words(texts, lambda words: self.parts(words, self.tree_ids))

    def library_texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """As encode_texts, by the tokenizers library."""
        return gather_words(texts, lambda words: self.parts(words, lambda units: flat_lists(self.library_ids(units))))

    def new_ids(self, words: list[str], step: int = 4096) -> list[bytes]:
        """Ids of each word by the library, as 32-bit integers; a few thousand words at a time, as its encodings are large.

        Words of plain letters are one piece each, so they go to the library side
        by side and their ids are told apart by the end-of-word suffix.
        """
        out: list[bytes] = [b""] * len(words)
        whole = [bool(self.splits and ONE_PIECE.fullmatch(w)) for w in words]
        rest = [i for i, x in enumerate(whole) if not x]
        for a in range(0, len(rest), step):
            part = rest[a : a + step]
            for i, e in zip(part, self.library.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        letters = [i for i, x in enumerate(whole) if x]
        for a in range(0, len(letters), step):
            part = letters[a : a + step]
            ids = np.array(self.library.encode_batch_fast([" ".join([words[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not end each word with its suffix")
            raw, at = ids.tobytes(), 0
            for i, end in zip(part, ends):
                out[i] = raw[4 * at : 4 * end]
                at = end
        return out

    def library_ids(self, words: list[str]) -> list[bytes]:
        """As new_ids; words that the worker has met before are remembered, up to PIECES_KEPT of them."""
        known = self.by_library
        new = [w for w in words if w not in known]
        own = dict(zip(new, self.new_ids(new)))
        out = [own[w] if w in own else known[w] for w in words]
        for w in new[: max(0, PIECES_KEPT - len(known))]:
            known[w] = own[w]
        return out

    def parts(self, whole: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (whole), one after the other, and where each starts; encode gives those of distinct units.

        ASCII punctuation around a core that starts and ends with a letter or
        digit is a piece of its own, so cores and punctuation are encoded apart.
        """
        if not self.splits or not len(whole):
            return encode(whole.to_pylist())
        left = pc.ascii_ltrim(whole, AROUND)
        core = pc.ascii_rtrim(left, AROUND)
        apart = pc.match_substring_regex(core, CORE)
        core = pc.if_else(apart, core, whole)
        plain = pc.and_(pc.string_is_ascii(core), pc.invert(pc.match_substring(core, "<")))
        core = pc.if_else(plain, pc.ascii_lower(core), core)  # as the file's normaliser does
        n, n_left, n_core = (np.asarray(pc.binary_length(x), np.int64) for x in (whole, left, core))
        cut = np.asarray(apart)
        before, after = np.where(cut, n - n_left, 0), np.where(cut, n_left - n_core, 0)
        coded = core.dictionary_encode()
        units = coded.dictionary.to_pylist()
        marks = {"": 0}
        part = np.zeros((len(whole), 3), np.int64)
        part[:, 1] = np.asarray(coded.indices)
        for column, size in ((0, before), (2, after)):
            at = np.flatnonzero(size)
            cuts = zip(whole.take(pa.array(at)).to_pylist(), size[at].tolist())
            found = [w[:k] for w, k in cuts] if column == 0 else [w[-k:] for w, k in cuts]
            part[at, column] = [marks.setdefault(x, len(marks)) for x in found]
        part[:, ::2] += len(units)
        ids, start = encode([*units, *marks])
        ids, size = C.gather(ids, start, part.ravel())
        ends = np.zeros(len(whole) + 1, np.int64)
        np.cumsum(size.reshape(-1, 3).sum(1), out=ends[1:])
        return ids, ends


def flat_lists(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    start = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in lists], out=start[1:])
    return np.frombuffer(b"".join(lists), np.uint32), start


def gather_words(texts, encode) -> tuple[np.ndarray, np.ndarray]:
    """encode gives the ids of distinct words, one after the other, and where each starts."""
    words, index, ends = C.index_array(texts)
    ids, start = encode(words)
    ids, size = C.gather(ids, start, index)
    by_word = np.zeros(len(index) + 1, np.int64)
    np.cumsum(size, out=by_word[1:])
    return ids, by_word[ends]


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str | None = None, decoded: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids are little-endian unsigned 32-bit integers; decoded is made from them."""
    path = path or default_path()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load(path)
        ids, ends = model.encode_texts(batch.column("text"))
        raw, at = ids.astype("<u4", copy=False).tobytes(), (4 * ends).tolist()
        columns = [batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary())]
        names = ["doc_id", "n_tokens", "ids"]
        if decoded:
            columns.append(model.decode_all(ids, ends))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(columns, names)

    return C.map_arrow(C.ids_and_texts(docs), step, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def query_of(docs: DataFrame) -> DataFrame:
    return encode(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return query_of(C.table(spark, sf_dir, "documents"))

"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A leaf of the tree holds the rank of the pair that starts at one symbol; an inner
node holds the smaller of its children, the left one in ties.  The root is thus
the leftmost pair of the lowest rank.  A merge changes three leaves, each of them
and its ancestors in logarithmic time, until the root holds no pair.

Short pieces are merged together, one tree per row of an array; long pieces get a
tree of their own, so a piece of a million letters costs n log n.

White space is dropped by these tokenizers and never joins two tokens, and a word's
pieces are merged apart, so equal pieces are merged once for a bounded cache.  Long texts
are encoded window by window.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .batches import with_text_columns
from .pieces import CACHE_BYTES, Cache, Cutter, windows
from .worker import kept

NONE = np.int64(1) << 60
#: Pieces of more symbols get a tree of their own.
ROW_SYMBOLS = 64
_ROW_CELLS = 1 << 18
#: Characters of texts that are cut and merged together.
_GROUP_CHARS = 1 << 20


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class PairRanks:
    """Rank and result of each mergeable pair of token ids."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list | tuple) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair can't merge."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)


def merge_long(symbols: list[int], pairs: PairRanks) -> list[int]:
    """Merge one piece with a tree of its own."""
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    none, result = (1 << 62), pairs.result.tolist()
    rank_of: dict[tuple[int, int], int | None] = {}  # of the pairs that this piece has come to
    tree = [none] * (2 * width)

    def key(i: int, j: int) -> int:
        pair = symbols[i], symbols[j]
        if pair not in rank_of:
            rank = int(pairs.lookup(np.array(pair[:1]), np.array(pair[1:]))[0])
            rank_of[pair] = None if rank == NONE else rank
        rank = rank_of[pair]
        return none if rank is None else rank * width + i

    for i in range(n - 1):
        tree[width + i] = key(i, i + 1)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        node >>= 1
        while node:
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
            node >>= 1

    symbols = list(symbols)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    while tree[1] != none:
        rank, i = divmod(tree[1], width)
        j = following[i]
        k = following[j]
        symbols[i], alive[j], following[i] = result[rank], False, k
        if j < n - 1:
            update(j, none)
        if k < n:
            before[k] = i
            update(i, key(i, k))
        else:
            update(i, none)
        if before[i] >= 0:
            update(before[i], key(before[i], i))
    return [s for s, a in zip(symbols, alive) if a]


def merge_rows(symbols: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merge many short pieces, a tree per row; (all ids row after row, ids per row)."""
    rows, most = symbols.shape
    width = 1 << max(0, most - 2).bit_length()
    symbols = symbols.astype(np.int64)
    at = np.arange(most)
    tree = np.full((rows, 2 * width), NONE)
    if most > 1:
        ranks = pairs.lookup(symbols[:, :-1], symbols[:, 1:])
        there = (at[1:] < lengths[:, None]) & (ranks < NONE)
        tree[:, width : width + most - 1] = np.where(there, ranks * width + at[:-1], NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    following = np.broadcast_to(at + 1, symbols.shape).copy()
    before = np.broadcast_to(at - 1, symbols.shape).copy()
    alive = at < lengths[:, None]
    live = np.nonzero(tree[:, 1] < NONE)[0]

    def update(r: np.ndarray, i: np.ndarray, values: np.ndarray) -> None:
        node = width + i
        tree[r, node] = values
        node = node >> 1
        for _ in range(width.bit_length() - 1):
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            node = node >> 1

    def keys(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ranks = pairs.lookup(symbols[r, i], symbols[r, j])
        return np.where(ranks < NONE, ranks * width + i, NONE)

    while len(live):
        rank, i = np.divmod(tree[live, 1], width)
        j = following[live, i]
        k = following[live, j]
        symbols[live, i] = pairs.result[rank]
        alive[live, j] = False
        following[live, i] = k
        inner = j < width
        update(live[inner], j[inner], np.full(int(inner.sum()), NONE))
        more = k < lengths[live]
        r, i2, k2 = live[more], i[more], k[more]
        before[r, k2] = i2
        update(r, i2, keys(r, i2, k2))
        update(live[~more], i[~more], np.full(int((~more).sum()), NONE))
        p = before[live, i]
        has = p >= 0
        update(live[has], p[has], keys(live[has], p[has], i[has]))
        live = live[tree[live, 1] < NONE]
    return symbols[alive], alive.sum(axis=1)


class SegmentTreeBPE:
    """Encoder and decoder for a word-end byte-level vocabulary file of the tokenizers library.

    The file's normalizer, pre-tokenizer and special strings are followed as the
    library does; merging and decoding are done here.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("unk_token") or model.get("byte_fallback") or spec.get("decoder"):
            raise ValueError("only byte-level vocabularies with a plain decoder are supported")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.pairs = PairRanks(vocab, model["merges"])
        self.cutter = Cutter(path, Tokenizer.from_file(path))
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.cutter.special, key=len, reverse=True))) + ")") if self.cutter.special else None
        chars = byte_characters()
        self._byte = {c: b for b, c in enumerate(chars)}
        self._first = [vocab[c] for c in chars]
        self._last = [vocab[c + suffix] for c in chars]
        strings = {i: s for s, i in [*vocab.items(), *self.cutter.special.items()]}
        self._strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.cache = Cache(self._encode, cache_bytes)

    def _odd(self, word: str) -> list[bytes | int]:
        """Pieces, as bytes, and ids of special strings of a word that isn't plain."""
        out: list[bytes | int] = []
        for part in self._split.split(word) if self._split else [word]:
            if part in self.cutter.special:
                out.append(self.cutter.special[part])
            elif part:
                cut = self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalized(part))
                out += [bytes(map(self._byte.__getitem__, p)) for p, _ in cut if p]
        return out

    def merge_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        first, last = self._first, self._last
        rows: dict[int, list[tuple[int, list[int]]]] = {}
        for i, p in enumerate(pieces):
            symbols = [first[b] for b in p]
            symbols[-1] = last[p[-1]]
            if len(symbols) == 1:
                out[i] = np.array(symbols)
            elif len(symbols) > ROW_SYMBOLS:
                out[i] = np.array(merge_long(symbols, self.pairs))
            else:
                rows.setdefault((len(symbols) - 2).bit_length(), []).append((i, symbols))
        for level, members in rows.items():
            most = (1 << level) + 1
            block = max(1, _ROW_CELLS // most)
            for at in range(0, len(members), block):
                part = members[at : at + block]
                lengths = np.array([len(s) for _, s in part])
                grid = np.zeros((len(part), most), np.int64)
                grid[np.arange(most) < lengths[:, None]] = np.concatenate([s for _, s in part])
                ids, counts = merge_rows(grid, lengths, self.pairs)
                start = 0
                for (i, _), end in zip(part, np.cumsum(counts).tolist()):
                    out[i] = ids[start:end]
                    start = end
        return out

    def _encode(self, items: list[str]) -> list[bytes]:
        """Packed ids of each plain piece or odd word."""
        plain = self.cutter.is_plain
        split = [[p.encode("utf-8")] if plain(p) else self._odd(p) for p in items]
        distinct = list(dict.fromkeys(p for pieces in split for p in pieces if isinstance(p, bytes)))
        merged = {p: ids.astype("<u4").tobytes() for p, ids in zip(distinct, self.merge_pieces(distinct))}
        return [b"".join([int(p).to_bytes(4, "little") if isinstance(p, int) else merged[p] for p in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by blanks, special ones included: the decoding of a file without a decoder."""
        return " ".join(map(self._strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode_texts(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """(ids as packed little-endian 32-bit integers, decoded text) of each text; null is empty."""
        ids: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, list[str]]] = []

        def flush() -> None:
            found = self.cache.lookup(set().union(*[p for _, p in group]))
            for i, pieces in group:
                ids[i].append(b"".join(map(found.__getitem__, pieces)))
            group.clear()

        held = 0
        for i, text in enumerate(texts):
            for window in windows(text or ""):
                group.append((i, self.cutter(window)))
                held += len(window)
                if held > _GROUP_CHARS:
                    flush()
                    held = 0
        flush()
        packed = [b"".join(parts) for parts in ids]
        return packed, [" ".join([self.decode(p) for p in parts if p]) for parts in ids]


def bpe_encode(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None, cache_bytes: int = CACHE_BYTES
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with token_ids (binary) and decoded (string) for each whole text.

    token_ids: the ids as little-endian unsigned 32-bit integers.  A null or empty
    text, or one of white space, has no ids and decodes to empty text.  A very long
    text is encoded in windows that end at white space; a single word of n letters
    costs n log n time and some 300 n bytes.  Rows that repeat are encoded alike;
    an empty table gives an empty one; other columns pass through, and columns that
    already have the new names are replaced.
    """
    fields = [("token_ids", T.BinaryType()), ("decoded", T.StringType())]
    key = ("bpe", tokenizer_path, cache_bytes)
    return with_text_columns(docs, text_col, fields, lambda: kept(key, lambda: SegmentTreeBPE(tokenizer_path, cache_bytes)).encode_texts, keep, key, 1 << 20)

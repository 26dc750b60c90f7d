"""Packing token ids of documents into sequences of one length, by first-fit decreasing.

A document's ids and an end id are cut at every full sequence, so that only its last
piece is shorter.  Pieces are dealt at random into groups of about ``GROUP_PIECES``,
whatever document they come from, and each group is packed on its own: pieces in order
of falling length go to the first sequence with room, which a tournament tree over the
sequences' free places finds in logarithmic time.  A group is all that one task holds.

What sequences of a group still lack is then taken from the emptiest of them: its
pieces are cut to fill the gaps of the others, and the rest of the last one is parted
into sequences of powers of two, which aren't padded.
"""

from __future__ import annotations

import gc
import os
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from .batches import slices
from .pieces import Cache, Cutter
from .worker import give_back, kept, release

SEQUENCE_TOKENS, END_ID = 2048, 1
#: Expected pieces of a group, if each byte were a token; most groups have fewer.
GROUP_PIECES = 8192
#: Bytes of a generation of the cache of encoded words.
WORD_CACHE_BYTES = 80 << 20
#: Words and pieces that are cut and encoded together.
TOGETHER = 128
_SALT = 20_011


class WordEncoder:
    """Packed ids (little-endian, 32 bits) of whole texts, word by word through a bounded cache.

    White space never stands in a token of the vocabularies that the cutter accepts, so
    words are encoded apart.  Words that the cache lacks are cut into pieces, and pieces
    that a second cache lacks go to the library many at once: each piece ends with the
    only token that has the vocabulary's end of a word, which parts the result again.
    """

    def __init__(self, path: str, cache_bytes: int = WORD_CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cutter = Cutter(path, self.library)
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or ""
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.words = Cache(self._encode_words, cache_bytes)
        self.pieces = Cache(self._encode_pieces, cache_bytes // 2)

    def _alone(self, items: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in self.library.encode_batch_fast(items, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        (found,) = self.library.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *stops], stops)] if len(stops) == len(pieces) and stops[-1] == len(packed) else self._alone(pieces)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), TOGETHER):
            part = pieces[at : at + TOGETHER]
            out += self._together(part) if self.cutter.is_plain(" ".join(part)) else self._alone(part)
        return out

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        cut: list[list[str]] = []
        for at in range(0, len(words), TOGETHER):
            cut += self.cutter.each(b"\n".join(words[at : at + TOGETHER]).decode("utf-8"))
        found = self.pieces.lookup(set(chain.from_iterable(cut)))
        return [found[p[0]] if len(p) == 1 else b"".join(map(found.__getitem__, p)) for p in cut]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        known = self.words.young.get
        split = [(t or "").encode("utf-8").split() for t in texts]
        values = [list(map(known, words)) for words in split]
        holes = [[i for i, v in enumerate(row) if v is None] for row in values]
        missing = {words[i] for words, at in zip(split, holes) for i in at}
        if missing:
            found = self.words.lookup(missing)
            for words, row, at in zip(split, values, holes):
                for i in at:
                    row[i] = found[words[i]]
        return list(map(b"".join, values))


class Tournament:
    """Free places of sequences; :meth:`take` finds the first with room for a piece, from the root down."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room, self.used = room, 0
        self.free = [0] * (2 * self.leaves)

    def _set(self, leaf: int, free: int) -> None:
        tree, at = self.free, self.leaves + leaf
        tree[at] = free
        while at > 1:
            at >>= 1
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best

    def take(self, size: int) -> tuple[int, int]:
        """(sequence, place in it) for a piece; a new sequence where none has room."""
        tree = self.free
        if tree[1] < size:
            leaf, free = self.used, self.room
            self.used += 1
        else:
            at = 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] >= size else 2 * at + 1
            leaf, free = at - self.leaves, tree[at]
        self._set(leaf, free - size)
        return leaf, self.room - free


def first_fit_decreasing(lengths: list[int], room: int) -> list[list[int]]:
    """Indexes of the pieces of each sequence; pieces of one length keep their order."""
    tree = Tournament(len(lengths), room)
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        leaf, _ = tree.take(lengths[i])
        if leaf == len(bins):
            bins.append([])
        bins[leaf].append(i)
    return bins


def top_up(bins: list[list[int]], lengths: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, first id, ids) without padding: gaps are filled by cutting the pieces of the emptiest sequences.

    The last sequence that isn't full is parted into sequences of powers of two.
    """
    whole = [[(i, 0, lengths[i]) for i in b] for b in bins]
    fills = [sum(n for _, _, n in b) for b in whole]
    out = [b for b, f in zip(whole, fills) if f == room]
    lacking = sorted((k for k, f in enumerate(fills) if f < room), key=lambda k: (-fills[k], k))
    waiting = [whole[k] for k in lacking]
    while len(waiting) > 1:
        target = waiting.pop(0)
        gap = room - sum(n for _, _, n in target)
        while gap and waiting:
            i, first, n = waiting[-1].pop()
            part = min(gap, n)
            target.append((i, first, part))
            gap -= part
            if part < n:
                waiting[-1].append((i, first + part, n - part))
            elif not waiting[-1]:
                waiting.pop()
        if gap:
            waiting.append(target)
            break
        out.append(target)
    for rest in waiting:
        left = sum(n for _, _, n in rest)
        while left:
            size = gap = room if left >= room else 1 << (left.bit_length() - 1)
            part: list[tuple[int, int, int]] = []
            while gap:
                i, first, n = rest.pop(0)
                part.append((i, first, min(gap, n)))
                if n > gap:
                    rest.insert(0, (i, first + gap, n - gap))
                gap -= min(gap, n)
            out.append(part)
            left -= size
    return out


def _cut(tokenizer_path: str, room: int, end_id: int, schema: pa.Schema, id_col: str, text_col: str) -> Callable:
    end, row_bytes = struct.pack("<I", end_id), 4 * room

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        key = ("words", tokenizer_path)
        release(key)
        gc.disable()  # many short lists and no cycles: what isn't needed goes by itself
        for batch in batches:
            for part in slices(batch, text_col):
                encoder = encoder or kept(key, lambda: WordEncoder(tokenizer_path))
                rows, starts, sizes, totals, ids = [], [], [], [], []
                for row, packed in enumerate(encoder.ids(part.column(text_col).to_pylist())):
                    packed += end
                    for at in range(0, len(packed), row_bytes):
                        piece = packed[at : at + row_bytes]
                        rows.append(row)
                        starts.append(at >> 2)
                        sizes.append(len(piece) >> 2)
                        totals.append(len(packed) >> 2)
                        ids.append(piece)
                columns = [part.column(id_col).take(pa.array(rows, pa.int64())), starts, sizes, totals, ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema)], schema=schema)
        gc.enable()
        give_back()

    return run


def _pack(room: int, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_pylist()
        base = group.column("group")[0].as_py() << 32
        rows, firsts, sizes, sequences, offsets = [], [], [], [], []
        for number, members in enumerate(top_up(first_fit_decreasing(lengths, room), lengths, room)):
            at = 0
            for i, first, n in members:
                rows.append(i)
                firsts.append(first)
                sizes.append(n)
                sequences.append(base + number)
                offsets.append(at)
                at += n
        picked = group.combine_chunks().take(pa.array(rows, pa.int64()))
        first, size = np.array(firsts, np.int64), np.array(sizes, np.int64)
        ids = [p if n * 4 == len(p) else p[4 * a : 4 * (a + n)] for p, a, n in zip(picked.column("ids").to_pylist(), firsts, sizes)]
        columns = [picked.column(0), picked.column("start").to_numpy() + first, size, picked.column("doc_tokens"), ids, sequences, offsets]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def pack_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    sequence_tokens: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, doc_tokens, ids, sequence_id, offset.

    ids: the piece's token ids as little-endian unsigned 32-bit integers; start: ids of
    its document before it; doc_tokens: all of its document's, the end id included;
    offset: ids before it in its sequence.  The pieces of a sequence follow one another
    without gaps, every id of a document is in exactly one piece, and each sequence is
    full or as long as a power of two (at most about eleven of these a group).

    A null or empty text has the end id alone.  A very long text is cut into pieces that
    are packed apart; one very long word is encoded at once, at some 100 bytes a letter.
    Repeated rows, null and repeated ids are packed each on its own; rows are dealt to
    groups by their place in ``docs``, so a table whose rows come in another order is
    packed otherwise, and hot ids don't meet.  An empty table gives an empty one.  Other
    columns are neither read nor returned; ``id_col`` may have any name but those above.
    """
    field = docs.schema[id_col]
    cut = T.StructType([field, *[T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")], T.StructField("ids", T.BinaryType())])
    if len({c.lower() for c in [*cut.names, "sequence_id", "offset", "group"]}) < len(cut.names) + 3:
        raise ValueError(f"{id_col!r} is the name of a result")
    sized = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    groups = max(1, -(-(sized["n"] + sized["b"] // sequence_tokens) // group_pieces))
    pieces = docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(_cut(tokenizer_path, sequence_tokens, end_id, to_arrow_schema(cut), id_col, text_col), cut)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(_SALT)), F.lit(groups)))
    packed = T.StructType([*cut.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("group").applyInArrow(_pack(sequence_tokens, to_arrow_schema(packed)), packed)

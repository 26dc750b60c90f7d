"""Token counts with overlap resynchronisation for huge documents.

A huge document is cut into chunks that overlap.  Each chunk is encoded on its own
with offsets, and two neighbours are spliced at a boundary that both of them have
inside the overlap: a token starts there in both, white space stands before it, and
the same tokens with the same offsets follow it for ``PROOF`` tokens or up to the end
of the overlap.  White space never joins two tokens of these vocabularies, so what
follows such a boundary doesn't depend on what stands before it.  Where no boundary
agrees the overlap is doubled and the chunk encoded again; at the worst it reaches
the end of the text, which is then one chunk.

Both that and the counting of ordinary documents piece by piece through a bounded cache
rest on the same fact, so it is checked when a vocabulary is opened, and a file whose
tokens may hold white space is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .batches import with_text_columns
from .pieces import Cache, Cutter
from .worker import kept

#: Characters of a chunk and of the first overlap tried.
CHUNK_CHARS, OVERLAP_CHARS = 16_384, 256
#: Tokens that must agree after a boundary, fewer only where the overlap ends.
PROOF = 8
_SPACE = re.compile(r"[ \t-\r]")


class ResyncCounter:
    """Token counts of whole texts for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        if overlap >= chunk:
            raise ValueError("the overlap must be shorter than the chunk")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.cutter = Cutter(path, self.library)
        self.cache = Cache(self._count)

    def _count(self, items: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(items, add_special_tokens=False)]

    def _tokens(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, id) of each token of ``text[start:end]``, in offsets of the whole text."""
        e = self.library.encode(text[start:end], add_special_tokens=False)
        return [(a + start, b + start, i) for (a, b), i in zip(e.offsets, e.ids)]

    @staticmethod
    def _boundary(text: str, left: list, right: list, start: int, end: int) -> tuple[int, int] | None:
        """Where tokens of both chunks agree: (index in left, index in right); ``[start, end)`` is the overlap."""
        places = {t[0]: i for i, t in reversed(list(enumerate(left))) if t[0] > start}
        for j, token in enumerate(right):
            at = token[0]
            if at >= end:
                return None
            if at <= start or not _SPACE.match(text[at - 1]) or at not in places:
                continue
            i = places[at]
            # A token that touches the cut may be half a token on the left; all others must agree.
            inside = [t for t in left[i : i + PROOF] if t[1] < end]
            if inside and inside == right[j : j + len(inside)]:
                return i, j
        return None

    def count_huge(self, text: str) -> int:
        """Tokens of one text, chunk by chunk."""
        n, total, skip = len(text), 0, 0
        end = min(self.chunk, n)
        left = self._tokens(text, 0, end)
        proven = 0  # a boundary; all tokens before it are in ``total``
        while end < n:
            width, found = self.overlap, None
            while end - width > proven:
                start, stop = end - width, min(n, end - width + max(self.chunk, 2 * width))
                right = self._tokens(text, start, stop)
                found = self._boundary(text, left[skip:], right, start, end)
                if found:
                    break
                width *= 2
            if found:
                total += found[0]
                left, skip, end = right, found[1], stop
                proven = left[skip][0]
            else:  # all that is not yet counted is overlap: encode it again with more text behind it
                end = min(n, proven + 2 * (end - proven) + self.chunk)
                left, skip = self._tokens(text, proven, end), 0
        return total + len(left) - skip

    def count_texts(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """(UTF-8 bytes, tokens) of each text; null is empty."""
        sizes = [len((t or "").encode("utf-8")) for t in texts]
        split = [self.cutter(t or "") if len(t or "") <= self.chunk else None for t in texts]
        found = self.cache.lookup(set().union(*[s for s in split if s is not None]))
        counts = [sum(map(found.__getitem__, s)) if s is not None else self.count_huge(t) for t, s in zip(texts, split)]
        return sizes, counts


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    keep: list[str] | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_bytes and n_tokens of each whole text.

    A null or empty text has no bytes and no tokens.  A very long text is encoded chunk
    by chunk, so it costs the memory of a chunk beside itself.  Repeated rows count
    alike; an empty table gives an empty one; columns that already have the new names
    are replaced.
    """
    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType())]
    key = ("count", tokenizer_path, chunk_chars, overlap_chars)
    return with_text_columns(
        docs, text_col, fields, lambda: kept(key, lambda: ResyncCounter(tokenizer_path, chunk_chars, overlap_chars)).count_texts, keep, key, 1 << 20
    )

"""Block-max WAND over the posting lists of one shard, for one query.

A posting list is cut into blocks of ``BLOCK`` postings.  Each block has its last
document, the greatest impact of its postings, and its bytes: the widths of gaps and
counts in one byte, then the gaps between documents, then the counts.  Only a block
whose documents may reach the threshold is ever unpacked.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heappush, heapreplace
from operator import attrgetter

import numpy as np

BLOCK = 128
#: Scales of the score: an impact is SCALE * tf div (TF_PART * tf + LENGTH_PART * m).
SCALE, TF_PART, LENGTH_PART = 1_000_000_000, 1000, 20
_STANDS = attrgetter("doc")
_KINDS = (np.dtype("<u1"), np.dtype("<u2"), np.dtype("<u4"))


def impact(tf, m):
    """What one occurrence list of a term adds to a document's score, before the term's weight; ints or arrays."""
    return SCALE * tf // (TF_PART * tf + LENGTH_PART * m)


def pack_blocks(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray) -> dict[str, np.ndarray]:
    """Postings in order of term and document -> blocks of all terms together.

    Returns terms, df, blocks (of each term), last, most, ends (byte ends within the
    term's body), sizes (bytes of each term's body) and body.
    """
    n = len(term)
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if n else np.zeros(0, np.int64)
    df = np.diff(np.r_[starts, n])
    place = np.arange(n) - np.repeat(starts, df)
    heads = np.flatnonzero(place % BLOCK == 0)
    held = np.diff(np.r_[heads, n])
    blocks = -(-df // BLOCK)
    gaps = doc - np.r_[0, doc[:-1]]
    gaps[heads] = doc[heads]
    width = [np.searchsorted([0xFF, 0xFFFF], np.maximum.reduceat(x, heads)) if n else heads for x in (gaps, tf)]
    spans = [held << w for w in width]
    sizes = 1 + spans[0] + spans[1]
    at = np.r_[0, np.cumsum(sizes)]
    body = np.zeros(at[-1], np.uint8)
    body[at[:-1]] = width[0] << 2 | width[1]
    block = np.repeat(np.arange(len(heads)), held)
    for x, w, base in ((gaps, width[0], at[:-1] + 1), (tf, width[1], at[:-1] + 1 + spans[0])):
        spot = base[block] + ((np.arange(n) - heads[block]) << w[block])
        for byte in range(4):
            wide = np.flatnonzero((1 << w[block]) > byte)
            body[spot[wide] + byte] = (x[wide] >> (8 * byte)) & 0xFF
    of_term = np.r_[0, np.cumsum(blocks)]
    edges = at[of_term]
    return {
        "terms": term[starts], "df": df, "blocks": blocks, "last": doc[heads + held - 1] if n else heads,
        "most": np.maximum.reduceat(impact(tf, m[doc]), heads) if n else heads, "ends": at[1:] - np.repeat(edges[:-1], blocks), "sizes": np.diff(edges), "body": body,
    }


def unpack(body: bytes, start: int, end: int) -> tuple[list[int], list[int]]:
    """(documents, counts) of one block."""
    gap, tf = body[start] >> 2, body[start] & 3
    n = (end - start - 1) // ((1 << gap) + (1 << tf))
    docs = np.frombuffer(body, _KINDS[gap], n, start + 1).cumsum(dtype=np.int64)
    return docs.tolist(), np.frombuffer(body, _KINDS[tf], n, start + 1 + (n << gap)).tolist()


class Postings:
    """One term's list for one query: where it stands, and the blocks' bounds."""

    __slots__ = ("weight", "last", "bounds", "ends", "body", "most", "shallow", "block", "docs", "tfs", "at", "doc")

    def __init__(self, weight: int, last: list[int], most: list[int], ends: list[int], body: bytes):
        self.weight, self.last, self.ends, self.body = weight, last, ends, body
        self.bounds = [weight * x for x in most]
        self.most = max(self.bounds)
        self.shallow = 0  # the block that a shallow move came to; no bytes are read for it
        self.block = -1  # the block that is unpacked
        self.docs: list[int] = []
        self.tfs: list[int] = []
        self.at = 0
        self.doc = -1

    def seek(self, doc: int, end: int) -> None:
        """Stand at the first document from ``doc`` on; ``end`` where there is none."""
        k = self.shallow
        last = self.last
        if last[k] < doc:
            k = bisect_left(last, doc, k + 1)
            if k == len(last):
                self.doc = end
                return
            self.shallow = k
        if k != self.block:
            self.docs, self.tfs = unpack(self.body, self.ends[k - 1] if k else 0, self.ends[k])
            self.block, self.at = k, 0
        self.at = bisect_left(self.docs, doc, self.at)
        self.doc = self.docs[self.at]


def search(lists: list[Postings], m: list[int], most: int, floor: int = 0) -> list[tuple[int, int]]:
    """(score, document) of the ``most`` best documents with a score above ``floor``; of equal scores the first documents stay.

    ``m`` is each document's length part; documents are numbered from 0 in the order of ties.
    """
    end = len(m)
    lists = [x for x in lists if x.weight > 0]
    for x in lists:
        x.seek(0, end)
    lists.sort(key=_STANDS)
    best: list[tuple[int, int]] = []
    threshold = floor
    while True:
        bound = 0
        for p, x in enumerate(lists):
            bound += x.most
            if bound > threshold:
                break
        else:
            break
        pivot = x.doc
        if pivot == end:
            break
        n = len(lists)
        p += 1
        while p < n and lists[p].doc == pivot:
            p += 1
        # Shallow moves: the blocks that would hold the pivot, and where the first of them ends.
        bound, until = 0, end - 1
        for x in lists[:p]:
            k = x.shallow
            last = x.last
            if last[k] < pivot:
                k = bisect_left(last, pivot, k + 1)
                if k == len(last):  # no such document: it doesn't count, and the next move ends the list
                    x.shallow = k - 1
                    continue
                x.shallow = k
            bound += x.bounds[k]
            if last[k] < until:
                until = last[k]
        if bound > threshold:
            if lists[0].doc == pivot:
                score, length = 0, LENGTH_PART * m[pivot]
                for x in lists[:p]:
                    tf = x.tfs[x.at]
                    score += x.weight * (SCALE * tf // (TF_PART * tf + length))
                if score > threshold:
                    if len(best) < most:
                        heappush(best, (score, -pivot))
                    else:
                        heapreplace(best, (score, -pivot))
                    if len(best) == most and best[0][0] > threshold:
                        threshold = best[0][0]
                for x in lists[:p]:
                    x.seek(pivot + 1, end)
            else:
                for x in lists[:p]:
                    if x.doc < pivot:
                        x.seek(pivot, end)
        else:
            # No document before the end of these blocks, or before the next list, can pass.
            following = until + 1
            if p < n and lists[p].doc < following:
                following = lists[p].doc
            if following <= pivot:
                following = pivot + 1
            for x in lists[:p]:
                if x.doc < following:
                    x.seek(following, end)
        lists.sort(key=_STANDS)
        while lists and lists[-1].doc >= end:
            lists.pop()
    return sorted(((s, -d) for s, d in best), key=lambda r: (-r[0], r[1]))

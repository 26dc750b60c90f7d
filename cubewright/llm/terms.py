"""Terms of texts as UTF-8 bytes, a bounded stretch of a text at a time."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text whose terms are held at once.
STRETCH_BYTES = 1 << 20
_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_SIGNS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Terms:
    """Maximal runs of letters (and digits, if asked for) and of all characters beyond ASCII; only A-Z are lower-cased.

    Bytes beyond ASCII belong to terms whatever they are, so texts are cut as bytes.
    """

    def __init__(self, digits: bool):
        between = _SIGNS if digits else _SIGNS + bytes(range(0x30, 0x3A))
        self.table = bytes.maketrans(between + _UPPER, b" " * len(between) + _LOWER)

    def __call__(self, text: str | None) -> Iterator[list[bytes]]:
        """The terms in order, in lists that together are all of them; none for a null text."""
        if not text:
            return
        raw = text.encode("utf-8").translate(self.table)
        start = 0
        while len(raw) - start > STRETCH_BYTES:
            cut = raw.find(b" ", start + STRETCH_BYTES)
            if cut < 0:
                break
            yield raw[start:cut].split()
            start = cut
        yield raw[start:].split()

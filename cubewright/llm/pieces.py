"""Cutting texts into the pieces that a lower-casing, word-end vocabulary encodes apart, with a bounded cache by piece.

These vocabularies drop white space, so no token spans two words, and their
pre-tokenizer parts a word into letters, single digits and other signs, which are merged
each on its own.  Texts of ASCII and Latin-1 letters are cut by one regular expression;
a word with any other character, or with what may be a special string, stays whole and
goes through the vocabulary file's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from tokenizers import Tokenizer

#: Characters of a text that are cut at once.
WINDOW_CHARS = 1 << 18
#: Bytes of a generation of the cache; two generations are kept.
CACHE_BYTES = 40 << 20
_ENTRY_BYTES = 200
# The pattern and normalizers of the vocabulary that the expressions below follow.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_LATIN = "À-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t-\r -~{_LATIN}]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")
_SPACE = re.compile(r"[\t-\r ]")


class Cutter:
    """Pieces and odd words of texts for one vocabulary file."""

    def __init__(self, path: str, library: Tokenizer):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.known = kinds == _NORMALIZERS and first.get("pattern") == {"Regex": _PATTERN} and first.get("behavior") == "Removed"
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._starts = tuple({s[:2] for s in self.special})
        if spec["model"].get("type") != "BPE" or not self._drops_space():
            raise ValueError(f"{path} is no vocabulary of pieces that white space parts")

    def _drops_space(self) -> bool:
        """Whether white space is dropped wherever it stands, so that words are encoded apart."""
        if self.pre_tokenizer is None:
            return False
        for space in "\t\n\v\f\r ":
            for left, right in (("a", "b"), ("1", "a"), ("!", "?"), ("a", "'s"), ("é", "日")):
                whole = f"{space}{left}{space}{space}{right}{space}"
                cut = [self.pre_tokenizer.pre_tokenize_str(self.normalized(t)) for t in (whole, left, right)]
                if [p for p, _ in cut[0]] != [p for part in cut[1:] for p, _ in part]:
                    return False
        return True

    def normalized(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def is_plain(self, text: str) -> bool:
        return self.known and _PLAIN.fullmatch(text) is not None and not any(s in text for s in self._starts)

    def each(self, words: str) -> list[list[str]]:
        """Pieces and odd words of each of the words that line ends part."""
        if self.is_plain(words):
            return list(map(_PIECES.findall, words.lower().split("\n")))
        return list(map(self, words.split("\n")))

    def __call__(self, text: str) -> list[str]:
        """Pieces, lower-cased, and odd words as they stand, in order; the two never look alike."""
        if self.is_plain(text):
            return _PIECES.findall(text.lower())
        out = []
        for word in text.encode("utf-8").split():
            word = word.decode("utf-8")
            if self.is_plain(word):
                out += _PIECES.findall(word.lower())
            else:
                out.append(word)
        return out


def windows(text: str, size: int = WINDOW_CHARS) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end at white space, or where the text has none for long, later."""
    start = 0
    while len(text) - start > size:
        cut = _SPACE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:] if start else text


class Cache:
    """Two generations of results by piece, together of no more than about twice ``limit`` bytes.

    ``compute`` gets the sorted pieces that neither generation has.  Pieces of over 64
    characters are computed and not kept.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = CACHE_BYTES):
        self.compute, self.limit, self.held = compute, limit, 0
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def _keep(self, piece: str, value: object) -> None:
        self.young[piece] = value
        self.held += _ENTRY_BYTES + len(piece) + (len(value) if isinstance(value, bytes) else 0)

    def lookup(self, pieces: set[str]) -> dict[str, object]:
        """Results for all of ``pieces``; the mapping may hold others as well, and is good until the next call."""
        missing = pieces.difference(self.young)
        if not missing:
            return self.young
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
            missing = pieces
        fresh = []
        for p in missing:
            found = self.old.get(p)
            if found is None:
                fresh.append(p)
            else:
                self._keep(p, found)
        fresh.sort()
        long = {}
        for p, value in zip(fresh, self.compute(fresh)):
            if len(p) > 64:
                long[p] = value
            else:
                self._keep(p, value)
        return {**self.young, **long} if long else self.young

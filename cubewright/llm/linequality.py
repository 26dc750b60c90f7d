"""Line labelling with a linear-chain conditional random field, and fixed quality counts.

Each line with a word is a position of a chain with two states, content and boilerplate.
Its features come from its bytes (shares of capitals, digits, symbols and punctuation,
words, repeats within the line and of earlier lines); transitions tie neighbours.
Viterbi decoding marks the lines, and a document stays where content lines hold at
least ``CONTENT_SHARE`` of its words.

The chain is fitted on a bounded sample of labelled documents (``SAMPLE_DOCS`` of each
quality, of at most ``SAMPLE_CHARS`` characters and ``SAMPLE_LINES`` lines), whose lines
all take the document's label.  Decoding covers whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import with_text_columns

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_LINES = 400, 16_384, 64
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
_SPACES = " \t\n\v\f\r"
_UPPER, _LOWER, _DIGIT = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
_ODD = b"#*$%&|<>{}[]=_~^\\@+/"
_STOPS = b".,;:!?"
N_FEATURES = 14


def line_features(line: bytes, words: list[bytes], repeated: bool) -> tuple[float, ...]:
    """Features of one line that has a word."""
    size, n = len(line), len(words)
    upper = size - len(line.translate(None, _UPPER))
    lower = size - len(line.translate(None, _LOWER))
    digits = size - len(line.translate(None, _DIGIT))
    odd = size - len(line.translate(None, _ODD))
    stops = size - len(line.translate(None, _STOPS))
    capitals = upper / (upper + lower + 1)
    again = 1 - len(set(words)) / n
    return (
        1.0, min(n, 40) / 40, float(n <= 2), float(n <= 5), capitals, float(capitals > 0.5), min(odd / n, 2.0), float(2 * odd > n),
        digits / size, float(stops > n), again, float(again > 0.6), float(repeated), min(line.count(b"!!") / n, 1.0),
    )


def text_lines(raw: bytes) -> tuple[list[tuple[int, tuple[float, ...]]], int]:
    """((words, features) of each line with a word, lines that repeat an earlier one)."""
    out, seen, repeats = [], set(), 0
    for line in raw.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            repeats += again
            seen.add(line)
            out.append((len(words), line_features(line, words, again)))
    return out, repeats


class LineChain:
    """A fitted chain: emission weights of content against boilerplate, and transitions."""

    def __init__(self) -> None:
        self.weights = np.zeros(N_FEATURES)
        self.steps = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.fitted = False

    def fit(self, texts: list[str], labels: list[int], rounds: int = 200, rate: float = 0.05, decay: float = 1e-3) -> LineChain:
        """Maximise the conditional likelihood by Adam over exact forward-backward gradients."""
        chains, states = [], []
        for text, label in zip(texts, labels):
            lines, _ = text_lines(text.encode("utf-8", "replace"))
            if 0 < len(lines) <= SAMPLE_LINES:
                chains.append([f for _, f in lines])
                states.append(label)
        if len(set(states)) < 2:
            return self
        lengths = np.array([len(c) for c in chains])
        most = int(lengths.max())
        x = np.zeros((len(chains), most, N_FEATURES))
        for row, chain in zip(x, chains):
            row[: len(chain)] = chain
        y = np.array(states)
        there = np.arange(most) < lengths[:, None]
        share = 1 / lengths[:, None] * there  # each document weighs the same
        moments = [np.zeros(N_FEATURES + 6) for _ in range(2)]
        params = np.zeros(N_FEATURES + 6)
        for t in range(1, rounds + 1):
            gradient = self._gradient(params, x, y, there, share) - decay * params
            moments[0] = 0.9 * moments[0] + 0.1 * gradient
            moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
            params = params + rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        self.weights, self.steps, self.start = params[:N_FEATURES], params[N_FEATURES:-2].reshape(2, 2), params[-2:]
        self.fitted = True
        return self

    @staticmethod
    def _gradient(params, x, y, there, share) -> np.ndarray:
        weights, steps, start = params[:N_FEATURES], params[N_FEATURES:-2].reshape(2, 2), params[-2:]
        docs, most, _ = x.shape
        score = np.zeros((docs, most, 2))
        score[:, :, 1] = x @ weights
        move = np.exp(steps)
        emit = np.exp(score - score.max(axis=2, keepdims=True))
        ahead = np.zeros((docs, most, 2))
        behind = np.ones((docs, most, 2))
        ahead[:, 0] = np.exp(start) * emit[:, 0]
        ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, most):
            new = (ahead[:, i - 1] @ move) * emit[:, i]
            ahead[:, i] = new / new.sum(axis=1, keepdims=True)
        for i in range(most - 2, -1, -1):
            new = (behind[:, i + 1] * emit[:, i + 1]) @ move.T
            new /= new.sum(axis=1, keepdims=True)
            behind[:, i] = np.where(there[:, i + 1, None], new, 1.0)
        node = ahead * behind
        node /= node.sum(axis=2, keepdims=True)
        truth = y[:, None].astype(float)
        g_weights = np.einsum("dl,dlf->f", (truth - node[:, :, 1]) * share, x) / docs
        pair = ahead[:, :-1, :, None] * move * (behind * emit)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        held = share[:, 1:] * there[:, 1:]
        seen = np.zeros((2, 2))
        for s in (0, 1):
            seen[s, s] = held[y == s].sum()
        g_steps = (seen - np.einsum("dl,dlij->ij", held, pair)) / docs
        first = share[:, 0]
        g_start = np.array([(first * ((y == s) - node[:, 0, s])).sum() for s in (0, 1)]) / docs
        return np.concatenate([g_weights, g_steps.ravel(), g_start])

    def content_words(self, lines: list[tuple[int, tuple[float, ...]]]) -> int:
        """Words of the lines that the best labelling calls content; all of them before a fit."""
        if not lines:
            return 0
        if not self.fitted:
            return sum(n for n, _ in lines)
        score = (np.array([f for _, f in lines]) @ self.weights).tolist()
        (bb, bc), (cb, cc) = self.steps.tolist()
        b, c = self.start[0], self.start[1] + score[0]
        from_b: list[tuple[bool, bool]] = []
        for s in score[1:]:
            b_first, c_first = b + bb >= c + cb, b + bc > c + cc
            b, c = (b + bb if b_first else c + cb), (b + bc if c_first else c + cc) + s
            from_b.append((b_first, c_first))
        content, total = c >= b, 0
        for i in range(len(lines) - 1, -1, -1):
            if content:
                total += lines[i][0]
            if i:
                content = not from_b[i - 1][1 if content else 0]
        return total


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    code = ids[:n]
    for k in range(1, width):
        # Codes are packed again to below n before each product: it stays under the number of words squared.
        code = code * len(number) + ids[k : n + k]
        _, code = np.unique(code, return_inverse=True)
    twice = np.bincount(code)[code] > 1
    inside = np.zeros(len(words), bool)
    for k in range(width):
        inside[k : n + k] |= twice
    return int(inside.sum())


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")


def quality_counts(docs: DataFrame, chain: LineChain, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_words, base_failed, kept.

    A null or empty text, or one of white space, has no words, fails the base rules
    and isn't kept.  Texts of fewer than 50 words fail, and texts of which more than
    half the words stand in repeated three-word windows; others are kept where
    content lines hold at least half of the words.  Without labelled documents of
    both qualities every line counts as content.  Repeated rows are judged alike; an
    empty table gives an empty one; columns that already have the new names are
    replaced.  A very long text is read whole, its words as some 60 bytes each.  Where
    both labels of a line are equally likely, content wins.
    """

    def make() -> Callable[[list], list[list]]:
        def count(texts: list) -> list[list]:
            rows = []
            for text in texts:
                text = text or ""
                raw = text.encode("utf-8", "replace")
                words = raw.split()
                lines, repeats = text_lines(raw)
                rows.append(
                    (
                        len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), repeats,
                        repeated_words(words), chain.content_words(lines),
                    )
                )
            return [list(c) for c in zip(*rows)]

        return count

    counted = with_text_columns(docs, text_col, [(c, T.LongType()) for c in _COUNTS], make, keep)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    out = counted.drop("base_failed", "kept").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("content_words") >= CONTENT_SHARE * F.col("n_words")))


def fit_lines(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineChain:
    """Fit on a bounded sample of the labelled documents, chosen by a hash of the id."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    sizes = dict(named.groupBy("label").count().collect())
    if len(sizes) < 2:
        return LineChain()
    order = F.xxhash64("id", F.lit("lines"))
    shares = F.when(F.col("label") == 1, F.lit(min(1.0, 4 * SAMPLE_DOCS / sizes[1]))).otherwise(F.lit(min(1.0, 4 * SAMPLE_DOCS / sizes[0])))
    few = named.where(F.pmod(order, F.lit(1 << 30)) < shares * (1 << 30))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(order)))
    chosen = {r["id"]: r["label"] for r in ranked.where(F.col("rank") <= SAMPLE_DOCS).collect()}
    text = F.col(text_col)
    rows = (
        docs.where(F.col(id_col).isin(list(chosen)) & text.isNotNull() & (F.length(text) <= SAMPLE_CHARS))
        .select(F.col(id_col).alias("id"), text.alias("text")).orderBy("id", "text").limit(4 * SAMPLE_DOCS).collect()
    )
    rows.sort(key=lambda r: (r["id"], r["text"]))
    return LineChain().fit([r["text"] for r in rows], [chosen[r["id"]] for r in rows])

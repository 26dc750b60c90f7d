"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams of 1 to 3 bytes, A-Z lower-cased and white space
folded to one blank.  The kernel of two texts is the size of the intersection of their
sets over the geometric mean of the sets' sizes: presence, not counts.  Landmark texts
give the Nyström features ``K(x, L) K(L, L)^-1/2``, in which a kernel ridge regression
for each language against the rest is linear.  A batch of texts is scored by the
product of its presence matrix with the landmarks' presence, the Nyström map and the
regression coefficients; the last three are multiplied once, after the fit.

Whether any language fits a text is asked apart from that, as the margins of a
one-versus-rest ridge always have the same sum: ``fit`` is the best share of the text's
distinct 3-byte grams that one language's labelled texts hold, on that language's scale
from what texts of others get that it fits best (0) to what its own held-out texts get
(1), so it doesn't depend on the number of languages.

The fit sees a bounded sample of labelled rows (``SAMPLE_ROWS`` in all, as many of each
language, ``LEAST_ROWS`` of each at least; whole texts of at most ``SAMPLE_CHARS``
characters, or the beginnings of longer ones for a language that has no others).  Every
label is learned; more than ``MAX_LANGUAGES`` of them are an error, as the sample would
have no bound.  All grams of the sample count, and grams that it lacks count in the size
of a text's set.  Prediction covers every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import with_text_columns
from .text import id_bucket

#: Bounds of the labelled sample: rows, characters of a row, languages; least rows of a language.
SAMPLE_ROWS, SAMPLE_CHARS, MAX_LANGUAGES, LEAST_ROWS = 1024, 16_384, 512, 4
#: Landmark texts of each language.
LANDMARKS = 32
RIDGE = 1e-4
#: Grams of a text's own language that each text counts as having besides its own, so that one rare word alone doesn't go.
PRIOR_GRAMS = 2
#: Share of a language's labelled texts that have a gram which counts as its own.
HELD_SHARE = 0.03
NO_LANGUAGE = "und"
_SLOTS = 1 << 24
#: Texts scored by one product, and cells of its presence matrix.
_BATCH_ROWS, _BATCH_CELLS = 128, 1 << 22
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_codes(text: str) -> list[np.ndarray]:
    """Codes below 2**24 of the 1-, 2- and 3-byte grams of a text, repeats included."""
    raw = b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split())
    one = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.int32)
    two = (one[:-1] << 8) | one[1:]
    return [one, two, (two[:-1] << 8) | one[2:]]


def word_grams(text: str) -> np.ndarray:
    """Distinct codes of the 3-byte grams of a text, with ASCII other than letters as white space."""
    raw = b" ".join(text.encode("utf-8", "replace").translate(_WORDS).split())
    one = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.int32)
    return np.unique((one[:-2] << 16) | (one[1:-1] << 8) | one[2:])


class Presence:
    """Presence vectors over a fixed set of grams."""

    def __init__(self, grams: np.ndarray):
        self.width = len(grams)
        kind = np.uint16 if self.width < 1 << 16 else np.int32
        self.column = np.full(_SLOTS, self.width, kind)
        self.column[grams] = np.arange(self.width, dtype=kind)

    def blocks(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the first, presence of each text, number of distinct grams of each), some texts at a time."""
        block = max(1, min(_BATCH_ROWS, _BATCH_CELLS // (self.width + 1)))
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            out = np.zeros((len(part), self.width + 1), np.float32)
            others = np.zeros(len(part))
            for i, text in enumerate(part):
                for codes in gram_codes(text):
                    columns = self.column[codes]
                    out[i, columns] = 1
                    new = codes[columns == self.width]
                    if len(new):
                        others[i] += len(np.unique(new))
            out = out[:, :-1]
            yield at, out, np.maximum(out.sum(axis=1) + others, 1)


class LanguageFit:
    """How well the best of the learned languages fits a text, whatever their number."""

    def __init__(self, texts: list[str], labels: list[str]):
        self.languages = sorted(set(labels))
        rows: dict[str, list[np.ndarray]] = {k: [] for k in self.languages}
        for text, label in zip(texts, labels):
            rows[label].append(word_grams(text))
        self._learn([own[::2] for own in rows.values()])
        presence = Presence(self.grams)
        known: list[list[float]] = [[] for _ in rows]
        alien: list[list[float]] = [[] for _ in rows]
        highest = np.zeros(len(rows))
        for i, own in enumerate(rows.values()):
            for grams in own[1::2]:
                share = self._shares(presence, grams)
                known[i].append(share[i])
                share[i] = 0
                alien[int(share.argmax())].append(share.max())
                highest = np.maximum(highest, share)
        #: Medians by language over held-out texts: its own, and those of others that it fits best.
        medians = [float(np.median(k)) for k in known if k]
        self.known = np.array([np.median(k) if k else min(medians, default=1.0) for k in known])
        self.alien = np.array([np.median(a) if a else h for a, h in zip(alien, highest)])
        self.alien = np.minimum(self.alien, 0.9 * self.known)
        self._learn(list(rows.values()))

    def _learn(self, rows: list[list[np.ndarray]]) -> None:
        """Each language's grams that at least ``HELD_SHARE`` of its texts have: labelled texts may have passages in others."""
        chosen = []
        for own in rows:
            codes, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int32), np.zeros(0, int))
            chosen.append(codes[counts >= HELD_SHARE * len(own)])
        self.grams = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int32)
        held = np.zeros((len(self.grams), len(rows)), bool)
        for k, codes in enumerate(chosen):
            held[np.searchsorted(self.grams, codes), k] = True
        self.held = np.packbits(held, axis=1)

    def _shares(self, presence: Presence, grams: np.ndarray) -> np.ndarray:
        columns = presence.column[grams]
        bits = np.unpackbits(self.held[columns[columns < presence.width]], axis=1, count=len(self.languages))
        return bits.sum(axis=0, dtype=np.int64) / max(1, len(grams))

    def scorer(self) -> Callable[[list], list]:
        """A function from texts to their fits (0 to 1; 0 for a text without a letter), for use inside one task."""
        if not self.languages:
            return lambda texts: [0.0] * len(texts)
        presence = Presence(self.grams)

        def score(text: str | None) -> float:
            if not text or not has_letter(text):
                return 0.0
            grams = word_grams(text)
            share = (self._shares(presence, grams) * len(grams) + PRIOR_GRAMS * self.known) / (len(grams) + PRIOR_GRAMS)
            return float(np.clip((share - self.alien) / np.maximum(self.known - self.alien, 1e-9), 0, 1).max())

        return lambda texts: [score(t) for t in texts]


class StringKernelClassifier:
    """One-versus-rest kernel ridge regression over Nyström features, folded into one matrix."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.labels = sorted(set(labels))
        self.grams, self.matrix, self.bias = np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0)
        self.fit = LanguageFit(texts, labels)
        if len(self.labels) < 2:
            return
        present = np.zeros(_SLOTS, bool)
        for text in texts:
            for codes in gram_codes(text):
                present[codes] = True
        self.grams = np.flatnonzero(present)
        presence = Presence(self.grams)
        seen: dict[str, int] = {}
        chosen = []
        for i, label in enumerate(labels):
            seen[label] = seen.get(label, 0) + 1
            if seen[label] <= landmarks:
                chosen.append(i)
        marks = np.concatenate([rows / np.sqrt(sizes)[:, None] for _, rows, sizes in presence.blocks([texts[i] for i in chosen])])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        to_features = (marks.T @ root).astype(np.float32)
        del marks
        features = np.concatenate([(rows @ to_features) / np.sqrt(sizes)[:, None] for _, rows, sizes in presence.blocks(texts)])
        target = np.where(np.array(labels)[:, None] == np.array(self.labels), 1.0, -1.0)
        centre, level = features.mean(axis=0), target.mean(axis=0)
        x = (features - centre).astype(np.float64)
        weights = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(x.shape[1]), x.T @ (target - level))
        self.matrix = (to_features @ weights).astype(np.float32)
        self.bias = (level - centre @ weights).astype(np.float32)

    def predictor(self) -> Callable[[list], tuple[list, list]]:
        """A function from texts to (languages, scores), for use inside one task."""
        if len(self.labels) < 2:
            only = self.labels[0] if self.labels else NO_LANGUAGE
            sure = 1.0 if self.labels else 0.0

            def constant(texts: list) -> tuple[list, list]:
                known = [bool(t) and has_letter(t) for t in texts]
                return [only if k else NO_LANGUAGE for k in known], [sure if k else 0.0 for k in known]

            return constant
        presence = Presence(self.grams)

        def predict(texts: list) -> tuple[list, list]:
            languages, scores = [], []
            for at, rows, sizes in presence.blocks([t or "" for t in texts]):
                margin = (rows @ self.matrix) / np.sqrt(sizes)[:, None] + self.bias
                best = margin.argmax(axis=1)
                sure = np.clip((margin.max(axis=1) + 1) / 2, 0, 1)
                for text, b, s in zip(texts[at : at + len(rows)], best.tolist(), sure.tolist()):
                    known = bool(text) and has_letter(text)
                    languages.append(self.labels[b] if known else NO_LANGUAGE)
                    scores.append(s if known else 0.0)
            return languages, scores

        return predict


def labelled_sample(labelled: DataFrame, text_col: str, label_col: str, key_col: str) -> list[tuple[str, str]]:
    """(text, label) pairs, ``SAMPLE_ROWS`` in all or ``LEAST_ROWS`` of each label if that is more, chosen by a hash of ``key_col``."""
    rows = labelled.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.col(key_col).alias("key")).where(
        F.col("label").isNotNull() & F.col("text").isNotNull()
    )
    short = F.length("text") <= SAMPLE_CHARS
    counted = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(short).alias("short")).limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    if not counted:
        return []
    sizes = {r["label"]: r["short"] or r["n"] for r in counted}
    long_only = [r["label"] for r in counted if not r["short"]]
    rows = rows.where(short | F.col("label").isin(long_only) if long_only else short).withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    each = max(LEAST_ROWS, SAMPLE_ROWS // len(sizes))
    order = F.xxhash64("key", F.lit("sample"))
    place = F.pmod(order, F.lit(1 << 30))
    # Rows below a threshold of the hash: some more than wanted, so that the window ranks a bounded number of them.
    wanted = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, 3 * max(each, 8) / n) * (1 << 30))) for k, n in sizes.items()])
    few = rows.where(place < wanted)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(order, "text")))
    taken = ranked.where(F.col("rank") <= each).orderBy("label", "rank").collect()
    return [(r["text"], r["label"]) for r in taken]


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> StringKernelClassifier:
    """Learn from the labelled rows whose crc32(id as text) mod 3 isn't 1."""
    pairs = labelled_sample(docs.where(id_bucket(F.col(id_col), 3) != 1), text_col, lang_col, id_col)
    return StringKernelClassifier([t for t, _ in pairs], [label for _, label in pairs])


def identify_languages(
    docs: DataFrame, model: StringKernelClassifier, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score (0 to 1) of each whole text.

    A text that is null or has no letter gets ``und`` and score 0, and so does every
    text if the model has seen no label.  A model of one label predicts it for all
    others.  Repeated rows are predicted alike; an empty table gives an empty one;
    columns that already have the new names are replaced.  A very long text is read
    whole, its grams as a few numbers for each byte.  Of labels with equal scores the
    first in order is predicted.
    """
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType())]
    return with_text_columns(docs, text_col, fields, model.predictor, keep)


def drop_unidentified(docs: DataFrame, model: StringKernelClassifier, least_score: float, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """``docs`` without texts that have no letter or that no language fits: a fit (0 to 1, see above) below ``least_score``.

    Null and empty texts go, and all texts if the model has seen no label.  Repeated
    rows stay or go alike; columns, whatever their names, and their order stay.  With a
    ``lang_col``, that column is the language that each text is identified as, whatever
    it held.  An empty table gives an empty one.  A very long text is read whole, as the
    prediction reads it.
    """
    columns = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    fields = [("fit", T.DoubleType())] + ([(f"c{columns.index(lang_col)}", T.StringType())] if lang_col else [])

    def make() -> Callable[[list], list[list]]:
        score, predict = model.fit.scorer(), model.predictor() if lang_col else None
        return lambda texts: [score(texts)] + ([predict(texts)[0]] if predict else [])

    judged = with_text_columns(renamed, f"c{columns.index(text_col)}", fields, make)
    stay = (F.col("fit") > 0) & (F.col("fit") >= least_score)
    return judged.where(stay).select(*[F.col(c).alias(n) for c, n in zip(renamed.columns, columns)])

"""Language-model scores: prediction by partial matching over bytes, and a unigram base.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of the
bytes that follow, learned from all training texts.  The code length of a byte is that
of the longest known context; each shorter context costs an escape of probability
q / (T + q), with T occurrences of q different bytes, and bytes that a longer context
knows are excluded from the shorter ones' counts.  Byte 0xFF, which UTF-8 never has,
stands before and after each text, so a text's end is coded too.

The trie grows with the corpus and is never in one place.  Documents go in batches of
``BATCH_BYTES``, longer texts in parts that end at white space and know the bytes before
them; a batch gives its distinct grams (context and next byte) and its distinct words
with their training counts.  Counts are summed by key, the code length of each gram is
worked out with all contexts that share their last two bytes, and the values come back
to their batches, which then score their texts by table look-ups.  A key stands in a
batch once, so no key has more than a small share of any shuffle, and batches are dealt
out to the scoring tasks in turn, so none gets many more than another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .batches import slices
from .scratch import Scratch
from .worker import give_back, release

ORDER = 4
EDGE = 0xFF
BATCH_BYTES = 16 << 20
#: Bytes that are looked up at once.
_PIECE = 1 << 20
_PIECE_DOCS = 512
_DOC, _WORD, _GRAM = 0, 1, 2
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SLOT_BITS = 21
#: Batches of a scoring task, where the partitions of the documents allow it.
_TASK_BATCHES = 4
_EDGES = bytes([EDGE]) * ORDER
_SPACE = re.compile(rb"[\t-\r ]")


class Part(NamedTuple):
    """A text, or a stretch of one: its bytes, the ``ORDER`` bytes before them, and whether the text ends with it."""

    body: bytes
    before: bytes = _EDGES
    last: bool = True


def cut(part: Part, limit: int, at_space: bool) -> Iterator[Part]:
    """Stretches of about ``limit`` bytes; ``at_space``: that end with white space, so that no word is cut."""
    body, start = part.body, 0
    while len(body) - start > limit:
        end = start + limit
        if at_space:
            found = _SPACE.search(body, end)
            if found is None:
                break
            end = found.end()
        yield Part(body[start:end], (part.before + body[max(0, start - ORDER) : start])[-ORDER:], part.last and end == len(body))
        start = end
    if start < len(body) or not body:
        yield Part(body[start:], (part.before + body[max(0, start - ORDER) : start])[-ORDER:], part.last)


def framed(parts: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    """(gram codes of all parts one after another, where each part's begin): a gram for each byte, and for a text's end."""
    raw = np.frombuffer(b"".join([p.before + p.body + _EDGES[: p.last] for p in parts]), np.uint8)
    sizes = np.array([len(p.body) + p.last for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
    code = np.zeros(max(0, len(raw) - ORDER), np.int64)
    for k in range(ORDER + 1):
        code = (code << 8) | raw[k : k + len(code)]
    inside = np.ones(len(code), bool)
    for k in range(ORDER):  # grams that begin in one part and end in the next
        inside[starts[1:] - ORDER + k] = False
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return code[inside], begins


def pieces(parts: list[Part], limit: int = _PIECE) -> Iterator[tuple[list[int], list[Part]]]:
    """Parts of about ``limit`` bytes together, longer ones cut, and the number of the given part that each is of."""
    numbers, group, held = [], [], 0
    for i, part in enumerate(parts):
        for p in cut(part, limit, False) if len(part.body) > limit else (part,):
            if group and held + len(p.body) > limit:
                yield numbers, group
                numbers, group, held = [], [], 0
            numbers.append(i)
            group.append(p)
            held += len(p.body)
    if group:
        yield numbers, group


def _gram_counts(parts: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, group in pieces(parts):
        c, n = np.unique(framed(group)[0], return_counts=True)
        codes.append(c)
        counts.append(n)
    return _summed(np.concatenate(codes), np.concatenate(counts))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def batch_rows(docs: DataFrame) -> DataFrame:
    """Rows (kind, batch, id, text, held, key, pos, n): documents, and the words and grams of each batch.

    ``docs``: id, text, held.  n: occurrences in the batch's training texts.  pos: a
    word's place among the sorted words of the batch, or a gram's code.  A document
    longer than a batch stands in several rows, with the bytes before each as key, the
    text's number as pos, and n = 1 in the last; these are null for others.  batch: the
    task's number, shifted left by 32, and the batch's own in its task.
    """
    schema = T.StructType(
        [
            T.StructField("kind", T.IntegerType()), T.StructField("batch", T.LongType()), docs.schema["id"],
            T.StructField("text", T.StringType()), T.StructField("held", T.BooleanType()), T.StructField("key", T.BinaryType()),
            T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def table(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow
        )

    def batch(number: int, docs: dict, parts: list[Part], held: list[bool]) -> Iterator[pa.RecordBatch]:
        same = lambda value, n, kind: pa.array(np.full(n, value), kind)
        yield table(len(parts), kind=same(_DOC, len(parts), pa.int32()), batch=same(number, len(parts), pa.int64()), **docs)
        counts: dict[bytes, int] = {}
        for p, h in zip(parts, held):
            step = 0 if h else 1
            for w in words_of(p.body):
                counts[w] = counts.get(w, 0) + step
        words = sorted(counts)
        yield table(
            len(words), kind=same(_WORD, len(words), pa.int32()), batch=same(number, len(words), pa.int64()),
            key=pa.array(words, pa.binary()), pos=pa.array(np.arange(len(words))), n=pa.array([counts[w] for w in words], pa.int64()),
        )
        learned, times = _gram_counts([p for p, h in zip(parts, held) if not h])
        others, _ = _gram_counts([p for p, h in zip(parts, held) if h])
        codes, times = _summed(np.concatenate([learned, others]), np.concatenate([times, np.zeros(len(others), np.int64)]))
        yield table(
            len(codes), kind=same(_GRAM, len(codes), pa.int32()), batch=same(number, len(codes), pa.int64()),
            pos=pa.array(codes), n=pa.array(times),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = TaskContext.get().partitionId() << 32
        for given in batches:
            for some in slices(given, "text", BATCH_BYTES):
                held = some.column("held").to_pylist()
                texts = some.column("text").to_pylist()
                stretches = list(cut(Part(_encoded(texts[0])), BATCH_BYTES, True)) if len(texts) == 1 else []
                if len(stretches) < 2:
                    docs = {"id": some.column("id"), "text": some.column("text"), "held": some.column("held")}
                    yield from batch(number, docs, [Part(_encoded(t)) for t in texts], held)
                    number += 1
                    continue
                whole = number
                for p in stretches:
                    docs = {
                        "id": some.column("id"), "text": pa.array([p.body.decode("utf-8")]), "held": some.column("held"),
                        "key": pa.array([p.before], pa.binary()), "pos": pa.array([whole]), "n": pa.array([int(p.last)]),
                    }
                    yield from batch(number, docs, [p], held)
                    number += 1
        give_back()

    return docs.select("id", "text", "held").mapInArrow(run, schema)


def _fall_back(p: np.ndarray, escape: np.ndarray, known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One order of the trie: adds the probabilities of its bytes, returns the escape and the known bytes after it.

    p, known: contexts by bytes.  escape: of each context.  counts: bytes (or contexts by bytes).
    """
    open_counts = np.where(known, 0, counts)
    total, kinds = open_counts.sum(axis=1), (open_counts > 0).sum(axis=1)
    whole = np.maximum(total + kinds, 1)
    p += escape[:, None] * open_counts / whole[:, None]
    escape = np.where(total > 0, escape * kinds / whole, escape)
    return escape, known | (open_counts > 0)


def code_lengths(codes: np.ndarray, counts: np.ndarray, after_one: np.ndarray) -> np.ndarray:
    """log10 probability of each gram; ``codes``: all grams of one two-byte suffix of contexts, with training counts.

    after_one: training counts of each byte after each single byte.
    """
    out = np.zeros(len(codes))
    symbol, context = codes & 255, codes >> 8
    order2 = np.bincount(symbol, counts, 256)
    order1, order0 = after_one[int(context[0]) & 255], after_one.sum(axis=0)
    middle = (context >> 16) & 255
    for b in np.unique(middle):
        rows = np.flatnonzero(middle == b)
        known_contexts, at = np.unique(context[rows], return_inverse=True)
        table = np.zeros((len(known_contexts), 256))
        table[at, symbol[rows]] = counts[rows]
        p, escape, known = np.zeros_like(table), np.ones(len(table)), np.zeros(table.shape, bool)
        for level in (table, table.sum(axis=0), order2, order1, order0):
            escape, known = _fall_back(p, escape, known, level)
        left = 256 - known.sum(axis=1)
        p += np.where(known, 0, (escape / np.maximum(left, 1))[:, None])
        out[rows] = np.log10(p[at, symbol[rows]])
    return out


def gram_scores(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(pos, value) for each gram of ``grams`` (pos, n): its log10 probability under the whole corpus."""
    counts = scratch.table(grams.groupBy("pos").agg(F.sum("n").alias("n")), "gram-counts")
    pairs = counts.where("n > 0").groupBy(F.expr("shiftright(pos, 8) & 255").alias("a"), F.expr("pos & 255").alias("b")).agg(F.sum("n").alias("n"))
    after_one = np.zeros((256, 256))
    for r in pairs.collect():  # at most 65,536 rows
        after_one[r["a"], r["b"]] = r["n"]

    def score(group: pa.Table) -> pa.Table:
        codes, n = group.column("pos").to_numpy(), group.column("n").to_numpy()
        return pa.table({"pos": codes, "value": code_lengths(codes, n, after_one)})

    return counts.groupBy(F.expr("shiftright(pos, 8) & 65535")).applyInArrow(score, "pos long, value double")


class Lookup:
    """Values of gram codes through a table of slots; codes that share a slot are found by bisection."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order].astype(np.float64)
        self.slots = np.zeros(1 << _SLOT_BITS, np.int32)
        self.slots[self._slot(self.codes)] = np.arange(len(codes), dtype=np.int32)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(codes)]
        missed = np.flatnonzero(self.codes[at] != codes)
        at[missed] = np.searchsorted(self.codes, codes[missed])
        return self.values[at]


def _score_batch(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
        release()
        pos, value = keys.column("pos").to_numpy(), keys.column("value").to_numpy()
        is_word = pos >= 0
        seen = np.zeros(int(is_word.sum()))
        seen[pos[is_word]] = np.floor(value[is_word])
        new = int((is_word & (value % 1 > 0) & (value >= 1)).sum())
        lookup = Lookup(-1 - pos[~is_word], value[~is_word])
        logs = np.log10(seen + 0.1)
        del keys, pos, value, is_word
        texts, before, last = (docs.column(c) for c in ("text", "before", "last"))

        def parts(a: int, b: int) -> list[Part]:
            rows = zip(*(c[a:b].to_pylist() for c in (texts, before, last)))
            return [Part(_encoded(t), _EDGES if p is None else p, n != 0) for t, p, n in rows]

        # The texts are held once, as Arrow has them; a piece of them at a time becomes Python objects.
        ranges = [(a, min(a + _PIECE_DOCS, len(texts))) for a in range(0, len(texts), _PIECE_DOCS)]
        known: set[bytes] = set()
        for a, b in ranges:
            for p in parts(a, b):
                known.update(words_of(p.body))
        place = {w: i for i, w in enumerate(sorted(known))}
        del known
        n_tokens, n_known, word_logs, scores = [], [], [], []
        for first, stop in ranges:
            some = parts(first, stop)
            for p in some:
                words = words_of(p.body)
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                n_tokens.append(len(words) + p.last)
                n_known.append(int((seen[at] > 0).sum()))
                word_logs.append(float(logs[at].sum()))
            own = np.zeros(len(some))
            for numbers, group in pieces(some):
                codes, begins = framed(group)
                np.add.at(own, numbers, np.add.reduceat(lookup(codes), begins))
            scores.append(own)
        held = docs.column("held").to_pylist()
        train = [0 if h else n for h, n in zip(held, n_tokens)]
        new_words = np.zeros(len(held), np.int64)
        new_words[0] = new
        columns = [
            docs.column("id").combine_chunks(), docs.column("held").combine_chunks(), docs.column("whole").combine_chunks(),
            pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(word_logs, pa.float64()), pa.array(np.concatenate(scores), pa.float64()),
            pa.array(train, pa.int64()), pa.array(new_words, pa.int64()), pa.array([int(n != 0) for n in last.to_pylist()], pa.int64()),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def _dealt(batch: Column, rows: DataFrame) -> tuple[Column, int]:
    """(scoring task of each batch, number of tasks): the batches of a task of the first step go to tasks of their own, in turn."""
    own = F.col("batch").bitwiseAND(F.lit((1 << 32) - 1))
    last = rows.where(F.col("kind") == _DOC).agg(F.max(F.shiftright("batch", 32)).alias("task"), F.max(own).alias("own")).first()
    tasks, most = (last["task"] or 0) + 1, (last["own"] or 0) + 1
    each = -(-most // _TASK_BATCHES)
    count = min(tasks * each, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = F.shiftright(batch, 32) * each + F.pmod(batch.bitwiseAND(F.lit((1 << 32) - 1)), F.lit(each))
    return F.pmod(number, F.lit(count)).cast("int"), count


def language_model_scores(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: a boolean column; rows where it is true (null counts as false) teach
    nothing.  score: log10 probability of the whole text and its end under the byte
    model.  base_score: the same under smoothed word counts, A-Z lower-cased.  A null
    or empty text is its end alone.  Without training rows all counts are zero and
    bytes are equally likely.  Repeated rows are each learned from and each scored.  A
    text longer than ``BATCH_BYTES`` goes in parts, so only its bytes are ever held
    whole; a single longer word stays in one part.  An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "ppm")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held"))
    rows = scratch.table(batch_rows(given), "batches", compression="zstd")
    grams = rows.where(F.col("kind") == _GRAM).select("batch", "pos", "n")
    values = gram_scores(grams.select("pos", "n"), scratch)
    # One narrow row for each key of a batch: a gram's place is below zero, and a word's count has a half added in one of its batches.
    by_gram = grams.join(values, "pos").select("batch", (-1 - F.col("pos")).alias("pos"), "value")
    same = Window.partitionBy("key")
    once = F.when(F.col("batch") == F.min("batch").over(same), 0.5).otherwise(0.0)
    by_word = rows.where(F.col("kind") == _WORD).select("batch", "pos", (F.sum("n").over(same) + once).alias("value"))
    numbers = ("n_tokens", "n_known", "word_logs", "score", "train", "new_words", "ends")
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("whole", T.LongType()),
            *[T.StructField(n, T.DoubleType() if n in ("word_logs", "score") else T.LongType()) for n in numbers],
        ]
    )
    texts = rows.where(F.col("kind") == _DOC).select("batch", "id", "text", "held", F.col("key").alias("before"), F.col("pos").alias("whole"), F.col("n").alias("last"))
    slot, count = _dealt(F.col("batch"), rows)
    texts = texts.select(slot.alias("of_slot"), F.col("batch").alias("of_batch"), *texts.columns[1:])
    left = texts.repartitionById(count, F.col("of_slot")).groupBy("of_slot", "of_batch")
    right = by_word.union(by_gram).withColumn("slot", slot).repartitionById(count, F.col("slot")).groupBy("slot", "batch")
    scored = scratch.table(left.cogroup(right).applyInArrow(_score_batch(to_arrow_schema(schema)), schema), "scores")
    scratch.keep_only(scored)
    sums = scored.agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("new_words"), F.lit(0)).alias("words"),
        F.count(F.when(~F.col("held_out") & (F.col("ends") == 1), 1)).alias("ends"),
    ).first()
    tokens, ends = sums["tokens"], sums["ends"]
    kinds = sums["words"] + (ends > 0)
    norm = F.lit(tokens + 0.1 * (kinds + 1))
    parts = scored.where("whole is not null").groupBy("whole").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *[F.sum(n).alias(n) for n in numbers])
    whole = scored.where("whole is null").drop("whole").unionByName(parts.drop("whole"))
    base = F.col("word_logs") + F.log10(F.lit(ends + 0.1)) - F.col("n_tokens") * F.log10(norm)
    return whole.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score",
    )

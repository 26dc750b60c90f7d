"""Packing against the tokenizers library, and first-fit decreasing against a plain loop."""

import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cubewright.llm import packing
from tests.against_sql import SF_DIR

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(rows, texts, library, room):
    """Every id of every document lies in one piece; sequences have no gap and no padding."""
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    want = {}
    for key, text in texts:
        want.setdefault(key, []).append(library.encode(text or "", add_special_tokens=False).ids + [1])
    assert documents.keys() == want.keys()
    for key, pieces in documents.items():
        assert all(len(r.ids) == 4 * r.length for r in pieces)
        if len(want[key]) == 1:
            pieces.sort(key=lambda r: r.start)
            assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
            ids = want[key][0]
            assert b"".join(r.ids for r in pieces) == struct.pack(f"<{len(ids)}I", *ids) and {r.doc_tokens for r in pieces} == {len(ids)}
        else:  # an id that comes again: its pieces can't be told apart, their ids can be counted
            assert sorted(i for r in pieces for i in struct.unpack(f"<{r.length}I", r.ids)) == sorted(i for ids in want[key] for i in ids)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        full = sum(r.length for r in pieces)
        assert full <= room and full & (full - 1) == 0


@pytest.mark.parametrize("room,group", [(2048, 8192), (64, 50)])
def test_pieces_of_documents(spark, library, room, group):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 80")
    rows = packing.pack_sequences(docs, PATH, room, group_pieces=group).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], library, room)
    assert len({r.sequence_id >> 32 for r in rows}) > 1 or group > 50


def test_hard_rows(spark, library):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "<|endoftext|> a<|endoftext|>b it's"), (5, "word " * 9000), (6, "x" * 30_000), (7, "é ́x \x00 日本語 \x7f</w>"), (None, "no id"), (8, "same"), (8, "same"), (8, "other")]
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in texts], "doc_id long, text string, length int, ids string")
    check(packing.pack_sequences(docs, PATH).collect(), texts, library, 2048)
    assert packing.pack_sequences(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack_sequences(docs.select(F.col("doc_id").alias("offset"), "text"), PATH, id_col="offset")


def test_first_fit_decreasing_is_that_of_a_loop():
    rng = random.Random(3)
    for _ in range(200):
        room = rng.choice([7, 16, 100])
        lengths = [rng.randint(1, room) for _ in range(rng.randrange(60))]
        want, free = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            k = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
            if k == len(free):
                free.append(room)
                want.append([])
            free[k] -= lengths[i]
            want[k].append(i)
        bins = packing.first_fit_decreasing(lengths, room)
        assert bins == want
        parts = packing.top_up(bins, lengths, room)
        cut = sorted((i, a, n) for b in parts for i, a, n in b)
        for i, n in enumerate(lengths):
            mine = [(a, m) for j, a, m in cut if j == i]
            assert [a for a, _ in mine] == [sum(m for _, m in mine[:k]) for k in range(len(mine))] and sum(m for _, m in mine) == n
        fills = [sum(n for _, _, n in b) for b in parts]
        assert sum(f < room for f in fills) <= room.bit_length() and all(f == room or f & (f - 1) == 0 for f in fills)


def test_words_are_encoded_as_by_the_library(library):
    encoder = packing.WordEncoder(PATH, 20_000)  # so small that both generations are given up
    rng = random.Random(5)
    parts = ["the", "Ab", "é", "É", "ñ", "12", "'s", "''", "...", "<|endoftext|>", "日", "́", "</w>", "\x7f", "ﬁ", "_", "İ", "\xa0"]
    for _ in range(30):
        texts = [" ".join("".join(rng.choices(parts, k=rng.randrange(6))) for _ in range(200)) for _ in range(5)]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoder.ids(texts) == [struct.pack(f"<{len(i)}I", *i) for i in want]

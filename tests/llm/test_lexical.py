"""Ranked search against SQL and against scoring every document; blocks packed and unpacked."""

import math
import random
import re
from collections import Counter

import numpy as np

from cubewright.llm import lexical, queries, wand
from tests.against_sql import SF_DIR, assert_same, connect

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, most):
    split = [(k, _TERM.findall((t or "").translate(_LOWER))) for k, t in docs]
    total, words = sum(1 for _, w in split if w), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in set(_TERM.findall((text or "").translate(_LOWER))) if df[t]}
        scored = []
        for k, w in split:
            tf = Counter(w)
            m = 50 + 50 * len(w) * total // words if words else 0
            score = sum(x * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t, x in asked.items() if tf[t])
            if score > 0:
                scored.append((-score, k is not None, k or 0, k))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query_equals_sql(spark):
    assert_same(queries.op12_block_max_wand(spark, SF_DIR), connect(), queries.oracle_sql()["op12_block_max_wand"])


def test_hard_rows(spark):
    docs = [(5, "b a"), (3, "a B"), (None, "a b"), (4, None), (6, ""), (7, ".,;"), (3, "a b"), (8, "é日 a1 " * 4000), (9, "A-b_c\x00d"), (10, "x" * 40_000 + " a"), (11, "1 2 3 a")]
    items = [(1, "a"), (1, "a b b"), (2, None), (3, "zz"), (None, "É日 é日 A1"), (4, "3"), (5, "")]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, term int, query string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(lexical.ranked_search(frame, asked, most=3)) == brute(docs, items, 3)
    assert lexical.ranked_search(frame.limit(0), asked).count() == 0
    assert lexical.ranked_search(frame, asked.limit(0)).count() == 0


def test_many_shards_and_query_blocks(spark):
    rng = random.Random(4)
    words = ["w%d" % min(int(rng.paretovariate(0.6)), 400) for _ in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(700)]
    items = [(i, " ".join(rng.choices(words, k=9))) for i in range(23)]
    got = lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=7, shard_postings=2000, query_block=5)
    assert found(got) == brute(docs, items, 7)


def shard(lists, n):
    term = np.array([t for t, l in enumerate(lists) for _ in l], np.int64)
    doc, tf = (np.array([p[k] for l in lists for p in l], np.int64) for k in (0, 1))
    m = np.array([50 + (7 * d) % 300 for d in range(n)], np.int64)
    return wand.pack_blocks(term, doc, tf, m), m


def test_blocks_are_unpacked_as_packed():
    rng = random.Random(2)
    lists = [[(d, rng.choice([1, 2, 300, 70_000])) for d in sorted(rng.sample(range(200_000), k))] for k in (1, 127, 128, 129, 1000)] + [[(0, 1), (199_999, 255)]]
    p, m = shard(lists, 200_000)
    at = block = 0
    for i, want in enumerate(lists):
        body, got, start = p["body"][at : at + p["sizes"][i]].tobytes(), [], 0
        for b in range(block, block + p["blocks"][i]):
            docs, tfs = wand.unpack(body, start, p["ends"][b])
            assert docs[-1] == p["last"][b] and max(wand.impact(t, int(m[d])) for d, t in zip(docs, tfs)) == p["most"][b]
            got += zip(docs, tfs)
            start = p["ends"][b]
        assert got == want and p["df"][i] == len(want)
        at, block = at + p["sizes"][i], block + p["blocks"][i]


def test_wand_finds_the_best_and_leaves_blocks_packed(monkeypatch):
    rng, n, unpacked = random.Random(8), 20_000, []
    lists = [[(d, rng.randrange(1, 9)) for d in sorted(rng.sample(range(n), k))] for k in (20, 300, 4000, 12_000)]
    lists[1] = [(d, 60 if d < 3000 else 1) for d, _ in lists[1]]
    p, m = shard(lists, n)
    edges, ends = np.r_[0, np.cumsum(p["blocks"])], np.r_[0, np.cumsum(p["sizes"])]
    real = wand.unpack
    monkeypatch.setattr(wand, "unpack", lambda *a: unpacked.append(a) or real(*a))
    for most, weights in ((1, (9000, 5000, 1500, 300)), (50, (9000, 5000, 1500, 300)), (50, (1, 1, 1, 1)), (9, (0, 5, 0, 1)), (30_000, (1, 2, 3, 4))):
        made = [wand.Postings(w, *(p[c][edges[i] : edges[i + 1]].tolist() for c in ("last", "most", "ends")), p["body"][ends[i] : ends[i + 1]].tobytes()) for i, w in enumerate(weights)]
        unpacked.clear()
        got = wand.search(made, m.tolist(), most)
        score = Counter()
        for w, l in zip(weights, lists):
            for d, tf in l:
                score[d] += w * wand.impact(tf, int(m[d]))
        assert got == sorted(((s, d) for d, s in score.items() if s > 0), key=lambda r: (-r[0], r[1]))[:most]
        if most == 1:
            assert len(unpacked) < 0.7 * sum(p["blocks"])

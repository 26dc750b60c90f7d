"""The divergence audit against SQL and against a plain loop over all terms of every two sources."""

import random
import re
from collections import Counter

from cubewright.llm import divergence, queries
from tests.against_sql import SF_DIR, assert_same, connect

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "text string, lang string, source string, item long, rank string"


def brute(docs, least, top):
    rows = [((t or "").translate(_LOWER), lang or "", source or "") for t, lang, source in docs]
    out = []
    for lang in {r[1] for r in rows}:
        df, counts = Counter(), {}
        for text, own, source in rows:
            if own == lang:
                words = _TERM.findall(text)
                df.update(set(words))
                counts.setdefault(source, Counter()).update(words)
        kept = {t for t, n in df.items() if n >= least}
        every = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(every)
        for s in counts:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            term = [(-(p[s][t] - q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", sorted(term, key=lambda r: (r[0], r[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, rank) for rank, (v, item) in enumerate(sorted(found, key=lambda r: (r[0], r[1].encode())), 1)]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_query_equals_sql(spark):
    assert_same(queries.op13_divergence(spark, SF_DIR), connect(), queries.oracle_sql()["op13_divergence"])


def test_hard_rows(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the", "The", "été", "日本", "a1b", "x_y", "Z", "ÀB", "naïve", "\x00q", "rare%d"]
    docs = [(" ".join(rng.choices(words, k=rng.randrange(30))) + (" rare%s" % "abc"[i % 3]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None, "é"])) for i in range(300)]
    docs += [(None, "en", "silent"), ("", "fr", "s1"), ("one two", "fr", "s2"), ("common " * 20_000, "en", "s1"), *[("the same", "de", "s1")] * 40]
    frame = spark.createDataFrame([(*d, i, "x") for i, d in enumerate(docs)], SCHEMA)
    assert found(divergence.divergence_audit(frame, least_docs=5, top=4)) == brute(docs, 5, 4)
    assert divergence.divergence_audit(frame.limit(0)).count() == 0


def test_tallies_sent_in_parts_add_up(spark):
    import pyarrow as pa

    rng = random.Random(1)
    lists = [sorted({rng.randrange(9): rng.randrange(1, 4) for _ in range(rng.randrange(9))}.items()) for _ in range(500)]
    held = pa.array([[{"source": f"s{s}", "n": n} for s, n in l] for l in lists], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 500), held], names=["lang", "held"])
    want = Counter((f"s{a}", f"s{b}", m, n) for l in lists for i, (a, m) in enumerate(l) for b, n in l[i + 1 :])
    for size in (100, 1_000_000):
        divergence.TALLY_PAIRS, before = size, divergence.TALLY_PAIRS
        got = Counter()
        for part in divergence._tally(iter([batch, batch.slice(0, 0)])):
            for r in part.to_pylist():
                got[r["s"], r["t"], r["a"], r["b"]] += r["m"]
        divergence.TALLY_PAIRS = before
        assert got == want

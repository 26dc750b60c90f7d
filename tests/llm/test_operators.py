"""Each operator against its brute-force version, and on hard rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cubewright.llm import decontam, langid, linequality, pii, ppm, queries, simhash, tokencount, urlfilter, warc
from cubewright.llm.bpe import SegmentTreeBPE, bpe_encode
from cubewright.llm.scratch import Scratch
from cubewright.llm.text import id_bucket
from tests.against_sql import SF_DIR, assert_same, connect
from tests.llm import brute

DOCS = "doc_id long, text string"
HARD = [None, "", " \n\t", "a", "The THE the", "é ́x \x00 \x1c", "word " * 3000, "x" * 50_000, "日本語 テキスト", "same text here", "same text here"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").where("doc_id < 120")


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD)] + [(None, "no id"), (1003, "a")], DOCS)


def collected(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def by_text(df):
    return sorted(df.collect(), key=repr)


# 1 ------------------------------------------------------------------------------


def test_links_spread_trust_and_distrust(spark):
    rows = [
        (1, "http://Good.org/a", '<a href="http://x.net/1">'), (2, "http://x.net/", "<a href=//y.net/>"), (3, "http://bad.com/de/1", ""),
        (4, "https://linker.net/q?x", "<A HREF='http://BAD.com/de/1'>"), (5, None, None), (6, "nohost", None), (7, "http://y.net", None),
        (8, "a://b.example.org/es/1?://", None), (9, "http://example.org/en/12#x", ""), (10, "http://foo.com/fr/?a", ""), (11, "http://org", None),
        (12, "http://forg/", None), (12, "http://forg/", None),
    ]
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES)
    assert sorted(collected(got, "page_id", "host", "path", "rule", "verdict"), key=repr) == sorted(
        [
            (1, "good.org", "/a", "org/", "allow"), (2, "x.net", "/", None, "allow"), (3, "bad.com", "/de/1", "com/de/", "block"),
            (4, "linker.net", "/q", None, "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "y.net", "", None, "allow"),
            (8, "b.example.org", "/es/1", "example.org/es/", "block"), (9, "example.org", "/en/12", "example.org/en/1", "block"),
            (10, "foo.com", "/fr/", "com/fr/", "allow"), (11, "org", "", None, "allow"), (12, "forg", "/", None, "allow"), (12, "forg", "/", None, "allow"),
        ],
        key=repr,
    )
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), queries.RULES).count() == 0


def test_rules_by_the_thousand_are_those_of_a_loop(spark):
    from cubewright.llm.scratch import Scratch

    rng = random.Random(9)
    names = ["org", "com", "a.com", "b.a.com", "x.org", "net", "y.net", "z.y.net"]
    rules = sorted({rng.choice(names) + "/" + "".join(rng.choices("ab/", k=rng.randrange(5))) for _ in range(2000)} | {"com", "z.y.net"})
    rules = [(rng.choice(["allow", "block"]), r) for r in rules]
    places = [(rng.choice(["", "q.", "b.", "xa."]) + rng.choice(names), "/" + "".join(rng.choices("ab/", k=rng.randrange(7)))) for _ in range(300)] + [("a..com", "/"), ("com", "")]
    want = {}
    for host, path in places:
        fit = [(len(r), len(n), r, a) for a, r in rules for n, s, rest in [r.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith(s + rest)]
        if fit:
            want[host, path] = max(fit)[2:]
    frame = spark.createDataFrame(places * 2, "host string, path string")
    for given in (rules, spark.createDataFrame(rules, "action string, rule string")):
        got = urlfilter.matching_rules(frame, given, Scratch(spark, "t")).collect()
        assert len(got) == len(want) and {(r.host, r.path): (r.rule, r.action) for r in got} == want


def test_a_hub_of_links_and_clashing_columns(spark):
    links = "".join(f"<a href='http://h{i}.net/'>" for i in range(300))
    rows = [(i, f"http://h{i}.net/{'p' * 20_000 if i == 7 else ''}", '<a href="http://hub.info/">' * (1 + i % 3)) for i in range(300)]
    rows += [(300, "http://hub.info/", links), (301, "http://seed.org/", "<a href='http://h1.net/'>" + " " * 100_000), (302, "http://x.com/de/", ""), (303, "http://h9.net/", "<a href=//x.com>")]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1)).withColumn("action", F.lit(1))
    got = {r.page_id: r for r in urlfilter.judge_urls(given, queries.RULES).collect()}
    assert len(got) == len(rows) and got[300].trust > got[2].trust > 0 and got[1].trust > got[2].trust
    assert got[9].distrust > got[2].distrust > 0 and got[9].distrust == got[303].distrust and len(got[7].path) == 20_001
    assert got[301].verdict == "allow" and got[302].verdict == "block"


def test_propagation_is_pagerank(spark):
    from cubewright.llm.scratch import Scratch

    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "d", 1.0), ("d", "b", 1.0)]
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: r for r in urlfilter.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, weight double"), Scratch(spark, "t"), 60).collect()}
    for name, seed, flow in (("trust", "a", edges), ("distrust", "c", [(b, a, w) for a, b, w in edges])):
        want = dict.fromkeys("abcd", 0.0)
        for _ in range(60):
            new = {h: 0.15 * (h == seed) for h in want}
            for a, b, w in flow:
                new[b] += 0.85 * want[a] * w / sum(x for s, _, x in flow if s == a)
            want = new
        assert all(math.isclose(got[h][name], want[h], abs_tol=1e-4) for h in want)


def test_distrust_comes_up_long_chains_and_circles_settle(spark):
    from cubewright.llm.scratch import Scratch

    rows = [(i, f"http://h{i}.net/", f"<a href='http://h{i + 1}.net/'>") for i in range(24)] + [(24, "http://h24.net/", "<a href=//bad.com/>"), (25, "http://bad.com/de/1", "")]
    got = {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert {r.verdict for r in got.values()} == {"block"}
    assert all(math.isclose(got[25 - n].distrust, 0.15 * 0.85**n, rel_tol=1e-9) for n in range(26))
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    circle = urlfilter.propagate(seeds, spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double"), Scratch(spark, "t"))
    settled = {r.host: r.trust for r in circle.collect()}
    assert math.isclose(settled["a"], 0.15 / (1 - 0.85**2), rel_tol=1e-4) and math.isclose(settled["b"], 0.85 * settled["a"], rel_tol=1e-4)


# 2 ------------------------------------------------------------------------------


def _variants(docs, spark):
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    rng = random.Random(5)
    for i, (d, t) in enumerate(list(rows)[:30]):
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((2000 + i, " ".join(words)))
    return spark.createDataFrame(rows, DOCS)


def test_simhash_components(spark, docs, hard):
    given = _variants(docs, spark).union(hard)
    rows = given.collect()
    prints = [brute.fingerprint(r.text) for r in rows]
    roots = brute.components([r.doc_id for r in rows], prints)
    want = sorted([(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, roots)], key=repr)
    got = simhash.simhash_groups(given)
    assert sorted(collected(got, "doc_id", "fingerprint", "component_id"), key=repr) == want
    kept = simhash.drop_near_duplicates(given.withColumn("fp", F.lit(1)).withColumn("first", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "fp", "first"] and kept.count() == len({c for c in roots})
    assert simhash.simhash_groups(given.where("false")).count() == 0


def unwritten(monkeypatch):
    """Plans of the tables that scratch folders are given, in order."""
    plans, write = {}, Scratch.table

    def table(self, df, name, compression=None):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name, compression)

    monkeypatch.setattr("cubewright.scratch.Scratch.table", table)
    return plans


def test_the_index_of_fingerprints_is_never_broadcast(spark, docs, monkeypatch):
    plans = unwritten(monkeypatch)
    assert simhash.simhash_groups(docs).count() == docs.count()
    assert "SortMergeJoin" in plans["lists"] and "Broadcast" not in plans["lists"]


def test_no_texts_wait_for_their_fingerprints(spark, docs, monkeypatch):
    plans = unwritten(monkeypatch)
    assert simhash.simhash_groups(docs).count() == docs.count()
    assert "MapInArrow" in plans["fingerprints"] and "EvalPython" not in plans["fingerprints"]


def test_components_of_all_fingerprints_are_never_broadcast(spark, docs, monkeypatch):
    plans = unwritten(monkeypatch)
    given = _variants(docs, spark)
    got = simhash.simhash_groups(given)
    result = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in result and not [k for k, plan in {**plans, "result": result}.items() if k in ("rooted", "labels", "result") and "Broadcast" in plan]
    assert got.count() == given.count()


def test_near_duplicates_are_dropped_without_a_broadcast_of_the_index(spark, docs, monkeypatch):
    plans = unwritten(monkeypatch)
    assert simhash.drop_near_duplicates(docs).count() <= docs.count()
    assert "SortMergeJoin" in plans["lists"] and "Broadcast" not in plans["lists"]


def test_the_tally_decides_what_is_verified(spark):
    from cubewright.llm.scratch import Scratch

    base = 0x1122334455667788
    prints = [base, base ^ 1, base ^ 0x0101, base ^ 0x010101, base ^ 0x7F7F, base ^ 0x01010101]
    lists = simhash.shared_lists(spark.createDataFrame([(p,) for p in prints], "fp long"), Scratch(spark, "t"))
    met = {(r.a, r.b): r.meetings for r in simhash.candidates(lists).collect()}
    shared = {(a, b): sum(a >> 8 * k & 255 == b >> 8 * k & 255 for k in range(8)) for a in prints for b in prints if a < b}
    assert met == {p: math.comb(n, 5) for p, n in shared.items() if n >= 6}
    assert {p for p, n in shared.items() if n == 5} - met.keys()  # these meet too, in one list


def test_long_posting_lists_lose_no_link(spark, monkeypatch):
    from cubewright.llm.scratch import Scratch

    rng = random.Random(1)
    base = rng.getrandbits(63)
    prints = {base ^ sum(1 << rng.randrange(16) for _ in range(rng.randrange(4))) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    for limit in (2, 48):
        monkeypatch.setattr(simhash, "LONG_LIST", limit)
        edges = [tuple(r) for r in simhash.near_links(frame, Scratch(spark, "t")).collect()]
        assert all(bin(a ^ b).count("1") <= 2 for a, b in edges)
        roots = {p: p for p in prints}

        def find(x):
            while roots[x] != x:
                x = roots[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            roots[max(a, b)] = min(a, b)
        assert [find(p) for p in prints] == brute.components(prints, prints)


# 3 ------------------------------------------------------------------------------


def test_ppm_is_that_of_dictionaries(spark, docs, hard, monkeypatch):
    monkeypatch.setattr(ppm, "BATCH_BYTES", 20_000)
    given = docs.where("doc_id < 40").select("doc_id", F.substring("text", 1, 1200).alias("text")).union(hard.where("doc_id <> 1006 and doc_id <> 1007 or doc_id is null"))
    given = given.withColumn("held", id_bucket(F.col("doc_id"), 5) == 0).withColumn("batch", F.lit(1))
    rows = given.collect()
    want = brute.ppm([(r.doc_id, r.text) for r in rows], [r.held for r in rows])
    got = ppm.language_model_scores(given, "held").collect()
    key = lambda r: (repr(r[0]), r[1], round(r[-1], 6))
    left = sorted([(g.doc_id, *(g[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))) for g in got], key=key)
    right = sorted([(r.doc_id, *w) for r, w in zip(rows, want)], key=key)
    assert [x[:4] for x in left] == [x[:4] for x in right]
    assert np.allclose([x[4:] for x in left], [x[4:] for x in right], atol=1e-6)


def test_ppm_of_texts_longer_than_a_batch(spark, docs, monkeypatch):
    monkeypatch.setattr(ppm, "BATCH_BYTES", 400)
    extra = spark.createDataFrame([(5000, "é" * 700 + " tail é"), (5001, "short"), (5002, "ab cd " * 200), (5002, "ab cd " * 200), (None, " " * 900)], DOCS)
    given = docs.where("doc_id < 9").select("doc_id", F.substring("text", 1, 1500).alias("text")).union(extra).withColumn("held", F.coalesce(F.col("doc_id"), F.lit(0)) % 4 == 1)
    rows = given.collect()
    want = sorted([(repr(r.doc_id), *w) for r, w in zip(rows, brute.ppm([(r.doc_id, r.text) for r in rows], [r.held for r in rows]))])
    got = sorted((repr(g.doc_id), *(g[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))) for g in ppm.language_model_scores(given, "held").collect())
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in got], [x[4:] for x in want], atol=1e-6)


def test_ppm_grams_of_cut_parts_are_those_of_the_whole():
    parts = [ppm.Part(t.encode()) for t in ("", "a", "words and more words " * 9, "é" * 50)]
    whole = ppm.framed(parts)[0].tolist()
    for limit in (1, 3, 7, 100):
        groups = list(ppm.pieces(parts, limit))
        assert [c for _, g in groups for c in ppm.framed(g)[0].tolist()] == whole
        assert [n for numbers, _ in groups for n in numbers] == sorted(n for numbers, _ in groups for n in numbers)


def test_ppm_without_rows_or_training(spark, hard):
    assert ppm.language_model_scores(hard.where("false").withColumn("held", F.lit(True)), "held").count() == 0
    row = ppm.language_model_scores(hard.where("doc_id = 1001").withColumn("held", F.lit(True)), "held").first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (1, 0, 0) and math.isclose(row.score, -math.log10(256))


# 4 ------------------------------------------------------------------------------


def test_winnowing_misses_no_span(spark, docs, hard):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    words = items[0][1].split()
    more = [(900, "the"), (901, "in the"), (902, "Éàé of"), (903, ""), (904, None), (None, "the and of"), (0, items[0][1])]
    bench = spark.createDataFrame(items + more, "item_id long, text string")
    extra = [(3000, items[1][1].upper()), (3001, " ".join(words[:13])), (3002, " ".join(words[2:14])), (3003, "x " * 400 + " ".join(words[:20]))]
    given = docs.where("doc_id < 60").union(hard).union(spark.createDataFrame(extra, DOCS)).withColumn("words", F.lit(1)).withColumn("n_hit", F.lit(1))
    got = decontam.contamination(given, bench)
    rows = [(r.doc_id, r.text) for r in given.collect()]
    known = [i for i in items + more if i[0] is not None]
    want = brute.contamination(rows, known + [("None", "the and of")])
    strip = lambda ids: ",".join(i for i in ids.split(",") if i not in ("", "None"))
    want = [(d, n, h, len(strip(i).split(",")) if strip(i) else 0, strip(i), c) for d, n, h, _, i, c in want]
    have = [(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    kept = decontam.drop_contaminated(given, bench)
    assert kept.columns == given.columns and kept.count() == sum(not w[5] for w in want)
    assert decontam.contamination(given, bench.where("false")).where("contaminated or n_hit > 0").count() == 0
    assert decontam.contamination(given.where("false"), bench).count() == 0


def test_winnowing_without_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontam, "MAX_BITS", 1 << 14)
    assert_same(queries.op4_winnowing(spark, SF_DIR), connect(), queries.OP4_SQL)


def test_spans_are_cut_around_true_hits_alone(spark, docs, monkeypatch):
    from cubewright.llm.scratch import Scratch

    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    spans = {}
    for bits in (1 << 14, 64):  # 64 bits: the set lets nearly all hashes pass
        monkeypatch.setattr(decontam, "MIN_BITS", bits)
        monkeypatch.setattr(decontam, "MAX_BITS", bits)
        scratch = Scratch(spark, "t")
        index = decontam.Benchmark(bench, scratch, "item_id", "text")
        rows, hits, _ = decontam._matches(docs, index, scratch, "text", ["doc_id"])
        marks = rows.agg(F.sum(F.size("marks"))).first()[0]
        spans[bits] = (decontam.spans_around(decontam.fingerprint_hits(rows, index)).count(), hits.count())
        assert bits > 64 or marks > 0.15 * rows.agg(F.sum("n_words")).first()[0]
    assert spans[64] == spans[1 << 14] and spans[64][0] < 20 * spans[64][1] + 2000


# 5 ------------------------------------------------------------------------------


def test_quality_counts(spark, docs, hard):
    given = docs.union(hard).withColumn("n_words", F.lit("clash"))
    got = linequality.quality_counts(given, linequality.LineChain())
    for r in got.collect():
        want = brute.quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert linequality.quality_counts(given.where("false"), linequality.LineChain()).count() == 0


def test_viterbi_finds_the_best_path():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(30):
        chain = linequality.LineChain()
        chain.fitted, chain.weights = True, rng.normal(size=linequality.N_FEATURES)
        chain.steps, chain.start = rng.normal(size=(2, 2)), rng.normal(size=2)
        lines = [(int(n), tuple(rng.normal(size=linequality.N_FEATURES))) for n in rng.integers(1, 9, size=7)]

        def score(path):
            s = chain.start[path[0]] + sum(np.dot(f, chain.weights) for p, (_, f) in zip(path, lines) if p)
            return s + sum(chain.steps[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=7), key=score)
        assert chain.content_words(lines) == sum(n for p, (n, _) in zip(best, lines) if p)


def test_lines_of_good_and_bad_documents(spark):
    sf = "/root/testdata/sf0.01"
    all_docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = linequality.quality_counts(all_docs, linequality.fit_lines(all_docs, labels), keep=["doc_id"]).join(labels, "doc_id")
    open_ = judged.where("not base_failed")
    assert open_.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.98
    assert open_.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.2
    assert not linequality.fit_lines(all_docs, labels.where("quality = 1")).fitted


def test_query_of_op5_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    chain = linequality.fit_lines(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op5_line_labels(spark, SF_DIR).collect():
        text = texts[r.doc_id]
        want = brute.quality(text)
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*want, failed)
        content = brute.content_words(chain, text or "", linequality.text_lines)
        assert r.kept == (not failed and 2 * content >= want[0])


def test_line_fit_climbs_the_likelihood():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(6, 5, linequality.N_FEATURES)), np.array([0, 1, 0, 1, 1, 0])
    for lengths in (np.full(6, 5), np.full(6, 3), np.array([5, 3, 1, 4, 5, 2])):
        there = np.arange(5) < lengths[:, None]
        params = rng.normal(size=linequality.N_FEATURES + 6) / 3
        got = linequality.LineChain._gradient(params, x, y, there, there / lengths[:, None])
        # A document's part of the likelihood is divided by its lines, so that each weighs the same.
        want = brute.chain_gradient(params, x, y, linequality.N_FEATURES, lengths)
        assert np.allclose(got, want, atol=1e-5)


# 6 ------------------------------------------------------------------------------


@pytest.mark.parametrize("letters", ["a@.-1", "0123456789.", "0123456789 -+()", "a1@.+ (2)-é"])
def test_base_spans(letters):
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == brute.personal(text)


@pytest.mark.parametrize("text", ["1" * 200_000, "1." * 100_000, "@" * 100_000, "a" * 200_000 + "@", "+" + "(" * 100_000])
def test_base_spans_of_long_runs_take_linear_time(text):
    import time

    began = time.time()
    pii.base_spans(text)
    assert time.time() - began < 5


def test_added_spans_and_redaction(spark, hard):
    every = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = pii.fit_spans(every)
    assert model.trees is not None
    texts = ["mail john.doe (at) mail dot example dot com now", "call (555) 123-4567 please", "card 4111.1111.1111.1111", "plain words and the year 1999", None, ""]
    found = model.spans(texts)
    assert [bool(f) for f in found] == [True, True, True, False, False, False]
    given = hard.union(spark.createDataFrame([(1, "to a.b@c.de or 10.0.0.1."), (2, "+1 (017) 555-7713")], DOCS)).withColumn("n_chars", F.length("text").cast("long")).withColumn("spans", F.lit(0))
    out = {r.doc_id: r for r in pii.redact_personal_data(given, model, length_col="n_chars").collect()}
    assert out[1].text == "to <EMAIL> or <IP>." and out[1].n_chars == 19 and out[2].text == "<PHONE>" and out[1000].text is None
    assert pii.personal_data(given.where("false"), model).count() == 0
    assert pii.SpanModel([]).spans(["a@b.cd"]) == [[(0, 0, 6, True)]]


def test_spans_are_learned_from_every_text(spark, monkeypatch):
    rng = random.Random(6)
    texts = [f"order {rng.randrange(10**9)} of {rng.randrange(300)}.{rng.randrange(300)}.1.{i % 300}, call ({rng.randrange(100, 999)}) 555-{i:04d}" for i in range(1500)]
    texts += ["word " * 3000 + f"at 10.0.{i}.7 and 4111.1111.1111.{i:04d}" for i in range(20)]
    given = spark.createDataFrame([(i % 700, t) for i, t in enumerate(texts)], DOCS)
    taught, learn = [], pii._taught
    monkeypatch.setattr(pii, "_taught", lambda rows: taught.append(rows.groupBy("y").agg(F.sum("n").alias("n")).collect()) or learn(rows))
    monkeypatch.setattr(pii, "_stand_ins", lambda texts, missing: iter(()))
    pii.fit_spans(given)
    every = [y for t in texts for _, y in pii._examples(t)]
    assert {r.y: r.n for r in taught[0]} == {y: every.count(y) for y in (0.0, 1.0)}


def test_trees_from_sums_are_those_of_all_rows():
    from cubewright.llm.boosting import BoostedTrees

    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, size=(3000, 5)).astype(float)
    y = (rng.random(len(x)) < np.where(x[:, 0] > 5, x[:, 1] / 12, 0.2)).astype(float)
    whole, parts = BoostedTrees().fit(x, y), BoostedTrees()
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, parts.bins + 1)[1:-1])) for c in x.T]
    cuts = [c[c < column.max()] for c, column in zip(cuts, x.T)]
    ones = np.ones(1000)
    parts.fit_sums(y.mean(), cuts, lambda trees, root: sum(trees.histogram(x[i : i + 1000], y[i : i + 1000], ones, cuts, root) for i in (0, 1000, 2000)))
    assert np.allclose(whole.margin(x), parts.margin(x))


def test_query_of_op6_by_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    seen = 0
    for r in queries.op6_personal_data(spark, SF_DIR).collect():
        base = brute.personal(texts[r.doc_id])
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [x for x in every if x in set(listed)] == listed
        key = [(int(s), pii.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in every)]
        assert key == sorted(key)
        seen += len(listed)
    assert seen > 20


def test_trees_and_calibration():
    from cubewright.llm.boosting import BoostedTrees

    rng = np.random.default_rng(3)
    x = rng.normal(size=(30_000, 4))
    chance = 1 / (1 + np.exp(-3 * np.where(x[:, 0] > 0, x[:, 1], 1.0)))  # two features together
    y = (rng.random(len(x)) < chance).astype(float)
    trees = BoostedTrees().fit(x[:2000], y[:2000]).calibrate(x[2000:6000], y[2000:6000])
    p = trees.probability(x[6000:])
    assert np.mean((p > 0.5) == (chance[6000:] > 0.5)) > 0.9
    for low, high in ((0, 0.25), (0.25, 0.75), (0.75, 1)):
        rows = (p >= low) & (p <= high)
        assert abs(p[rows].mean() - y[6000:][rows].mean()) < 0.08
    by_hand = [sum(v[0 if a[n[1][0]] <= n[1][1] else 1] if a[n[0][0]] <= n[0][1] else v[2 if a[n[2][0]] <= n[2][1] else 3] for n, v in trees.nodes) + trees.base for a in x[:50]]
    assert np.allclose(trees.margin(x[:50]), by_hand)


def _without_plus(text, share, rng):
    """The text with a share of its base telephones in other forms, and these forms."""
    forms = []
    for start, kind, end in reversed(pii.base_spans(text)):
        if kind == 3 and rng.random() < share:
            tail = "".join(c for c in text[start:end] if c.isdigit())[-10:]
            forms.append(rng.choice([f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"00 49 {tail[:3]} {tail[3:]}"]))
            text = text[:start] + forms[-1] + text[end:]
    return text, forms


@pytest.mark.parametrize("share", [1 / 3, 0.8, 1])
def test_telephones_without_a_plus_are_found_however_many_there_are(spark, share):
    rng = random.Random(2)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(6000).collect()]
    changed = [_without_plus(t, share, rng) for t in texts]
    given = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(changed)], DOCS)
    model = pii.fit_spans(given)
    held = [(t, forms) for t, forms in changed if forms]
    out = [pii.redact(t, s) for (t, _), s in zip(held, model.spans([t for t, _ in held]))]
    wanted = [(f, o) for (_, forms), o in zip(held, out) for f in forms]
    assert len(wanted) > 10 and sum(f in o for f, o in wanted) <= 0.05 * len(wanted)
    assert sum(o.count("<PHONE>") for o in out) >= 0.95 * len(wanted)


def test_a_rare_kind_is_in_the_sample(spark):
    rows = [(i, f"order {i} of 1999, 17 pieces at 12.50, call +1 415 555 {1000 + i % 9000} or mail a{i}@b.org") for i in range(3000)]
    rows += [(5000 + i, f"the host 10.0.{i}.7 is down") for i in range(6)]
    model = pii.fit_spans(spark.createDataFrame(rows, DOCS))
    assert np.isfinite(model.thresholds[1]) and model.spans(["the host 10[.]0[.]3[.]9 is down"])[0]


# 7 ------------------------------------------------------------------------------


def test_held_out_languages(spark, hard):
    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(every)
    held = every.where(id_bucket(F.col("doc_id"), 3) == 1)
    got = langid.identify_languages(held, model, keep=["doc_id", "lang"])
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    rows = {r.doc_id: r for r in langid.identify_languages(hard.withColumn("score", F.lit("clash")), model).collect()}
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {rows[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert langid.drop_unidentified(held, model, 0.25).count() == held.count()
    assert langid.identify_languages(hard.where("false"), model).count() == 0


def test_margins_are_those_of_explicit_kernels(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("text is not null and lang is not null").select(F.substring("text", 1, 400).alias("text"), "lang").limit(160).collect()
    train, rest = rows[:100], [r.text for r in rows[100:]] + ["", "the", "日本語", "Größe ÉTÉ 12", "zzz " * 400]
    model = langid.StringKernelClassifier([r.text for r in train], [r.lang for r in train], landmarks=9, ridge=1e-3)
    want = brute.string_kernel_margins([r.text for r in train], [r.lang for r in train], rest, 9, 1e-3)
    presence = langid.Presence(model.grams)
    got = np.concatenate([(m @ model.matrix) / np.sqrt(n)[:, None] + model.bias for _, m, n in presence.blocks(rest)])
    assert np.allclose(got, want, atol=2e-3)
    names, scores = model.predictor()(rest)
    for text, name, score, margin in zip(rest, names, scores, want):
        letters = any(c.isalpha() for c in text)
        assert name == (model.labels[int(margin.argmax())] if letters else "und")
        assert math.isclose(score, min(1, max(0, (margin.max() + 1) / 2)) if letters else 0, abs_tol=2e-3)


def test_query_of_op7_never_reads_the_label_of_what_it_predicts(spark, tmp_path):
    every = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op7_string_kernel(spark, SF_DIR).collect()}
    held = id_bucket(F.col("doc_id"), 3) == 1
    every.withColumn("lang", F.when(~held, F.col("lang")).otherwise("xx")).withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op7_string_kernel(spark, str(tmp_path)).collect()}
    assert got == want and {d for d, r in got.items() if r[0]} == {r.doc_id for r in every.where(held).collect()}


def _invented(count):
    """Word lists of invented languages."""
    out = []
    for seed in range(count):
        rng = random.Random(100 + seed)
        syllables = ["".join((rng.choice("bcdfghjklmnpqrstvwxz"), rng.choice("aeiouyéö"), rng.choice(["", "", "n", "r", "st"]))) for _ in range(12)]
        out.append(["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(80)])
    return out


@pytest.mark.parametrize("languages", [2, 4, 20])
def test_unlearned_languages_go_and_short_texts_stay_whatever_the_number_of_languages(spark, languages):
    words = _invented(languages + 1)
    rng = random.Random(7)
    rows = [(" ".join(rng.choices(words[k], k=30)), f"l{k}") for k in range(languages) for _ in range(40)]
    model = langid.StringKernelClassifier([t for t, _ in rows], [label for _, label in rows])
    good = [" ".join(rng.choices(words[k], k=n)) for k in range(languages) for n in (1, 1, 20)]
    bad = [" ".join(rng.choices(words[languages], k=20)) for _ in range(20)] + ["xqzjk wvvq kkxz qqwj zzxv", "日本語 テキスト"]
    given = spark.createDataFrame(list(enumerate(good + bad)), DOCS)
    stayed = {r.doc_id for r in langid.drop_unidentified(given, model, 0.25).collect()}
    assert stayed == set(range(len(good)))


def test_documents_of_an_unlearned_language_go(spark):
    every = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = every.where((id_bucket(F.col("doc_id"), 3) == 1) & (F.length("text") > 200))
    for language in ("en", "fr"):
        model = langid.fit_languages(every.where(F.col("lang") != language))
        new, known = ((c, held.where(c).count()) for c in (F.col("lang") == language, F.col("lang") != language))
        assert langid.drop_unidentified(held.where(new[0]), model, 0.25).count() < 0.1 * new[1]
        assert langid.drop_unidentified(held.where(known[0]), model, 0.25).count() > 0.995 * known[1]


def test_every_label_is_learned(spark):
    words = _invented(140)
    rng = random.Random(8)
    rows = [(i * 140 + k, " ".join(rng.choices(words[k], k=40)), f"l{k}") for i in range(12) for k in range(140)]
    rows += [(10_000 + i, " ".join(rng.choices(["ωραία", "θάλασσα", "και", "ουρανός", "το"], k=4000)), "long") for i in range(6)]
    every = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4)
    model = langid.fit_languages(every)
    assert model.labels == sorted([f"l{k}" for k in range(140)] + ["long"])
    got = langid.identify_languages(every.where((id_bucket(F.col("doc_id"), 3) == 1) | (F.col("lang") == "long")), model, keep=["lang"])
    right = {r.lang: r.share for r in got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share")).collect()}
    assert right["long"] == 1 and min(right.values()) > 0 and sum(right.values()) > 0.95 * len(right)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        langid.fit_languages(many)


def test_models_of_one_label_and_of_none(spark, hard):
    none = langid.fit_languages(hard.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify_languages(hard, none).collect()} == {"und"}
    one = langid.fit_languages(hard.withColumn("lang", F.lit("xx")))
    assert {r.lang_pred for r in langid.identify_languages(hard, one).collect()} == {"und", "xx"}


# 8 ------------------------------------------------------------------------------


def test_archives_give_back_what_was_written(spark, tmp_path):
    tricky = "<p>\r\n\r\nWARC/1.1\r\n\r\n é</p>" * 60
    rows = [(1, "http://a/\r\nx", tricky), (5, None, tricky), (9, "http://b", tricky), (9, "http://b", tricky), (2, "http://c", "short"), (3, "http://d", "short"), (4, "http://e", None), (None, "http://f", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archived_pages(pages, with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = next((h or "").encode() for p, _, h in rows if p == r.id)
        assert r.response.payload_bytes == len(payload) and r.response.payload_digest == hashlib.sha1(payload).hexdigest()
        assert r.request is not None and r.metadata is not None
        assert (r.response.type, r.refers_to_id) == (("revisit", 9) if r.id in (1, 5) else ("response", None))
        assert r.response.payload == (payload if r.response.type == "response" else None)
    assert warc.archived_pages(pages.where("false")).count() == 0


def test_archives_are_bounded_by_bytes_and_clashing_columns_do_no_harm(spark, tmp_path):
    rng = random.Random(4)
    long = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=150_000)) for _ in range(40)]
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate([*long, long[3], "x" * 3_000_000])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).withColumn("sha1", F.lit("clash")).withColumn("bytes", F.lit(1)).withColumn("id", F.lit(2))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        warc.write_warc(pages, str(tmp_path / "w"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) > 3 and max(sizes) < 2_500_000 < sum(sizes)
    got = {r.id: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path / "w"))).collect()}
    assert len(got) == 42 and got[3].response.type == "revisit" and got[3].refers_to_id == 40 and got[41].response.payload_bytes == 3_000_000


def test_reader_takes_plain_files_and_many_members():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    for content in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 3)):
        assert [r["fields"] for r in warc.read_records(content, True)] == ["a: b\n"] * 3
    with pytest.raises(ValueError):
        list(warc.read_records(one[:-8], True))


# 9 and 10 -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def _texts():
    rng = random.Random(1)
    letters = "ab'sİé \n\t́<|endoftext|>9½한가👧 \x85ſK"
    return [t for t in HARD] + ["x<|endoftext|>y <|startoftext|>", "'s 'S don'T 12345 ½ ²", " a\u0085b\x1cc\x1fd　"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]


@pytest.mark.parametrize("chunk, overlap", [(16_384, 256), (64, 8), (40, 3)])
def test_counts_are_the_library_s(library, chunk, overlap):
    texts = _texts()
    sizes, counts = tokencount.ResyncCounter(public_tokenizers.path("word_bpe_49k.json"), chunk, overlap).count_texts(texts)
    assert counts == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert sizes == [len((t or "").encode()) for t in texts]


def test_encoding_is_the_library_s(library):
    texts = _texts()
    ids, decoded = SegmentTreeBPE(public_tokenizers.path("word_bpe_49k.json")).encode_texts(texts)
    for t, i, d in zip(texts, ids, decoded):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == want and d == library.decode(want, skip_special_tokens=False)


def test_vocabularies_with_white_space_in_tokens_are_refused():
    for build in (tokencount.ResyncCounter, SegmentTreeBPE):
        with pytest.raises(ValueError):
            build(public_tokenizers.path("byte_bpe_50k.json"))


def test_small_caches_and_windows_change_nothing(library, monkeypatch):
    from cubewright.llm import bpe, pieces

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*_texts(), "long text of words " * 40_000, "é" + "z" * 300_000 + " end"]
    coder = SegmentTreeBPE(path, 2000)
    monkeypatch.setattr(bpe, "_GROUP_CHARS", 3000)
    monkeypatch.setattr(bpe, "windows", lambda text: pieces.windows(text, 50))
    want = SegmentTreeBPE(path).encode_texts(texts)
    assert coder.encode_texts(texts) == want
    assert np.frombuffer(want[0][-2], "<u4").tolist() == library.encode(texts[-2], add_special_tokens=False).ids


def test_query_of_op10_against_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.op10_bpe(spark, SF_DIR).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())


def test_query_of_op9_against_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.op9_token_counts(spark, SF_DIR).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_token_frames(spark, hard):
    path = public_tokenizers.path("word_bpe_49k.json")
    given = hard.withColumn("n_tokens", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    assert tokencount.token_counts(given, path).count() == given.count() == bpe_encode(given, path).count()
    assert tokencount.token_counts(given.where("false"), path).count() == 0 == bpe_encode(given.where("false"), path).count()


def test_filters_keep_odd_columns_and_take_empty_tables(spark, docs, hard):
    names = ["row", "fp", "kept", "fit", "redacted", "spans", "n_words", "words", "c0", "c1"]
    given = docs.limit(20).union(hard).withColumns({n: F.lit(n) for n in names})
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    model = langid.StringKernelClassifier(["the one and the other", "der eine und die andere"], ["en", "de"])
    steps = {
        "language": lambda d: langid.drop_unidentified(d, model, 0.0), "near": simhash.drop_near_duplicates,
        "bench": lambda d: decontam.drop_contaminated(d, bench), "personal": lambda d: pii.redact_personal_data(d, pii.SpanModel([])),
    }
    for name, step in steps.items():
        out = step(given)
        assert out.columns == given.columns and step(given.where("false")).count() == 0, name
        assert out.select(*names).distinct().collect() == given.select(*names).distinct().collect(), name
    assert sorted(map(repr, steps["bench"](given).select("doc_id", "text").collect())) == sorted(map(repr, given.select("doc_id", "text").collect()))


# Queries ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF_DIR), connect(), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_return_a_row_for_each_input_row(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert queries.queries()[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()

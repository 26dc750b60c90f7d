"""Similarity joins, containment, assignment and running totals against plain loops."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubewright import queries
from cubewright.functions.logic import running_total
from cubewright.operators import expansion, matching, similar
from tests.against_sql import SF_DIR


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def names(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "name string")


def alike(texts, rng):
    """Names and others that are a few letters off."""
    out = set(texts)
    for t in texts:
        for _ in range(2):
            letters = list(t)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(letters) + 1)
                rng.choice([lambda: letters.insert(i, rng.choice("abcn")), lambda: letters.pop(i - 1) if letters else None, lambda: letters.reverse() if rng.random() < 0.1 else None])()
            out.add("".join(letters))
    return sorted(out)


def test_similar_names_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("aabnrst_", k=rng.randrange(1, 14))) for _ in range(120)] + ["a", "b", "ab", "abc", "aaaa", "aaaaa", "banana", "bananan", "日本語テキスト", "日本語テキス"]
    left, right = alike(base[::2], rng) + [None, ""], alike(base, rng) + ["", None]
    got = {(r.a, r.b): r.ratio for r in similar.similar_names(names(spark, left), names(spark, right)).collect()}
    want = {(a, b): r for a in left if a for b in right if b for r in [difflib.SequenceMatcher(None, a, b).ratio()] if r >= similar.FUZZY}
    assert got == want and len(want) > 150
    assert similar.similar_names(names(spark, left).limit(0), names(spark, right)).count() == 0
    with pytest.raises(ValueError):
        similar.similar_names(names(spark, left), names(spark, right), 0.5)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_index_of_names_goes_through_the_driver(spark, tmp_path):
    for x in ("l", "r"):  # only files are taken for small
        names(spark, [f"{x}name_{i:04d}" for i in range(50)]).write.parquet(str(tmp_path / x))
    left, right = (spark.read.parquet(str(tmp_path / x)) for x in ("l", "r"))
    assert "Broadcast" not in physical(similar.similar_names(left, right))
    frames = [df.select(F.lit("t").alias("table"), F.col("name").alias("column")) for df in (left, right)]
    found = matching.matched_columns(*frames)
    assert "Broadcast" not in physical(found) and found.where("method = 'fuzzy'").count() >= 50


def test_keys_of_assigned_columns_do_not_go_through_the_driver(spark):
    out = physical(queries.QUERIES["STR-05_assigned_columns"](spark, SF_DIR))
    assert "Broadcast" not in out and "SortMergeJoin" in out


def test_names_by_ends_or_by_grams_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdef", k=rng.randrange(1, 34))) for _ in range(40)] + ["sales_" + "".join(rng.choices("abcdef", k=12)) for _ in range(25)]
    left, right = alike(base, rng), alike(base, rng)
    want = {(a, b) for a in left for b in right if a and b and difflib.SequenceMatcher(None, a, b).ratio() >= similar.FUZZY}
    for crowded, edits in ((200, 8), (2, 8), (200, 2)):
        monkeypatch.setattr(similar, "CROWDED", crowded)
        monkeypatch.setattr(similar, "MOST_EDITS", edits)
        got = [(r.a, r.b) for r in similar.similar_names(names(spark, left), names(spark, right)).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_alike_names_share_a_key_of_an_end():
    rng, levels = random.Random(12), similar.end_levels(similar.FUZZY)

    def keys(name, side):
        out = set()
        if len(name) < len(side):
            for back, text in enumerate((name, name[::-1])):
                for level in range(side[len(name)][back] + 1):
                    start = (text + " " * 9)[: similar.END + level]
                    out |= {(back, "".join(start[i] for i in (*kept, similar.END + level - 1))) for kept in itertools.combinations(range(similar.END + level - 1), similar.END - 1)}
        return out

    met = 0
    for _ in range(4000):
        a = "".join(rng.choices("abcd", k=rng.randrange(1, len(levels[0]))))
        b = list(a)
        for _ in range(rng.randrange(1, 8)):
            if rng.random() < 0.5:
                b.insert(rng.randrange(len(b) + 1), rng.choice("abcd"))
            elif b:
                b.pop(rng.randrange(len(b)))
        b = "".join(b)
        if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= similar.FUZZY:
            assert keys(a, levels[0]) & keys(b, levels[1])
            met += 1
    assert met > 500


def test_assigned_columns_leave_nothing_but_what_they_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cubewright.scratch.scratch_root", lambda _: f"file://{tmp_path}")
    out = queries.QUERIES["STR-05_assigned_columns"](spark, SF_DIR)
    # The forms of names were written once and are gone; the rows are those of the SQL.
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["assigned"]
    want = {(r.p_partkey, r.p_partkey) for r in spark.read.parquet(f"{SF_DIR}/part.parquet").where("p_partkey % 4 < 3").collect()}
    assert {tuple(r) for r in out.collect()} == want


def test_unlike_names_do_not_meet(spark):
    rng = random.Random(13)
    sides = [names(spark, ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=22)) for _ in range(3000)]).select(F.col("name").alias("n"), F.xxhash64("name").alias("id")) for _ in range(2)]
    assert similar._by_ends(*sides, similar.end_levels(similar.FUZZY), similar.FUZZY).count() < 100


def test_forms_of_names_are_worked_out_once(spark):
    found = similar.name_matches(names(spark, ["Sales Amount", "qty"]), names(spark, ["SalesAmount", "QTY", "zip"]))
    assert "regexp_replace" not in physical(found) and "split(" not in physical(found)
    assert sorted(r.method for r in found.collect()) == ["case", "normalised"]


def test_least_shared_grams_holds_for_all_matches():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choices("ab", k=rng.randrange(1, 12)))
        b = list(a)
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("ab"))
        b = "".join(b)
        if difflib.SequenceMatcher(None, a, b).ratio() >= similar.FUZZY and min(len(a), len(b)) > 1:
            grams = [sorted(x[i : i + 2] for i in range(len(x) - 1)) for x in (a, b)]
            shared = sum(min(grams[0].count(g), grams[1].count(g)) for g in set(grams[0]))
            assert shared >= max(1, -(-(1.5 * similar.FUZZY * (len(a) + len(b)) - len(a) - len(b) - 1) // 1))


def test_name_matches_take_the_surest_tier(spark):
    model = ["Sales Amount", "qty", "Customer Name", "Zip", "same", "Ord Date", None, "", "unlike"]
    source = ["SalesAmount", "QTY", "name_customer", "zip", "same", "order_dates", "SAME", "", None, "salesamounts", "xyzzy"]
    got = {(r.column, r.source_column): (r.confidence, r.method) for r in similar.name_matches(names(spark, model), names(spark, source)).collect()}
    assert got["same", "same"] == (1.0, "exact") and got["same", "SAME"] == (0.99, "case") and got["qty", "QTY"] == (0.99, "case")
    assert got["Sales Amount", "SalesAmount"] == (0.97, "normalised") and got["Customer Name", "name_customer"][1] in ("tokens-reordered", "synonym")
    assert got["Sales Amount", "salesamounts"] == (0.88, "fuzzy")
    assert not any("unlike" in k or "xyzzy" in k or "" in k or None in k for k in got)


def greedy(pairs):
    taken, out = (set(), set()), []
    for table, a, b, sure, method in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if (table, a) not in taken[0] and (table, b) not in taken[1]:
            taken[0].add((table, a))
            taken[1].add((table, b))
            out.append((table, a, b, sure, method))
    return sorted(out)


def test_assignment_is_that_of_a_greedy_loop(spark):
    rng = random.Random(7)
    pairs = list({(f"t{rng.randrange(3)}", f"a{rng.randrange(9)}", f"b{rng.randrange(9)}"): rng.choice([0.71, 0.9, 0.9, 1.0]) for _ in range(150)}.items())
    pairs = [(*k, v, "fuzzy") for k, v in pairs]
    shape = "table string, column string, source_column string, confidence double, method string"
    extra = [("t0", "x", "y", 0.5, "fuzzy"), ("t0", "x", "z", 1.0, "unresolved"), ("t1", None, "q", 1.0, "exact")]
    frame = spark.createDataFrame(pairs + pairs[:9] + extra, shape)
    assert sorted(tuple(r) for r in matching.assign_columns(frame).collect()) == greedy(pairs)
    assert matching.assign_columns(frame.limit(0)).collect() == []


def test_contained_texts_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    wholes = ["".join(rng.choices("abc ", k=rng.randrange(25))) for _ in range(200)] + ["", "日本語"]
    parts = ["".join(rng.choices("abc ", k=rng.randrange(7))) for _ in range(150)] + ["", None, "本", "zzz", "z", wholes[0] + "x"]
    frames = [spark.createDataFrame([(t,) for t in texts], "t string") for texts in (parts, wholes + wholes[:5])]
    got = [tuple(r) for r in expansion.contained(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == {(p, w) for p in parts if p for w in wholes if p in w}


def test_long_parts_are_found_and_no_index_of_texts_goes_through_the_driver(spark, tmp_path):
    rng = random.Random(4)
    wholes = ["".join(rng.choices("ab", k=rng.randrange(60))) for _ in range(100)]
    parts = [w[i : i + rng.randrange(1, 40)] for w in wholes for i in (0, 3, 7)] + ["ab" * 15, "aab" * 9]
    for x, texts in (("p", parts), ("w", wholes)):  # only files are taken for small
        names(spark, texts).write.parquet(str(tmp_path / x))
    out = expansion.contained(*[spark.read.parquet(str(tmp_path / x)) for x in ("p", "w")])
    assert "Broadcast" not in physical(out)
    assert sorted(map(tuple, out.collect())) == sorted({(p, w) for p in parts if p for w in wholes if p in w})


def test_findings_come_without_all_entities_in_one_row(spark):
    cases = spark.createDataFrame([(1, "R", "b"), (2, None, "none"), (3, "R", None)], "test_case_id int, rule_id string, entity string")
    found = spark.createDataFrame([("R", f"e{i}b", i % 2 == 0) for i in range(40)], "rule_id string, entity string, passed boolean")
    out = expansion.match_findings(cases, found)
    assert sorted(map(tuple, out.collect())) == [(1, "FAIL", 40), (2, "NOT EXECUTED", 0), (3, "FAIL", 40)]
    assert "collect_list" not in plan(out) and "collect_set" not in plan(out)


@pytest.mark.parametrize("n", [0, 1, 3, 500])
def test_running_totals_over_all_rows(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 2, 3, 4]), i, rng.choice([None, 1, 5, -2])) for i in range(n)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "a int, b int, v long").repartition(3)
    out = running_total(frame, "v", ["a", "b"])
    assert "windowspecdefinition(a" not in plan(out).lower() and out.columns == ["a", "b", "v", "running"]
    want, total = {}, None
    for a, b, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        total = v if total is None else total + (v or 0)
        want[b] = total
    assert {r.b: r.running for r in out.collect()} == want
    assert out.schema["running"].dataType == T.LongType()
    money = running_total(frame.withColumn("v", F.col("v").cast("decimal(9,2)")), "v", ["a", "b"])
    assert {r.b: None if r.running is None else int(r.running) for r in money.collect()} == want

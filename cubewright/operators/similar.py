"""Names that are alike, found through indexes instead of by comparing every two."""

from __future__ import annotations

import difflib
import itertools
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import column_concepts, column_words, normal_column
from ..scratch import Scratch

# How sure each way of matching two column names is, the surest first.
TIERS = (("exact", 1.0), ("case", 0.99), ("normalised", 0.97), ("tokens", 0.96), ("tokens-reordered", 0.93), ("synonym", 0.91))
FUZZY, FUZZY_TOP, REVIEW = 0.86, 0.88, 0.70
#: Letters of the grams that index names.
GRAM = 2
#: Matched letters of the keys of beginnings and ends; letters without a match, and letters of a name, up to which these keys index names.
END, MOST_EDITS, LONGEST = 5, 8, 64
#: Names on either side that begin or end alike, beyond which grams tell their partners better than beginnings and ends.
CROWDED = 200


def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)], dtype=float)


ratio = F.pandas_udf(_ratio, T.DoubleType())


def least_shared(letters: Column, at_least: float) -> Column:
    """Grams that two names of together so many letters share at least, if their ratio is high enough.

    The ratio is 2 M / T of M matched among T letters, so M is ``at_least`` T / 2 or more.
    Between two matched blocks lies a letter that isn't matched, and there are T - 2 M of
    those, so M letters lie in at most T - 2 M + 1 blocks, each of which has one gram less
    than letters.
    """
    return F.ceil(1.5 * at_least * letters - letters - 1 - 1e-9)


def end_levels(at_least: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """For each length (left out at the beginning, left out at the end): most letters of a name that its keys leave out, -1 for no key.

    The first list is for names that are looked up, and ends before the first length with a
    partner that may differ in more than ``MOST_EDITS`` letters; the second is for their
    partners.  Two names of ratio ``at_least`` match m letters in order, and e letters of
    both have no match.  Where the first and the last ``END`` matched letters are apart,
    at most x of the e lie before the END-th matched letter, or else at most e - 1 - x
    after the END-th last: keys that leave out so many letters meet, whatever x.
    """
    asked, partners = [(-1, -1)], {0: (-1, -1)}
    for a in range(1, LONGEST + 1):
        found = []
        for b in range(math.ceil(a * at_least / (2 - at_least) - 1e-9), math.floor(a * (2 - at_least) / at_least + 1e-9) + 1):
            m = math.ceil(at_least * (a + b) / 2 - 1e-9)
            e = a + b - 2 * m
            if m <= min(a, b) and e:  # without such letters the names are equal
                found.append((b, m, e, *(((e - 1) // 2, e // 2) if 2 * END <= m + 1 else (e, -1))))
        if any(e > MOST_EDITS for _, _, e, _, _ in found):
            break
        asked.append(tuple(max((min(f[i], a - f[1]) for f in found), default=-1) for i in (3, 4)))
        for b, m, _, *levels in found:
            partners[b] = tuple(max(old, min(new, b - m)) for old, new in zip(partners.get(b, (-1, -1)), levels))
    return asked, [partners.get(n, (-1, -1)) for n in range(max(partners) + 1)]


def _by_ends(left: DataFrame, right: DataFrame, levels: tuple[list, list], at_least: float) -> DataFrame:
    """(a, b), ids of different names of left and right that may be alike; both frames: n, id.

    A key is the first END letters that are left of a name when up to some letters are
    left out, or the last.  What meets must be of fitting lengths, and differ in no more
    letters than may stay without a match: each flips one of 64 bits at most, a bit for
    a letter and one for its repeat.
    """
    most = [max(0, *(x[i] for side in levels for x in side)) for i in (0, 1)]
    # Whether from the end, letters left out, places of the letters that stay.
    kinds = [[back, level, *places, END + level] for back in (0, 1) for level in range(most[back] + 1) for places in itertools.combinations(range(1, END + level), END - 1)]

    def keys(side: DataFrame, name: str, held: list) -> DataFrame:
        letters = F.transform(F.sequence(F.lit(1), F.length("n")), lambda i: F.pmod(F.ascii(F.substr("n", i, F.lit(1))), F.lit(32)))
        bits = F.transform(letters, lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k))
        seen = F.aggregate(bits, F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(k).bitwiseOR(F.shiftleft(s.bitwiseAND(k), 32)))
        rows = side.where((F.length("n") > 0) & (F.length("n") < len(held))).select(
            F.col("id").alias(name), F.length("n").alias(f"{name}_letters"), seen.alias(f"{name}_seen"),
            *[F.get(F.lit([x[i] for x in held]), F.length("n")).alias(f"most{i}") for i in (0, 1)],
            *[F.concat(text, F.lit(" " * (END + max(most)))).alias(f"text{i}") for i, text in enumerate((F.col("n"), F.reverse("n")))],
        )
        k = F.col("kind")
        kept = rows.withColumn("kind", F.explode(F.lit(kinds))).where(k[1] <= F.when(k[0] == 0, F.col("most0")).otherwise(F.col("most1")))
        kept = kept.withColumn("text", F.when(k[0] == 0, F.col("text0")).otherwise(F.col("text1")))
        return kept.select(F.xxhash64(k[0], *[F.substr("text", k[2 + i], F.lit(1)) for i in range(END)]).alias("key"), name, f"{name}_letters", f"{name}_seen")

    letters = F.col("a_letters") + F.col("b_letters")
    matched = F.ceil(at_least * letters / 2 - 1e-9)
    fits = (matched <= F.least("a_letters", "b_letters")) & (F.bit_count(F.col("a_seen").bitwiseXOR(F.col("b_seen"))) <= letters - 2 * matched)
    met = keys(left, "a", levels[0]).join(keys(right, "b", levels[1]).hint("merge"), "key")
    return met.where(fits & (F.col("a") != F.col("b"))).select("a", "b").distinct()


def _by_grams(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """(a, b), names of left and right that may be alike; both frames: n.

    An index of two-letter grams, the rarest first: a name's least number of shared grams
    says how many of its rarest grams must hold two of them; places, lengths and the edit
    distance drop nearly all other pairs.
    """
    listed = F.transform(F.sequence(F.lit(1), F.length("n") - GRAM + 1), lambda i: F.substr("n", i, F.lit(GRAM)))
    sides = [names.where(F.length("n") >= GRAM).select("n", listed.alias("list")) for names in (left, right)]
    counts = sides[0].union(sides[1]).select(F.explode("list").alias("gram")).groupBy("gram").agg(F.count("*").alias("held"))

    def keys(side: DataFrame, name: str) -> DataFrame:
        """Two of a name's rarest grams together, and for pairs that may share less than two grams one alone."""
        ordered = side.select("n", F.posexplode("list").alias("at", "gram")).join(counts.hint("merge"), "gram").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("held", "gram", "at"))).alias("o"))
        # The shortest partner leaves the fewest letters, and so the fewest shared grams.
        fewest = least_shared(F.length("n") * (1 + at_least / (2 - at_least)), at_least)
        size, none = F.size("o"), F.lit(None)
        single = F.slice("o", F.lit(1), (size - F.greatest(F.lit(1), fewest) + 1).cast("int"))
        double = F.slice("o", F.lit(1), F.least(size, size - F.greatest(F.lit(2), fewest) + 2).cast("int"))
        alone = F.transform(single, lambda x: F.struct(x["gram"].alias("g"), none.cast("string").alias("h"), x["at"].alias("at"), none.cast("int").alias("too")))
        both = F.flatten(F.transform(double, lambda x, i: F.transform(F.slice(double, i + 2, F.size(double)), lambda y: F.struct(x["gram"].alias("g"), y["gram"].alias("h"), x["at"].alias("at"), y["at"].alias("too")))))
        listed = F.when(fewest < 2, F.concat(alone, both)).otherwise(both)
        keyed = ordered.select(F.col("n").alias(name), F.length("n").alias(f"{name}_letters"), F.explode(listed).alias("k"))
        return keyed.select(F.xxhash64("k.g", "k.h").alias("key"), name, f"{name}_letters", F.col("k.at").alias(f"{name}_at"), F.col("k.too").alias(f"{name}_too"))

    letters, most = F.col("a_letters") + F.col("b_letters"), F.least("a_letters", "b_letters")
    # Matched blocks keep their order, so a matched letter is moved by the letters without a match at most.
    moved = (1 - at_least) * letters + 1e-9
    close = (F.abs(F.col("a_at") - F.col("b_at")) <= moved) & (F.coalesce(F.abs(F.col("a_too") - F.col("b_too")), F.lit(0)) <= moved)
    met = keys(sides[0], "a").join(keys(sides[1], "b").hint("merge"), "key")
    return met.where(close & (2 * most >= at_least * letters - 1e-9) & _few_edits(at_least)).select("a", "b").distinct()


def _few_edits(at_least: float) -> Column:
    """Letters without a match are the most edits that lead from one name to the other."""
    letters = F.length("a") + F.length("b")
    return F.call_function("levenshtein", F.col("a"), F.col("b"), F.floor((1 - at_least) * letters + 1e-9).cast("int")) >= 0


def similar_names(left: DataFrame, right: DataFrame, at_least: float = FUZZY) -> DataFrame:
    """(a, b, ratio) of all names ``a`` of left and ``b`` of right whose letter-by-letter ratio is at least that; both frames: name.

    Names are looked up by keys of their beginnings and ends, of which a pair that is
    alike shares one; long names, and many that begin or end like many others, by their
    rarest grams.  Every pair that may be alike is met in one of the two ways, and the
    ratio decides.  Equal names pair whatever their length.  Null and empty names pair
    with nothing.  ``at_least`` must be above 0.8, below which short names would share no
    gram.  Spark takes an index for as small as the names it is made of, so the hints
    keep it from being broadcast through the driver.
    """
    if not 0.8 < at_least <= 1:
        raise ValueError("the ratio must be above 0.8")
    a, b = (names.select(F.col("name").alias("n")).where("n <> ''").distinct().withColumn("id", F.xxhash64("n")) for names in (left, right))
    levels = end_levels(at_least)
    ends = F.array(F.concat(F.lit("^"), F.left("n", F.lit(END))), F.concat(F.right("n", F.lit(END)), F.lit("$")))
    often = [side.select(F.explode(ends).alias("end")).groupBy("end").agg(F.count("*").alias("names")).where(F.col("names") > CROWDED).select("end") for side in (a, b)]
    crowds = often[0].join(often[1].hint("merge"), "end")
    crowded = a.select("n", F.explode(ends).alias("end")).join(crowds.hint("merge"), "end").select("n").distinct().withColumn("crowded", F.lit(True))
    told = a.join(crowded.hint("merge"), "n", "left")
    by_grams = F.col("crowded").isNotNull() | (F.length("n") >= len(levels[0]))

    def partners(names: DataFrame) -> DataFrame:
        """Names of right that have a length of which a partner among these may be."""
        least, most = (names.select(of(F.length("n"))).scalar() for of in (F.min, F.max))
        least, most = F.ceil(least * at_least / (2 - at_least) - 1e-9), F.floor(most * (2 - at_least) / at_least + 1e-9)
        return b.where(F.length("n").between(least, most))

    short, rest = told.where(~by_grams), told.where(by_grams)
    found = _by_ends(short, partners(a.where(F.length("n") < len(levels[0]))), levels, at_least)
    named = [side.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n")) for side, x in ((a, "a"), (b, "b"))]
    met = found.join(named[0].hint("merge"), "a").join(named[1].hint("merge"), "b").select(F.col("a_n").alias("a"), F.col("b_n").alias("b"))
    # Names of one id are equal, but for chance.
    one = a.select(F.col("n").alias("a"), "id").join(b.select(F.col("n").alias("b"), "id").hint("merge"), "id").select("a", "b")
    near = met.union(one.where("a <> b")).where(_few_edits(at_least)).union(_by_grams(rest, partners(rest), at_least).where("a <> b"))
    alike = near.select("a", "b", ratio("a", "b").alias("ratio")).where(F.col("ratio") >= at_least)
    return alike.unionByName(one.where("a = b").withColumn("ratio", F.lit(1.0)))


def _forms(model_names: DataFrame, source_names: DataFrame) -> list[DataFrame]:
    """The different names of either frame (m and s) with their normal forms, worked out once, as what matches them reads them often."""
    names = [df.select(F.lit(x).alias("side"), "name") for df, x in ((model_names, "m"), (source_names, "s"))]
    out = names[0].union(names[1]).where("name <> ''").distinct().withColumns({"bare": normal_column(F.col("name")), "words": column_words(F.col("name"))})
    out = out.withColumns({"sorted": F.array_sort("words"), "concepts": F.array_distinct(column_concepts(F.col("words")))})
    held = Scratch(model_names.sparkSession, "names").table(out, "forms")
    return [held.where(F.col("side") == x).select(F.col("name").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in out.columns[2:]]) for x in ("m", "s")]


def name_matches(model_names: DataFrame, source_names: DataFrame) -> DataFrame:
    """(column, source_column, confidence, method) of all names that count as the same; both frames: name.

    The surest tier of ``TIERS`` that holds decides; what no tier settles is ``fuzzy``
    where :func:`similar_names` finds it.  Each tier is an equi-join, so names that are
    unlike never meet.  Null and empty names match nothing.  The names and their forms
    are written to the scratch folder, which the result reads.
    """
    m, s = _forms(model_names, source_names)

    def tier(name: str, left: DataFrame, right: DataFrame, key: Callable[[str], Column]) -> DataFrame:
        both = [df.select(x, key(x).alias("key")) for df, x in ((left, "m"), (right, "s"))]
        return both[0].join(both[1].hint("merge"), "key").select("m", "s", F.lit(dict(TIERS)[name]).alias("confidence"), F.lit(name).alias("method"))

    worded = [df.where(F.size(f"{x}_words") > 0) for df, x in ((m, "m"), (s, "s"))]
    bare = [df.where(f"{x}_bare <> ''") for df, x in ((m, "m"), (s, "s"))]
    found = [
        tier("exact", m, s, F.col), tier("case", m, s, F.lower), tier("normalised", *bare, lambda x: F.col(f"{x}_bare")),
        tier("tokens", *worded, lambda x: F.to_json(f"{x}_words")), tier("tokens-reordered", *worded, lambda x: F.to_json(f"{x}_sorted")),
    ]
    # A synonym holds every concept of the other: they meet under the one that the fewest names hold.
    held = worded[1].select("s", F.size("s_words").alias("size"), "s_concepts", F.explode("s_concepts").alias("concept"))
    counts = held.groupBy("concept").agg(F.count("*").alias("held"))
    asked = worded[0].select("m", F.size("m_words").alias("size"), "m_concepts", F.explode("m_concepts").alias("concept")).join(counts.hint("merge"), "concept")
    rarest = asked.groupBy("m", "size", "m_concepts").agg(F.min_by("concept", F.struct("held", "concept")).alias("concept"))
    synonyms = rarest.join(held.hint("merge"), ["size", "concept"]).where(F.size(F.array_except("m_concepts", "s_concepts")) == 0)
    found.append(synonyms.select("m", "s", F.lit(dict(TIERS)["synonym"]).alias("confidence"), F.lit("synonym").alias("method")))
    alike = similar_names(bare[0].select(F.col("m_bare").alias("name")), bare[1].select(F.col("s_bare").alias("name")))
    fuzzy = bare[0].select("m", F.col("m_bare").alias("a")).join(alike.hint("merge"), "a").join(bare[1].select("s", F.col("s_bare").alias("b")).hint("merge"), "b")
    # Two names of one bare form are settled above; the tier that is surest stays.
    found.append(fuzzy.select("m", "s", F.round(F.least("ratio", F.lit(FUZZY_TOP)), 3).alias("confidence"), F.lit("fuzzy").alias("method")))
    every = found[0]
    for frame in found[1:]:
        every = every.unionByName(frame)
    best = every.groupBy("m", "s").agg(F.max(F.struct("confidence", "method")).alias("best"))
    return best.select(F.col("m").alias("column"), F.col("s").alias("source_column"), "best.confidence", "best.method")

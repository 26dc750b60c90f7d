"""URL filter: host rules, and trust and distrust propagated over the host graph.

A link from one host to another is an edge.  Trust is a personalised PageRank from the
hosts of pages that an allow rule fits; distrust is one over the reversed edges from
the hosts of pages that a block rule fits, so a host that links to blocked ones gets
its share.  A page without a rule takes its host's verdict: block where distrust is
more than ``THRESHOLD`` of trust and distrust together, allow elsewhere.

Rules are a table, of any size: a host's suffixes are joined with the rules' hosts, then
the beginnings of its paths, of the lengths that these rules have, with their paths.

Links are summed up to weighted host pairs before anything else; a round is one join
and one sum over two-column tables, written to the shared scratch folder.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import ascii_lower

#: (action, host and path prefix) pairs, or a DataFrame (action, rule); a rule fits the host and its subdomains.
Rules = Sequence[tuple[str, str]] | DataFrame
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^"'\s<>/?#]+)"""


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """(rule, action, name, path), one row for each rule; of one rule with several actions block stays."""
    if isinstance(rules, DataFrame):
        given = rules.select("action", "rule")
    else:  # one literal, so that no Python worker is asked for it; long lists come as a DataFrame
        listed = F.from_json(F.lit(json.dumps([{"action": a, "rule": r} for a, r in rules])), "array<struct<action:string,rule:string>>")
        given = spark.range(1).select(F.inline(listed))
    once = given.where("rule is not null").groupBy("rule").agg(F.max("action").alias("action"))
    name = F.substring_index("rule", "/", 1)
    return once.select("rule", "action", name.alias("name"), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"))


def matching_rules(places: DataFrame, rules: Rules, scratch: Scratch) -> DataFrame:
    """(host, path, rule, action): the longest rule that fits each of ``places`` (host, path), of equal ones that of the longer host; places without one are absent."""
    table = scratch.table(_rule_table(places.sparkSession, rules), "rules")
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = table.groupBy("name").agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    hosts = places.select("host").distinct().select("host", F.explode(suffixes).alias("name")).join(names, "name")
    lengths = F.filter("lengths", lambda n: n <= F.length("path"))
    begun = places.select("host", "path").distinct().join(hosts, "host").select("host", "path", "name", F.explode(lengths).alias("n"))
    fits = begun.withColumn("begin", F.expr("substr(path, 1, n)")).join(table.withColumnRenamed("path", "begin"), ["name", "begin"])
    best = F.max(F.struct(F.length("rule").alias("n"), F.length("name").alias("m"), "rule", "action")).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.action")


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust) over ``edges`` (src, dst, weight).

    Rounds go on until none changes a score by more than ``TOLERANCE`` of it, so every
    host that a path of links joins to a seed is reached.  As a round keeps ``DAMPING`` of
    what moved, they settle by themselves, after some 90 rounds beyond the longest path.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    steps = scratch.table(
        edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("weight") / F.col("total")).alias("share"))
        .union(edges.join(into, "dst").select(F.lit("distrust"), "dst", "src", F.col("weight") / F.col("total"))),
        "steps",
    )
    pairs = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("seed"))))
    start = seeds.select("host", pairs.alias("p")).select("host", "p.kind", "p.seed")
    hosts = start.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    kinds = F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind")
    state = hosts.select("host", kinds).join(start, ["host", "kind"], "left").select("host", "kind", F.coalesce("seed", F.lit(0.0)).alias("seed"))
    held = state = scratch.table(state.withColumn("score", F.col("seed")), "state")
    moves = True
    while moves:
        sent = state.join(steps, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = (1 - DAMPING) * F.col("seed") + DAMPING * F.coalesce("got", F.lit(0.0))
        following = scratch.table(
            state.join(sent, ["kind", "host"], "left").select("host", "kind", "seed", score.alias("score"), F.abs(score - F.col("score")).alias("change")), "state"
        )
        moves = following.where(F.col("change") > TOLERANCE * F.col("score")).limit(1).count() > 0
        scratch.drop(held)
        held, state = following, following.drop("change")
    by_kind = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    return state.groupBy("host").agg(*by_kind)


def judge_urls(
    pages: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, trust, distrust.

    A null URL, or one without ``://``, has an empty host and path, no rule and,
    having no host to judge, the verdict allow.  A null html has no links; links
    within a host count for nothing.  A seed's weight is the share of its host's
    pages that an allow (or block) rule fits.  Hosts that no seed reaches have no
    trust or distrust and are allowed.  Repeated rows are judged alike; only the
    columns named are read, and an empty table gives an empty one.  A very long html
    or URL is searched in place; its links are one array.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    bare = scratch.table(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "bare")
    ruled = scratch.table(matching_rules(bare.where("host <> ''"), rules, scratch), "ruled")
    placed = scratch.table(bare.join(ruled, ["host", "path"], "left"), "placed")
    scratch.drop(bare)
    scratch.drop(ruled)
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1)), ascii_lower))
    edges = scratch.table(
        pages.select(host.alias("src"), F.explode(targets).alias("dst"))
        .where("src <> '' and src <> dst")
        .groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")),
        "edges",
    )
    seeds = (
        placed.where("host <> ''").groupBy("host")
        .agg(F.avg((F.coalesce("action", F.lit("")) == "allow").cast("double")).alias("trust"), F.avg((F.coalesce("action", F.lit("")) == "block").cast("double")).alias("distrust"))
    )
    scores = scratch.table(propagate(scratch.table(seeds, "seeds"), edges, scratch), "scores")
    scratch.keep_only(placed, scores)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    judged = F.when(distrust > threshold * (trust + distrust), "block").otherwise("allow")
    return placed.join(scores, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", judged).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )

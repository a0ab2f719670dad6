"""URL filters: allow and block rules, and a tree of path templates for what no rule decides.

Only DataFrame operations. A null URL or one without ``://`` has an empty host
and path, which form one template. Repeated rows are judged alike; other
columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
#: Levels of the tree; deeper segments share the last level.
DEPTH = 6
#: From so many children on, those with less than this share of their parent's URLs become one wildcard.
FAN_OUT, RARE = 20, 0.02
#: Branches merge when their distribution lies within so many standard deviations of the pooled one.
DEVIATIONS = 2.0
#: A template is rejected from this smoothed share of blocked among labelled URLs (one of each is added beforehand),
#: if so many are labelled.
LEAST_PURITY, LEAST_LABELLED = 0.8, 10
#: Templates that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return df.withColumns({
        "host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))})


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits the host, or a domain above it, and the start of the path."""
    def fits(rule: str) -> Column:
        name, slash, start = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)

    return F.coalesce(*[F.when(fits(r), r) for r, _ in sorted(rules, key=lambda x: -len(x[0]))], F.lit(None).cast("string"))


def skeleton(path: Column) -> Column:
    """The path with runs of digits and long hexadecimal runs replaced by ``#``."""
    return F.regexp_replace(path, r"[0-9a-fA-F]{16,}|\d+", "#")


def path_templates(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Template of each (host, skeleton) of ``urls`` (host, skeleton, n, labelled, blocked).

    Level by level, per host and template so far: rare children of a parent
    with many become ``*``; then sibling branches whose URLs go on alike (kind
    of the next segment) and whose labelled URLs agree become one branch ``~kind``;
    branches without labels join where two labelled ones do, else each other.
    Each branch is compared with the pool of its siblings, never with each
    other, in pre-aggregated sums. A level deals the URLs once and the sums of
    their children twice, whatever the number of comparisons.
    """
    names = ["host", "template"]
    depth = min(depth, urls.agg(F.max(F.size(F.split("skeleton", "/")))).first()[0] or 0)
    now = urls.withColumns({"parts": F.split("skeleton", "/"), "template": F.lit("")})
    for level in range(depth):
        part = F.get("parts", F.lit(level)) if level < depth - 1 else F.when(
            F.size("parts") > level, F.array_join(F.slice("parts", level + 1, 1 << 30), "/"))
        now = now.withColumn("child", F.coalesce(part, F.lit("\u0000")))
        following = F.get("parts", F.lit(level + 1))
        kind = (F.when(following.isNull(), "end").when(following == "", "empty").when(following == "#", "number")
                .when(following.contains("#"), "mixed").otherwise("word"))
        # Dealt once by parent and child; the sums of a parent's children then lie together, and all below are windows over them.
        now = now.withColumn("kind", kind).repartition(*names, "child")
        cells = now.groupBy(*names, "child", "kind").agg(
            F.sum("n").alias("k"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).repartition(*names)

        def over(*keys: str) -> Window:
            return Window.partitionBy(*names, *keys)

        def leads(keys: Sequence[str], *order: str) -> Column:
            return F.row_number().over(over(*keys).orderBy(*order)) == 1

        cells = cells.withColumns({"c": F.sum("k").over(over("child")), "of_child": leads(["child"], "kind")}).withColumns({
            "fan": F.count_if("of_child").over(over()), "total": F.sum("k").over(over())})
        rare = (F.col("fan") >= FAN_OUT) & (F.col("c") < RARE * F.col("total")) & (F.col("child") != "\u0000")
        cells = cells.withColumn("branch", F.when(rare, "*").otherwise(F.col("child"))).withColumns({
            "own": F.sum("k").over(over("branch", "kind")), "of_kind": leads(["branch", "kind"], "child"), "of_branch": leads(["branch"], "kind", "child"),
            "size": F.sum("k").over(over("branch")), "bl": F.sum("l").over(over("branch")), "bb": F.sum("b").over(over("branch"))})
        # Siblings are pooled with those whose URLs mostly go on with the same kind.
        cells = cells.withColumn("lead", F.max(F.struct("own", "kind")).over(over("branch"))["kind"]).withColumns({
            "pool": F.sum("k").over(over("lead", "kind")), "whole": F.sum("k").over(over("lead")),
            "cells": F.size(F.collect_set("kind").over(over("lead"))),
            "share": F.sum("b").over(over("lead")) / F.nullif(F.sum("l").over(over("lead")), F.lit(0))})
        # Pearson's statistic as a sum over what a branch has: sum of k^2 / expected, less its size.
        expected = F.col("size") * F.col("pool") / F.col("whole")
        cells = cells.withColumn(
            "off", F.sum(F.when(F.col("of_kind"), F.col("own") * F.col("own") / expected)).over(over("branch")) - F.col("size"))
        # The same for blocked and allowed among labelled URLs; a branch without any, or a pool of one verdict, does not differ.
        spread = F.col("bl") * F.col("share") * (1 - F.col("share"))
        gap = F.col("bb") - F.col("bl") * F.col("share")
        differs = F.coalesce(gap * gap / F.nullif(spread, F.lit(0.0)), F.lit(0.0))

        def bound(freedom: Column) -> Column:
            return freedom + DEVIATIONS * F.sqrt(2.0 * F.greatest(freedom, F.lit(1)))

        alike = (F.col("branch") != "\u0000") & (F.col("off") <= bound(F.col("cells") - 1)) & (differs <= bound(F.lit(1)))
        told, once = F.col("bl") > 0, F.col("alike") & F.col("of_branch")
        # Two labelled branches that agree show that the segment varies; then, and only then, branches without labels join them.
        cells = cells.withColumn("alike", alike).withColumns({
            "told_n": F.count_if(once & told).over(over("lead")), "silent_n": F.count_if(once & ~told).over(over("lead"))})
        merged = F.col("alike") & ((F.col("told_n") > 1) | (~told & (F.col("silent_n") > 1)))
        step = F.when(F.col("branch") == "\u0000", "").otherwise(
            F.concat(F.lit("/"), F.when(merged, F.concat(F.lit("~"), "lead")).otherwise(F.col("branch"))))
        steps = cells.filter("of_child").select(*names, "child", step.alias("step"))
        now = durable(
            now.join(steps, [*names, "child"]).withColumn("template", F.concat("template", "step")).drop("child", "kind", "step"))
    return now.select("host", "skeleton", F.substring("template", 2, 1 << 30).alias("template"), "n", "labelled", "blocked")


def judge_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES,
               least_purity: float = LEAST_PURITY, depth: int = DEPTH) -> DataFrame:
    """Per row: ``key``, host, path, rule, verdict, template and the template's smoothed purity.

    The rules' verdicts are the labels from which templates are judged.
    """
    given = dict(rules)
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    said = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in given.items()], F.lit(None).cast("string"))
    rows = (
        with_host_and_path(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url")))
        .withColumn("rule", rule).withColumns({"said": said, "skeleton": skeleton(F.col("path"))}).drop("url")
    )
    counted = durable(rows.groupBy("host", "skeleton").agg(
        F.count(F.lit(1)).alias("n"), F.count("said").alias("labelled"),
        F.count_if(F.col("said") == "block").alias("blocked")))
    templates = path_templates(counted, depth)
    purity = templates.groupBy("host", "template").agg(
        ((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("purity"), F.sum("labelled").alias("labels"))
    known = durable(templates.drop("labelled", "blocked", "n").join(purity, ["host", "template"]))
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    learned = F.when((F.col("purity") >= least_purity) & (F.col("labels") >= LEAST_LABELLED), "block").otherwise("allow")
    return rows.join(side, ["host", "skeleton"], "left").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("said", learned).alias("verdict"), "template", "purity")

"""URL verdicts by stated rules, and by a tree of path templates where no rule fits.

Rules decide first and label what they decide. For each host the path segments form a
tree, as deep as the paths are. Segments that look like numbers, hex strings or mixed codes
become their shape, and a node with many rare children turns them into one wildcard. Sibling
branches whose next segments and labels are distributed alike (their chi-square
statistic against the siblings together is no more than its mean) are merged. What all paths
below a node share is passed in one step, so a round of the tree is a branching, not a segment.

A template's purity is the share of block among its labelled addresses, smoothed towards
its parent template on the host, that towards the same shapes on the hosts of the
domain, that towards the same shapes everywhere, and that towards the share over all.
How much each step counts is fitted: with the weight that foretells left-out labels best,
those of an address, a template, a host or a domain. So a template without labels takes
the purity of what is nearest to it and has shown to be worth something. A template is
rejected from ``PURITY`` on; one that has labels nowhere, on no host, has no purity and is not:
what is said of its siblings does not speak of it.

Addresses are counted once per distinct host and path before anything is joined, and all
tables of the tree are counts.

Defined results: an address that is null or has no ``://`` has host and path empty, no
rule, and the verdict allow; without labels nothing is rejected; repeated rows get equal
results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import salted_lookup

# The stated rules, (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
# A node's children are a wildcard from so many distinct ones, if they are this rare.
MANY, RARE = 8, 0.3
PURITY = 0.9
# Weights (in labelled addresses) of what a share is smoothed towards, to choose from.
WEIGHTS = [0.5, 2.0, 8.0, 32.0, 128.0, 512.0, 1e6]
FREQUENT = 2000
REST = 1 << 30  # segments: all that are left


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    value = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(value, found, 1), upper, lower), F.regexp_extract(value, found, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):  # the last set wins: the longest
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(slash + own_path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    """A segment, or what kind of code it is; a file's ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    name = F.substring(segment, F.lit(1), F.length(segment) - F.length(ending))
    return (
        F.when(name.rlike("^[0-9]+$"), F.concat(F.lit("{n}"), ending))
        .when(name.rlike("^[0-9a-fA-F-]{8,}$"), F.concat(F.lit("{x}"), ending))
        .when(name.rlike("[0-9]"), F.concat(F.lit("{c}"), ending))
        .otherwise(segment)
    )


def _labels(prefix: str = "") -> list[Column]:
    return [F.sum(c).alias(prefix + c) for c in ("n", "blocked", "allowed")]


def _looked_up(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``found``, one row per key with its number of rows
    ``n``. Fewer than FREQUENT keys can hold more than a part in so many of all rows;
    they are sent to all executors, so no task gets the rows of one of them."""
    share = (found.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    frequent = F.broadcast(found.where(F.col("n") > share).drop("n"))
    rare = found.where(F.col("n") <= share).drop("n")
    others = rows.join(frequent.select(*keys), keys, "left_anti").join(rare, keys, "left")
    return rows.join(frequent, keys).unionByName(others)


def _shared(low: Column, high: Column) -> Column:
    """How many first segments all paths have in common whose smallest and largest are these."""
    differs = F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(low)).cast("int")


def path_templates(addresses: DataFrame) -> DataFrame:
    """``host, path, template`` for distinct ``host, path, n, blocked, allowed``."""
    parts = F.transform(F.slice(F.split("path", "/"), 2, REST), shape)
    here = cut(addresses.withColumns({"rest": parts, "prefix": F.lit("")}))
    columns = ["host", "path", "prefix", "n", "blocked", "allowed"]
    done = None
    while True:
        # what all paths below a node share has no branches
        ends = here.groupBy("host", "prefix").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.count(F.lit(1)).alias("n"))
        skipped = _looked_up(here, cut(ends.select("host", "prefix", _shared(F.col("low"), F.col("high")).alias("shared"), "n")), ["host", "prefix"])
        first = F.slice("rest", F.lit(1), F.col("shared"))
        passed = F.when(F.col("shared") > 0, F.concat("prefix", F.lit("/"), F.array_join(first, "/"))).otherwise(F.col("prefix"))
        here = skipped.withColumns({"prefix": passed, "rest": F.slice("rest", F.col("shared") + 1, F.lit(REST))})
        here = cut(here.drop("shared"))
        ended = here.where(F.size("rest") == 0).select(columns)
        done = ended if done is None else done.unionByName(ended)
        here = here.where(F.size("rest") > 0)
        if here.isEmpty():
            return done.withColumnRenamed("prefix", "template")
        # what a branch goes on with, by kind only
        onward = F.coalesce(F.get("rest", F.lit(1)), F.lit(""))
        kind = F.when(onward.rlike(r"^\{|^$"), onward).otherwise(F.lit("word"))
        here = cut(here.withColumns({"part": F.get("rest", F.lit(0)), "kind": kind}))
        leaves = here.groupBy("host", "prefix", "part", "kind").agg(*_labels())
        branches = cut(leaves)
        children = branches.groupBy("host", "prefix", "part").agg(*_labels())
        nodes = children.groupBy("host", "prefix").agg(
            F.count(F.lit(1)).alias("children"), F.sum("n").alias("node_n"), F.sum("blocked").alias("node_blocked"), F.sum("allowed").alias("node_allowed")
        )
        wild = (F.col("children") >= MANY) & (F.col("children") >= RARE * F.col("node_n"))
        nodes = nodes.withColumn("wild", wild)
        pooled = branches.groupBy("host", "prefix", "kind").agg(F.sum("n").alias("kind_n"))
        # chi-square of a branch against its siblings together: kinds, then labels
        seen = branches.join(pooled, ["host", "prefix", "kind"]).groupBy("host", "prefix", "part").agg(
            F.sum(F.col("n") * F.col("n") / F.col("kind_n")).alias("squares"), F.sum("n").alias("n"),
            F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"),
        )
        kinds = pooled.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("kinds"))
        judged = seen.join(nodes, ["host", "prefix"]).join(kinds, ["host", "prefix"])
        share = F.col("n") / F.col("node_n")
        by_kind = F.col("node_n") * F.col("squares") / F.col("n") - F.col("n")

        def by_label(own: Column, all_: Column) -> Column:
            expected = all_ * share
            return F.when(expected > 0, (own - expected) * (own - expected) / expected).otherwise(0.0)

        none, node_none = (F.col("n") - F.col("blocked") - F.col("allowed"), F.col("node_n") - F.col("node_blocked") - F.col("node_allowed"))
        statistic = by_kind + by_label(F.col("blocked"), F.col("node_blocked")) + by_label(F.col("allowed"), F.col("node_allowed")) + by_label(none, node_none)
        freedom = F.col("kinds") + 1
        alike = statistic <= freedom
        step = (
            F.when(F.startswith("part", F.lit("{")), F.col("part"))
            .when(F.col("wild"), F.lit("*"))
            .when(alike & (F.col("children") > 1), F.lit("~"))
            .otherwise(F.col("part"))
        )
        steps = cut(judged.select("host", "prefix", "part", step.alias("step"), "n"))
        moved = _looked_up(here, steps, ["host", "prefix", "part"])
        longer = F.concat("prefix", F.lit("/"), "step")
        here = moved.withColumns({"prefix": longer, "rest": F.slice("rest", F.lit(2), F.lit(REST))}).drop("step", "part", "kind")


def _share(blocked, labelled, weight, towards):
    return (blocked + weight * towards) / (labelled + weight)


def purities(templates: DataFrame) -> DataFrame:
    """``host, template, shapes, purity, n, nearest``: smoothed purity of each template of
    ``path_templates`` and the plain shapes that fall under it; ``nearest`` names where it has labels: on its host, on the domain's,
    everywhere, or (without a purity) nowhere."""
    shapes = F.transform(F.slice(F.split("path", "/"), 2, REST), shape)
    shaped = templates.withColumn("shapes", F.array_join(shapes, "/"))
    own = shaped.groupBy("host", "template", "shapes").agg(
        F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l")
    )
    placed = cut(
        own.withColumns(
            {
                "parent": F.regexp_replace("template", r"/[^/]*\z", ""),
                "domain": F.regexp_extract("host", r"([^.]*\.)?[^.]*\z", 0),
            }
        )
    )
    prior_b, prior_l = placed.agg(F.sum("b"), F.sum("l")).first()
    prior = (prior_b or 0) / prior_l if prior_l else 0.0
    # the tree of a host merges and generalises; other hosts are asked for the plain shapes
    steps = {"0": ["host", "template"], "1": ["host", "parent"], "2": ["domain", "shapes"], "3": ["shapes"], "_host": ["host", "shapes"]}
    counted = placed
    for step, keys in steps.items():
        sums = placed.groupBy(*keys).agg(F.sum("b").alias(f"b{step}"), F.sum("l").alias(f"l{step}"))
        counted = salted_lookup(counted, sums, keys, F.xxhash64("host", "template", "shapes"), 8)
    counted = cut(counted)
    weight: dict[int, float] = {}

    def smoothed(least: int, less: dict[int, str] | None = None, b: int = 0, l: int = 0) -> Column:
        """Share at a step: from it on with the labels of ``less`` left out, or with ``b`` and ``l`` less."""
        share = F.lit(prior)
        for step in range(3, least - 1, -1):
            out = less[step] if less else None
            gone = (F.col(f"b{out}"), F.col(f"l{out}")) if out else (F.lit(b), F.lit(l))
            blocked, labelled = (F.greatest(F.col(f"{c}{step}") - g, F.lit(0)) for c, g in zip("bl", gone))
            share = _share(blocked, labelled, F.lit(weight[step]), share)
        return share

    def loss(share: Column, blocked: Column, allowed: Column) -> Column:
        bounded = F.greatest(F.least(share, F.lit(1 - 1e-6)), F.lit(1e-6))
        return -(blocked * F.log(bounded) + allowed * F.log(1 - bounded))

    labelled = counted.where("l > 0")
    allowed = F.col("l") - F.col("b")
    # a share is fitted by what it says of a domain, a host, a template or an address that is left out
    left_out = {3: {3: "2"}, 2: {3: "_host", 2: "_host"}, 1: {3: "_host", 2: "_host", 1: "0"}}
    for step in (3, 2, 1, 0):
        losses = []
        for candidate in WEIGHTS:
            weight[step] = candidate
            if step:
                losses.append(F.sum(loss(smoothed(step, left_out[step]), F.col("b"), allowed)))
            else:
                losses.append(F.sum(loss(smoothed(0, b=1, l=1), F.col("b"), F.lit(0)) + loss(smoothed(0, l=1), F.lit(0), allowed)))
        found = labelled.agg(*losses).first()
        weight[step] = min(zip([v if v is not None else 0.0 for v in found], WEIGHTS), key=lambda f: f[0])[1]
    held = {0: "host", 2: "domain", 3: "everywhere"}
    nearest = F.coalesce(*[F.when(F.col(f"l{step}") > 0, F.lit(name)) for step, name in held.items()], F.lit("nowhere"))
    purity = F.when(F.col("l0") + F.col("l3") > 0, smoothed(0))
    return counted.select("host", "template", "shapes", "n", purity.alias("purity"), nearest.alias("nearest"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity, nearest`` for each row of
    ``pages`` (``page_id, url``); the last three are null where a rule decides."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = cut(parsed.withColumns({"rule": rule, "ruled": verdict}))
    addresses = ruled.where("host <> ''").groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count_if(F.col("ruled") == "allow").alias("allowed")
    )
    templates = cut(path_templates(addresses))
    purity = cut(purities(templates))
    # a rule decides all rows of an address or none
    shapes = F.array_join(F.transform(F.slice(F.split("path", "/"), 2, REST), shape), "/").alias("shapes")
    open_ = templates.where("blocked + allowed = 0").select("host", "path", "template", shapes)
    judged = _looked_up(open_, purity, ["host", "template", "shapes"]).drop("shapes")
    nothing = {"template": "string", "purity": "double", "nearest": "string"}
    by_rule = ruled.where("rule is not null").select(
        "page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]
    )
    by_tree = ruled.where("rule is null").join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.when(F.col("purity") >= PURITY, "block").otherwise("allow").alias("verdict"), *nothing
    )
    return by_rule.unionByName(by_tree)

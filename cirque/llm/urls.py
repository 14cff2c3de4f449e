"""URL filter: host and path rules, then a path-template tree judged by labelled purity (native).

Paths are cut into segments. Segments that look variable (numbers, ids) become
wildcards at once; then, level by level, a host's template position that has too
many different values becomes a wildcard, and branches whose labels can't be told
from the rest of their parent (two-proportion z below a bound) are merged into it.
The same tree is grown for each domain and for all hosts together, where a segment
stays apart if it is on several hosts. A template's share of bad labels is smoothed
from its parents over the tree of all hosts, then towards that by the domain's and
the host's own labels, so a branch without labels has those of its like elsewhere.
All of it is aggregation over distinct (host, template) rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import joinable, materialise, table


@dataclass(frozen=True)
class TreeParams:
    """depth: levels that are kept apart (deeper segments fold into one tail `**`).
    fan_out: different values at a position from which it is a wildcard of its host.
    hosts: hosts with a segment for it to stay apart in the tree of a domain or of all, and
    hosts with labels for such a tree to be heard.
    z: branches that differ less from their parent are merged into it.
    prior, strength: the root's share of bad labels and the weight of a parent in rows.
    purity, support: reject from this smoothed share, and this many labelled rows of the host
    (or labels on so many `hosts`)."""

    depth: int = 4
    fan_out: int = 32
    hosts: int = 3
    z: float = 1.96
    prior: float = 0.05
    strength: float = 2.0
    purity: float = 0.8
    support: int = 3


#: (host suffix, path prefix, verdict), as the contract gives them. Fixed values.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end; A-Z lower-cased; empty for null or no ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, says in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule, verdict = F.when(fits, suffix + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def generalised(segment: Column) -> Column:
    """Numbers, hexadecimal ids and long mixed tokens as wildcards; a file ending stays."""
    s = F.regexp_replace(segment, r"^\d+(\.\w+)?\z", "<n>$1")
    s = F.regexp_replace(s, r"^[0-9a-fA-F-]{16,}\z", "<id>")
    return F.when(s.rlike(r"\d") & s.rlike(r"^[\w%~-]{24,}\z"), "<token>").otherwise(s)


def template_of(path: Column, depth: int) -> Column:
    """Array of generalised segments, at most `depth` and a tail mark."""
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), generalised)
    return F.when(F.size(segments) > depth, F.concat(F.slice(segments, 1, depth), F.array(F.lit("**")))).otherwise(segments)


def template_tree(labelled: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """(host, template, label: 1 bad, 0 good, null none) rows -> (host, template, leaf, purity, support, judged).

    leaf is the host's template after wildcards and merges, support its labelled rows; purity the smoothed bad
    share; judged, whether there are labels enough to speak. Repeated rows count each; an empty table gives none.
    """
    rows = materialise(
        labelled.groupBy("host", "template").agg(F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("bad")), "url-rows"
    )
    # a scope is a host (h), its domain (d) or all hosts (a)
    kinds = F.array(F.concat(F.lit("h"), F.col("host")), F.concat(F.lit("d"), domain_of(F.col("host"))), F.lit("a"))
    tree = rows.where("host <> ''").select("host", "template", "known", "bad", F.explode(kinds).alias("scope"))
    labelled_hosts = F.count_distinct(F.when(F.col("known") > 0, F.col("host")))
    roots = joinable(tree.groupBy("scope").agg(F.sum("known").alias("k"), F.sum("bad").alias("b"), labelled_hosts.alias("h")), "url-roots")
    tree = tree.join(roots, "scope").select(
        "*", ((F.col("b") + params.strength * params.prior) / (F.col("k") + params.strength)).alias("score"), F.lit("").alias("node")
    )
    for level in range(params.depth + 1):
        tree = materialise(tree.withColumn("seg", F.get("template", F.lit(level))), "url-tree")
        open_ = tree.where("seg is not null")
        if open_.isEmpty():
            tree = tree.drop("seg")
            break
        values = open_.groupBy("scope", "node", "seg").agg(F.sum("known").alias("k"), F.sum("bad").alias("b"), F.count_distinct("host").alias("on"))
        # positions of a host with many values: few rows whatever the host's size, so its values needn't meet in a task
        wide = values.where("scope like 'h%'").groupBy("scope", "node").agg(F.count("*").alias("fan")).where(F.col("fan") > params.fan_out)
        wide = joinable(wide.select("scope", "node", F.lit(True).alias("wide")), "url-wide")
        apart = F.when(F.col("scope").like("h%"), F.col("wide").isNull()).otherwise(F.col("on") >= params.hosts)
        parts = joinable(values.join(wide, ["scope", "node"], "left").select("scope", "node", "seg", F.when(apart, F.col("seg")).otherwise("*").alias("part")), "url-parts")
        open_ = open_.join(parts, ["scope", "node", "seg"])
        pooled = open_.groupBy("scope", "node", "part").agg(F.sum("known").alias("ck"), F.sum("bad").alias("cb"), labelled_hosts.alias("ch"))
        whole = joinable(pooled.groupBy("scope", "node").agg(F.sum("ck").alias("pk"), F.sum("cb").alias("pb")), "url-whole")
        rest_k, rest_b = F.col("pk") - F.col("ck"), F.col("pb") - F.col("cb")
        share = F.col("pb") / F.greatest(F.col("pk"), F.lit(1))
        error = F.sqrt(share * (1 - share) * (1 / F.greatest(F.col("ck"), F.lit(1)) + 1 / F.greatest(rest_k, F.lit(1))))
        gap = F.abs(F.col("cb") / F.greatest(F.col("ck"), F.lit(1)) - rest_b / F.greatest(rest_k, F.lit(1)))
        alike = (F.col("ck") > 0) & (rest_k > 0) & (gap <= params.z * error)  # a branch without labels says nothing
        branch = joinable(pooled.join(whole, ["scope", "node"]).select("scope", "node", "part", "ck", "cb", "ch", alike.alias("alike")), "url-branch")
        keep = ["host", "template", "known", "bad", "scope"]
        grown = open_.join(branch, ["scope", "node", "part"])
        own = lambda mine, new: F.when(F.col("alike"), F.col(mine)).otherwise(new).alias(mine)
        grown = grown.select(
            *keep, own("k", F.col("ck")), own("b", F.col("cb")), own("h", F.col("ch")),
            own("score", (F.col("cb") + params.strength * F.col("score")) / (F.col("ck") + params.strength)),
            F.concat("node", F.lit("/"), F.when(F.col("alike"), F.lit("*")).otherwise(F.col("part"))).alias("node"),
        )
        done = tree.where("seg is null").select(grown.columns)
        tree = done.unionByName(grown)
    tree = materialise(tree, "url-leaves")
    of = lambda kind: tree.where(F.col("scope").like(f"{kind}%")).select("host", "template", *[F.col(c).alias(f"{kind}_{c}") for c in ("k", "b", "h", "score", "node")])
    both = of("h").join(of("d"), ["host", "template"]).join(of("a"), ["host", "template"])
    heard = lambda kind: F.col(f"{kind}_h") >= params.hosts
    towards = lambda p, kind: (F.col(f"{kind}_b") + params.strength * p) / (F.col(f"{kind}_k") + params.strength)
    p = F.when(heard("a"), F.col("a_score")).otherwise(F.lit(params.prior))
    both = both.withColumn("p", p).withColumn("p", F.when(heard("d"), towards(F.col("p"), "d")).otherwise(F.col("p")))
    judged = (F.col("h_k") >= params.support) | heard("d") | heard("a")
    return both.select("host", "template", F.col("h_node").alias("leaf"), towards(F.col("p"), "h").alias("purity"), F.col("h_k").alias("support"), judged.alias("judged"))


def judge(pages: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """(page_id, host, path, rule, verdict, leaf, purity) for each row of pages.

    Rows that a rule decides are the labels of the tree (block: bad), which judges the
    others; what has too few labels is allowed. Null urls and urls without :// have an
    empty host and path, no rule, no leaf, and are allowed. Repeated rows and rows of null page_id
    are judged each. Rules of equal length can't both fit. Urls of any length are judged whole; segments beyond
    `depth` are one tail. Only page_id and url are read, so other columns are no matter. An empty table gives none.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"))
    base = base.select("*", rule.alias("rule"), says.alias("says"), template_of(F.col("path"), params.depth).alias("template"))
    label = F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0)
    tree = joinable(template_tree(base.select("host", "template", label.alias("label")), params), "url-judged")
    reject = F.col("judged") & (F.col("purity") >= params.purity)
    return base.join(tree, ["host", "template"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("says", F.when(reject, "block").otherwise("allow")).alias("verdict"), "leaf", "purity"
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

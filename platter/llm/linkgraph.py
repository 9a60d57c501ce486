"""URL filters: fixed rules first, then trust and distrust propagated over the links between hosts. DataFrame functions only.

A rule names a host (and its subdomains) and a path prefix; of the rules that fit a url the longest decides. Hosts most of
whose pages the rules allow are trusted seeds, hosts most of whose pages they block are blocked seeds. Personalised PageRank
carries trust along links from trusted seeds, and distrust against the direction of links from blocked seeds: who links to bad
hosts is suspect. A host is blocked when its distrust is more than RATIO times its trust and more than FLOOR of the largest
distrust that a single seed would keep. Urls that no rule fits get their host's verdict.

Every iteration is a join on the source host and a sum by the target host with partial aggregation, so hub hosts do not make
heavy tasks; ranks are written to the shared folder every few iterations, so that lost executors cost little.

Defined results: a null url or one without `://` has empty host and path, fits no rule and is allowed; null html has no links;
repeated rows count as pages of their own and get a row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: (host, path prefix, verdict): fixed values of the query.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DAMPING, ROUNDS, RATIO, FLOOR, SEED_SHARE = 0.85, 12, 1.0, 0.05, 0.5
#: Absolute or protocol-relative link targets; relative links stay on their host and are no edges.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 32
CHECKPOINT_EVERY = 4


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict or null)."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return p.withColumn("f", fitting(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("f.rule").alias("rule"), F.col("f.verdict").alias("ruled"))


def edges(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts: src, dst, and how many pages have them."""
    target = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER))))
    return pages.select(host_of(F.col("url")).alias("src"), target.alias("dst")).where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def seeds(pages: DataFrame) -> DataFrame:
    """host, trust and distrust seed masses, from a table that judged() made; each kind's masses sum to one."""
    of = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("b"))
    return of.select("host", (F.col("a") > SEED_SHARE * F.col("n")).cast("double").alias("t0"), (F.col("b") > SEED_SHARE * F.col("n")).cast("double").alias("d0"))


def propagate(seed: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust after `rounds` steps. links: src, dst, n. Seeds keep 1 - DAMPING each step (unnormalised personal
    masses: a seed alone has trust 1 - DAMPING)."""
    out = links.join(links.groupBy("src").agg(F.sum("n").alias("all")), "src").select(F.col("src").alias("of"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("wt"), F.lit(0.0).alias("wd"))
    back = links.join(links.groupBy("dst").agg(F.sum("n").alias("all")), "dst").select(F.col("dst").alias("of"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), (F.col("n") / F.col("all")).alias("wd"))
    flow = table(out.unionByName(back), "flow")
    base = seed.select("host", ((1 - DAMPING) * F.col("t0")).alias("t"), ((1 - DAMPING) * F.col("d0")).alias("d"))
    ranks = base
    if flow.isEmpty():  # nothing flows: every further step gives the same
        return ranks.withColumnsRenamed({"t": "trust", "d": "distrust"})
    for k in range(rounds):
        moved = ranks.join(flow, ranks["host"] == flow["of"]).select(F.col("to").alias("host"), (DAMPING * F.col("t") * F.col("wt")).alias("t"), (DAMPING * F.col("d") * F.col("wd")).alias("d"))
        ranks = base.unionByName(moved).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        if k % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
            ranks = table(ranks, "ranks")
    return ranks.withColumnsRenamed({"t": "trust", "d": "distrust"})


def blocked(ranks: DataFrame) -> DataFrame:
    return ranks.where((F.col("distrust") > RATIO * F.col("trust")) & (F.col("distrust") > FLOOR * (1 - DAMPING))).select("host")


def verdicts(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Per page: host, path, the rule that decides, and the verdict."""
    own = table(judged(pages, rules), "judged")
    bad = blocked(propagate(seeds(own), edges(pages)))
    # the hot host's pages are spread over SALTS keys; a host's verdict is repeated as often
    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
    marks = bad.select("host", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))).alias("salt"), F.lit(True).alias("bad"))
    met = salted.join(marks, ["host", "salt"], "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))

"""URL filters: rules on host and path, and trust propagated over the link graph of hosts.

Rules come first: a rule fits its host and all subdomains where the url's path
starts with the rule's, and the longest that fits wins. What no rule judges is
judged by its host. Hosts of pages that rules allow seed trust, hosts of
blocked pages seed distrust (by pages). Trust flows along links (a host that
trusted hosts link to), distrust against them (a host that links to blocked
ones); both are personalised PageRank. A host is blocked where its distrust,
as a share of both, is above the threshold.

Only DataFrame functions run here. The graph is aggregated to one weighted
edge per pair of hosts before it is iterated; both directions are one table,
keyed by (direction, host), so that an iteration is one join and one
aggregation of rows that are hosts, not pages. Edges are laid out by that key
once; ranks are checkpointed every few iterations. It ends where no host is
newly reached and no rank has changed between checkpoints by more than
TOLERANCE of itself; ``iterations`` are the steps between those.

Defined results: null url has empty host and path and no rule; a url without
``://`` likewise; a host that nothing reaches has no score and is allowed;
null html has no links; an empty table gives an empty result; repeated rows
are judged row by row and weigh as pages of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import checkpointed, saved

#: Greatest change of a rank over the steps between two checkpoints, as a share of it.
TOLERANCE = 1e-7
#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What follows the < of a link: an absolute or scheme-relative address, or any other; group 1 is the host of the former.
LINK = r"""(?i)^a\s[^>]*?href\s*=\s*["']?\s*(?:(?:[a-z][a-z0-9+.-]{0,30}:)?//([^/?#"'\s>]+)|[^"'\s>#])"""
#: Edges of a host that are dealt together.
HUB = 100_000


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    after = F.when(F.contains(url, F.lit("://")), F.expr("substring(__url, locate('://', __url) + 3)")).otherwise("")
    return F.translate(F.regexp_extract(after, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    after = F.when(F.contains(url, F.lit("://")), F.expr("substring(__url, locate('://', __url) + 3)")).otherwise("")
    return F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from pages of host src to host dst, one row a pair; relative links stay on the host."""
    # Cut at each < first: then a page is searched in time proportional to its length, whatever stands in it.
    tags = F.filter(F.split(F.coalesce("html", F.lit("")), "<"), lambda x: x.rlike(LINK))
    links = pages.select(F.col("host").alias("src"), F.explode(F.transform(tags, lambda x: F.regexp_extract(x, LINK, 1))).alias("dst"))
    dst = F.when(F.col("dst") == "", F.col("src")).otherwise(F.translate("dst", _UPPER, _LOWER))
    return links.filter("src != ''").groupBy("src", dst.alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 10, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from edges (src, dst, n) and seeds (host, trusted, distrusted: pages).

    Ranks are in pages: trust sums to all trusted seeds, distrust to all
    distrusted ones, in every iteration. A host without a link in a direction
    keeps its rank there.
    """
    both = edges.select(F.lit("t").alias("way"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    both = both.unionByName(edges.select(F.lit("d").alias("way"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    ways = F.array(*[F.struct(F.lit(w).alias("way"), F.col(c).cast("double").alias("seed")) for w, c in (("t", "trusted"), ("d", "distrusted"))])
    start = saved(seeds.select("host", F.inline(ways)).filter("seed > 0"))
    both = saved(both)
    out_of = both.groupBy("way", "host").agg(F.sum("n").alias("all"))
    nodes = both.select("way", F.col("to").alias("host")).unionByName(start.select("way", "host")).distinct()
    ends = nodes.join(out_of, ["way", "host"], "left_anti").select("way", "host", F.col("host").alias("to"), F.lit(1.0).alias("part"))
    parts = both.join(out_of, ["way", "host"]).select("way", "host", "to", (F.col("n") / F.col("all")).alias("part")).unionByName(ends)
    # A hub's edges are dealt to as many tasks as they need, and its rank to each of them.
    hubs = saved(both.groupBy("way", "host").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("cells")).filter("cells > 1"))
    cell = F.pmod(F.xxhash64("to"), F.coalesce("cells", F.lit(1))).cast("int").alias("cell")
    parts = parts.join(hubs, ["way", "host"], "left").select("way", "host", "to", "part", cell)
    parts = checkpointed(parts.repartition("way", "host", "cell"))
    ranks = start.withColumnRenamed("seed", "rank")
    back = start.select("way", "host", (F.col("seed") * (1 - damping)).alias("rank"))

    def step(now: DataFrame) -> DataFrame:
        dealt = now.join(hubs, ["way", "host"], "left").select("way", "host", "rank", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)).alias("cell"))
        flow = parts.join(dealt, ["way", "host", "cell"]).select("way", F.col("to").alias("host"), (F.col("rank") * F.col("part") * damping).alias("rank"))
        return flow.unionByName(back).groupBy("way", "host").agg(F.sum("rank").alias("rank"))

    settled = start.isEmpty()
    while not settled:
        before = ranks
        for _ in range(iterations):
            ranks = step(ranks)
        ranks = checkpointed(ranks)
        old = before.select("way", "host", F.col("rank").alias("old"))
        moved = F.col("old").isNull() | (F.abs(F.col("rank") - F.col("old")) > F.col("rank") * tolerance)
        settled = ranks.join(old, ["way", "host"], "left").filter(moved).isEmpty()
    of = lambda way: F.sum(F.when(F.col("way") == way, F.col("rank")))
    return ranks.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, damping: float = 0.85, iterations: int = 10) -> DataFrame:
    """page_id, host, path, rule, verdict, distrust (of the host; null where nothing reached it) for every row."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("__url"), F.col("html").cast("string").alias("html"))
    named = named.withColumns({"host": url_host(F.col("__url")), "path": url_path(F.col("__url"))})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "by_rule": verdict})
    edges = host_edges(named)
    light = named.drop("html", "__url")
    seeds = light.filter("rule is not null").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("trusted"), F.count_if(F.col("by_rule") == "block").alias("distrusted"))
    # What only one of both reaches has a share of 0 or 1, however small its rank is.
    share = F.when(F.col("distrust").isNull(), 0.0).when(F.col("trust").isNull(), 1.0).otherwise(F.try_divide("distrust", F.col("trust") + F.col("distrust")))
    scores = propagate(edges, seeds, damping, iterations).select("host", share.alias("distrust"))
    out = light.join(scores, "host", "left")
    by_host = F.when(F.col("distrust") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "distrust")

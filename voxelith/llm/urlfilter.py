"""URL filters: rules, and link-graph propagation for what no rule decides.

Every host's pages are judged by the rules first.  The share of its pages that
a rule allows is the host's trust seed, the share that a rule blocks its
distrust seed.  Both spread over the graph of links between hosts as
personalised PageRank: trust forward, distrust over the reversed links.  The
walk goes back to the seeds with probability ``stay`` and from hosts without a
way on, so the mass of the seeds is conserved.

PageRank splits a host's mass among its links, so a rank says nothing by
itself.  A host's trust is therefore the share, of the rank that reaches it over
links when all hosts are seeds, that comes from trusted seeds; its distrust is the same of the
reversed graph.  Both lie between 0 and 1 and never below the host's own seed: no link
frees a blocked host, and none taints a trusted one.  A host is blocked where
distrust exceeds trust by ``threshold``.

Edges are aggregated per pair of hosts on the map side before anything is
shuffled; each round is two joins and one sum over host pairs.  Hub hosts' ranks are
broadcast (``join_hot``), so a hub's links are never gathered, and rounds are written to the shared
folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, fresh, join_hot, materialise, replaced

#: Rules up to which they are one expression in the plan; more are joined.
INLINE_RULES = 500


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: Sequence[Rule], url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """Add host, path, and the longest rule that fits (``rule``, ``rule_verdict``; null if none).

    A rule fits its host and all subdomains, for paths that start with the rule's.  Among equally long rules
    the last in alphabetical order wins, among repeated ones the last given.
    """
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    if len(rules) > inline:
        return _joined_rules(out, rules)
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumn("rule", text).withColumn("rule_verdict", verdict)


def _joined_rules(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The same for any number of rules, by equi-joins.

    A page's candidates are its host's suffixes at dots, each with those prefixes of its path whose lengths some
    rule of that suffix has.
    """
    spark = pages.sparkSession
    rows = [(r.host, len(r.path), r.path, r.text, r.verdict, i) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "suffix string, size int, prefix string, rule string, rule_verdict string, nth int")
    table = table.groupBy("suffix", "size", "prefix").agg(F.max_by(F.struct("rule", "rule_verdict", "nth"), "nth").alias("r"))
    sizes = table.groupBy("suffix").agg(F.sort_array(F.collect_set("size")).alias("sizes"))
    # no host holds a slash, so host and path together tell pages apart
    key = fresh(pages, "url_key")
    keyed = pages.withColumn(key, F.concat("host", "path"))
    urls, _ = materialise(keyed.groupBy(key, "host", "path").agg(F.count("*").alias("n")), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    at, _ = materialise(urls.select(key, "path", F.explode(suffixes).alias("suffix")), "suffixes")
    tried = join_hot(at, sizes, "suffix").where("sizes is not null")
    fit = F.filter("sizes", lambda n: n <= F.length("path"))
    tried = tried.select(key, "path", "suffix", F.explode(fit).alias("size"))
    tried = tried.select(key, "suffix", "size", F.col("path").substr(F.lit(1), F.col("size")).alias("prefix"))
    found = tried.join(table, ["suffix", "size", "prefix"])
    best = F.max(F.struct(F.length("r.rule"), "r.rule", "r.nth", "r.rule_verdict")).alias("best")
    found = found.groupBy(key).agg(best).select(key, "best.rule", "best.rule_verdict")
    return join_hot(keyed, found, key, urls.select(key, "n")).drop(key)


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(src, dst, n)``: links between hosts; a page's own host and relative links are loops and left out."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    full = lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)
    to = pages.select(F.col("host").alias("src"), F.explode(F.transform(links, full)).alias("link"))
    to = to.select("src", host_of(F.col("link")).alias("dst")).where("dst <> '' and src <> '' and src <> dst")
    return to.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 10, stay: float = 0.15) -> DataFrame:
    """``seeds(host, trust0, distrust0)`` -> ``(host, trust, distrust)`` after a fixed number of rounds.

    Hosts that are only linked to have no seed of their own and are returned too.  Without links
    every score is the seed.
    """
    spark = edges.sparkSession
    edges, edges_at = materialise(edges, "pairs")
    if not edges.take(1):
        discard(spark, edges_at)
        return seeds.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    out, out_at = materialise(edges.groupBy("src").agg(F.sum("n").alias("out"), F.count("*").alias("n")), "out")
    back, back_at = materialise(edges.groupBy("dst").agg(F.sum("n").alias("in"), F.count("*").alias("n")), "in")
    both = join_hot(edges, out.drop("n"), "src", out)
    both, both_at = materialise(both, "pairs")
    both = join_hot(both, back.drop("n"), "dst", back)
    shares, shares_at = materialise(both.select("src", "dst", (F.col("n") / F.col("out")).alias("forward"), (F.col("n") / F.col("in")).alias("backward")), "shares")
    # trust and all of a rank move forward, distrust and all of the reversed rank backward
    hosts = seeds.select("host", "trust0", "distrust0").unionByName(out.select(F.col("src").alias("host"), F.lit(0.0).alias("trust0"), F.lit(0.0).alias("distrust0")))
    hosts = hosts.unionByName(back.select(F.col("dst").alias("host"), F.lit(0.0).alias("trust0"), F.lit(0.0).alias("distrust0")))
    hosts = hosts.groupBy("host").agg(F.max("trust0").alias("trust0"), F.max("distrust0").alias("distrust0"))
    ends = out.select(F.col("src").alias("host"), F.lit(1).alias("has_out"), F.lit(0).alias("has_in")).union(back.select("dst", F.lit(0), F.lit(1)))
    ends = ends.groupBy("host").agg(F.max("has_out").alias("has_out"), F.max("has_in").alias("has_in"))
    now = hosts.join(ends, "host", "left").fillna(0, ["has_out", "has_in"])
    zero = F.lit(0.0)
    came = ("t1", "u1", "d1", "v1")
    start = {"t": F.col("trust0"), "u": F.lit(1.0), "d": F.col("distrust0"), "v": F.lit(1.0)}
    now, path = materialise(now.withColumns(start | dict.fromkeys(came, zero)), "ranks")
    stuck = lambda x, has: F.sum(F.when(F.col(has) == 0, F.col(x)).otherwise(zero)).alias(x)
    for _ in range(rounds):
        mass = now.agg(stuck("t", "has_out"), stuck("u", "has_out"), stuck("d", "has_in"), stuck("v", "has_in"), F.sum("trust0").alias("ts"), F.sum("distrust0").alias("ds"), F.count("*").alias("hosts")).first()
        fore = join_hot(shares, now.select(F.col("host").alias("src"), "t", "u"), "src", out)
        fore = fore.select(F.col("dst").alias("host"), (F.col("forward") * F.col("t")).alias("t1"), (F.col("forward") * F.col("u")).alias("u1"), zero.alias("d1"), zero.alias("v1"))
        aft = join_hot(shares, now.select(F.col("host").alias("dst"), "d", "v"), "dst", back)
        aft = aft.select(F.col("src").alias("host"), zero.alias("t1"), zero.alias("u1"), (F.col("backward") * F.col("d")).alias("d1"), (F.col("backward") * F.col("v")).alias("v1"))
        moved = fore.union(aft).groupBy("host").agg(*(F.sum(c).alias(c) for c in came))

        def step(seed, total: float, lost: float, over: str):
            """Back to the seeds with probability ``stay`` and from where the walk is stuck; else along the links."""
            again = (1 - stay) * lost / total if total else 0.0
            return (stay + again) * seed + (1 - stay) * F.col(over)

        after = {
            "t": step(F.col("trust0"), mass["ts"], mass["t"], "t1"), "u": step(F.lit(1.0), mass["hosts"], mass["u"], "u1"),
            "d": step(F.col("distrust0"), mass["ds"], mass["d"], "d1"), "v": step(F.lit(1.0), mass["hosts"], mass["v"], "v1"),
        }
        before = path
        now, path = materialise(now.drop(*came).join(moved, "host", "left").fillna(0.0, list(came)).withColumns(after), "ranks")
        discard(spark, before)
    for at in (edges_at, out_at, back_at, both_at, shares_at):
        discard(spark, at)
    share = lambda seed, part, whole: F.greatest(F.col(seed), F.least(F.lit(1.0), F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(zero)))
    return now.select("host", share("trust0", "t1", "u1").alias("trust"), share("distrust0", "d1", "v1").alias("distrust"))


def _with_ranks(pages: DataFrame, ranks: DataFrame, hosts: DataFrame, small: int = 200_000) -> DataFrame:
    """Join each page's host scores.

    Up to ``small`` hosts, of 64 characters on average, are sent to all executors (a dozen MB).  Of a larger
    table only the hosts with over a thousandth of all pages are, and the rest is dealt by host.
    """
    size = ranks.agg(F.count("*"), F.coalesce(F.sum(F.length("host")), F.lit(0))).first()
    if size[0] <= small and size[1] <= 64 * small:
        return pages.join(F.broadcast(ranks), "host", "left")
    return join_hot(pages, ranks, "host", hosts)


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html", rounds: int = 10, stay: float = 0.15, threshold: float = 0.5, inline: int = INLINE_RULES, small: int = 200_000) -> DataFrame:
    """``pages`` with host, path, rule, verdict (``allow`` or ``block``), trust and distrust of the host.

    A rule's verdict holds for its pages; others get their host's.  Pages without
    a host (null or no ``://``) have no host score and are allowed.  Every row
    comes back, repeated rows too; null html has no links.  Input columns named like
    these results are replaced.  An empty table gives no rows.
    """
    pages = replaced(pages, "host", "path", "rule", "rule_verdict", "verdict", "trust", "distrust")
    marked = with_rule(pages, rules, url, inline)
    share = lambda v: (F.count_if(F.col("rule_verdict") == v) / F.count("*")).alias({"allow": "trust0", "block": "distrust0"}[v])
    hosts, _ = materialise(marked.groupBy("host").agg(share("allow"), share("block"), F.count("*").alias("n")), "hosts")
    ranks = propagate(host_edges(marked, html), hosts.where("host <> ''"), rounds, stay)
    scored = _with_ranks(marked, ranks, hosts, small)
    low = F.round(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)), 9) >= threshold
    verdict = F.coalesce("rule_verdict", F.when(low, "block").otherwise("allow"))
    return scored.select(*pages.columns, "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))

"""URL verdicts from rules and from trust and distrust that spread over the graph of hosts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Rounds, materialize, null_safe_join

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
STEPS, DAMPING, THRESHOLD = 12, 0.85, 0.4
#: Steps that one plan takes before its result is written.
WRITTEN = 3


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path. Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or
    the end. A null url, or one without `://`, has both empty."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits host and path, or null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(str(r))):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        found = F.when(fits, F.lit(str(r))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, path, n: how often the html of a host's pages links to a path of another host, whether that has pages or not."""
    links = pages.select("host", F.explode(F.expr(r"regexp_extract_all(coalesce(html, ''), '(?i)\\bhref\\s*=\\s*[\"\']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"\'\\s>]+[^?#\"\'\\s>]*)', 1)")).alias("to"))
    dst = F.translate(F.regexp_extract("to", r"^[^/]*", 0), ASCII_UPPER, ASCII_LOWER)
    links = links.select(F.col("host").alias("src"), dst.alias("dst"), F.regexp_extract("to", r"^[^/]*(.*)$", 1).alias("path")).where("src <> dst")
    return links.groupBy("src", "dst", "path").agg(F.count(F.lit(1)).alias("n"))


def host_edges(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """src, dst, weight between `hosts` (host, once each): `links` of `host_links` (counted), and a subdomain with the nearest host above
    it, both ways, once. Relative links stay on their host: every host has a loop of weight 1."""
    links = links.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("weight"))
    known = hosts.select(F.col("host").alias("dst"))
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("step", "dst")).where("dst <> '' AND dst <> host")
    above = above.join(known, "dst", "left_semi").groupBy("host").agg(F.min(F.struct("step", "dst")).alias("up")).select(F.col("host").alias("src"), F.col("up.dst").alias("dst"))
    both = above.unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    loops = hosts.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight"))
    return links.unionByName(both).unionByName(loops).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, table: Callable[[DataFrame, str], DataFrame] = materialize, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust, each as a share of what reaches the host at all.

    `seeds` has host, pages, trusted, blocked (numbers of pages). Trust is personalised PageRank along the edges from trusted pages; distrust
    the same along reversed edges from blocked pages, so a host that links to blocked ones takes it on. Both are divided by
    the PageRank of all pages over the same edges. Each step is a join and a sum over one row an edge; every third is written to the shared folder, by `table`.
    After STEPS steps 0.85 ** 12, or a seventh, of the weight has not yet settled; it is spread as the steps before have spread it.
    """
    ways = edges.select(F.lit("trust").alias("way"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = ways.groupBy("way", "src").agg(F.sum("weight").alias("_out"))
    ways = table(null_safe_join(ways, total, ["way", "src"]).select("way", "src", "dst", (F.col("weight") / F.col("_out")).alias("share")), "edges")
    n = seeds.agg(F.sum("pages")).first()[0] or 1
    start = seeds.select(F.lit("trust").alias("way"), "host", (F.col("pages") / n).alias("all0"), (F.col("trusted") / n).alias("own0"))
    start = table(start.unionByName(seeds.select(F.lit("distrust").alias("way"), "host", (F.col("pages") / n).alias("all0"), (F.col("blocked") / n).alias("own0"))), "seeds")
    state = start.withColumnsRenamed({"all0": "all", "own0": "own"})
    for step in range(1, steps + 1):
        sent = null_safe_join(ways, state.withColumnRenamed("host", "src"), ["way", "src"])
        got = sent.groupBy("way", F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("all")).alias("all"), F.sum(F.col("share") * F.col("own")).alias("own"))
        moved = null_safe_join(start, got, ["way", "host"], "left")
        state = moved.select("way", "host", *[((1 - damping) * F.col(f"{c}0") + damping * F.coalesce(c, F.lit(0.0))).alias(c) for c in ("all", "own")])
        state = state if step % WRITTEN else table(state, "rank")
    share = F.when(F.col("all") > 0, F.col("own") / F.col("all")).otherwise(F.lit(0.0))
    pick = lambda way: F.max(F.when(F.col("way") == way, share)).alias(way)
    return state.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A page that a rule fits has the longest rule's verdict. Any other is blocked if, for its host, distrust is above
    `threshold` and above trust. Pages under an allow rule seed trust and those under a block rule distrust. A url without a
    host is of the host ``, which is judged as any other; a null html has no links. Hosts that are only linked to are hosts of the graph as
    well; each of their distinct linked urls counts as a page, under the rule that fits it. Hosts that hold any share of the pages are
    reduced to one row a task before they move. An empty table gives no rows.
    """
    with Rounds(pages.sparkSession, "urls") as rounds:
        known = with_host(pages.select("page_id", "url")).withColumn("rule", rule_of(rules)).drop("url")
        verdicts = {str(r): r.verdict for r in rules}
        says = F.lit(None).cast("string")
        for name, verdict in verdicts.items():
            says = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(says)
        known = known.withColumn("says", says)
        counted = lambda v: F.count(F.when(F.col("says") == v, 1))
        seeds_of = lambda df: df.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), counted("allow").alias("trusted"), counted("block").alias("blocked"))
        crawled = rounds.table(seeds_of(known), "hosts")
        links = rounds.table(host_links(with_host(pages.select("url", "html")).select("host", "html")), "links")
        linked = links.select(F.col("dst").alias("host"), "path").distinct().join(crawled.select("host"), "host", "left_anti").withColumn("rule", rule_of(rules)).withColumn("says", says)
        seeds = rounds.table(crawled.unionByName(seeds_of(linked)), "seeds")
        edges = host_edges(seeds.select("host"), links)
        ranks = rounds.table(propagate(edges, seeds, rounds.table), "ranks")
        out = null_safe_join(known, ranks, ["host"], "left")
        worse = (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))
        out = out.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(worse, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
        return rounds.result(out)

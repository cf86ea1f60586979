"""URL verdicts by rules, and by link-graph propagation where no rule fits.

Host edges come from the pages' link attributes (absolute or
protocol-relative), counted per pair of hosts, and from each host to the domain
that it is a direct subdomain of, and back. Two personalised PageRanks run over
them in one table: trust starts at hosts in proportion to their pages that a
rule allows and follows the links; distrust starts at hosts in proportion to
their pages that a rule blocks and follows the links backwards (who links to
blocked hosts is suspect). Ranks only grow from round to round, so that the sum
of all ranks tells how far they still are from their limit: rounds go on until
STRIDE of them add less than SETTLED to it. A host's threshold test is distrust above LIMIT
times trust: such hosts are blocked, all others (unknown ones included) allowed.

Pages meet hosts, never pages: edges are summed before they are shuffled, so a
host with most pages is one row of the graph. A host with more than SPLIT edges
(a parent domain of very many) is dealt into parts of its edges.

Cases: a null url or one without :// has an empty host and path, no rule and no
place in the graph, and is allowed; a null html has no links; repeated rows
count as often as they come; no pages or no seeds give ranks of 0 and allow;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, small, store, table

#: (verdict, rule): host, then path from the first slash.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
#: Rounds between written tables, and the growth of all ranks (2 at most) in them that ends the rounds.
STRIDE, SETTLED = 5, 5e-2
#: Edges of a part of a host, and rows that one task of a round is given at least.
SPLIT, FILE = 100_000, 100_000
LIMIT = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, else null."""
    tests = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.index("/")
        own = (host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))
        tests.append(F.when(own & F.startswith(path, F.lit(rule[at:])), F.lit(rule)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def _verdict_of(rule: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _seeds(hosts: DataFrame) -> DataFrame:
    """hosts(host, allowed, blocked) -> way (1 trust, -1 distrust), host, seed; seeds of a way sum to 1."""
    totals = hosts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    a, b = totals["a"] or 0, totals["b"] or 0
    trust = hosts.filter("allowed > 0").select(F.lit(1).alias("way"), "host", (F.col("allowed") / F.lit(float(max(a, 1)))).alias("seed"))
    return trust.union(hosts.filter("blocked > 0").select(F.lit(-1).alias("way"), "host", (F.col("blocked") / F.lit(float(max(b, 1)))).alias("seed")))


def ranks(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """hosts(host, allowed, blocked), links(src, dst, weight) -> host, trust, distrust for hosts that a seed reaches."""
    # A round over few edges is a few tasks, whatever the number of shuffle partitions.
    files = max(1, (hosts.count() + links.count()) // FILE)
    seeds = store(_seeds(hosts).coalesce(files), "seeds")
    every = hosts.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    family = every.select(F.col("host").alias("src"), parent.alias("dst")).filter("dst <> ''")
    plain = links.filter("src <> dst").select("src", "dst", "weight")
    both = plain.union(family.withColumn("weight", F.lit(1).cast("long"))).union(family.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("weight")))
    both = both.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    ways = both.withColumn("way", F.lit(1)).unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(-1).alias("way")))
    out = store(ways.groupBy("way", "src").agg(F.sum("weight").alias("out"), F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")).coalesce(files), "out")
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part")
    edges = ways.join(small(out), ["way", "src"]).select("way", "src", part, "dst", (F.lit(DAMPING) * F.col("weight") / F.col("out")).alias("share"))
    edges = store(edges.coalesce(files), "edges")
    split = store(out.filter("parts > 1").select("way", F.col("src").alias("host"), "parts").coalesce(1), "split")
    wide = None if split.isEmpty() else small(split)
    # Hosts without edges keep their seed; the others share theirs out.
    base = seeds.select("way", "host", (F.lit(1 - DAMPING) * F.col("seed")).alias("rank"))
    rank, old, mass = base, [], 0.0
    while True:
        for _ in range(STRIDE):
            keys, dealt = ["way", "src"], rank.withColumnRenamed("host", "src")
            if wide is not None:
                part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
                keys, dealt = [*keys, "part"], rank.join(wide, ["way", "host"], "left").select("way", F.col("host").alias("src"), "rank", part)
            flow = dealt.join(edges, keys).select("way", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
            rank = flow.union(base).groupBy("way", "host").agg(F.sum("rank").alias("rank")).coalesce(files)
        rank = store(rank, "ranks")
        drop(*old)
        old = [rank]
        now = rank.agg(F.sum("rank")).first()[0] or 0.0
        if now - mass < SETTLED:
            break
        mass = now
    drop(seeds, edges, out, split)
    sums = [F.sum(F.when(F.col("way") == w, F.col("rank")).otherwise(0.0)).alias(n) for w, n in ((1, "trust"), (-1, "distrust"))]
    return rank.groupBy("host").agg(*sums)


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row."""
    df = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_ruled", _verdict_of(F.col("rule"), rules))
    linked = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(F.regexp_replace(h, r"^[^@]*@", ""), UPPER, LOWER))
    slim = store(df.select("page_id", "host", "path", "rule", "_ruled", F.coalesce(linked, F.array()).alias("links")), "pages")
    count = lambda v: F.sum(F.when(F.col("_ruled") == v, 1).otherwise(0)).alias(v + "ed")
    hosts = store(slim.filter("host <> ''").groupBy("host").agg(count("allow"), count("block")), "hosts")
    links = slim.filter("host <> '' and size(links) > 0").select(F.col("host").alias("src"), F.explode("links").alias("dst")).filter("dst <> ''")
    links = store(links.groupBy("src", "dst").agg(F.count("*").alias("weight")), "links")
    found = store(ranks(hosts.select("host", F.col("allowed"), F.col("blocked")), links), "hosts")
    drop(hosts, links)
    found = small(found.withColumnRenamed("host", "_host"))
    out = slim.join(found, F.col("host") == F.col("_host"), "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    method = F.when(F.col("distrust") > LIMIT * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", method).alias("verdict"), "trust", "distrust")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")

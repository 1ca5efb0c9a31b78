"""URL filters: rules of host and path, and propagation over the link graph where no rule fits.

Links between hosts form edges. Personalised PageRank carries trust from hosts with allowed pages along
the links, and distrust from hosts with blocked pages against them; a host whose distrust is above its
trust is blocked. All of it is DataFrame operations; each iteration is a join and an aggregation that
combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Share of the mass that goes on at each step; it is followed until less than TOLERANCE of it is under way.
DAMPING, TOLERANCE = 0.85, 1e-6
#: A host is blocked if its distrust exceeds this many times its trust; both are rounded to DIGITS places first, so that equal ones stay equal in any order of adding up.
RATIO, DIGITS = 1.0, 9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) for distinct links between different hosts; relative links stay on their host."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), F.lit(1))
    found = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.array_distinct(links)).alias("dst"))
    found = found.select("src", F.translate(F.regexp_replace("dst", "^.*@", ""), _UPPER, _LOWER).alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst) and seeds (host, good, bad), whose columns each sum to 1 or 0.

    The rank is the sum of what the seeds send over paths of 0, 1, 2... links; each step is a table of the mass still under way, which
    shrinks at least by the damping. Hosts that no mass reaches are absent. Mass at hosts without further links ends there.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    into = edges.groupBy("dst").agg(F.count("*").alias("n"))
    forward = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (1 / F.col("n")).alias("wt"), F.lit(0.0).alias("wd"))
    back = edges.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), (1 / F.col("n")).alias("wd"))
    steps = table(forward.union(back), "steps")
    moving = table(seeds.select("host", ((1 - damping) * F.col("good")).alias("trust"), ((1 - damping) * F.col("bad")).alias("distrust")), "rank")
    whole = moving
    while (moving.agg(F.sum(F.col("trust") + F.col("distrust"))).first()[0] or 0.0) > tolerance * (1 - damping):
        moved = steps.join(moving, "host").select(
            F.col("to").alias("host"), (damping * F.col("trust") * F.col("wt")).alias("trust"), (damping * F.col("distrust") * F.col("wd")).alias("distrust")
        )
        moving = table(moved.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).where("trust > 0 or distrust > 0"), "rank")
        whole = whole.union(moving)
    return whole.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html") -> DataFrame:
    """pages' rows and columns with host, path, rule and verdict added (columns of these names are replaced).

    A null url, or one without ``://``, has empty host and path and is allowed, as is any host that no
    distrust reaches or whose trust equals it. Repeated rows each get the same. Null html has no links.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "trust", "distrust")
    seen = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", name).withColumn("said", said)
    good, bad = F.sum(F.when(F.col("said") == "allow", 1.0)), F.sum(F.when(F.col("said") == "block", 1.0))
    by_host = seen.where("said is not null and host <> ''").groupBy("host").agg(F.coalesce(good, F.lit(0.0)).alias("good"), F.coalesce(bad, F.lit(0.0)).alias("bad"))
    by_host = table(by_host, "marks")
    total = by_host.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    seeds = by_host.select("host", (F.col("good") / max(total[0], 1.0)).alias("good"), (F.col("bad") / max(total[1], 1.0)).alias("bad"))
    rank = propagate(table(host_edges(pages, url, html), "edges"), seeds)
    judged = seen.join(rank.where(F.round("distrust", DIGITS) > RATIO * F.round("trust", DIGITS)).select("host", F.lit("block").alias("spread")), "host", "left")
    return judged.withColumn("verdict", F.coalesce("said", "spread", F.lit("allow"))).select(*pages.columns, "host", "path", "rule", "verdict")

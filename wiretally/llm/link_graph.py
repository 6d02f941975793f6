"""URL filter: rules for hosts and paths, and trust along links between hosts.

Pages that no rule fits are judged by their host: personalised PageRank from
the hosts of allowed pages spreads trust along links, and PageRank on the
reversed links from the hosts of blocked pages spreads distrust to those that
link to them. DataFrame functions only.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.storage import durable

DAMPING = 0.85
#: Rounds that run as one job, after which the change is looked at.
STRIDE = 5
#: Rounds end when all scores together move by less.
TOLERANCE = 1e-5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z lowered; or empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; or empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _domains(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, rules)``: those that fit the host or a domain above it, longest first."""
    above = hosts.select("host", F.explode(_domains(F.col("host"))).alias("domain"))
    fitting = above.join(rules.withColumnRenamed("host", "domain"), "domain")
    name = F.concat("domain", "path")
    # Ties in length cannot both fit one url: same host part, same path start.
    entry = F.struct(F.length(name).alias("length"), name.alias("rule"), "path", "action")
    return fitting.groupBy("host").agg(F.sort_array(F.collect_set(entry), asc=False).alias("rules"))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, weight)``: links from host to host, counted; links within a host do not count."""
    found = pages.select(
        host_of(F.col(url_col)).alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(_LINK), F.lit(1))).alias("link"),
    )
    target = F.regexp_replace("link", "^(?i:https?:)?//", "")
    found = found.select("src", F.translate(target, ascii_uppercase, ascii_lowercase).alias("dst"))
    found = found.where("src != dst AND src != ''")
    return found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """Edges both ways between a host and the domain one label up, of two labels at least."""
    labels = F.split("host", r"\.")
    chain = F.filter(_domains(F.col("host")), lambda d: F.size(F.split(d, r"\.")) >= 2)
    steps = hosts.where(F.size(labels) > 2).select(F.explode(F.arrays_zip(
        F.slice(chain, F.lit(1), F.size(chain) - 1).alias("low"),
        F.slice(chain, F.lit(2), F.size(chain)).alias("high"),
    )).alias("step"))
    steps = steps.select("step.low", "step.high").distinct()
    up = steps.select(F.col("low").alias("src"), F.col("high").alias("dst"))
    down = steps.select(F.col("high").alias("src"), F.col("low").alias("dst"))
    return up.unionAll(down).withColumn("weight", F.lit(1.0))


def propagated(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``(host, trust, distrust)`` of every host that either reaches.

    ``seeds`` has ``(host, trust, distrust)`` weights, of which each kind is
    scaled to a sum of 1. Trust flows along edges, distrust against them; what
    a host without such edges would pass on is left out. Rounds go on until the
    scores move by less than ``tolerance`` in sum. As each round moves at most
    0.85 times what the one before moved, about 70 rounds always suffice, and
    no host with a score above the tolerance is left out.
    """
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    backward = edges.select(
        F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"
    )
    steps = forward.unionAll(backward)
    out = steps.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    steps = steps.join(out, ["kind", "src"]).select(
        "kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share")
    )
    steps = durable(steps, "steps")
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("seed")) for k in ("trust", "distrust")
    ])
    start = seeds.select("host", F.explode(kinds).alias("s")).select("host", "s.kind", "s.seed")
    start = start.where("seed > 0")
    total = start.groupBy("kind").agg(F.sum("seed").alias("total"))
    start = start.join(total, "kind").select("kind", "host", (F.col("seed") / F.col("total")).alias("score"))
    start = durable(start, "seeds")
    base = start.withColumn("score", F.col("score") * (1 - DAMPING))
    scores = start
    while True:
        before = scores
        for _ in range(STRIDE):
            flow = steps.join(scores.withColumnRenamed("host", "src"), ["kind", "src"])
            flow = flow.select("kind", F.col("dst").alias("host"), (DAMPING * F.col("score") * F.col("share")).alias("score"))
            scores = flow.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        scores = durable(scores, "scores")
        signed = scores.unionByName(before.withColumn("score", -F.col("score")))
        moved = signed.groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("by"))
        if (moved.agg(F.sum("by")).first()[0] or 0.0) < tolerance:
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judged_pages(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)``, one row per page.

    ``rules`` has ``(action, host, path)``, action allow or block. A rule fits
    its host and all hosts below it, if the path starts with the rule's; the
    longest fitting rule decides. Otherwise a host with more distrust than
    trust is blocked, and any other allowed. Hosts are joined by links in the
    html and to the domain above them. A null url, or one without ``://``, has
    empty host and path and no edges; null html has no links. Urls and html of
    any length are read whole; repeated rows are judged each; empty tables give
    no rows. Other columns are not looked at.
    """
    placed = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    counts = placed.groupBy("host", "path").agg(F.count("*").alias("n"))
    hosts = durable(counts.groupBy("host").agg(F.sum("n").alias("n")).select("host"), "hosts")
    fitting = durable(rules_by_host(hosts, rules), "host-rules")

    def with_rule(rows: DataFrame) -> DataFrame:
        first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
        return rows.join(fitting, "host", "left").withColumn("first", first).drop("rules")

    of = lambda action: F.sum(F.when(F.col("first.action") == action, F.col("n")).otherwise(0))
    seeds = with_rule(counts).groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    edges = link_edges(pages, url_col, html_col).unionByName(domain_edges(hosts))
    edges = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    scores = propagated(edges, seeds)
    found = with_rule(placed).join(scores, "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce("first.action", F.when(distrust > trust, "block").otherwise("allow"))
    return found.select(
        "page_id", "host", "path", F.col("first.rule").alias("rule"), verdict.alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )

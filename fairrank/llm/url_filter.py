"""URL filters: rules first, link-graph propagation for the rest.

A rule is a host followed by a path prefix; it fits the host and its subdomains, and of the
rules that fit a page the longest decides.  Every host with allowed (or blocked) pages is a
trusted (or blocked) seed whose mass is their share of its pages.  Trust is the personalised PageRank from trusted seeds along links between
hosts; distrust is the same from blocked seeds against the links (who links to a blocked host is
suspect).  Neither is normalised: a host's ranks depend on the hosts it is linked with, not on the
size of the table.  A page without a rule is blocked if its host's distrust is above ``THRESHOLD``
and above its trust.

Edges are distinct host pairs, counted map-side, so a host with a third of all pages is one row
per task; ranks are tables that are joined, never collected; each step is written to the shared
folder, and steps end when less than ``TOLERANCE`` is left to move over all hosts; ranks that have
not settled after ``MAX_STEPS`` are an error.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, has no
edges and is allowed; null html has no links; links within a host and relative links are no
edges; hosts that no seed reaches are allowed; repeated pages count as pages; rules of equal
length that fit one page are equal rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairrank.llm.common import pick, staged

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
#: So many rules become one expression; more of them are joined by the suffixes of hosts.
MAX_RULES = 500
DAMPING = 0.85
#: Mass falls by the damping at each step: enough for a hundred million seeds.
MAX_STEPS = 200
TOLERANCE = 1e-6
#: Distrust, where a host with only blocked pages has mass 1, above which a host may be blocked.
THRESHOLD = 1e-4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, the first of equally long ones; null if none does."""
    rule = verdict = None
    for action, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """The pages (host, path and more) with rule and ruled."""
    if len(rules) <= MAX_RULES:
        rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
        return pages.withColumn("rule", rule).withColumn("ruled", ruled)
    parts = [(text.partition("/")[0], "/" + text.partition("/")[2], text, action, -i) for i, (action, text) in enumerate(rules)]
    table = pages.sparkSession.createDataFrame(parts, "name string, start string, rule string, ruled string, nth int")
    # the host and every domain above it; a page's address is looked up once
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spots = pages.select("host", "path").distinct().withColumn("name", F.explode(above))
    fits = spots.join(table, "name").where(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "ruled"), F.struct(F.length("rule"), "nth")).alias("b"))
    best = staged(best.select(F.col("host").alias("h"), F.col("path").alias("p"), "b.rule", "b.ruled"), "ruled-addresses")
    return pages.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").drop("h", "p")


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts, from absolute links of (host, html)."""
    links = pages.where((F.col("host") != "") & F.col("html").contains("//")).select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(2))).alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src != dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int | None = None,
           tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank) by power iteration: rank = (1 - damping) seed weight + damping * inflow; what
    hosts without out-links hold is lost, so hosts that no link joins do not bear on each other.
    ``seeds``: host, weight.  With ``steps``, the iterate after that many."""
    # x is what moves on next, p what stayed; all that x can still add anywhere is its own sum
    state = staged(seeds.where("weight > 0").select("host", F.col("weight").cast("double").alias("x"),
                                                    F.lit(0.0).alias("p")), "seeds")
    if not edges.limit(1).count():
        return state.select("host", ((1.0 - damping) * F.col("x")).alias("rank"))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = staged(edges.join(out, "src").select("src", "dst", (1.0 / F.col("out")).alias("w")), "edges")
    for k in range(MAX_STEPS if steps is None else steps):
        if (state.agg(F.sum("x")).first()[0] or 0.0) < tolerance:
            break
        moved = weighted.join(state.where("x > 0"), F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), (damping * F.col("x") * F.col("w")).alias("x"), F.lit(0.0).alias("p"))
        stay = state.select("host", F.lit(0.0).alias("x"), (F.col("p") + (1.0 - damping) * F.col("x")).alias("p"))
        state = staged(moved.union(stay).groupBy("host").agg(F.sum("x").alias("x"), F.sum("p").alias("p")), "ranks")
    else:
        if steps is None:
            raise RuntimeError(f"ranks did not settle in {MAX_STEPS} steps")
    return state.select("host", (F.col("p") + F.col("x")).alias("rank"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int | None = None,
                      tolerance: float = TOLERANCE) -> DataFrame:
    """``spread`` from seed weights made to sum to 1."""
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0
    shares = seeds.select("host", (F.col("weight") / F.lit(float(total))).alias("weight"))
    return spread(edges, shares, damping, steps, tolerance)


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) per page."""
    p = pick(pages, ["page_id", "url", "html"])
    p = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    p = with_rules(p, rules)
    hosts = staged(p.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"),
        F.count_if(F.col("ruled") == "block").alias("bad")), "hosts")
    edges = staged(host_edges(p.select("host", "html")), "host-edges")
    good = hosts.select("host", (F.col("good") / F.col("n")).alias("weight"))
    bad = hosts.select("host", (F.col("bad") / F.col("n")).alias("weight"))
    trust = spread(edges, good).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = spread(back, bad).withColumnRenamed("rank", "distrust")
    by_host = trust.join(distrust, "host", "full").withColumnRenamed("host", "h")
    by_host = staged(by_host.select("h", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]), "ranks")
    out = p.drop("html").join(by_host, F.col("host") == F.col("h"), "left")
    out = out.select("page_id", "host", "path", "rule", "ruled",
                     *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")])
    suspect = (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(suspect, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")

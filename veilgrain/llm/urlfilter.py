"""URL filter: host and path rules, and trust that spreads over links between hosts. DataFrame operations only.

Hosts most of whose pages a rule allows, or blocks, are seeds, with the weight of those pages. Trust starts at allowed seeds
and follows links; distrust starts at blocked seeds and goes against them, as whoever links to bad hosts is suspect.
Both are personalised PageRanks. A page without a rule gets its host's verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.session import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
MASS = 1_000_000_000_000  # all the trust, and all the distrust, in whole units so that sums don't depend on their order
DAMPING = 0.85
ROUNDS = 12
STORE_EVERY = 4  # rounds between written tables
Rule = tuple[str, str, str]  # verdict (allow or block), host, path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; null and others: empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Place in ``rules`` of the longest rule that fits, else null; of equally long ones a block goes first."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), rules[i][0] != "block", i))
    tests = []
    for i in order:
        _, h, p = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        tests.append(F.when(fits, F.lit(i)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("int")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): how many pages of host src link to host dst; from (host, html). Relative links stay at home."""
    low = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER))
    links = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(low)).alias("dst"))
    return links.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def host_trust(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from seeds (host, allowed, blocked page counts) and links (src, dst, pages).

    Masses are whole units of 1 / MASS. A host without outgoing (for distrust: incoming) links passes nothing on.
    """
    counts = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("allowed").alias("n")),
        F.struct(F.lit(1).alias("kind"), F.col("blocked").alias("n")),
    )
    kinds = seeds.select("host", F.explode(counts).alias("x")).select("host", "x.kind", "x.n").where("n > 0")
    total = kinds.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows
    seed = F.floor(F.col("n") * F.lit(float(MASS)) / F.col("total")).alias("seed")
    start = store(kinds.join(F.broadcast(total), "kind").select("host", "kind", seed), "seeds")
    both = links.select(F.col("src").alias("host"), F.lit(0).alias("kind"), F.col("dst").alias("to"), "pages").union(
        links.select(F.col("dst").alias("host"), F.lit(1).alias("kind"), F.col("src").alias("to"), "pages")
    )
    out = both.groupBy("host", "kind").agg(F.sum("pages").alias("all"))
    share = (F.col("pages") / F.col("all")).alias("share")
    edges = store(both.join(out, ["host", "kind"]).select("host", "kind", "to", share), "edges")
    mass = start.select("host", "kind", F.col("seed").alias("mass"))
    if not edges.isEmpty():
        again = start.select("host", "kind", F.floor(F.col("seed") * F.lit(1 - damping)).alias("mass"))
        for i in range(rounds):
            sent = F.floor(F.col("mass") * (F.col("share") * F.lit(damping))).alias("mass")
            moved = mass.join(edges, ["host", "kind"]).select(F.col("to").alias("host"), "kind", sent)
            mass = moved.union(again).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
            if (i + 1) % STORE_EVERY == 0:
                mass = store(mass, "mass")
    trust, distrust = (F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)) for k in (0, 1))
    return mass.groupBy("host").agg(trust.alias("trust"), distrust.alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[Rule], tolerance: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    ``verdict`` is the rule's where one fits; else block if the host's distrust exceeds ``tolerance`` times its trust,
    else allow. A host that neither reaches is allowed, and so is a page without a host (null url, no ``://``).
    Null html has no links. Repeated rows are judged alike and weigh as often as they occur. An empty table gives no
    rows. Other columns are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    names = F.array(*(F.lit(h + p) for _, h, p in rules)) if rules else F.array().cast("array<string>")
    verdicts = F.array(*(F.lit(v) for v, _, _ in rules)) if rules else F.array().cast("array<string>")
    parts = parts.withColumn("i", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = parts.select(
        "page_id", "host", "path", F.get(names, F.col("i")).alias("rule"), F.get(verdicts, F.col("i")).alias("ruled")
    )
    judged_as = [F.count(F.when(F.col("ruled") == v, 1)).alias(v) for v in ("allow", "block")]
    counts = rows.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), *judged_as)
    most = [F.when(F.col(v) * 2 > F.col("n"), F.col(v)).otherwise(0) for v in ("allow", "block")]
    seeds = counts.select("host", most[0].alias("allowed"), most[1].alias("blocked"))
    links = store(host_links(parts), "links")
    trust = host_trust(seeds, links, rounds)
    known = trust.select(F.col("host").alias("h"), "trust", "distrust")
    joined = rows.join(known, F.col("host") == F.col("h"), "left")
    trust_, distrust_ = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("trust", "distrust"))
    spread = F.when(distrust_ > trust_ * F.lit(tolerance), "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", spread).alias("verdict"),
        trust_.alias("trust"), distrust_.alias("distrust"),
    )

"""Central release: small-cell gate with downgrade, mechanisms, uncertainty and provenance.

k-thresholding and the choice of level depend on the data and are not covered by epsilon; a release must not be
described as pure differential privacy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions.noise import classic_sigma, gaussian, laplace, two_sided_geometric
from veilgrain.operators import bounding
from veilgrain.operators.transforms import ladder
from veilgrain.schema import GRANULARITY_RANK, ReleaseContract
from veilgrain.session import store

Z95 = 1.959964


# ---- small cells ------------------------------------------------------------------------------------------------
def k_gate(staged: DataFrame, k_min: int) -> DataFrame:
    """Label cells: ``passes`` is true with at least ``k_min`` contributors."""
    return staged.withColumn("passes", F.col("contributors_count") >= k_min)


def level_support(staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return staged.groupBy(*keys, "level", "lvl").agg(
        F.min("contributors_count").alias("min_contributors"), F.count("*").alias("n_cells")
    )


def choose_level(staged: DataFrame, keys: Sequence[str], k_min: int, finest: int = 0, coarsest: int = 2) -> DataFrame:
    """Per feature and window, the finest permitted level at which every cell has ``k_min`` contributors.

    A window in which no level qualifies is missing from the result; that is the BLOCK outcome.
    """
    ok = level_support(staged, keys).filter(
        (F.col("min_contributors") >= k_min) & F.col("lvl").between(finest, coarsest)
    )
    return ok.groupBy(*keys).agg(F.min("lvl").alias("lvl"))


def downgrade_feature(staged: DataFrame, keys: Sequence[str], k_min: int, finest: int = 0, coarsest: int = 2) -> DataFrame:
    """Cells of the chosen level. ``staged`` holds all levels, each aggregated from bounded rows of its own.

    It is read twice, for the choice and for the cells, so it should be a stored staging table.
    """
    return at_level(staged, choose_level(staged, keys, k_min, finest, coarsest), keys)


def at_level(staged: DataFrame, levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of the level that ``levels`` names for their keys."""
    return staged.join(levels, [*keys, "lvl"], "left_semi")


def blocked(staged: DataFrame, keys: Sequence[str], k_min: int, finest: int = 0, coarsest: int = 2) -> DataFrame:
    """Audit rows of features and windows that no permitted level can release."""
    support = level_support(staged, keys).filter(F.col("lvl").between(finest, coarsest))
    worst = support.groupBy(*keys).agg(F.max("min_contributors").alias("min_support"))
    return worst.filter(F.col("min_support") < k_min).withColumn("reason", F.lit("MIN_SUPPORT_FAIL"))


def downgrade_cells(df: DataFrame, levels: Sequence[str], k_min: int, keys: Sequence[str], contributor: str,
                    value: Column) -> DataFrame:
    """Only failing cells move up: their rows merge into a residual cell of the parent level.

    ``levels`` are cell columns from fine to coarse. Contributors are recounted for every residual cell. What still
    fails at the coarsest level is suppressed. Result cells are disjoint: a row is counted in exactly one of them.
    """
    base = df.groupBy(*keys, *levels, contributor).agg(
        F.count("*").alias("n"), F.sum(value).alias("v")
    )
    out, rest = None, store(base, "downgrade-base")
    for depth, cell in enumerate(levels):
        cells = rest.groupBy(*keys, cell, contributor).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        cells = cells.groupBy(*keys, cell).agg(
            F.count("*").alias("contributors_count"), F.sum("n").alias("event_count"), F.sum("v").alias("value_sum")
        )
        passing = store(cells.filter(F.col("contributors_count") >= k_min), "downgrade-cells")
        released = passing.select(
            *keys, F.lit(depth).alias("lvl"), F.lit(depth > 0).alias("residual"),
            F.col(cell).cast("string").alias("cell"), "contributors_count", "event_count", "value_sum",
        )
        out = released if out is None else out.unionByName(released)
        if depth + 1 < len(levels):
            rest = rest.join(passing.select(*keys, cell), [*keys, cell], "left_anti")
    return out


def suppressed(staged: DataFrame, k_min: int) -> DataFrame:
    """Cells dropped because no downgrade is permitted, as audit rows without their values."""
    return staged.filter(F.col("contributors_count") < k_min).select(
        "window_id", "level", "cell", F.lit("SUPPRESSED_BELOW_K").alias("reason")
    )


# ---- mechanisms -------------------------------------------------------------------------------------------------
def sensitivity(metric: str, cap: int, max_cells: int, lo: float, hi: float) -> tuple[float, float]:
    """(L1, L2) sensitivity of one contributor with at most ``cap`` rows in each of ``max_cells`` cells."""
    unit = {"COUNT": 1.0, "HIST": 1.0, "SUM": max(abs(lo), abs(hi))}[metric]
    return cap * max_cells * unit, cap * math.sqrt(max_cells) * unit


def multiplier(c: ReleaseContract) -> float:
    """Gaussian noise multiplier: calibrated, or the contract's own if it supports the stated epsilon and delta."""
    needed = classic_sigma(c.epsilon, c.delta)
    if c.sigma is not None and c.sigma < needed:
        raise ValueError(f"sigma {c.sigma} is below {needed:.4f}, which epsilon {c.epsilon} and delta {c.delta} need")
    return needed if c.sigma is None else c.sigma


def add_noise(value: Column, mechanism: str, metric: str, c: ReleaseContract, key: Sequence[Column]) -> Column:
    """Noised value under the contract; the key fixes the draw for this release."""
    l1, l2 = sensitivity(metric, c.cap, c.max_cells, c.lo, c.hi)
    parts = [c.secret, c.contract_id, c.feature_id, c.contract_version, *key, metric]
    if mechanism == "GAUSSIAN":
        return value + F.lit(multiplier(c) * l2) * gaussian(*parts, digest=c.digest)
    if mechanism == "LAPLACE":
        return value + laplace(F.lit(l1 / c.epsilon), *parts, digest=c.digest)
    if mechanism == "DISCRETE":
        return value + two_sided_geometric(math.exp(-c.epsilon / l1), *parts, digest=c.digest)
    raise ValueError(f"unknown mechanism {mechanism}")


def noise_sd(mechanism: str, metric: str, c: ReleaseContract) -> float:
    l1, l2 = sensitivity(metric, c.cap, c.max_cells, c.lo, c.hi)
    if mechanism == "GAUSSIAN":
        return multiplier(c) * l2
    if mechanism == "LAPLACE":
        return math.sqrt(2.0) * l1 / c.epsilon
    alpha = math.exp(-c.epsilon / l1)
    return math.sqrt(2.0 * alpha) / (1.0 - alpha)


def dp_metrics(cells: DataFrame, c: ReleaseContract, key: Sequence[str] = ("window_id", "level", "cell")) -> DataFrame:
    """Noised count, sum and mean of each cell. Only noised values stay in the result."""
    k = [F.col(x) for x in key]
    count = F.greatest(F.lit(0.0), add_noise(F.col("event_count"), c.mechanism, "COUNT", c, k))
    out = cells.withColumn("dp_event_count", count)
    if "SUM" in c.metrics:
        out = out.withColumn("dp_value_sum", add_noise(F.col("value_sum"), c.mechanism, "SUM", c, k)).withColumn(
            "dp_value_mean", F.col("dp_value_sum") / F.greatest(F.lit(1.0), F.col("dp_event_count"))
        )
    return out.drop("event_count", "value_sum", "value_sumsq", "contributors_count", "passes")


def mean_sensitivity(cap: int, max_cells: int) -> float:
    """L2 sensitivity, times n, of means of values in [0, 1] to one contributor of ``cap`` rows in ``max_cells`` cells."""
    return cap * math.sqrt(max_cells)


def dp_mean_bounded01(mean: Column, n: Column, sigma: float, *key, digest: str = "md5") -> Column:
    """Mean of values in [0, 1] with noise of standard deviation sigma / n, clamped back.

    ``sigma`` is a noise multiplier times ``mean_sensitivity``; contributors must be bounded to match.
    """
    n = F.greatest(F.lit(1), n)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean + (F.lit(float(sigma)) / n) * gaussian(*key, digest=digest)))


def full_domain(counts: DataFrame, keys: Sequence[str], bin_col: str, bins: Sequence[str]) -> DataFrame:
    """Counts over every public bin of every key, zero where nothing was seen.

    Empty bins get noise too; leaving them out would reveal which bins are empty. The domain is a literal list, so a
    key's counts fit one small map and the missing bins need no second pass over the data.
    """
    entry = F.struct(F.col(bin_col).alias("key"), F.col("event_count").alias("value"))
    public = F.when(F.col(bin_col).isin(*bins), entry)
    seen = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(public)).alias("_seen"))
    grid = seen.withColumn(bin_col, F.explode(F.array(*[F.lit(b) for b in bins])))
    found = F.try_element_at("_seen", F.col(bin_col))
    return grid.select(*keys, bin_col, F.coalesce(found, F.lit(0)).alias("event_count"))


def with_uncertainty(df: DataFrame, value: str, sd: Column | float, z: float = Z95) -> DataFrame:
    sd = sd if isinstance(sd, Column) else F.lit(float(sd))
    return df.withColumns(
        {"variance": sd * sd, "ci_lower": F.col(value) - z * sd, "ci_upper": F.col(value) + z * sd}
    )


def with_provenance(df: DataFrame, c: ReleaseContract, release_ts_ms: Column | int, metric: str = "COUNT") -> DataFrame:
    l1, l2 = sensitivity(metric, c.cap, c.max_cells, c.lo, c.hi)
    ts = release_ts_ms if isinstance(release_ts_ms, Column) else F.lit(release_ts_ms).cast("bigint")
    return df.withColumns(
        {
            "contract_id": F.lit(c.contract_id),
            "contract_version": F.lit(c.contract_version),
            "feature_id": F.lit(c.feature_id),
            "mechanism_type": F.lit(c.mechanism),
            "epsilon": F.lit(c.epsilon),
            "delta": F.lit(c.delta),
            "sensitivity_l1": F.lit(l1),
            "sensitivity_l2": F.lit(l2),
            "release_ts_ms": ts,
        }
    )


# ---- whole path -------------------------------------------------------------------------------------------------
def gathered(events: DataFrame, item: Column, cluster: Column, c: ReleaseContract, order: Sequence[str]) -> DataFrame:
    """The rows that some level can keep, those of a contributor and window in one partition.

    A row among the first ``cap`` of a cell is among the first ``cap`` of its item and cluster as well, since these are part of
    the cell at every level. Ranking there bounds what a large contributor sends on.
    """
    capped = bounding.contribution_cap(events, c.cap, ("contributor", "window_id", item, cluster), order)
    return capped.repartition("contributor", "window_id")


def ranked_partials(events: DataFrame, item: Column, cluster: Column, c: ReleaseContract, order: Sequence[str]) -> DataFrame:
    """Clipped sums per contributor and cell at every level over the contributor's first ``cap`` rows.

    Rows that are ``gathered`` stay where they are. Others are shuffled once per level, so the level travels as its number and
    is named again afterwards.
    """
    rows = ladder(events, item, cluster).drop("level")
    capped = bounding.contribution_cap(rows, c.cap, ("contributor", "window_id", "lvl", "cell"), order)
    names = F.array(*[F.lit(g) for g in GRANULARITY_RANK])
    return bounding.contributor_partials(capped.withColumn("level", names[F.col("lvl")]), c.lo, c.hi)


def cell_capped(partials: DataFrame, c: ReleaseContract) -> DataFrame:
    """At most ``max_cells`` cells per contributor, window and level, as ``bounding.l0_cell_cap``.

    The coarsest level has one cell, in which nothing is left to choose, so its rows are neither shuffled nor ranked.
    """
    if c.max_cells < 1:
        return bounding.l0_cell_cap(partials, c.max_cells, c.secret, digest=c.digest)
    coarsest = GRANULARITY_RANK["AGGREGATE"]
    finer = partials.filter(F.col("lvl") < coarsest)
    capped = bounding.l0_cell_cap(finer, c.max_cells, c.secret, digest=c.digest)
    return capped.unionByName(partials.filter(F.col("lvl") == coarsest))


def bounded_staging(events: DataFrame, item: Column, cluster: Column, c: ReleaseContract,
                    order: Sequence[str] = ("ts", "event_id"), cap_cells: bool = True) -> DataFrame:
    """Events to a stored staging table: cap rows per cell, clip, cap cells per contributor, aggregate.

    A contract that releases only counts needs no ranking of rows; its capped counts come from plain aggregation. Other rows are
    gathered before they are repeated per level, so that every cap and sum of a contributor needs one shuffle of them.
    """
    if "SUM" in c.metrics:
        partials = ranked_partials(gathered(events, item, cluster, c, order), item, cluster, c, order)
    else:
        partials = bounding.count_partials(events, item, cluster, c.cap)
    if cap_cells:
        partials = cell_capped(partials, c)
    return store(bounding.stage(partials), "staging")


def release(staged: DataFrame, c: ReleaseContract, release_ts_ms: Column | int) -> DataFrame:
    """Staging to the released table: level choice, noise, interval, provenance.

    The chosen levels are stored, so that their size is known and the cells need not be shuffled to meet them.
    """
    levels = store(choose_level(staged, ["window_id"], c.k_min), "levels")
    cells = at_level(staged, levels, ["window_id"])
    noised = dp_metrics(cells, c)
    noised = with_uncertainty(noised, "dp_event_count", noise_sd(c.mechanism, "COUNT", c))
    return with_provenance(noised, c, release_ts_ms)


def materialize_active(cells: DataFrame, contracts: DataFrame, boundary: str, k_min: int, secret: str, cap: int,
                       max_cells: int, digest: str = "sha2") -> DataFrame:
    """Click-through rates of all active contracts of a boundary in one job.

    ``cells`` has feature_id, window_id, level, lvl, cell, clicks, impressions, contributors for every level, from
    contributors of at most ``cap`` rows in each of ``max_cells`` cells; the noise is scaled to that. Each
    feature starts at its contract's level and moves to the next coarser one its contract permits.
    """
    active = contracts.filter((F.col("boundary") == boundary) & F.col("active")).select(
        "feature_id", "contract_version", "sigma", "lvl_preferred"
    )
    joined = store(cells.join(active, "feature_id").filter(F.col("lvl") >= F.col("lvl_preferred")), "active-cells")
    ok = joined.groupBy("feature_id", "window_id", "lvl").agg(F.min("contributors").alias("m")).filter(F.col("m") >= k_min)
    pick = ok.groupBy("feature_id", "window_id").agg(F.min("lvl").alias("lvl"))
    chosen = joined.join(pick, ["feature_id", "window_id", "lvl"], "left_semi")
    n = F.greatest(F.lit(1), F.col("impressions"))
    names = [F.col(x) for x in ("feature_id", "contract_version", "window_id", "level", "cell")]
    noise = mean_sensitivity(cap, max_cells) * gaussian(secret, *names, "ctr", digest=digest)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("clicks") / n + F.col("sigma") / n * noise))
    return chosen.select("feature_id", "contract_version", "window_id", "level", "cell", value.alias("ctr"))


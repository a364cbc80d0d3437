"""Statistics of event tables that feed the risk scores.

Everything runs as cell counts first (partial aggregation, so a hot cell costs one row per map task), then as
aggregates over the much smaller cell table. Shares of a total are taken over histograms of cell counts, not
over windows that would pull every cell of a group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.operators.prefix import range_totals
from veilgrain.operators.transforms import roll_up


def ladder_cells(df: DataFrame, keys: Sequence[str], item: Column, cluster: Column, outcome: Column | None = None) -> DataFrame:
    """Rows and outcome sums per cell at every granularity.

    Counts and sums add up along the ladder, so events are counted once per item and only the item cells are
    repeated for the coarser levels.
    """
    y = outcome if outcome is not None else F.lit(0.0)
    items = df.groupBy(*keys, item.alias("_item"), cluster.alias("_cluster")).agg(
        F.count("*").alias("cnt"), F.sum(y).alias("y"), F.sum(y * y).alias("yy")
    )
    return roll_up(items, keys, ["cnt", "y", "yy"])


def two_window_cells(
    df: DataFrame, keys: Sequence[str], item: Column, cluster: Column, age_days: Column, windows: dict[str, int],
    outcome: Column | None = None,
) -> DataFrame:
    """Cells of overlapping look-back windows, e.g. {"W1": 7, "W0": 28}, in one pass.

    A row of age ``a`` days belongs to every window longer than ``a``. Each item cell is counted once per window by
    conditional sums, then laid out as one row per window and level.
    """
    y = outcome if outcome is not None else F.lit(0.0)
    inside = {w: (age_days >= 0) & (age_days < days) for w, days in windows.items()}
    sums = []
    for w, ok in inside.items():
        sums += [F.count_if(ok).alias(f"cnt_{w}"), F.sum(F.when(ok, y)).alias(f"y_{w}"),
                 F.sum(F.when(ok, y * y)).alias(f"yy_{w}")]
    longest = max(windows.values())
    items = df.filter((age_days >= 0) & (age_days < longest)).groupBy(
        *keys, item.alias("_item"), cluster.alias("_cluster")
    ).agg(*sums)
    per_window = F.array(
        *[
            F.struct(F.lit(w).alias("window_id"), F.col(f"cnt_{w}").alias("cnt"), F.col(f"y_{w}").alias("y"),
                     F.col(f"yy_{w}").alias("yy"))
            for w in windows
        ]
    )
    rows = items.select(*keys, "_item", "_cluster", F.explode(per_window).alias("_w")).select(
        *keys, "_item", "_cluster", "_w.*"
    )
    return roll_up(rows.filter("cnt > 0"), [*keys, "window_id"], ["cnt", "y", "yy"])


def ladder_contributors(
    df: DataFrame, keys: Sequence[str], item: Column, cluster: Column, contributor: str = "contributor"
) -> DataFrame:
    """Rows per contributor and cell at every granularity, built up from one row per contributor and item."""
    items = df.groupBy(*keys, item.alias("_item"), cluster.alias("_cluster"), contributor).agg(F.count("*").alias("n"))
    return roll_up(items, [*keys, contributor], ["n"])


def cell_supports(per_contributor: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct contributors and rows per cell. Contributors are recounted per level; they do not add up."""
    return per_contributor.groupBy(*keys, "level", "lvl", "cell").agg(
        F.count("*").alias("support"), F.sum("n").alias("n_rows")
    )


def _count_histogram(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of cells (and outcome sum) per cell count.

    A group of N rows has at most sqrt(2N) different cell counts, since they add up to N. That bounds the windows
    below: about 1.4 million rows for a group of 10^12.
    """
    return cells.groupBy(*keys, "cnt").agg(F.count("*").alias("n_cells"), F.sum("y").alias("y"))


def feature_stats(cells: DataFrame, keys: Sequence[str], tail_share: float) -> DataFrame:
    """n_obs, n_distinct, min support, tail mass, mean rows per cell and sampling variance per key group.

    ``keys`` holds feature, window and level; the outcome summed in ``y`` is a 0/1 rate. Tail mass is the share of
    rows in cells whose own share is below ``tail_share``.
    """
    rows = F.col("cnt") * F.col("n_cells")
    hist = _count_histogram(cells, keys).withColumn("_all", F.sum(rows).over(W.partitionBy(*keys)))
    small = F.when(F.col("cnt") < tail_share * F.col("_all"), rows).otherwise(0)
    totals = hist.groupBy(*keys).agg(
        F.sum(rows).alias("n_obs"),
        F.sum("n_cells").alias("n_distinct_est"),
        F.min("cnt").alias("min_support_est"),
        F.sum("y").alias("_y"),
        F.sum(small).alias("_tail"),
    )
    rate = F.col("_y") / F.col("n_obs")
    n_eff = F.col("n_obs") / F.col("n_distinct_est")
    return totals.select(
        *keys,
        "n_obs",
        "n_distinct_est",
        "min_support_est",
        (F.col("_tail") / F.col("n_obs")).alias("tail_mass_est"),
        n_eff.alias("n_eff"),
        (rate * (1 - rate) / n_eff).alias("approx_variance"),
    )


def tail_masses(cells: DataFrame, keys: Sequence[str], tail_share: float, q: float) -> DataFrame:
    """Share of rows in rare cells, by two definitions of rare.

    ``tail_mass``: the cell's own share is below ``tail_share``. ``bottom_mass``: its percent rank by count is at most
    ``q``; cells of equal count share a rank, so ranks come from the histogram of counts.
    """
    rows = F.col("cnt") * F.col("n_cells")
    group = W.partitionBy(*keys)
    before = F.coalesce(F.sum("n_cells").over(group.orderBy("cnt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = _count_histogram(cells, keys).select(
        *keys, "cnt", rows.alias("_rows"), before.alias("_before"),
        F.sum("n_cells").over(group).alias("_cells"), F.sum(rows).over(group).alias("_all"),
    )
    pct = F.when(F.col("_cells") > 1, F.col("_before") / (F.col("_cells") - 1)).otherwise(F.lit(0.0))

    def share(rare: Column) -> Column:
        return F.sum(F.when(rare, F.col("_rows")).otherwise(0)) / F.sum("_rows")

    return ranked.groupBy(*keys).agg(
        share(F.col("cnt") < tail_share * F.col("_all")).alias("tail_mass"), share(pct <= q).alias("bottom_mass")
    )


def expected_inverse_support(supports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E[1/support]: averaged over cells, and over rows."""
    inv = 1.0 / F.col("support")
    return supports.groupBy(*keys).agg(
        F.avg(inv).alias("u_cells"), (F.sum(F.col("n_rows") * inv) / F.sum("n_rows")).alias("u_rows")
    )


def mutual_information(df: DataFrame, keys: Sequence[str], attr: str, cell: str) -> DataFrame:
    """MI in nats between an attribute and a cell, per key group."""
    return mutual_information_counts(df.withColumn("_n", F.lit(1)), keys, attr, cell, "_n")


def mutual_information_counts(df: DataFrame, keys: Sequence[str], attr: str, cell: str, n: str) -> DataFrame:
    """The same from rows that carry a count ``n``: joint counts joined with both marginals."""
    joint = df.groupBy(*keys, F.col(attr).alias("_a"), F.col(cell).alias("_s")).agg(F.sum(n).alias("_n"))
    by_a = joint.groupBy(*keys, "_a").agg(F.sum("_n").alias("na"))
    by_s = joint.groupBy(*keys, "_s").agg(F.sum("_n").alias("ns"))
    total = by_a.groupBy(*keys).agg(F.sum("na").alias("nt"))
    both = joint.join(by_a, [*keys, "_a"]).join(by_s, [*keys, "_s"]).join(total, list(keys))
    ratio = F.col("_n") * F.col("nt") / (F.col("na") * F.col("ns"))
    return both.groupBy(*keys).agg(F.sum(F.col("_n") / F.col("nt") * F.log(ratio)).alias("mi"))


def binary_auc(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mann-Whitney AUC with half ties per key group, from (value, pos, neg) counts.

    ``value`` is a bigint; ``pos`` and ``neg`` count the rows of each label.
    """
    hist = df.groupBy(*keys, value).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = range_totals(hist, keys, value, ["neg"])
    wins = F.col("pos").cast("double") * (F.col("before_neg") + 0.5 * F.col("neg"))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return ranked.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.when((p > 0) & (n > 0), F.sum(wins) / (p * n)).alias("auc"),
    )


def label_auc(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n_pos, n_neg, auc): how well ``value`` tells the rows of each label from all others, ties counting half.

    Ranks depend on the rows of all labels together, so one histogram row per value with its counts by label is ranked once,
    however many labels there are. A row without a label or value is left out.
    """
    known = df.filter(F.col(label).isNotNull() & F.col(value).isNotNull())
    counts = known.groupBy(value, label).agg(F.count("*").alias("n"))
    hist = counts.groupBy(value).agg(F.sum("n").alias("total"), F.collect_list(F.struct(F.col(label).alias("label"), "n")).alias("_by"))
    ranked = range_totals(hist, [], value, ["total"])
    twice = 2 * F.col("before_total") + F.col("total") + 1  # twice the middle rank, a whole number
    rows = ranked.select(F.inline("_by"), twice.alias("_rank"))
    sums = rows.groupBy(F.col("label").alias(label)).agg(
        F.sum("n").alias("n_pos"), F.sum((F.col("n") * F.col("_rank")).cast("decimal(38,0)")).alias("_ranks")
    )
    every = sums.agg(F.sum("n_pos")).scalar()
    p, n = F.col("n_pos"), every - F.col("n_pos")
    wins = F.col("_ranks").cast("double") / 2 - p.cast("double") * (p + 1) / 2
    return sums.select(label, "n_pos", n.alias("n_neg"), F.when(n > 0, wins / (p.cast("double") * n)).alias("auc"))


def value_persistence(df: DataFrame, unit: str, value: str, day: str, order: Sequence[str]) -> DataFrame:
    """Per day, the share of units active on both this and the previous day whose last value is the same.

    One row per unit and day enters the window, so its partitions are bounded by the number of days.
    """
    last = df.groupBy(unit, F.col(day).cast("date").alias("_d")).agg(
        F.max_by(value, F.struct(*order)).alias("_v")
    )
    w = W.partitionBy(unit).orderBy("_d")
    pairs = last.select(
        F.col("_d").alias("day"),
        (F.lag("_d").over(w) == F.date_sub("_d", 1)).alias("_adjacent"),
        (F.lag("_v").over(w) == F.col("_v")).alias("_same"),
    ).filter("_adjacent")
    return pairs.groupBy("day").agg(
        F.count("*").alias("n_units"), F.avg(F.col("_same").cast("double")).alias("persistence")
    )


def lag1_autocorrelation(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Lag-1 autocorrelation of daily counts."""
    daily = df.groupBy(*keys, F.col(day).alias("_d")).agg(F.count("*").cast("double").alias("x"))
    w = W.partitionBy(*keys).orderBy("_d")
    lagged = daily.withColumn("prev", F.lag("x").over(w)).filter("prev is not null")
    return lagged.groupBy(*keys).agg(F.corr("x", "prev").alias("autocorrelation"))


def within_cell_loss(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean squared error of predicting the outcome by its cell mean, from the sums per cell."""
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("cnt")
    return cells.groupBy(*keys).agg((F.sum(spread) / F.sum("cnt")).alias("loss"))


def heavy_hitters(cells: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent cells per key group, exact; ties by cell name."""
    w = W.partitionBy(*keys).orderBy(F.col("cnt").desc(), "cell")
    return cells.select(*keys, "cell", "cnt", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)

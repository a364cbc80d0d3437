"""Staging tables between the counting and the release job: dimension columns, and the checks a release makes before it reads them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.operators.gates import leak_guard
from veilgrain.operators.transforms import UNKNOWN

# fixed values: columns of every staging table beside its dimensions, with their types
STAGING_TYPES = {
    "contract_id": "string", "contract_version": "string", "feature_id": "string", "window_id": "string", "level": "string",
    "event_count": "bigint", "value_sum": "double", "value_sumsq": "double", "contributors_count": "bigint", "staging_ts_ms": "bigint",
}


def with_dimensions(df: DataFrame, names: Sequence[str], cell: str = "cell", whole: str = "all") -> DataFrame:
    """Add one column per bucketed dimension from the canonical cell key; what a coarser level has dropped is UNKNOWN."""
    parts = F.split(F.col(cell), r"\|")

    def part(i: int) -> Column:
        found = F.get(parts, F.lit(i))
        return F.when((F.col(cell) == whole) | found.isNull() | (found == ""), UNKNOWN).otherwise(found)

    return df.withColumns({name: part(i) for i, name in enumerate(names)})


def validate_staging(
    staging: DataFrame, active: DataFrame, dims: Sequence[str], forbidden: Sequence[str], types: Mapping[str, str] = STAGING_TYPES
) -> DataFrame:
    """``staging`` if a release may read it, else an error that fails the job.

    REJECT_CONTRACT: a contract version in the table is not in ``active`` (contract_id, contract_version). REJECT_SCHEMA: a column is
    missing, of another type or forbidden, or a row lacks its window or a dimension. The rows are looked at once.
    """
    have = dict(staging.dtypes)
    missing = sorted(set(types) - set(have)) + sorted(set(dims) - set(have))
    if missing:
        raise ValueError(f"REJECT_SCHEMA: missing columns {missing}")
    wrong = sorted(c for c, t in types.items() if have[c] != t)
    if wrong:
        raise ValueError(f"REJECT_SCHEMA: types of {wrong}")
    leak_guard(staging, forbidden)
    lacking = F.lit(False)
    for c in ("window_id", *dims):
        lacking |= F.col(c).isNull()
    found = staging.groupBy("contract_id", "contract_version").agg(F.count_if(lacking).alias("n"))
    known = active.select("contract_id", "contract_version").distinct().withColumn("known", F.lit(True))
    bad = found.join(known, ["contract_id", "contract_version"], "left").filter("known IS NULL OR n > 0").limit(10).collect()
    if any(r["known"] is None for r in bad):
        raise ValueError(f"REJECT_CONTRACT: {sorted(str((r['contract_id'], r['contract_version'])) for r in bad if r['known'] is None)}")
    if bad:
        raise ValueError(f"REJECT_SCHEMA: {sum(r['n'] for r in bad)} rows without window or dimension")
    return staging

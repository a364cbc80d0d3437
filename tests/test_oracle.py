"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest
from conftest import MEDIUM, SMALL

from veilgrain.queries import load

QUERIES, ORACLES = load()
# thresholds made for larger tables leave nothing over on the smallest ones
NEED_LARGER_TABLES = {
    "downgrade_feature", "release_shipments", "release_shipment_value", "dp_count", "dp_sum", "dp_mean", "uncertainty",
    "release_provenance", "sink_release", "select_from_release", "commit_spend", "calibrate_sigma", "materialize_active",
    "shuffle_mix", "stream_release", "shuffle_release", "read_staged", "min_effvar_qualify", "scorecard_stats_policy_join",
    "blocked_windows", "degree_spike", "downgrade_cell", "min_support_collapse", "distinct_spike", "score_reproducibility",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    tables = MEDIUM if name in NEED_LARGER_TABLES else SMALL
    assert oracle.compare(spark, oracle.connect(tables), QUERIES[name], ORACLES[name], tables) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0
    assert "contributors_count" not in out.columns

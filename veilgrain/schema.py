"""Fixed vocabularies, table schemas and policy/contract parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Boundary and granularity names with their ranks.
BOUNDARY_RANK = {"LOCAL": 0, "SHUFFLE": 1, "CENTRAL": 2}
GRANULARITY_RANK = {"ITEM": 0, "CLUSTER": 1, "AGGREGATE": 2}
BOUNDARIES = tuple(BOUNDARY_RANK)
GRANULARITIES = tuple(GRANULARITY_RANK)
QUERY_TYPES = ("MEAN_BOUNDED_0_1", "COUNT")

# Policy weight of each sensitivity tag; any other tag weighs OTHER_TAG_WEIGHT.
TAG_WEIGHTS = {
    "health": 0.50,
    "precise_location": 0.45,
    "financial": 0.40,
    "children": 0.60,
    "age": 0.20,
    "gender": 0.15,
    "location": 0.20,
}
OTHER_TAG_WEIGHT = 0.10

FIELD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("is_sensitive", T.BooleanType()),
        T.StructField("is_identifier", T.BooleanType()),
        T.StructField("cardinality_hint", T.LongType()),
    ]
)
JOIN_KEY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("stability", T.DoubleType()),
        T.StructField("ndv_hint", T.LongType()),
    ]
)
FEATURE_SPEC = T.StructType(
    [
        T.StructField("feature_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("fields", T.ArrayType(FIELD)),
        T.StructField("join_keys", T.ArrayType(JOIN_KEY)),
        T.StructField("ttl_days", T.IntegerType()),
        T.StructField("bucketizations", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("privacy_unit", T.StringType()),
        T.StructField("policy_tags", T.ArrayType(T.StringType())),
        T.StructField("support_hint", T.MapType(T.StringType(), T.LongType())),
    ]
)
POLICY_SPEC = T.StructType(
    [
        T.StructField("policy_version", T.StringType()),
        T.StructField(
            "thresholds",
            T.StructType(
                [
                    T.StructField("k_min", T.IntegerType()),
                    T.StructField("tau_boundary", T.MapType(T.StringType(), T.DoubleType())),
                    T.StructField("tau_granularity", T.MapType(T.StringType(), T.DoubleType())),
                ]
            ),
        ),
    ]
)
CELL_KEY = T.StructType(
    [
        T.StructField("geo_bucket", T.StringType()),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("age_bucket", T.StringType()),
    ]
)
PAYLOAD = T.StructType([T.StructField("format", T.StringType()), T.StructField("data", T.ArrayType(T.IntegerType()))])
METADATA = T.StructType(
    [T.StructField("client_ts_ms", T.LongType()), T.StructField("sample_rate", T.DoubleType())]
)
RANDOMIZED_REPORT = T.StructType(
    [
        T.StructField("contract_id", T.StringType()),
        T.StructField("contract_version", T.StringType()),
        T.StructField("feature_id", T.StringType()),
        T.StructField("window_id", T.StringType()),
        T.StructField("cell_key", CELL_KEY),
        T.StructField("mechanism_type", T.StringType()),
        T.StructField("payload", PAYLOAD),
        T.StructField("metadata", METADATA),
    ]
)
SHUFFLE_MESSAGE = T.StructType(
    [
        T.StructField("contract_id", T.StringType()),
        T.StructField("contract_version", T.StringType()),
        T.StructField("feature_id", T.StringType()),
        T.StructField("window_id", T.StringType()),
        T.StructField("cell_key", CELL_KEY),
        T.StructField("protocol_type", T.StringType()),
        T.StructField("local_randomization_enabled", T.BooleanType()),
        T.StructField("epsilon_local", T.DoubleType()),
        T.StructField("payload", PAYLOAD),
        T.StructField("metadata", METADATA),
    ]
)
LEDGER = T.StructType(
    [
        T.StructField("feature_id", T.StringType(), False),
        T.StructField("contract_version", T.StringType(), False),
        T.StructField("boundary", T.StringType(), False),
        T.StructField("granularity", T.StringType(), False),
        T.StructField("privacy_unit", T.StringType(), False),
        T.StructField("window_day", T.DateType(), False),
        T.StructField("accountant", T.StringType(), False),
        T.StructField("epsilon_spend", T.DoubleType(), False),
        T.StructField("delta_spend", T.DoubleType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)


@dataclass(frozen=True)
class Thresholds:
    """Risk caps and weights of the catalog scorecard. The defaults are fixed values."""

    tau_boundary: dict[str, float] = field(
        default_factory=lambda: {"LOCAL": 0.90, "SHUFFLE": 0.70, "CENTRAL": 0.55}
    )
    tau_granularity: dict[str, float] = field(
        default_factory=lambda: {"ITEM": 0.45, "CLUSTER": 0.60, "AGGREGATE": 0.75}
    )
    k_min: int = 100
    alpha_l: float = 0.30
    alpha_u: float = 0.35
    alpha_i: float = 0.25
    alpha_r: float = 0.10


@dataclass(frozen=True)
class ScorePolicy:
    """Parameters of the measured score family and of routing. The defaults are fixed values."""

    policy_version: str = "policy_v1"
    w_link: float = 0.25
    w_uniq: float = 0.25
    w_infer: float = 0.25
    w_policy: float = 0.25
    a_id: float = 0.5
    a_join: float = 0.3
    a_ttl: float = 0.2
    deg_max: int = 10
    retention_days_max: int = 365
    band_mid: float = 0.45
    band_high: float = 0.75
    min_support_floor: int = 10
    distinct_drift_threshold: int = 1000
    infer_default: float = 0.2
    infer_high: float = 0.7
    tau_lps: float = 0.1
    central_sigma: float = 4.0
    min_support_threshold: int = 25
    soft_penalty: float = 0.5


@dataclass(frozen=True, kw_only=True)
class ReleaseContract:
    """What a central release may do: bounding, small-cell rule and noise parameters."""

    secret: str  # whoever knows it can subtract the noise
    digest: str = "sha2"  # of the noise keys; "md5" lets any SQL engine check a result
    contract_id: str = "c_events"
    contract_version: str = "v1"
    feature_id: str = "events_weekly"
    cap: int = 2
    max_cells: int = 8
    lo: float = 0.0
    hi: float = 200.0
    k_min: int = 20
    sigma: float | None = None  # noise multiplier; None calibrates it from epsilon and delta
    epsilon: float = 1.0
    delta: float = 1e-6
    mechanism: str = "GAUSSIAN"
    metrics: tuple[str, ...] = ("COUNT", "SUM")

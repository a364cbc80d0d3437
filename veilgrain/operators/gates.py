"""Validation gates.

A gate labels each row with the first rule it breaks; nothing aborts the batch. ``passed`` and ``rejected``
split the labelled rows, ``audit_rows`` turns rejects into audit records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions.noise import keyed_uniform
from veilgrain.operators.bounding import keep_first
from veilgrain.operators.transforms import UNKNOWN
from veilgrain.schema import BOUNDARIES, GRANULARITIES, QUERY_TYPES

REASON = "reject_reason"


def label(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add ``reject_reason``: the code of the first rule that is not true, or null. Fails closed on null."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]
    return df.withColumn(REASON, F.coalesce(*checks))


def passed(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNull()).drop(REASON)


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNotNull())


def audit_rows(rejects: DataFrame, event_type: str, subject: str, ts: str, detail: Sequence[str] = ()) -> DataFrame:
    """Audit records (ts, event_type, feature_id, details_json) of rejected rows; only named detail columns."""
    return rejects.select(
        F.col(ts).alias("ts"),
        F.lit(event_type).alias("event_type"),
        F.col(subject).alias("feature_id"),
        F.to_json(F.struct(F.col(REASON).alias("reason"), *detail)).alias("details_json"),
    )


def violations(rules: Sequence[tuple[str, Column]]) -> Column:
    """All broken rules as a sorted array of codes."""
    codes = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules])
    return F.array_sort(F.filter(codes, lambda c: c.isNotNull()))


def validate_features(df: DataFrame) -> DataFrame:
    """Catalog row validation; column ``errors`` lists every broken rule."""

    def within(column: str, vocabulary: Sequence[str]) -> Column:
        return F.size(F.array_except(F.col(column), F.array(*[F.lit(v) for v in vocabulary]))) == 0

    rules = [
        ("MISSING_ID", F.length("feature_id") > 0),
        ("MISSING_VERSION", F.length("feature_version") > 0),
        ("BAD_QUERY_TYPE", F.col("query_type").isin(*QUERY_TYPES)),
        ("NEGATIVE_RETENTION", F.col("retention_days") >= 0),
        ("BAD_BOUNDARY", within("boundary_capabilities", BOUNDARIES)),
        ("BAD_GRANULARITY", within("granularity_candidates", GRANULARITIES)),
    ]
    return df.withColumn("errors", violations(rules))


def validate_policies(df: DataFrame) -> DataFrame:
    """Policy row validation: required members, weights and threshold ranges; a missing member breaks its rule."""
    weights = [F.col(c) for c in ("w_link", "w_uniq", "w_infer", "w_policy")]
    total = weights[0] + weights[1] + weights[2] + weights[3]
    rules = [
        ("MISSING_THRESHOLDS", F.col("tau_low").isNotNull() & F.col("tau_high").isNotNull()),
        ("NEGATIVE_WEIGHT", F.least(*weights) >= 0),
        ("WEIGHTS_NOT_ONE", F.abs(total - 1.0) <= 1e-9),
        ("THRESHOLD_RANGE", F.col("tau_low").between(0, 1) & F.col("tau_high").between(0, 1)),
        ("BANDS_CROSSED", F.col("tau_low") <= F.col("tau_high")),
        ("BAD_K", F.col("k_min") >= 1),
    ]
    return df.withColumn("errors", violations(rules))


def allowed_contracts(contracts: DataFrame, keep: int) -> DataFrame:
    """Per feature the active contract and the ``keep`` newest versions a rollout still accepts."""
    newest = keep_first(contracts, ["feature_id"], [F.col("contract_version").desc()], keep)
    return newest.groupBy("feature_id").agg(
        F.max_by("boundary", "contract_version").alias("contract_boundary"),
        F.max("contract_version").alias("active_version"),
        F.collect_set("contract_version").alias("allowed_versions"),
    )


def contract_gate(df: DataFrame, allowed: DataFrame, boundary: str) -> DataFrame:
    """Contract exists, has the pipeline's boundary, and the row's version is still allowed."""
    joined = df.join(allowed, "feature_id", "left")
    return label(
        joined,
        [
            ("REJECT_CONTRACT:NO_ACTIVE_CONTRACT", F.col("active_version").isNotNull()),
            ("REJECT_CONTRACT:BOUNDARY", F.col("contract_boundary") == boundary),
            ("REJECT_CONTRACT:VERSION", F.array_contains("allowed_versions", F.col("contract_version"))),
        ],
    ).drop("contract_boundary", "active_version", "allowed_versions")


def lateness_gate(df: DataFrame, event_ts: str, ingest_ts: str, allowed: Column, window_pattern: str) -> DataFrame:
    return label(
        df,
        [
            ("REJECT_CONTRACT:WINDOW_ID", F.col("window_id").rlike(window_pattern)),
            ("REJECT_CONTRACT:LATE", F.col(ingest_ts) <= F.col(event_ts) + allowed),
        ],
    )


def schema_gate(
    df: DataFrame, required: Sequence[str], forbidden: Sequence[str] = (), types: Mapping[str, str] | None = None
) -> DataFrame:
    """Required columns present and non-null, forbidden ones absent or null, text castable to its declared type.

    A missing required column makes every row fail; there is nothing to read in it.
    """
    rules = [
        (f"REJECT_SCHEMA:MISSING_{c}", F.col(c).isNotNull() if c in df.columns else F.lit(False)) for c in required
    ]
    rules += [(f"REJECT_SCHEMA:FORBIDDEN_{c}", F.col(c).isNull()) for c in forbidden if c in df.columns]
    for c, dtype in (types or {}).items():
        if c in df.columns:
            rules.append((f"REJECT_SCHEMA:TYPE_{c}", F.col(c).isNull() | F.col(c).try_cast(dtype).isNotNull()))
    return label(df, rules)


def dim_domain_gate(
    df: DataFrame, enums: Mapping[str, Sequence[str]], patterns: Mapping[str, str], allow_unknown: Sequence[str] = ()
) -> DataFrame:
    """Enum membership and id patterns. A null dimension becomes UNKNOWN where allowed, else REJECT_DIM."""
    for c in allow_unknown:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(UNKNOWN)))
    dims = [*enums, *patterns]
    rules = [(f"REJECT_DIM:{c}", F.col(c).isNotNull()) for c in dims]
    for c, domain in enums.items():
        rules.append((f"REJECT_DOMAIN:{c}", F.col(c).isin(*domain, *([UNKNOWN] if c in allow_unknown else []))))
    for c, pattern in patterns.items():
        ok = F.col(c).rlike(pattern)
        rules.append((f"REJECT_DOMAIN:{c}", ok | (F.col(c) == UNKNOWN) if c in allow_unknown else ok))
    return label(df, rules)


def payload_gate(
    df: DataFrame, cap: int, categories: int, width: int, depth: int, max_update: int, allow_negative: bool = False
) -> DataFrame:
    """Payload shape and range by protocol: bounded increment, category index or vector, sketch update."""
    data = F.col("data")
    fmt = F.col("format")
    low = -1 if allow_negative else 0

    def at(i: int) -> Column:
        return F.get(data, F.lit(i))

    increment = (F.size(data) == 1) & at(0).between(low, cap)
    category = (F.size(data) == 1) & at(0).between(0, categories - 1)
    vector = (F.size(data) == categories) & F.forall(data, lambda x: x.between(0, 1))
    sketch = (
        (F.size(data) == 3)
        & at(0).between(0, depth - 1)
        & at(1).between(0, width - 1)
        & at(2).between(0, max_update)
    )
    known = F.coalesce(fmt.isin("bounded_increment", "category", "vector", "sketch"), F.lit(False))
    return label(
        df,
        [
            ("REJECT_PAYLOAD_FORMAT", known & data.isNotNull()),
            ("REJECT_PAYLOAD_INCREMENT", (fmt != "bounded_increment") | increment),
            ("REJECT_PAYLOAD_CATEGORY", (fmt != "category") | category),
            ("REJECT_PAYLOAD_VECTOR", (fmt != "vector") | vector),
            ("REJECT_PAYLOAD_SKETCH", (fmt != "sketch") | sketch),
        ],
    )


def event_sanity_gate(df: DataFrame) -> DataFrame:
    clicks, imps = F.col("clicks"), F.col("impressions")
    return label(df, [("INVALID_EVENT", (clicks >= 0) & (imps >= 0) & (clicks <= imps))])


def boundary_mismatch_gate(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """Reads or writes whose boundary is not the contract's; the reject doubles as a security event.

    Every request comes back: one for a feature without a contract is rejected as NO_CONTRACT.
    """
    known = contracts.select("feature_id", F.col("boundary").alias("contract_boundary"), F.lit(True).alias("_known"))
    joined = requests.join(known, "feature_id", "left")
    return label(
        joined,
        [
            ("NO_CONTRACT", F.col("_known")),
            ("BOUNDARY_MISMATCH", F.col("boundary") == F.col("contract_boundary")),
        ],
    ).drop("_known")


def shuffle_ops_gate(requests: DataFrame, max_window_hours: int) -> DataFrame:
    """At SHUFFLE only stateless count, sum and histogram over short windows; no per-user state or longitudinal join."""
    at_shuffle = F.col("boundary") == "SHUFFLE"
    return label(
        requests,
        [
            ("SHUFFLE_OP_NOT_ALLOWED", ~at_shuffle | F.col("operation").isin("count", "sum", "hist")),
            ("SHUFFLE_WINDOW_TOO_LONG", ~at_shuffle | (F.col("window_hours") <= max_window_hours)),
            ("SHUFFLE_USER_STATE", ~at_shuffle | ~F.col("per_user_state")),
            ("SHUFFLE_LONGITUDINAL_JOIN", ~at_shuffle | ~F.col("longitudinal_join")),
        ],
    )


def policy_gate(df: DataFrame, policies: DataFrame, consent: DataFrame) -> DataFrame:
    """Feature enabled for the row's region, contract not deprecated, contributor consented."""
    joined = df.join(policies, ["feature_id", "region"], "left").join(
        consent.select("contributor").distinct().withColumn("_consent", F.lit(True)), "contributor", "left"
    )
    return label(
        joined,
        [
            ("POLICY_DISABLED", F.col("enabled")),
            ("POLICY_DEPRECATED", ~F.col("deprecated")),
            ("POLICY_NO_CONSENT", F.col("_consent")),
        ],
    ).drop("_consent", *[c for c in policies.columns if c not in ("feature_id", "region")])


def sampling_gate(df: DataFrame, p: float, seed: str, keys: Sequence[str]) -> DataFrame:
    """Keep with probability ``p``, decided by a hash of seed and keys, so a replay keeps the same rows."""
    return df.filter(keyed_uniform(seed, *[F.col(k) for k in keys]) < p)


def message_size_gate(df: DataFrame, max_bytes: int) -> DataFrame:
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    return label(df, [("REJECT_SCHEMA:MESSAGE_TOO_LARGE", size <= max_bytes)])


def eliminate_identifiers(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    return df.drop(*forbidden)


def leak_guard(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Raise when a table about to be written still has a forbidden column."""
    leaked = sorted(set(df.columns) & set(forbidden))
    if leaked:
        raise ValueError(f"REJECT_SCHEMA: forbidden columns {leaked}")
    return df


def leaked_values(df: DataFrame, text_columns: Sequence[str], identifiers: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` in which a text column equals a known identifier."""
    ids = identifiers.select(F.col(id_col).cast("string").alias("_id")).distinct()
    hit = F.lit(False)
    for i, c in enumerate(text_columns):
        known = ids.select(F.col("_id").alias(f"_id{i}"))
        df = df.join(known, F.col(c).cast("string") == F.col(f"_id{i}"), "left")
        hit = hit | F.col(f"_id{i}").isNotNull()
    return df.filter(hit).drop(*[f"_id{i}" for i in range(len(text_columns))])


TOKEN = r"[\p{L}\p{N}_.@#+-]+"


def identifier_hashes(identifiers: DataFrame, id_col: str, salt: str) -> DataFrame:
    """(id_hash) of known identifiers; the list itself need not be at hand where tables are scanned."""
    return identifiers.select(F.sha2(F.concat_ws("|", F.lit(salt), F.col(id_col).cast("string")), 256).alias("id_hash")).distinct()


def identifier_hits(df: DataFrame, key: Sequence[str], text_columns: Sequence[str], hashes: DataFrame, salt: str) -> DataFrame:
    """(key, column, id_hash) of every known identifier that stands as a word anywhere in a text column, JSON included.

    Distinct words of each text are hashed with the salt of ``identifier_hashes`` and joined with the hashes, so a word
    that many rows share meets one row of the list. A full stop at the end of a word is not part of it.
    """

    def words_of(column: str) -> Column:
        words = F.regexp_extract_all(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(f"({TOKEN})"))

        def hashed(word: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(salt), F.regexp_replace(word, r"\.+$", "")), 256)
            return F.struct(F.lit(column).alias("column"), digest.alias("id_hash"))

        return F.transform(F.array_distinct(words), hashed)

    words = [words_of(c) for c in text_columns]
    found = df.select(*key, F.explode(F.flatten(F.array(*words))).alias("_w")).select(*key, "_w.*")
    return found.join(hashes, "id_hash", "left_semi").select(*key, "column", "id_hash").distinct()

"""Bounding, downgrade, noise and leak rules on small tables with a hot contributor."""

import collections
import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from veilgrain.functions import noise
from veilgrain.operators import history, bounding, central, gates, joins, lineage, shuffle_dp, stats
from veilgrain.operators import local_dp as ld
from veilgrain.operators import transforms as tr
from veilgrain.operators.prefix import running_totals
from veilgrain.schema import ReleaseContract
from veilgrain.sources import sinks


@pytest.fixture(scope="module")
def rows():
    """900 rows; contributor 0 and item 7 each hold about a third of them."""
    rng = random.Random(5)
    out = []
    for i in range(900):
        who = 0 if i % 3 == 0 else rng.randrange(1, 40)
        item = 7 if i % 3 == 1 else rng.randrange(30)
        out.append((i, who, f"w{i % 2}", item, float(rng.randrange(0, 400)), i * 10))
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, "event_id int, contributor int, window_id string, item int, value double, ts int").repartition(5).cache()


def cells():
    return F.col("item").cast("string"), F.floor(F.col("item") / 10).cast("string")


def brute_cells(rows, cap, lo, hi):
    """Capped counts, clipped sums and contributors per (window, level, cell)."""
    groups = collections.defaultdict(list)
    for eid, who, w, item, v, ts in rows:
        for level, cell in (("ITEM", str(item)), ("CLUSTER", str(item // 10)), ("AGGREGATE", "all")):
            groups[(who, w, level, cell)].append((ts, eid, min(hi, max(lo, v))))
    out = collections.defaultdict(lambda: [0, 0.0, 0])
    for (_, w, level, cell), g in groups.items():
        kept = sorted(g)[:cap]
        c = out[(w, level, cell)]
        c[0] += len(kept)
        c[1] += sum(x[2] for x in kept)
        c[2] += 1
    return {k: tuple(v) for k, v in out.items()}


def test_staging_equals_brute_force(spark, rows, events):
    c = ReleaseContract(secret="s", cap=3)
    staged = central.bounded_staging(events, *cells(), c, cap_cells=False)
    got = {(r.window_id, r.level, r.cell): (r.event_count, r.value_sum, r.contributors_count) for r in staged.collect()}
    assert got == brute_cells(rows, 3, c.lo, c.hi)


def test_count_only_staging_equals_ranked_staging(events):
    c = ReleaseContract(secret="s", cap=3, max_cells=4)
    keys = ("window_id", "level", "cell", "event_count", "contributors_count")
    ranked = central.bounded_staging(events, *cells(), c)
    counted = central.bounded_staging(events, *cells(), dataclasses.replace(c, metrics=("COUNT",)))
    assert sorted(map(tuple, ranked.select(*keys).collect())) == sorted(map(tuple, counted.select(*keys).collect()))


def test_nobody_exceeds_the_sensitivity(events):
    c = ReleaseContract(secret="s", cap=3, max_cells=4)
    partials = bounding.l0_cell_cap(bounding.count_partials(events, *cells(), c.cap), c.max_cells, c.secret)
    worst = partials.groupBy("contributor", "window_id", "level").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))
    top = worst.agg(F.max("n"), F.max("cells")).first()
    l1, l2 = central.sensitivity("COUNT", c.cap, c.max_cells, c.lo, c.hi)
    assert top[0] <= l1 and top[1] <= c.max_cells and l2 == pytest.approx(3 * math.sqrt(4))


def test_caps_trim_before_the_shuffle(events):
    plan = bounding.contribution_cap(tr.ladder(events, *cells()), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cap_of_capped_parts_is_the_cap_of_all(events):
    lad = tr.ladder(events, *cells())
    parts = [bounding.contribution_cap(lad.filter(F.col("event_id") % 4 == i), 2) for i in range(4)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    key = ("event_id", "level", "cell")
    again = bounding.contribution_cap(merged, 2).select(*key).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, bounding.contribution_cap(lad, 2).select(*key).collect()))


def test_feature_downgrade_takes_the_finest_level_that_fits(events):
    staged = central.bounded_staging(events, *cells(), ReleaseContract(secret="s", cap=3), cap_cells=False)
    for k in (1, 10, 30, 41):
        out = central.downgrade_feature(staged, ["window_id"], k).collect()
        assert all(r.contributors_count >= k for r in out)
        blocked = {r.window_id for r in central.blocked(staged, ["window_id"], k).collect()}
        assert blocked.isdisjoint({r.window_id for r in out})
        assert blocked | {r.window_id for r in out} == {"w0", "w1"}
    assert {r.level for r in central.downgrade_feature(staged, ["window_id"], 1).collect()} == {"ITEM"}
    assert central.downgrade_feature(staged, ["window_id"], 41).count() == 0


def test_cell_downgrade_conserves_rows(spark, rows, events):
    levels = events.withColumn("cluster", F.floor(F.col("item") / 10)).withColumn("total", F.lit("all"))
    out = central.downgrade_cells(levels, ["item", "cluster", "total"], 8, ["window_id"], "contributor", F.col("value"))
    got = out.collect()
    assert all(r.contributors_count >= 8 for r in got)
    assert {r.lvl for r in got} >= {0, 1}
    released = sum(r.event_count for r in got)
    everything = central.downgrade_cells(levels, ["item", "cluster", "total"], 1, ["window_id"], "contributor", F.col("value"))
    assert released <= len(rows) and everything.agg(F.sum("event_count")).first()[0] == len(rows)
    if released < len(rows):  # what is missing was suppressed at the coarsest level, per window
        missing = {w: sum(1 for r in rows if r[2] == w) - sum(r.event_count for r in got if r.window_id == w) for w in ("w0", "w1")}
        assert all(not any(r.lvl == 2 and r.window_id == w for r in got) for w, m in missing.items() if m)


def test_release_is_reproducible_and_leaks_nothing(events):
    c = ReleaseContract(secret="s", k_min=5)
    staged = central.bounded_staging(events, *cells(), c)
    one, two = (sorted(map(tuple, central.release(staged, c, 1).collect())) for _ in range(2))
    assert one == two
    other = central.release(staged, dataclasses.replace(c, secret="another"), 1)
    assert sorted(map(tuple, other.collect())) != one
    assert not {"event_count", "value_sum", "contributors_count", "contributor"} & set(other.columns)


def test_sigma_must_support_epsilon():
    with pytest.raises(ValueError):
        central.multiplier(ReleaseContract(secret="s", sigma=4.0, epsilon=1.0, delta=1e-6))
    assert central.multiplier(ReleaseContract(secret="s", sigma=6.0)) == 6.0
    assert central.multiplier(ReleaseContract(secret="s")) == pytest.approx(math.sqrt(2 * math.log(1.25e6)))
    with pytest.raises(ValueError):
        noise.classic_sigma(2.0, 1e-6)


def test_leak_guard_stops_identifiers(spark, tmp_path, events):
    with pytest.raises(ValueError):
        sinks.write_partitioned(events, str(tmp_path / "t"), ["window_id"])
    clean = gates.eliminate_identifiers(events, ["contributor"])
    sinks.write_partitioned(clean, str(tmp_path / "t"), ["window_id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 900


def test_gates_fail_closed_on_null(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    out = {r.id: r.reject_reason for r in gates.label(df, [("BAD", F.col("v") > 0)]).collect()}
    assert out == {1: "BAD", 2: None}


# ---- noise ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("digest", ["md5", "sha2"])
def test_uniform_and_gaussian_moments(spark, digest):
    n = 40_000
    df = spark.range(n).select(
        noise.keyed_uniform("s", F.col("id"), digest=digest).alias("u"),
        noise.gaussian("s", F.col("id"), digest=digest).alias("g"),
        noise.laplace(F.lit(2.0), "s", F.col("id"), digest=digest).alias("l"),
        noise.two_sided_geometric(math.exp(-0.5), "s", F.col("id"), digest=digest).alias("d"),
    )
    m = df.agg(*[f(c).alias(f"{c}{k}") for c in "ugld" for f, k in ((F.avg, "m"), (F.var_pop, "v"))]).first()
    alpha = math.exp(-0.5)
    for mean, var, want_mean, want_var in (
        (m.um, m.uv, 0.5, 1 / 12), (m.gm, m.gv, 0.0, 1.0), (m.lm, m.lv, 0.0, 8.0), (m.dm, m.dv, 0.0, 2 * alpha / (1 - alpha) ** 2),
    ):
        assert abs(mean - want_mean) < 4 * math.sqrt(want_var / n)
        assert var == pytest.approx(want_var, rel=0.08)


def test_estimators_are_unbiased(spark):
    """Pooled over many cells, the standardized errors have mean near zero."""
    cells_n, per_cell, domain = 60, 400, 12
    df = spark.range(cells_n * per_cell).select(
        F.col("id"), (F.col("id") % cells_n).alias("cell"), (F.floor(F.col("id") / cells_n) % domain).cast("int").alias("v")
    )
    truth = df.groupBy("cell", "v").agg(F.count("*").alias("true"))
    p = ld.keep_probability(1.0)
    row, bit = ld.hadamard_report(F.col("v"), domain, 1.0, "s", F.col("id"))
    estimates = {
        "unary": (ld.unary_estimate(ld.unary_sums(df, ["cell"], F.col("v"), domain, 1.0, "s", F.col("id")), 1.0), None),
        "hadamard": (ld.hadamard_estimate(df.withColumn("row", row).withColumn("bit", bit), ["cell"], "row", "bit", domain, 1.0),
                     per_cell / (2 * p - 1) ** 2),
    }
    for name, (est, var) in estimates.items():
        err = est.join(truth, ["cell", "v"]).select((F.col("estimate") - F.col("true")).alias("e"))
        stat = err.agg(F.avg("e").alias("m"), F.stddev("e").alias("s"), F.count("*").alias("n")).first()
        assert stat.n == cells_n * domain, name
        assert abs(stat.m) < 4 * stat.s / math.sqrt(stat.n), name
        if var is not None:
            assert stat.s == pytest.approx(math.sqrt(var), rel=0.15), name


def test_sketch_estimates_what_its_hashes_allow(spark):
    """Given the hash functions, the expected estimate follows from which values share a column."""
    n, domain, depth, width = 40_000, 10, 4, 16
    df = spark.range(n).select("id", F.lit(0).alias("cell"), (F.col("id") % domain).cast("int").alias("v"))
    est = ld.sketch_estimate(ld.sketch_sums(df, ["cell"], F.col("v"), depth, width, 2.0, "s", F.col("id")), ["cell"], df, "v", depth, width, 2.0)
    col = tr.hash_bucket(F.concat_ws("|", F.col("j").cast("string"), F.col("v").cast("string")), "sketch", width)
    grid = spark.range(domain).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("j"))
    at = {(r.j, r.v): r.c for r in grid.select("v", "j", col.alias("c")).collect()}
    each = n / domain
    p = ld.keep_probability(1.0)
    sd = math.sqrt(n * p * (1 - p)) / (2 * p - 1)
    for r in est.collect():
        shared = sum(each / depth for j in range(depth) for u in range(domain) if at[(j, u)] == at[(j, r.v)])
        assert abs(r.estimate - (shared - n / width) * width / (width - 1)) < 5 * sd


def test_randomized_response_estimate(spark):
    df = spark.range(50_000).withColumn("bit", ld.rr_binary((F.col("id") % 5 == 0).cast("int"), 1.0, "s", F.col("id")))
    r = ld.rr_estimate(df, [], "bit", 1.0).first()
    assert abs(r.estimate - 10_000) < 4 * math.sqrt(r.variance)


def test_mixing_keeps_messages_and_drops_keys(spark, events):
    out, held = shuffle_dp.shuffle_mix(events, ["event_id"], "window_id", 50, 1, "s", ["item"])
    assert out.columns == ["window_id", "batch_id", "item"] and out.count() == 900 and held.count() == 0
    even, held = shuffle_dp.shuffle_mix(events, ["event_id"], "window_id", 50, 50, "s", ["item"])
    assert even.groupBy("window_id", "batch_id").count().agg(F.min("count")).first()[0] >= 50
    assert even.count() + sum(r["n"] for r in held.collect()) == 900


def test_contracts_need_a_secret():
    with pytest.raises(TypeError):
        ReleaseContract(cap=3)


def test_means_move_by_at_most_the_cap(events):
    per = events.withColumn("y", (F.col("value") > 50).cast("double")).groupBy("contributor", "window_id", "item").agg(
        F.count("*").alias("n"), F.sum("y").alias("y")
    )
    assert per.agg(F.max("n")).first()[0] > 2
    worst = bounding.scaled_to_cap(per, 2, "n", ["y"]).agg(F.max("n"), F.max("y"), F.min("n")).first()
    assert worst[0] == 2 and worst[1] <= 2 and worst[2] == 1


def test_noise_differs_between_features_and_contracts(spark):
    cells = spark.createDataFrame([("w", "AGGREGATE", "all", 100)], "window_id string, level string, cell string, event_count long")

    def drawn(**names):
        c = ReleaseContract(secret="s", **names)
        key = [F.col(x) for x in ("window_id", "level", "cell")]
        return cells.select(central.add_noise(F.col("event_count"), "GAUSSIAN", "COUNT", c, key)).first()[0]

    same = drawn(contract_id="a", feature_id="f")
    assert same == drawn(contract_id="a", feature_id="f")
    assert len({same, drawn(contract_id="b", feature_id="f"), drawn(contract_id="a", feature_id="g")}) == 3


def test_updates_replace_rows_of_equal_version(spark):
    old = spark.createDataFrame([(1, 1, "old"), (2, 3, "newer")], "id int, version int, x string")
    new = spark.createDataFrame([(1, 1, "new"), (2, 2, "older")], "id int, version int, x string")
    assert {r.id: r.x for r in history.upsert(old, new, ["id"], "version").collect()} == {1: "new", 2: "newer"}


def test_floors_of_deep_and_cyclic_lineage(spark):
    own = spark.createDataFrame([(str(i), float(i == 0)) for i in range(70)], "feature_id string, risk double")
    edges = spark.createDataFrame([(str(i + 1), str(i)) for i in range(69)] + [("0", "69")], "child string, parent string")
    assert {r.floor for r in lineage.inherit_floor(own, edges).collect()} == {1.0}


def test_rounding_of_large_numbers(spark):
    from veilgrain.functions.scalar import stable_round

    row = spark.range(1).select(stable_round(F.lit(1e14), 6), stable_round(F.lit(1.2345678), 6)).first()
    assert row[0] == pytest.approx(1e14) and row[1] == 1.234568


@pytest.mark.parametrize("k,slices", [(7, 4), (50, 16), (1000, 16), (300, 1)])
def test_balanced_sample_is_exact(spark, k, slices):
    df = spark.range(900).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    got = bounding.balanced_sample(df, "label", "id", k, "s", slices).collect()
    u = {r.id: r.u for r in df.select("id", noise.keyed_uniform("s", F.col("id")).alias("u")).collect()}
    for label in (0, 1):
        members = sorted((u[r], r) for r in range(900) if int(r % 3 == 0) == label)
        assert sorted(r.id for r in got if r.label == label) == sorted(i for _, i in members[:k])


def test_empty_bins_are_part_of_the_domain(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("b", "y", 5), ("b", "elsewhere", 9), ("c", "elsewhere", 1)], "g string, bin string, event_count bigint")
    got = {(r.g, r.bin): r.event_count for r in central.full_domain(counts, ["g"], "bin", ["x", "y"]).collect()}
    assert got == {("a", "x"): 3, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 5, ("c", "x"): 0, ("c", "y"): 0}


# ---- building blocks --------------------------------------------------------------------------------------------
@pytest.mark.parametrize("radix,levels", [(2, 3), (1024, 2), (5, 1)])
def test_running_totals_equal_a_plain_window(spark, radix, levels):
    rng = random.Random(radix)
    data = [(g, k, rng.randrange(9)) for g in "ab" for k in rng.sample(range(500), 120)]
    df = spark.createDataFrame(data, "g string, k bigint, v bigint")
    got = {(r.g, r.k): r.before_v for r in running_totals(df, ["g"], "k", ["v"], radix, levels).collect()}
    assert got == {(g, k): sum(v for h, j, v in data if h == g and j < k) for g, k, _ in data}


def test_auc_equals_pair_counting(spark):
    rng = random.Random(3)
    data = [("x", rng.randrange(25), int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame([(a, v, y, 1 - y) for a, v, y in data], "attr string, v bigint, pos int, neg int")
    pos, neg = [v for _, v, y in data if y], [v for _, v, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert stats.binary_auc(df, ["attr"], "v").first().auc == pytest.approx(want)


def test_join_degree_equals_pair_search(spark):
    rng = random.Random(9)
    sets = [(i, rng.sample("abcdef", rng.randrange(0, 4))) for i in range(80)]
    got = {r.id: r.degree for r in joins.join_degree(spark.createDataFrame(sets, "id int, keys array<string>"), "id", "keys").collect()}
    assert got == {i: sum(1 for j, t in sets if j != i and set(s) & set(t)) for i, s in sets}


def test_join_degree_of_large_key_sets(spark):
    rng = random.Random(10)
    sets = [(i, rng.sample(range(400), 40 if i % 3 else rng.randrange(0, 4))) for i in range(60)]
    got = {r.id: r.degree for r in joins.join_degree(spark.createDataFrame(sets, "id int, keys array<int>"), "id", "keys").collect()}
    assert got == {i: sum(1 for j, t in sets if j != i and set(s) & set(t)) for i, s in sets}


def test_inherited_floor_follows_all_ancestors(spark):
    own = spark.createDataFrame([(i, r) for i, r in enumerate([0.9, 0.1, 0.2, 0.05, 0.3])], "feature_id int, risk double")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (3, 4)], "child int, parent int")
    got = {r.feature_id: r.floor for r in lineage.inherit_floor(own, edges).collect()}
    assert got == {0: 0.9, 1: 0.9, 2: 0.9, 3: 0.9, 4: 0.3}


def test_asof_contract_picks_the_newest_issued(spark):
    ev = spark.sql("SELECT * FROM VALUES (1, 'f', timestamp'2024-01-01 05:00:00'), (2, 'f', timestamp'2024-01-05 01:00:00'), (3, 'f', timestamp'2024-01-03 12:00:00'), (4, 'g', timestamp'2024-01-03 12:00:00') t(event_id, feature_id, ts)")
    con = spark.sql("SELECT * FROM VALUES ('f', 'a', timestamp'2024-01-01 06:00:00'), ('f', 'b', timestamp'2024-01-03 12:00:00') t(feature_id, contract_version, issued_at)")
    got = {r.event_id: r.contract_version for r in joins.asof_contract(ev, con).collect()}
    assert got == {2: "b", 3: "b"}


def test_requests_without_contract_are_rejected(spark):
    req = spark.createDataFrame([(1, "f", "CENTRAL"), (2, "f", "SHUFFLE"), (3, "g", "CENTRAL"), (4, None, "CENTRAL")], "id int, feature_id string, boundary string")
    con = spark.createDataFrame([("f", "CENTRAL")], "feature_id string, boundary string")
    got = {r.id: r.reject_reason for r in gates.boundary_mismatch_gate(req, con).collect()}
    assert got == {1: None, 2: "BOUNDARY_MISMATCH", 3: "NO_CONTRACT", 4: "NO_CONTRACT"}


def test_asof_contract_gate_returns_every_event(spark):
    ev = spark.sql("SELECT * FROM VALUES (1, 'f', timestamp'2024-01-01 05:00:00'), (2, 'f', timestamp'2024-01-05 01:00:00'), (3, 'f', timestamp'2024-01-03 12:00:00'), (4, 'g', timestamp'2024-01-03 12:00:00'), (5, NULL, timestamp'2024-01-03 12:00:00') t(event_id, feature_id, ts)")
    con = spark.sql("SELECT * FROM VALUES ('f', 'a', timestamp'2024-01-01 06:00:00'), ('f', 'b', timestamp'2024-01-03 12:00:00') t(feature_id, contract_version, issued_at)")
    got = {r.event_id: (r.contract_version, r.reject_reason) for r in joins.asof_contract_gate(ev, con).collect()}
    assert got == {1: (None, "NO_CONTRACT"), 2: ("b", None), 3: ("b", None), 4: (None, "NO_CONTRACT"), 5: (None, "NO_CONTRACT")}

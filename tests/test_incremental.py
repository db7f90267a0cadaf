"""The pair store, resumed work, segments, content ids and rebalancing with holes."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from quartzfolio.operators import blocks, constraints, identity, pairs, portfolio
from quartzfolio.sources import pair_store, resume, segments
from quartzfolio.sources.tables import exists, files_of, read_rows

DAY = datetime.date(2020, 1, 1)
RETS = "listing string, date date, ret double"


def walks(names, days=40, seed=1):
    r = random.Random(seed)
    return [(n, DAY + datetime.timedelta(days=k), r.gauss(0, 0.01)) for n in names for k in range(days) if r.random() < 0.9]


def store_of(spark, tmp_path, buckets=4):
    return pair_store.PairStore(spark, str(tmp_path / "store"), buckets=buckets)


def statuses(report):
    return {r.bucket: (r.status, r.rows, r.fresh, r.dropped) for r in report.collect()}


def expected(spark, rows):
    d = spark.createDataFrame(rows, RETS)
    return {(r.left, r.right): r for r in pairs.moments(pairs.aligned(d)).collect()}


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    store, rows = store_of(spark, tmp_path), walks("abcdefg")
    store.update(spark.createDataFrame(rows, RETS))
    before = store.files()
    assert {f.split("/")[0] for f in before} == {f"bucket={b}" for b in range(4)}
    again = statuses(store.update(spark.createDataFrame(rows, RETS).repartition(3)))
    assert {s for s, *_ in again.values()} == {"kept"} and store.files() == before
    # g is only ever a right side; a, in bucket 0, changes its pairs there alone.
    changed = [(n, d, -x if n == "a" else x) for n, d, x in rows]
    got = statuses(store.update(spark.createDataFrame(changed, RETS)))
    assert got[0][0] == "rewritten" and got[0][2] == 6 and {got[b][0] for b in (1, 2, 3)} == {"kept"}
    after = store.files()
    assert {f for f in after if not f.startswith("bucket=0")} == {f for f in before if not f.startswith("bucket=0")} and after != before
    want = expected(spark, changed)
    have = {(r.left, r.right): r for r in store.rows().collect()}
    assert set(have) == set(want) and all(math.isclose(have[k].pearson, want[k].pearson, abs_tol=1e-12) for k in want)


def test_store_drops_and_removes(spark, tmp_path):
    store, rows = store_of(spark, tmp_path), walks("abcd")
    store.update(spark.createDataFrame(rows, RETS))
    left = [r for r in rows if r[0] in "ab"]
    got = statuses(store.update(spark.createDataFrame(left, RETS)))
    assert got == {0: ("rewritten", 1, 0, 2), 1: ("removed", 0, 0, 2), 2: ("removed", 0, 0, 1)}
    assert {f.split("/")[0] for f in store.files()} == {"bucket=0"}
    # A new listing that sorts first gets the next number, so that no other moves.
    got = statuses(store.update(spark.createDataFrame(left + walks(["A"], seed=2), RETS)))
    assert got[0][:3] == ("rewritten", 3, 2) or (got[0][0] == "kept" and sum(x[2] for x in got.values()) == 2)
    assert {r.listing: r.number for r in store.listings().collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "A": 4}
    store.tidy()
    assert store.rows().count() == 3


def test_store_keeps_pairs_without_common_dates(spark, tmp_path):
    store = store_of(spark, tmp_path)
    rows = [("a", DAY, 0.1), ("b", DAY + datetime.timedelta(days=1), 0.2)]
    store.update(spark.createDataFrame(rows, RETS))
    assert [(r.n, r.pearson) for r in store.rows().collect()] == [(0, None)]
    assert {x[0] for x in statuses(store.update(spark.createDataFrame(rows, RETS))).values()} == {"kept"}
    with pytest.raises(ValueError):
        pair_store.PairStore(spark, str(tmp_path / "small"), most=2).update(spark.createDataFrame(walks("abcd", 3), RETS))


def test_store_answers_selections(spark, tmp_path):
    store, rows = store_of(spark, tmp_path), walks("abcdefgh")
    store.update(spark.createDataFrame(rows, RETS))
    ids = identity.series_ids(spark.createDataFrame([(n, d, x * 2 if n == "e" else x) for n, d, x in rows + walks("z")], RETS)).select("listing", "series_id")
    view = store.selected(ids.filter("listing IN ('a', 'e', 'z')"))
    assert {(r.left, r.right): r.status for r in view.collect()} == {("a", "e"): "stale", ("a", "z"): "missing", ("e", "z"): "missing"}
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert any("bucket" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:])
    # a and e are in bucket 0 and z in none, so that no other bucket is opened.
    for part in (tmp_path / "store" / "pairs").glob("*/bucket=[123]/*.parquet"):
        part.with_name(f".{part.name}.crc").unlink()
        part.write_bytes(b"not read")
    assert store.selected(ids.filter("listing IN ('a', 'e', 'z')")).count() == 3
    with pytest.raises(ValueError, match="a/e .stale."):
        store.statistics_of(ids.filter("listing IN ('a', 'e')"))
    assert store.statistics_of(ids.filter("listing IN ('a', 'h')")).count() == 1


def test_edges_of_stale_buckets_go(spark, tmp_path):
    path = str(tmp_path / "edges")
    numbers = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "listing string, number long")
    schema = "left string, right string, pearson double"
    pair_store.write_edges(spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8)], schema), numbers, path, "1", "pearson", 2)
    pair_store.write_edges(spark.createDataFrame([("b", "c", 0.8)], schema), numbers, path, "1", "spearman", 2)
    assert len({f.rsplit("/", 1)[0] for f in files_of(spark, path)}) == 3
    pair_store.write_edges(spark.createDataFrame([("b", "c", 0.7)], schema), numbers, path, "1", "pearson", 2)
    assert {f.rsplit("/", 1)[0] for f in files_of(spark, path)} == {"version=1/metric=pearson/bucket=1", "version=1/metric=spearman/bucket=1"}


# ---------------------------------------------------------------- content ids
def test_ids_depend_on_content_alone(spark):
    d = spark.createDataFrame(walks("abc"), RETS)
    p = pairs.aligned(d)
    turned = p.select(F.col("right").alias("left"), F.col("left").alias("right"), "date", F.col("y").alias("x"), F.col("x").alias("y"))
    one = {tuple(r) for r in identity.alignment_ids(p).collect()}
    assert one == {tuple(r) for r in identity.alignment_ids(turned.repartition(7)).collect()} and len({r[3] for r in one}) == 3
    more = d.union(spark.createDataFrame([("a", DAY + datetime.timedelta(days=99), 0.5)], RETS))
    ids = lambda x: {r.listing: r.series_id for r in identity.series_ids(x).collect()}
    a, b = ids(d), ids(more)
    assert a["a"] != b["a"] and a["b"] == b["b"] and ids(d.union(d.limit(1)))["a"] != a["a"]
    assert identity.canonical_json({"b": 1, "a": [1, "ü"]}) == '{"a":[1,"ü"],"b":1}'


def test_artifacts_of_equal_series_are_refused(spark):
    d = spark.createDataFrame([(n, x, r) for n in "ab" for _, x, r in walks("q")], RETS)
    with pytest.raises(Exception, match="same returns"):
        identity.artifact_ids(identity.alignment_ids(pairs.aligned(d)), identity.series_ids(d)).collect()


def test_members_are_a_set(spark):
    rows = [("x", "B"), ("x", "A"), ("x", " A "), ("x", ""), ("x", None), ("y", "A"), ("y", "B")]
    got = {r.selection: (r.members, r.membership_id) for r in identity.membership_ids(spark.createDataFrame(rows, "selection string, member string")).collect()}
    assert got["x"] == got["y"] and got["x"][0] == 2 and got["x"][1].startswith("members-")


# ---------------------------------------------------------------- resumed work
def test_work_is_resumed_after_its_data(spark, tmp_path, monkeypatch):
    work = resume.Resumable(spark, str(tmp_path / "work"), "listing string, twice long")
    inputs = spark.createDataFrame([("a", "1"), ("b", "1")], "listing string, content string")
    build = lambda todo: todo.select("listing", (F.ascii("listing") * 2).cast("long").alias("twice"))

    def cut_off(self, todo, attempt):
        raise OSError("cut off")

    with monkeypatch.context() as m:
        m.setattr(resume.Resumable, "_publish", cut_off)
        with pytest.raises(OSError):
            work.run(inputs, build)
    assert work.outputs().count() == 0 and files_of(spark, f"{work.path}/data")
    assert work.run(inputs, build) == 2 and work.run(inputs, build) == 0
    want = {("a", 194), ("b", 196)}
    assert {tuple(r) for r in work.outputs().collect()} == want and work.outputs().count() == 2
    assert work.vacuum() == 1 and {tuple(r) for r in work.outputs().collect()} == want
    more = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1")], "listing string, content string")
    assert {r.listing for r in work.pending(more).collect()} == {"a", "c"}
    assert work.run(more, build) == 2 and work.outputs().count() == 3


def test_snapshots_tell_what_changed(spark):
    rows = [("a", DAY), ("b", DAY), ("b", DAY + datetime.timedelta(days=1))]
    got = {r.listing: r.content for r in resume.snapshot(spark.createDataFrame(rows, "listing string, date date")).collect()}
    assert got == {"a": "2020-01-01|2020-01-02|2", "b": "2020-01-02|2020-01-02|2"}


# ---------------------------------------------------------------- segments
def test_segments_are_written_once_and_checked(spark, tmp_path):
    root = str(tmp_path / "segments")
    d = spark.createDataFrame([(k, f"v{k}", None) for k in range(50)], "id long, value string, note string")
    first = segments.publish(d, root, "p", "daily")
    files = files_of(spark, root)
    second = segments.publish(d.union(d).repartition(5), root, "p", "daily")
    assert (first["written"], second["written"]) == (True, False) and files_of(spark, root) == files
    assert second["segment_id"] == first["segment_id"] and first["row_count"] == 50
    assert segments.publish(d, root, "p", "weekly")["segment_id"] != first["segment_id"]
    assert segments.read(spark, root, first).count() == 50
    at = f"{root}/p/daily/{first['segment_id']}"
    d.withColumn("value", F.when(F.col("id") == 7, "other").otherwise(F.col("value"))).write.mode("overwrite").parquet(at)
    with pytest.raises(ValueError, match="aren't those"):
        segments.read(spark, root, first)
    with pytest.raises(ValueError):
        segments.publish(d.limit(0), root, "p", "daily")


def test_a_changed_byte_is_found(spark, tmp_path):
    root = str(tmp_path / "segments")
    m = segments.publish(spark.createDataFrame([(k, f"value {k}") for k in range(200)], "id long, value string").coalesce(1), root, "p", "d")
    [part] = (tmp_path / "segments" / "p" / "d" / m["segment_id"]).glob("*.parquet")
    data = bytearray(part.read_bytes())
    data[len(data) // 3] ^= 0x55
    part.write_bytes(bytes(data))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        segments.read(spark, root, m)


def test_files_without_a_manifest_are_replaced(spark, tmp_path):
    root = str(tmp_path / "segments")
    d = spark.createDataFrame([(1,)], "id long")
    m = segments.publish(d, root, "p", "d")
    (tmp_path / "segments" / "p" / "d" / f"{m['segment_id']}.json").unlink()
    assert not exists(spark, f"{root}/p/d/{m['segment_id']}.json")
    assert segments.publish(d, root, "p", "d")["written"] and segments.read(spark, root, m).count() == 1


# ---------------------------------------------------------------- blocks, rebalancing, constraints
def test_block_products_equal_joined_rows(spark):
    rows = walks([f"l{k}" for k in range(23)], days=30) + [("flat", DAY + datetime.timedelta(days=k), 0.5) for k in range(30)] + [("once", DAY, 0.1)]
    d, want = spark.createDataFrame(rows, RETS), expected(spark, rows)
    for n in (1, 4):
        got = {(r.left, r.right): r for r in blocks.moments(d, blocks=n).collect()}
        assert set(got) == set(want)
        assert all(got[k].n == want[k].n and all(math.isclose(got[k][c], want[k][c], rel_tol=1e-9, abs_tol=1e-13) for c in ("pearson", "covariance", "left_variance", "right_variance", "beta_left")) for k in want)
    some = spark.createDataFrame([("l1", "l2"), ("flat", "l3")], "left string, right string")
    assert {(r.left, r.right) for r in blocks.statistics(d, only=some).collect()} == {("l1", "l2"), ("flat", "l3")}
    isins = d.withColumn("isin", F.when(F.col("listing").isin("l1", "l2"), "same").otherwise(F.col("listing")))
    assert ("l1", "l2") not in {(r.left, r.right) for r in blocks.moments(isins, blocks=2).collect()}
    assert blocks.moments(d.limit(0)).count() == 0


def test_rebalance_with_an_absent_listing(spark):
    m = spark.createDataFrame([("a", DAY, 0.1), ("b", DAY, -0.02), ("a", DAY + datetime.timedelta(days=1), 0.05)], "listing string, date date, simple double")
    w = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.5), ("q", "a", 0.4), ("q", "b", 0.4)], "portfolio string, listing string, weight double")
    events, rows = portfolio.rebalance_events(m, w, "month")
    e = {(r.portfolio, r.date): r for r in events.collect()}
    assert math.isclose(e["p", DAY].portfolio_value, 1.04) and math.isclose(e["p", DAY].turnover, 0.028846153846, abs_tol=1e-9)
    last = DAY + datetime.timedelta(days=1)
    assert math.isclose(e["p", last].portfolio_value, 1.066) and math.isclose(e["p", last].post_cost_return, 0.025) and not e["p", last].rebalanced
    assert math.isclose(e["q", DAY].cash_remainder, 0.832 * 0.2)
    r = {(x.portfolio, x.listing, x.date): x for x in rows.collect()}
    assert math.isclose(r["p", "a", DAY].target_value, 0.52) and math.isclose(r["p", "a", DAY].trade_value, -0.03, abs_tol=1e-12)
    assert math.isclose(r["p", "b", last].pre_trade_value, 0.52) and r["p", "b", last].trade_value == 0
    with pytest.raises(ValueError):
        portfolio.rebalance_events(m, w, "week")


def test_limits_and_bounded_grids(spark):
    for bad in ({"min_weight": -0.1}, {"max_weight": 0}, {"min_weight": 0.5, "max_weight": 0.4}, {"min_coverage": 0}):
        with pytest.raises(ValueError):
            constraints.Limits(**bad)
    got = {tuple(r.candidate) for r in portfolio.grid(spark, ["a", "b", "c"], 10, low=2, high=5).collect()}
    assert got == {(a, b, 10 - a - b) for a in range(2, 6) for b in range(2, 6) if 2 <= 10 - a - b <= 5} and len(got) == portfolio.grid_size(3, 10, 2, 5)
    cov = spark.createDataFrame([(f"l{i}", f"l{j}", 0.01 * (i == j)) for i in range(30) for j in range(30)], "left string, right string, covariance double")
    means = spark.createDataFrame([(f"l{i}", 0.0) for i in range(30)], "listing string, mean double")
    [r] = constraints.optimized(cov, means, "min_variance", constraints.Limits(max_weight=0.9)).collect()
    assert r.status == "fallback_equal_weight" and math.isclose(r.variance, 0.01 / 30)
    [r] = constraints.optimized(cov, means, "min_variance", constraints.Limits(max_weight=0.03)).collect()
    assert r.status == "infeasible"


def test_selected_partitions_are_pruned(spark, tmp_path):
    """A selection join on a table stored by its key reads the selection's partitions alone."""
    from quartzfolio.sources.tables import pruned, write_rows

    path = str(tmp_path / "quotes")
    write_rows(spark.range(400).select((F.col("id") % 20).alias("listing"), "id"), path, ("listing",))
    members = spark.range(20).filter("id IN (3, 7)").select(F.col("id").alias("listing"))
    table = read_rows(spark, path, "id long, listing long")
    d = pruned(table, members, ["listing"])
    assert d.count() == 40
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    scan = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "listing" in scan


def test_answers_that_fail_leave_others_alone(spark, tmp_path):
    from quartzfolio.operators import ingest

    texts = ['[{"date": "2020-01-02", "value": 1.5}, {"date": "2021-01-02", "value": 2}]', '[{"date": "2020-13-02", "value": 1}]', '[{"value": 1}]', '{"error": "no"}', '[{"date": "2020-01-02"', None, "[]", '[{"date": "2020-01-03", "value": null}]']
    schema = "run_id string, isin string, exchange string, code string, endpoint string, payload string"
    payloads = lambda run, some: spark.createDataFrame([(run, f"I{k}", "X", "C", "e", t) for k, t in some], schema)
    rows, errors = ingest.parsed_payloads(payloads("1", enumerate(texts)))
    assert {(r.isin, str(r.date), r.value, r.year) for r in rows.collect()} == {("I0", "2020-01-02", 1.5, 2020), ("I0", "2021-01-02", 2.0, 2021), ("I7", "2020-01-03", None, 2020)}
    assert {(r.isin, r.error_type) for r in errors.collect()} == {("I1", "invalid_date"), ("I2", "invalid_date"), ("I3", "malformed_payload"), ("I4", "malformed_payload"), ("I5", "malformed_payload")}
    path = str(tmp_path / "answers")
    ingest.merge_years(rows, path)
    before = files_of(spark, path)
    ingest.merge_years(ingest.parsed_payloads(payloads("2", [(0, '[{"date": "2020-01-02", "value": 9}]')]))[0], path)
    got = read_rows(spark, path, "run_id string, isin string, code string, date date, value double, exchange string, year int")
    assert {(r.isin, str(r.date), r.value) for r in got.collect()} == {("I0", "2020-01-02", 9.0), ("I0", "2021-01-02", 2.0), ("I7", "2020-01-03", None)}
    assert {f for f in files_of(spark, path) if "year=2021" in f} == {f for f in before if "year=2021" in f}


def test_equal_orders_are_decided_by_the_row(spark):
    from quartzfolio.operators import ingest

    rows = [("I", "X", "C", DAY, 1.0, 1.0, 1.0, c, c, 5, "EUR", 1) for c in (2.0, 3.0)]
    schema = "isin string, exchange string, code string, date date, open double, high double, low double, close double, adjusted_close double, volume long, currency string, seq long"
    for order in (rows, rows[::-1]):
        assert [r.close for r in ingest.normalized_quotes(spark.createDataFrame(order, schema), "seq").collect()] == [3.0]


def test_stress_windows_of_two_portfolios(spark):
    rows = [(p, datetime.date(2024, 1, 1 + k), x) for p, xs in (("a", (0.1, -0.2, -0.1, 0.05, -0.3)), ("b", (-0.5, 0.0, 0.1, 0.1, 0.1)), ("few", (0.1, -0.9))) for k, x in enumerate(xs)]
    d = spark.createDataFrame(rows, "portfolio string, date date, r double")
    got = {r.portfolio: r for r in portfolio.stress_windows(d, 3).collect()}
    assert set(got) == {"a", "b"} and got["a"].start == datetime.date(2024, 1, 3) and got["a"].until == datetime.date(2024, 1, 5)
    assert abs(got["a"].compounded - (0.9 * 1.05 * 0.7 - 1)) < 1e-9 and abs(got["a"].max_drawdown - (0.9 * 1.05 * 0.7 - 1)) < 1e-9
    assert got["b"].start == datetime.date(2024, 1, 1) and abs(got["b"].max_drawdown + 0.5) < 1e-9 and abs(got["b"].value_at_risk - 0.5) < 1e-9 and got["b"].tail_count == 1
    assert portfolio.stress_windows(d.limit(0), 3).count() == 0


def test_covariance_summary(spark):
    cov = spark.createDataFrame([("x", "x", 0.04), ("x", "y", 0.0), ("y", "x", 0.0), ("y", "y", 0.04)], "left string, right string, covariance double")
    weights = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "listing string, weight double")
    r = portfolio.covariance_summary(cov, weights).first()
    assert (r.listing_count, r.pair_count, r.average_covariance, r.average_correlation) == (2, 1, 0.0, 0.0)
    assert abs(r.volatility - 0.02**0.5) < 1e-12 and abs(r.diversification_ratio - 2**0.5) < 1e-12 and abs(r.effective_bets - 2) < 1e-12 and abs(r.largest_risk_share - 0.5) < 1e-12
    none = portfolio.covariance_summary(cov.withColumn("covariance", F.lit(0.0)), weights).first()
    assert none.volatility == 0 and none.average_correlation is None and none.effective_bets is None

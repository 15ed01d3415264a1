"""What a date may know, faults of inner nodes, content hashes, and tables that are written once."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quantpanel import queries
from quantpanel.operators import diagnostics as D
from quantpanel.operators import panel as P
from quantpanel.operators import quality as Q
from quantpanel.plans import journal as J
from quantpanel.plans import research as G
from quantpanel.plans.candidates import signals
from quantpanel.sources import tables

SF = "/root/testdata/sf0.001"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


@pytest.fixture(scope="module")
def ledger_rows():
    rng = random.Random(4)
    return [(run, day(7 * i), None if rng.random() < 0.1 else day(7 * i + rng.choice([-9, 0, 7, 30, 90])), rng.choice("abc"), rng.choice(["PASS", "FAIL", "FAIL", "NUMERICAL_REJECT"]), rng.random()) for run in ("r1", "r2") for i in range(40)]


@pytest.fixture(scope="module")
def ledger(spark, ledger_rows):
    df = spark.createDataFrame(ledger_rows, "run_id string, research_date date, oos_end date, candidate_id string, label string, oos_value double")
    return df.withColumns({"expression_hash": F.col("candidate_id"), "context": F.lit("c")}).cache()


def visible(rows, run, date):
    return sorted((r for r in rows if r[0] == run and r[2] is not None and r[2] <= date and r[1] < date), key=lambda r: r[1])


def test_visible_priors_equal_the_join(spark, ledger, ledger_rows):
    got = {(r.run_id, r.research_date, r.prior_date, r.prior_end, r.prior_candidate, r.prior_label) for r in G.visible_priors(ledger, ["run_id"]).collect()}
    assert got == {(run, d, p[1], p[2], p[3], p[4]) for run, d, *_ in ledger_rows for p in visible(ledger_rows, run, d)} and len(got) > 500
    plan = G.visible_priors(ledger, ["run_id"])._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_latest_failures_are_the_last_ones(spark, ledger, ledger_rows):
    got = {}
    for r in G.latest_failures(ledger, 3, ["run_id"]).collect():
        got.setdefault((r.run_id, r.research_date), {})[r.age] = r.prior_date
    for run, d, *_ in ledger_rows:
        failed = [p[1] for p in visible(ledger_rows, run, d) if p[4] == "FAIL"][::-1][:3]
        assert got.get((run, d), {}) == {i + 1: p for i, p in enumerate(failed)}


def test_lessons_as_they_stood_on_any_day(spark, ledger, ledger_rows):
    history = J.lesson_history(ledger).cache()
    for n in range(-10, 400, 13):
        got = {(r.expression_hash, r.won): (r.n_seen, r.oos_value) for r in J.known_lessons(history, str(day(n))).collect()}
        expected = {}
        for r in sorted((r for r in ledger_rows if r[2] is not None and r[2] <= day(n) and r[4] in ("PASS", "FAIL")), key=lambda r: (r[1], r[0])):
            key = (r[3], r[4] == "PASS")
            expected[key] = (expected.get(key, (0,))[0] + 1, r[5])
        assert got == expected


def small_panel(spark, close):
    rows = [(day(i), s, float(v)) for s, values in close.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "dt date, symbol string, close double")
    return df.select("dt", "symbol", "close", *((F.col("close") * k).alias(n) for n, k in (("open", 1.0), ("high", 1.1), ("low", 0.9), ("vwap", 1.0))), F.lit(3.0).alias("volume"), F.lit(0.01).alias("returns"))


@pytest.mark.parametrize("shape, final, faulty", [("raw", "rank", False), ("raw", "zscore", True), ("raw", "scale", False), ("raw", "demean", False), ("deviation", "rank", True), ("corr", "rank", True), ("baseline_mean", "rank", False)])
def test_infinite_dispersion_is_a_fault_and_a_mean_is_none(spark, shape, final, faulty):
    panel = small_panel(spark, {s: [1e200 * (k + 1) * (i % 3 + 1) for i in range(8)] for k, s in enumerate("ab")})
    row = ("x", shape, "close", "volume" if shape == "corr" else None, 3, 3, final, [], 1)
    cells = signals(panel, [row], faults=True)
    assert (cells.where("fault").count() > 0) == faulty
    outcome = Q.admission(cells, str(day(0)), str(day(9))).first().outcome
    assert (outcome == "NUMERICAL_NONFINITE") == faulty


def test_an_infinite_scale_is_a_fault(spark):
    panel = small_panel(spark, {s: [1.5e308] * 3 for s in "ab"})
    assert signals(panel, [("x", "raw", "close", None, 0, 0, "scale", [], 1)], faults=True).where("fault").count() == 6


def test_fingerprints_ignore_order_and_tell_values_apart(spark):
    rows = [("a", 1.5, day(1)), ("b", None, None), ("a", float("nan"), day(2)), ("é|", 1e300, day(3)), ("a", float("-inf"), day(1))]
    of = lambda rows: P.fingerprint(spark.createDataFrame(rows, "s string, x double, d date"), ["s", "x", "d"]).first()
    whole = of(rows)
    assert of(rows[::-1]) == whole and whole.rows == 5
    for i, changed in enumerate([("a", 1.6, day(1)), ("b", 0.0, None), ("a", None, day(2)), ("é|", 2e300, day(3)), ("a", float("inf"), day(1))]):
        assert of([*rows[:i], changed, *rows[i + 1 :]]).version != whole.version
    assert of([rows[0], *rows]).version != whole.version and of([]) != of(rows[:1])


def test_a_proxy_is_judged_by_other_words(spark):
    prose = [("1", ["vwap"], "the volume-weighted flow", "source"), ("2", ["vwap"], "the volume-weighted flow", "hlc3"), ("3", ["vwap"], "a midpoint of the bar", "hlc3"), ("4", ["vwap"], "a midpoint of the bar", "source"), ("5", ["close"], "price and dollar volume", "hlc3"), ("6", ["vwap"], None, None)]
    df = spark.createDataFrame(prose, "candidate_id string, fields array<string>, text string, vwap_source string")
    assert {r.candidate_id for r in D.unmentioned_fields(df).collect()} == {"2", "4", "6"}
    assert {r.candidate_id: r.claims for r in D.volume_claims(df).collect()} == {"1": [], "2": ["volume-weight"], "3": [], "4": [], "5": [], "6": []}
    assert [r.candidate_id for r in D.vwap_warnings(df).collect()] == ["2"]
    assert {r.candidate_id for r in D.unmentioned_fields(df.drop("vwap_source")).collect()} == {"1", "2", "6"}


def test_the_panel_reads_trades_once(spark):
    plan = queries.QUERIES["p5_panel"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("l_shipdate|p_brand|lineitem", re.sub(r"lineitem\(vwap=", "", plan))


def test_written_tables_follow_their_input_and_can_be_cleared(spark, tmp_path):
    for name in ("lineitem", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(50).write.parquet(f"{tmp_path}/{name}.parquet")
    first = tables.version(spark, str(tmp_path), "lineitem", "part")
    assert first == tables.version(spark, str(tmp_path), "lineitem", "part")
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(60).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert first != tables.version(spark, str(tmp_path), "lineitem", "part")
    kept = tables.written(spark.range(5))
    assert kept.count() == 5
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    tables.clear(spark)
    queries.DAILY.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

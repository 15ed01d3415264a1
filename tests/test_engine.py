"""Replay, metrics, windows, verdicts, ingest and journal on hand-made tables."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantpanel.operators import metrics as M
from quantpanel.operators import panel as P
from quantpanel.operators import portfolio as B
from quantpanel.operators import windows as V
from quantpanel.plans import journal as J
from quantpanel.plans import research as G
from quantpanel.schema import Config
from quantpanel.sources import bars as S

RETURNS = [0.010, -0.020, 0.030, -0.010, 0.020, 0.005, -0.015, 0.025]


def daily(spark, returns, gross=1.0):
    days = pd.bdate_range("2020-01-01", periods=len(returns))
    return spark.createDataFrame([("c", d.date(), float(r), 0.1, float(g)) for d, r, g in zip(days, returns, np.broadcast_to(gross, len(returns)))], "candidate_id string, dt date, ret double, turnover double, gross double")


def one(spark, returns, gross=1.0, **config):
    return M.metrics(daily(spark, returns, gross), ["candidate_id"], Config(**config)).first()


def test_metrics_of_a_known_vector(spark):
    m = one(spark, RETURNS)
    nav = np.cumprod(1 + np.array(RETURNS))
    assert m.cagr == m.ann_return == pytest.approx(nav[-1] ** (52 / 8) - 1)
    assert m.hit_rate == 5 / 8 and m.n == m.n_active == 8
    path = np.concatenate([[1], nav])
    assert m.maxdd == pytest.approx((path / np.maximum.accumulate(path) - 1).min())
    ex = np.array(RETURNS) - 0.02 / 52
    assert m.sharpe == pytest.approx(ex.mean() / np.std(RETURNS, ddof=1) * 52**0.5)
    assert m.sortino == pytest.approx(ex.mean() / np.sqrt((np.minimum(ex, 0) ** 2).mean()) * 52**0.5)
    assert M.baseline(daily(spark, RETURNS), ["candidate_id"]).count() == 9


def test_metric_edges(spark):
    assert one(spark, [0.01]).sharpe is None and one(spark, [0.01]).n == 1
    win = one(spark, [0.004] * 40)
    assert win.sortino == win.calmar == math.inf
    idle = one(spark, [0.004] * 40, 0.0)
    assert idle.sortino is None and idle.n_active == 0
    part = one(spark, [0.001] * 40, [1.0] * 10 + [0.0] * 30)
    assert (part.n, part.n_active, part.avg_gross) == (40, 10, 0.25)
    assert one(spark, [0.1, -1.0, 0.1]).cagr is None


@pytest.fixture(scope="module")
def market(spark):
    """Six symbols whose daily returns reverse: autocorrelation -0.5; open is the close before."""
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2015-01-01", "2019-12-31")
    r = np.zeros((len(days), 6))
    for t in range(1, len(days)):
        r[t] = -0.5 * r[t - 1] + rng.normal(0, 0.01, 6)
    close = 100 * np.cumprod(1 + r, axis=0)
    rows = [(d.date(), f"S{j}", float(close[i - 1, j] if i else close[0, j]), float(close[i, j]), 1.0) for i, d in enumerate(days) for j in range(6)]
    df = spark.createDataFrame(rows, "dt date, symbol string, open double, close double, volume double")
    return P.with_derived(df.withColumns({"high": F.greatest("open", "close"), "low": F.least("open", "close"), "vwap": F.col("close")})).cache()


def ledger_loop(w, x, g, rate):
    """Shares and cash, bar by bar."""
    value, held, out = 1.0, np.zeros(w.shape[1]), []
    for t in range(len(w)):
        start = value
        cash = value - held.sum()
        held = held * g[t]
        value = held.sum() + cash
        traded = np.abs(w[t] * value - held).sum()
        cost = rate * traded
        held = w[t] * value
        cash = value - held.sum() - cost
        held = held * (1 + x[t])
        out.append((held.sum() + cash) / start - 1)
        value = held.sum() + cash
    return np.array(out)


def test_replay_equals_a_share_and_cash_loop(spark, market):
    signal = market.select(F.lit("c").alias("candidate_id"), "dt", "symbol", (-F.col("returns")).alias("value"))
    book = B.weights(signal, Config())
    got = B.replay(book, market, 3.0).orderBy("dt").toPandas()
    w = book.toPandas().pivot(index="dt", columns="symbol", values="w").to_numpy()
    m = market.toPandas()
    o, c = (m.pivot(index="dt", columns="symbol", values=k).to_numpy() for k in ("open", "close"))
    g = np.vstack([np.ones(6), o[1:] / c[:-1]])
    np.testing.assert_allclose(got["ret"], ledger_loop(w, c / o - 1, g, 3e-4), atol=1e-7)
    np.testing.assert_allclose(got["gross"].iloc[2:], 1.0)
    assert (got["turnover"].iloc[3:] > 0).all()
    free = B.replay(book, market, 0.0).orderBy("dt").toPandas()
    np.testing.assert_allclose(free["ret"], ledger_loop(w, c / o - 1, g, 0), atol=1e-12)


def test_planted_edge_passes_and_flat_prices_fail(spark, market):
    config = Config(periods_per_year=252, oos_bars=120, pass_line=0.5, cost_bps=0)
    signal = market.select(F.lit("c").alias("candidate_id"), "dt", "symbol", (-F.col("returns")).alias("value"))
    dates = spark.createDataFrame([(dt.date(2018, 1, 1),)], "research_date date")
    windows = V.research_windows(dates, market.select("dt").distinct(), config)
    judge = lambda s, m: V.verdicts(G.scored(B.replay(B.weights(s, config), m), windows, config), config).first()
    won = judge(signal, market)
    assert won.label == "PASS" and won.reasons == []
    flat = judge(signal.withColumn("value", F.lit(1.0)), market)
    assert flat.label == "FAIL" and any("inactive" in r for r in flat.reasons)
    honest = B.replay(B.weights(signal, config), market).agg(F.sum("ret")).first()[0]
    cheat = B.unlagged_return(market.select(F.lit("c").alias("candidate_id"), "dt", "symbol", F.col("returns").alias("value")), market).agg(F.sum("cheat")).first()[0]
    assert cheat > 1.5 * honest


def test_oos_starts_after_is(spark, market):
    config = Config(oos_bars=10)
    w = V.research_windows(V.schedule(spark, "2017-01-01", "2018-12-31", "QS"), market.select("dt").distinct(), config).toPandas()
    assert len(w) == 8 and (w["oos_start"] > w["is_end"]).all() and (w["oos_end"].iloc[:-1].to_numpy() < w["research_date"].iloc[1:].to_numpy()).all()


def test_schedules(spark):
    dates = lambda alias: [str(r[0]) for r in V.schedule(spark, "2020-01-01", "2020-12-31", alias).orderBy("research_date").collect()]
    assert dates("QS") == ["2020-01-01", "2020-04-01", "2020-07-01", "2020-10-01"] and dates("2QS") == ["2020-01-01", "2020-07-01"]
    assert dates("6MS") == ["2020-01-01", "2020-07-01"] and dates("QE")[-1] == "2020-12-31" and len(dates("13W")) == 4
    for bad in ("M", "-1QS", "H", ""):
        with pytest.raises(ValueError):
            V.frequency(bad)


def test_top_k_keeps_at_most_k_a_side(spark, market):
    signal = market.select(F.lit("c").alias("candidate_id"), "dt", "symbol", F.col("returns").alias("value"))
    book = B.weights(signal, Config(selection="top_k", top_k=1))
    assert book.where("w <> 0").groupBy("dt").count().agg(F.max("count")).first()[0] == 2
    assert book.groupBy("dt").agg(F.sum(F.abs("w")).alias("g")).agg(F.max("g")).first()[0] == pytest.approx(1.0)


def test_vwap_is_all_or_nothing(spark):
    rows = [(dt.date(2020, 1, 1), s, 1.0, 3.0, 1.0, 2.0, 1.0, v) for s, v in (("A", 5.0), ("B", None))]
    df = spark.createDataFrame(rows, "dt date, symbol string, open double, high double, low double, close double, volume double, vwap double")
    assert {(r.vwap, r.vwap_source) for r in P.with_vwap(df).collect()} == {(2.0, "hlc3")}
    assert {r.vwap_source for r in P.with_vwap(df.where("symbol = 'A'")).collect()} == {"source"}
    with pytest.raises(ValueError):
        P.missing_symbols(spark.createDataFrame([("Z",)], "symbol string"), df)


def test_delisting_reads_only_the_past(spark):
    days = pd.bdate_range("2020-01-01", periods=7)
    rows = [(d.date(), "A", 1.0 + i if i < 4 else None, 2.0 + i if i < 4 else None) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "dt date, symbol string, open double, close double")
    whole, part = (B.settle_delisted(x).orderBy("dt").toPandas() for x in (df, df.where(F.col("dt") <= days[4].date())))
    assert whole["settled"].tolist() == [False] * 4 + [True, False, False] and whole["close"][4] == 5.0
    pd.testing.assert_frame_equal(whole.iloc[:5], part)


def test_corrupt_ledger_lines_are_split_off(spark, tmp_path):
    path = tmp_path / "ledger"
    path.mkdir()
    (path / "a.json").write_text('{"run_id": "a", "n": 1}\n{"run_id": "b", "n"\n{"run_id": "c", "n": 3}\n')
    good, bad = S.read_ledger(spark, str(path), spark.createDataFrame([("a", 1)], "run_id string, n long").schema)
    assert {r.run_id for r in good.collect()} == {"a", "c"} and bad.count() == 1


def test_wide_round_trip(spark):
    df = spark.createDataFrame([("2020-01-01", 1.0, "x", 2.0)], "Datetime string, AA_B_Close double, C_Close string, C_Open double")
    got = {r.symbol: r for r in P.from_wide(df).collect()}
    assert got["AA_B"].close == 1.0 and got["C"].close is None and got["C"].open == 2.0


def test_journal(spark):
    row = "research_date date, candidate_id string, label string, reasons array<string>, oos_end date, oos_value double, expression_hash string, context string, run_id string, ops array<string>"
    d = dt.date
    led = spark.createDataFrame([
        (d(2020, 1, 1), "f", "FAIL", ["OOS 1.5 fails (>= 2)"], d(2020, 6, 1), 1.5, "h", "c", "r1", ["rank", "rank"]), (d(2021, 1, 1), "f", "FAIL", ["OOS 0.5 fails (>= 2)"], None, 0.5, "h", "c", "r2", ["rank"]),
        (d(2020, 1, 1), "g", "PASS", [], d(2020, 6, 1), 3.0, "i", "c", "r1", ["rank", "sub"]), (d(2020, 1, 1), "x", "NUMERICAL_REJECT", [], None, None, "j", "c", "r1", []),
    ], row)
    lessons = {r.formula: r for r in J.lessons(led).collect()}
    assert set(lessons) == {"f", "g"} and lessons["f"].n_seen == 2 and lessons["f"].oos_end is None and lessons["f"].oos_value == 0.5
    assert lessons["f"].modes == ["OOS # fails (>= #)"]
    assert [r.formula for r in J.as_of(J.lessons(led), "2020-12-31").collect()] == ["g"]
    assert {(r.op, r.won, r.lost) for r in J.operator_usage(led).collect()} == {("rank", 1, 2), ("sub", 1, 0)}
    assert J.failure_modes(led).first().n == 2


def test_redaction(spark):
    texts = ["key sk-abcdefghijklmnop end", "Authorization: Bearer abcdefghijkl", "password=hunter22, ok", "token expired", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(J.redact(F.col("t"))).collect()]
    assert got == ["key <redacted> end", "Authorization: Bearer <redacted>", "password=<redacted>, ok", "token expired", None]


def test_results_differ_where_values_do(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, nan, "x"), (2, 1.0, "y"), (3, 1.0, "z")], "research_date int, v double, s string")
    b = spark.createDataFrame([(1, nan, "x"), (2, 2.0, "y")], "research_date int, v double, s string")
    assert {r.research_date: r.unequal for r in J.differences(a, b, ["v", "s"]).collect()} == {2: ["v"], 3: ["missing right"]}


def test_stream_equals_batch(spark, tmp_path):
    from quantpanel.sources.tables import event_bars, table
    from quantpanel.streaming.bars import stream_bars

    src = "/root/testdata/sf0.001"
    trades = table(spark, src, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    trades.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_bars(spark.readStream.schema(trades.schema).parquet(str(tmp_path / "in")), ("ts", "event_id"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.symbol, r.dt): (r.open, r.close, r.volume) for r in spark.table("bars").collect()}
    batch = {(r.symbol, r.dt): (r.open, r.close, r.volume) for r in event_bars(spark, src).collect()}
    assert got and all(batch[k] == v for k, v in got.items())


def test_redaction_reaches_nested_values(spark):
    secret = "token=abcdefgh1234"
    df = spark.sql(f"SELECT 1 AS n, '{secret}' AS a, named_struct('x', '{secret}', 'y', 2, 'z', array(named_struct('t', '{secret} /home/someone/f'))) AS b, map('k', '{secret}') AS c, array(array('{secret}')) AS d, CAST(NULL AS struct<x:string>) AS e, array(1, 2) AS f")
    got = J.redact_all(df, home="/home/someone")
    assert got.schema.simpleString() == df.schema.simpleString()
    row = got.first()
    masked = "token=<redacted>"
    assert (row.n, row.a, row.b.x, row.b.y, row.b.z[0].t, row.c, row.d, row.e, row.f) == (1, masked, masked, 2, masked + " ~/f", {"k": masked}, [[masked]], None, [1, 2])


def test_merge_takes_the_later_of_two_rows(spark):
    make = lambda *rows: spark.createDataFrame(rows, "research_date string, formula string, line int")
    old, new = make(("2020", "a", 1), ("2020", "b", 2), ("2021", "c", 3), (None, "d", 4)), make(("2021", "e", 2), ("2021", "f", 1), (None, "g", 3))
    got = sorted((r.research_date or "", r.formula) for r in J.merge_ledgers(old, new, "line").collect())
    assert got == [("", "d"), ("", "g"), ("2020", "b"), ("2021", "e")]
    assert J.merge_ledgers(old, new).where("research_date = '2020'").count() == 1


def test_the_walk_admits_by_inputs_and_rejects_by_cells(spark, market):
    dates = spark.createDataFrame([(dt.date(2018, 1, 1),), (dt.date(2019, 1, 1),)], "research_date date")
    config = Config(pass_line=-100.0, require_profit=False, periods_per_year=252.0, is_years=1, oos_bars=60)
    rows = [("flat", "raw", "volume", None, 0, 0, "rank", ["rank"], 1), ("reversal", "baseline_delay", "close", None, 1, 0, "rank", ["delta", "rank"], 1)]
    plain = {r.research_date.year: (r.candidate_id, r.label) for r in G.walk_forward(market, dates, config, rows).collect()}
    assert plain == {2018: ("reversal", "PASS"), 2019: ("reversal", "PASS")}  # the ranks of equal volumes are all equal: degenerate
    spoil = lambda day: market.withColumn("close", F.when((F.col("dt") == day) & (F.col("symbol") == "S1"), F.lit(float("inf"))).otherwise(F.col("close")))
    late = {r.research_date.year: r for r in G.walk_forward(spoil("2019-02-05"), dates, config, rows).collect()}
    assert late[2018].label == "PASS" and late[2019].label == "NUMERICAL_REJECT" and late[2019].oos_value is None and not late[2019].passed and late[2019].is_value is not None
    early = {r.research_date.year for r in G.walk_forward(spoil("2018-09-05"), dates, config, rows).collect()}
    assert early == {2018}  # in sample of 2019 nothing is left that can be scored
    outcomes = {r.candidate_id: r.outcome for r in G.admissions(spoil("2018-09-05"), "2018-01-01", "2018-12-31", rows).collect()}
    assert outcomes == {"flat": "DEGENERATE_SIGNAL", "reversal": "NUMERICAL_NONFINITE"}

"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quantpanel import queries
from quantpanel.sources import bars

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents conversations".split()
SOME = ["s2_scan", "s5_clean_bars", "s7_wide_to_long", "p5_panel", "p10_bars_month", "c1_rank_close", "t8_ts_rank_w8", "t9_ts_corr_w8", "t11_decay_linear_w20", "t11_decay_linear_w252", "k5_deviation", "m5_node_report", "m6_admission", "m4_dispersion_faults", "m8_signal_hash", "p9_fingerprint", "s9_discover", "v7_frequencies", "s1_load_bars", "s10_ledger", "s12_manifest", "s13_entries", "s14_truncate_trace", "s15_register_signal", "p4_request_order", "m9_genuine_vwap", "j7_context", "j13_stale", "i3_macd", "i4_rsi", "i12_beta", "i12_beta_w252", "i13_momentum_w120", "g4_dead_ends", "g4_spoilt_input", "g5_walk_forward", "g9_numerical_reject", "g6_visible_priors", "g7_latest_failures", "g8_summaries", "g11_history", "v5_verdict", "j3_run_ids", "j9_failure_modes", "j1_merge", "j5_lessons", "j8_lesson_history", "j8_known_lessons", "j12_run_tables", "j12_run_heads", "j18_redact", "b3_top_q", "b5_hold_rebalance", "b10_delisted", "d4_unmentioned", "d5_volume_claims", "d5_vwap_warnings", "j4_conflicts", "j16_differences"]


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 6)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(shown, r)) for r in df.select(*cols).collect()), key=str)
    r = con.execute(queries.SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    assert got == sorted((tuple(shown(x[i]) for i in at) for x in r.fetchall()), key=str)
    assert got


def test_discover_writes_orders_in_parts(spark, tmp_path, monkeypatch):
    """No task writes more than some PART_ROWS orders, and all of them are in the files."""
    monkeypatch.setattr(queries, "PART_ROWS", 200)
    monkeypatch.setattr(queries, "shared_dir", lambda spark: tmp_path.as_uri())
    assert {r.name for r in queries.QUERIES["s9_discover"](spark, SF).collect()} == {r[0] for r in duckdb.sql(queries.SQL["s9_discover"].replace("FROM orders", f"FROM '{SF}/orders.parquet'")).fetchall()}
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderpriority IS NOT NULL")
    files = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/found")
    in_task = files.groupBy(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("task")).count()
    assert in_task.agg(F.max("count")).first()[0] <= 300
    assert sorted(files.select("o_orderkey").collect()) == sorted(orders.select("o_orderkey").collect())


def test_discover_takes_a_folder_of_parts_as_one_file(spark, tmp_path):
    below, name = tmp_path / "below", "Data_5_US_D1.parquet"
    for place in (tmp_path, below, below / "deeper"):
        place.mkdir(exist_ok=True)
        (place / f"Data_{5 + len(place.name)}_XX_D1.parquet").write_bytes(b"12")
    spark.range(4).repartition(4).write.parquet(str(below / name))
    for folder in (str(tmp_path), f"{tmp_path}/", tmp_path.as_uri()):
        got = sorted((r.name, r.path, r.length > 2) for r in bars.discover(spark, folder, ["5"], ["US"]).collect())
        first, second = f"Data_{5 + len(tmp_path.name)}_XX_D1.parquet", "Data_10_XX_D1.parquet"
        assert got == sorted([(first, f"file:{tmp_path}/{first}", False), (second, f"file:{below}/{second}", False), (name, f"file:{below}/{name}", True)])


def test_every_query_with_sql_is_registered():
    assert set(queries.SQL) == set(queries.QUERIES) and len(queries.QUERIES) > 150

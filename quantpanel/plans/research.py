"""Scoring many candidates on many research dates as one job, and what later dates may know of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantpanel.operators import metrics as M
from quantpanel.operators import portfolio as B
from quantpanel.operators import quality as Q
from quantpanel.operators import windows as V
from quantpanel.plans.candidates import CATALOG, catalog, signals
from quantpanel.schema import OBJECTIVES, Config
from quantpanel.sources.tables import written

LATEST_FAILURES = 8


def daily_returns(panel: DataFrame, config: Config, rows=CATALOG) -> DataFrame:
    return B.replay(B.weights(signals(panel, rows), config), panel, config.cost_bps)


def scored(daily: DataFrame, windows: DataFrame, config: Config) -> DataFrame:
    """One row a candidate and research date with is_* and oos_* metrics; windows join at the level of daily rows.

    Both phases come from one aggregate: its rows are folded side by side, so the returns are computed once.
    """
    table = M.metrics(V.in_phases(daily, windows), ("candidate_id", "research_date", "phase"), config)
    side = lambda phase: [F.max(F.when(F.col("phase") == phase, F.col(m))).alias(f"{phase.lower()}_{m}") for m in M.NAMES]
    both = table.groupBy("candidate_id", "research_date").agg(F.bool_or(F.col("phase") == "IS").alias("any_is"), *side("IS"), *side("OOS"))
    return both.where("any_is").drop("any_is")


def eligible(table: DataFrame, config: Config) -> DataFrame:
    """Candidates that were active and had enough live bars in sample."""
    return table.where(M.is_active(F.col("is_avg_gross")) & (F.col("is_n_active") >= config.min_is_bars))


def best(table: DataFrame, config: Config) -> DataFrame:
    """The best in-sample candidate of each date; of equals the earlier in the catalog."""
    higher = next(o[1] for o in OBJECTIVES if o[0] == config.objective)
    good = M.goodness(F.col(f"is_{config.objective}"), F.lit(higher))
    order = Window.partitionBy("research_date").orderBy(good.desc(), "candidate")
    return eligible(table, config).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def dead_ends(admissions: DataFrame) -> DataFrame:
    """Candidates that can't be scored, with the reason."""
    return admissions.where("outcome <> 'ADMITTED'").select("candidate_id", F.col("outcome").alias("reason"))


def walk_forward(panel: DataFrame, dates: DataFrame, config: Config, rows=CATALOG, values: DataFrame | None = None) -> DataFrame:
    """The ledger: for each research date the best admitted candidate with its verdict.

    A candidate is a dead end for a date if its signal can't be scored in sample (see quality.admission; faults of its
    inputs count). Selection reads in-sample figures only, so dates don't depend on one another and need no loop. A chosen
    candidate with a numerical fault out of sample gets NUMERICAL_REJECT and no out-of-sample value; later dates go on.
    `values` are signals with faults, by default those of the catalog; they are evaluated once: each candidate's day, with
    its return and what decides on its signal, is written, and windows read that.
    """
    values = signals(panel, rows, faults=True) if values is None else values
    daily = written(B.replay(B.weights(values.select("candidate_id", "dt", "symbol", "value", "fault"), config, keep=True), panel, config.cost_bps))
    windows = V.research_windows(dates, daily.select("dt").distinct(), config)  # the panel is dense: every date has its row
    known = Q.admission_by_date(daily, windows)
    table = scored(daily, windows, config).join(known.where("outcome = 'ADMITTED'").select("candidate_id", "research_date", "oos_faults"), ["candidate_id", "research_date"])
    chosen = best(table.join(F.broadcast(catalog(panel.sparkSession, rows).select("candidate_id", "candidate", "ops", "expression_hash")), "candidate_id"), config)  # the catalog is a list of the driver's
    return numerical_rejects(V.verdicts(chosen, config)).join(F.broadcast(windows), "research_date")


def numerical_rejects(judged: DataFrame) -> DataFrame:
    """Verdicts with `oos_faults`: where there are any, no value and no pass, but NUMERICAL_REJECT and the reason."""
    fault = F.col("oos_faults") > 0
    reason = F.array(F.concat(F.lit("non-finite values out of sample: "), F.col("oos_faults").cast("string")))
    return judged.withColumns({
        "label": F.when(fault, "NUMERICAL_REJECT").otherwise(F.col("label")), "passed": ~fault & F.col("passed"),
        "oos_value": F.when(~fault, F.col("oos_value")), "reasons": F.when(fault, reason).otherwise(F.col("reasons")),
    })


PRIOR = ("prior_date", "prior_end", "prior_candidate", "prior_label")


def seen_priors(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, research_date, priors): the verdicts that were closed by the date, an array in the order of their dates.

    Verdicts stand at the day when they can be seen (their window has closed, and it is later than their own date), before
    the dates of that day; one sort and one running list over both do what a join by inequality would. A ledger has a row a
    research date; `by` keeps several apart.
    """
    opened = F.greatest("oos_end", F.date_add("research_date", 1))
    prior = F.struct(*(F.col(a).alias(b) for a, b in zip(("research_date", "oos_end", "candidate_id", "label"), PRIOR)))
    events = ledger.where("oos_end IS NOT NULL").select(*by, opened.alias("at"), F.lit(0).alias("kind"), prior.alias("prior"))
    asked = ledger.select(*by, F.col("research_date").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(events.schema["prior"].dataType).alias("prior"))
    so_far = Window.partitionBy(*by).orderBy("at", "kind", "prior").rowsBetween(Window.unboundedPreceding, 0)
    running = events.union(asked).withColumn("priors", F.collect_list("prior").over(so_far))
    return running.where("kind = 1").select(*by, F.col("at").alias("research_date"), F.sort_array("priors").alias("priors"))


def visible_priors(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, research_date, prior_date, ...): a row for each verdict that was closed by the date."""
    return seen_priors(ledger, by).select(*by, "research_date", F.inline("priors"))


def latest_failures(ledger: DataFrame, most: int = LATEST_FAILURES, by: Sequence[str] = ()) -> DataFrame:
    """The `most` latest failures that each date may know, with age (1: the latest)."""
    failed = F.filter("priors", lambda p: p["prior_label"] == "FAIL")
    latest = F.slice(F.reverse(failed), 1, most)
    return seen_priors(ledger, by).select(*by, "research_date", F.posexplode(latest).alias("age", "p")).select(*by, "research_date", "p.*", (F.col("age") + 1).alias("age"))


def summaries(ledger: DataFrame) -> DataFrame:
    """(research_date, candidate_id, kind, detail): wins and failures; a numerical rejection is neither."""
    detail = F.when(F.col("label") == "PASS", F.format_string("%s out of sample %.4f", "objective", "oos_value")).otherwise(F.array_join("reasons", "; "))
    return ledger.where(F.col("label").isin("PASS", "FAIL")).select("research_date", "candidate_id", F.when(F.col("label") == "PASS", "win").otherwise("failure").alias("kind"), detail.alias("detail"))


def pending(dates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Dates still to be done. Raises if the ledger has other dates or more than one data version."""
    off = ledger.join(dates, "research_date", "left_anti").limit(1).count()
    if off or ledger.agg(F.count_distinct("data_version")).first()[0] > 1:
        raise ValueError("the ledger belongs to another schedule or other data")
    return dates.join(ledger, "research_date", "left_anti")


def history(table: DataFrame, objective: str) -> DataFrame:
    """What was tried on each date, in the catalog's order."""
    return table.groupBy("research_date").agg(F.sort_array(F.collect_list(F.struct("candidate", "candidate_id", F.col(f"is_{objective}").alias("is_value")))).alias("iterations"))


def admissions(panel: DataFrame, start: str, end: str, rows=CATALOG) -> DataFrame:
    return Q.admission(signals(Q.truncated(panel, end), rows, faults=True), start, end)

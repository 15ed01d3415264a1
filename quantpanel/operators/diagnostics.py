"""Information coefficient, sign checks and checks of a factor's prose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION = ("candidate_id", "dt")

#: Word stems that count as a mention of a field.
STEMS = {
    "open": ["open"],
    "high": ["high", "range", "intraday"],
    "low": ["low", "range", "intraday"],
    "close": ["clos", "price", "level", "move", "gain", "loss", "rally", "drop", "momentum", "trend", "winner", "loser"],
    "volume": ["volume", "liquid", "turnover", "traded", "trade", "flow", "particip", "activ", "interest"],
    "typical_price": ["typical price", "hlc", "midpoint", "mid-price", "intraday average", "bar average", "fair value"],
    "vwap": ["vwap", "volume-weight", "volume weight", "average price", "execution price"],
    "returns": ["return", "rever", "moment", "drift", "trend", "perform", "gain", "loss", "move", "winner", "loser", "volatil"],
}
#: Phrases that claim a volume term.
VOLUME_CLAIMS = ["volume-weight", "volume weight", "weighted by volume", "volume weighted", "turnover-weight", "turnover weight", "dollar volume", "traded value", "execution price", "execution benchmark", "institutional flow"]
MIN_NAMES, RELIABLE, PROSE_FLOOR = 3, 0.02, 40


def forward_returns(panel: DataFrame) -> DataFrame:
    """(symbol, dt, fwd, fwd_dt): the next bar's return and date on a dense panel."""
    series = Window.partitionBy("symbol").orderBy("dt")
    return panel.select("symbol", "dt", F.lead("returns", 1).over(series).alias("fwd"), F.lead("dt", 1).over(series).alias("fwd_dt"))


def daily_ic(signals: DataFrame, panel: DataFrame, start: str, end: str) -> DataFrame:
    """(candidate_id, dt, ic): Spearman of the signal and the next return; the return's bar must be in the window too."""
    pairs = signals.join(forward_returns(panel), ["symbol", "dt"]).where(F.col("value").isNotNull() & F.col("fwd").isNotNull() & (F.col("dt") >= F.lit(start).cast("date")) & (F.col("fwd_dt") <= F.lit(end).cast("date")))
    section = Window.partitionBy(*SECTION)
    average = lambda c: F.rank().over(section.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*SECTION, c)) - 1) / F.lit(2.0)
    ranked = pairs.withColumns({"rs": average("value"), "rf": average("fwd")})
    by_day = ranked.groupBy(*SECTION).agg(F.count(F.lit(1)).alias("names"), F.covar_samp("rs", "rf").alias("cov"), F.stddev_samp("rs").alias("ss"), F.stddev_samp("rf").alias("sf"))
    return by_day.where((F.col("names") >= MIN_NAMES) & (F.col("ss") > 0) & (F.col("sf") > 0)).select(*SECTION, (F.col("cov") / (F.col("ss") * F.col("sf"))).alias("ic"))


def mean_ic(signals: DataFrame, panel: DataFrame, start: str, end: str) -> DataFrame:
    return daily_ic(signals, panel, start, end).groupBy("candidate_id").agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("days"))


def sign_check(ics: DataFrame, expected: DataFrame) -> DataFrame:
    """Adds contradicts where a reliable mean has another sign than expected_sign."""
    joined = ics.join(F.broadcast(expected), "candidate_id")
    return joined.withColumn("contradicts", (F.abs("ic") >= RELIABLE) & ((F.col("ic") > 0) != (F.col("expected_sign") > 0)))


def is_proxy(prose: DataFrame):
    """Whether the panel that the prose speaks of has no genuine VWAP; one that isn't known has none."""
    return ~F.col("vwap_source").eqNullSafe(F.lit("source")) if "vwap_source" in prose.columns else F.lit(True)


def unmentioned_fields(prose: DataFrame, text: str = "text") -> DataFrame:
    """(candidate_id, field) of factor fields that the prose (candidate_id, fields, text, vwap_source) doesn't mention.

    A VWAP that is a proxy is a typical price: words for one, or its name, are what mentions it.
    """
    known = STEMS | {"vwap proxy": [*STEMS["typical_price"], "vwap"]}
    stems = prose.sparkSession.createDataFrame([(f, s, " " in s or "-" in s) for f, all_of in known.items() for s in all_of], "vocabulary string, stem string, phrase boolean")
    used = prose.select("candidate_id", F.explode("fields").alias("field"), F.lower(text).alias("said"), is_proxy(prose).alias("proxy"))
    used = used.withColumn("vocabulary", F.when((F.col("field") == "vwap") & F.col("proxy"), "vwap proxy").otherwise(F.col("field")))
    joined = used.join(F.broadcast(stems), "vocabulary", "left")  # the stems are a list of this module
    said = F.when(F.col("phrase"), F.contains("said", "stem")).otherwise(F.expr(r"said rlike concat('\\b', stem)"))
    return joined.groupBy("candidate_id", "field").agg(F.coalesce(F.bool_or(said), F.lit(False)).alias("mentioned")).where(~F.col("mentioned")).select("candidate_id", "field")


def volume_claims(prose: DataFrame, text: str = "text") -> DataFrame:
    """Adds claims: the volume-weighting phrases of a text that speaks of a VWAP which is only a proxy, sorted; else empty."""
    claims = F.array(*(F.lit(c) for c in sorted(VOLUME_CLAIMS)))
    told = F.filter(claims, lambda c: F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), c))
    return prose.withColumn("claims", F.when(F.array_contains("fields", "vwap") & is_proxy(prose), told).otherwise(F.slice(claims, 1, 0)))


def vwap_warnings(prose: DataFrame, text: str = "text") -> DataFrame:
    """(candidate_id, warning): stories of volume about a VWAP that holds none."""
    told = F.concat(F.lit("claims of volume ("), F.array_join("claims", ", "), F.lit(") about a vwap that is a typical price"))
    return volume_claims(prose, text).where(F.size("claims") > 0).select("candidate_id", told.alias("warning"))


def folded(column: str):
    return F.trim(F.lower(F.regexp_replace(column, r"\s+", " ")))


def prose_faults(prose: DataFrame) -> DataFrame:
    """(candidate_id, fault): short or repeated rationale, mechanism and formula."""
    r, m, f = folded("rationale"), folded("mechanism"), folded("formula")
    faults = F.array_compact(F.array(F.when(F.length(r) < PROSE_FLOOR, "short rationale"), F.when(F.length(m) < PROSE_FLOOR, "short mechanism"), F.when(r == m, "rationale repeats mechanism"), F.when((r == f) | (m == f), "prose repeats formula")))
    return prose.select("candidate_id", F.explode(faults).alias("fault"))

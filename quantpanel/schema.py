"""Fixed schemas, units, objectives and the run configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

FIELDS = ("open", "high", "low", "close", "volume", "typical_price", "vwap", "returns")
#: Fixed values: (power of price, power of volume) of each field.
UNITS = {"open": (1, 0), "high": (1, 0), "low": (1, 0), "close": (1, 0), "typical_price": (1, 0), "vwap": (1, 0), "volume": (0, 1), "returns": (0, 0)}


def field(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType(), True, {"unit": str(UNITS[name])})


BARS = T.StructType([T.StructField("dt", T.DateType()), T.StructField("symbol", T.StringType()), *(field(n) for n in ("open", "high", "low", "close", "volume", "vwap"))])
PANEL = T.StructType([T.StructField("dt", T.DateType()), T.StructField("symbol", T.StringType()), *(field(n) for n in FIELDS), T.StructField("source", T.StringType()), T.StructField("vwap_source", T.StringType())])

#: Objective, is higher better, value without edge, label.
OBJECTIVES = [
    ("sortino", True, 0.0, "Sortino"),
    ("sharpe", True, 0.0, "Sharpe"),
    ("calmar", True, 0.0, "Calmar"),
    ("cagr", True, 0.0, "CAGR"),
    ("ann_return", True, 0.0, "AnnReturn"),
    ("hit_rate", True, 0.5, "HitRate"),
    ("maxdd", True, None, "MaxDD"),
    ("ann_vol", False, None, "AnnVol"),
    ("avg_turnover", False, None, "Turnover"),
]
ACTIVE = 1e-8


@dataclass(frozen=True)
class Config:
    """What a research run is scored with; checked when it is made."""

    objective: str = "sharpe"
    pass_line: float = 0.5
    gross: float = 1.0
    cost_bps: float = 3.0
    risk_free: float = 0.02
    periods_per_year: float = 52.0
    is_years: int = 2
    oos_bars: int = 26
    min_is_bars: int = 20
    min_oos_bars: int = 10
    require_profit: bool = True
    selection: str = "all"  # all, top_k, top_q
    top_k: int = 3
    top_q: float = 0.2
    rebalance_every: int = 1
    hold_every: int = 1

    def __post_init__(self) -> None:
        if self.objective not in {o[0] for o in OBJECTIVES}:
            raise ValueError(f"unknown objective {self.objective!r}")
        if self.selection not in ("all", "top_k", "top_q"):
            raise ValueError(f"unknown selection {self.selection!r}")
        if min(self.is_years, self.oos_bars, self.rebalance_every, self.hold_every, self.top_k) < 1:
            raise ValueError("windows and counts start at 1")
        if not 0 < self.top_q <= 1 or self.gross <= 0 or self.cost_bps < 0:
            raise ValueError("0 < top_q <= 1, gross > 0 and cost_bps >= 0 are asked for")

    @classmethod
    def of(cls, **given) -> Config:
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**given)

"""Back-tests as a table function, so that strategies and their parameters are given in SQL:

    SELECT * FROM backtest(TABLE(contexts) PARTITION BY asset ORDER BY date, strategy => 'long_call', target => 2.0)

A strategy is a dataclass whose fields are its parameters, with four methods: enters(day), opens(day) -> (strike, premium),
worth(day, strike, days_left) and exits(pnl, days_left); `days` and `most_open` are fields of every one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from millrace.operators.simulate import LongCall, premium

NEEDED = {"asset": T.StringType, "date": T.DateType, "close": T.DoubleType, "volatility": T.DoubleType, "vol_regime": T.StringType, "distance_to_support": T.DoubleType}
TRADES = T.StructType().add("asset", "string").add("entry_date", "date").add("exit_date", "date").add("strike", "double").add("premium", "double").add("pnl", "double")


@dataclass(frozen=True)
class Call(LongCall):
    """LongCall with the worth of its position."""

    def worth(self, day: Row, strike: float, days_left: int) -> float:
        return premium(day.close, strike, day.volatility / 100, days_left)


@dataclass(frozen=True)
class Put:
    """Buys an out-of-the-money put in loud markets far above support; sells at the target, at the stop, or a week before expiry."""

    days: int = 30
    target: float = 2.0
    stop: float = -0.5
    most_open: int = 3
    below: float = 0.05

    def enters(self, day: Row) -> bool:
        return day.vol_regime in ("high", "extreme") and day.distance_to_support is not None and day.distance_to_support > 5

    def opens(self, day: Row) -> tuple[float, float]:
        strike = float(round(day.close * (1 - self.below) / 50) * 50)
        return strike, self.worth(day, strike, self.days)

    def worth(self, day: Row, strike: float, days_left: int) -> float:
        """Intrinsic value, and before expiry the time value that a call has."""
        intrinsic = max(strike - day.close, 0.0)
        return intrinsic if days_left <= 0 else intrinsic + premium(day.close, day.close, day.volatility / 100, days_left)

    def exits(self, pnl: float, days_left: int) -> bool:
        return pnl >= self.target or pnl <= -abs(self.stop) or days_left <= 7


STRATEGIES: dict[str, type] = {"long_call": Call, "long_put": Put}


def register(spark: SparkSession, name: str = "backtest", strategies: dict[str, type] = STRATEGIES) -> None:
    """Register the table function under a name, for these strategies.

    Its table needs the columns of NEEDED, in any order and among others.  Days of a partition come in order, exits before at most one entry a
    day; what is open at the end is closed on the last day.  A task holds one partition's open trades.  Days without a price or volatility
    are passed over.  Unknown strategies and parameters, and missing columns, are refused when the query is analysed.
    """
    known = dict(strategies)

    class Backtest:
        @staticmethod
        def analyze(contexts: AnalyzeArgument, strategy: AnalyzeArgument, **params: AnalyzeArgument) -> AnalyzeResult:
            if not contexts.isTable:
                raise ValueError("the first argument must be TABLE(...)")
            have = {f.name: type(f.dataType) for f in contexts.dataType.fields}
            if wrong := [c for c, kind in NEEDED.items() if have.get(c) is not kind]:
                raise ValueError(f"the table lacks {', '.join(wrong)}, or has other types")
            if strategy.value not in known:
                raise ValueError(f"no strategy {strategy.value}; there are {', '.join(sorted(known))}")
            own = {f.name for f in fields(known[strategy.value])}
            if wrong := [p for p in params if p not in own]:
                raise ValueError(f"{strategy.value} has no {', '.join(wrong)}; it has {', '.join(sorted(own))}")
            return AnalyzeResult(schema=TRADES)

        def __init__(self) -> None:
            self.open: list[tuple] = []
            self.strategy, self.day = None, None

        def _closed(self, t: tuple) -> tuple:
            return (self.day.asset, t[0], self.day.date, t[1], t[2], self._pnl(t))

        def _left(self, t: tuple) -> int:
            return self.strategy.days - (self.day.date - t[0]).days

        def _pnl(self, t: tuple) -> float:
            return float(self.strategy.worth(self.day, t[1], self._left(t)) - t[2])

        def eval(self, day: Row, strategy: str, **params) -> Iterator[tuple]:
            if day.close is None or day.volatility is None:
                return
            if self.strategy is None:
                kinds = {f.name: type(f.default) for f in fields(known[strategy])}
                self.strategy = known[strategy](**{k: kinds[k](v) for k, v in params.items()})
            self.day, s = day, self.strategy
            ends = [t for t in self.open if s.exits(self._pnl(t), self._left(t))]
            yield from map(self._closed, ends)
            self.open = [t for t in self.open if t not in ends]
            if len(self.open) < s.most_open and s.enters(day):
                self.open.append((day.date, *map(float, s.opens(day))))

        def terminate(self) -> Iterator[tuple]:
            yield from map(self._closed, self.open)

    spark.udtf.register(name, udtf(Backtest))

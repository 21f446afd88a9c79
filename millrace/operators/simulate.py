"""Sequential strategies over daily contexts: parallel over assets and parameters, in order within each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRADES = "asset string, params string, entry_date date, exit_date date, strike double, premium double, pnl double"


@dataclass(frozen=True)
class LongCall:
    """Buys an at-the-money call in quiet markets near support; sells at the target, at the stop, or a week before expiry.

    Other strategies have the same three methods.
    """

    days: int = 30
    target: float = 2.0
    stop: float = -0.5
    most_open: int = 5

    def jittered(self, seed: int) -> LongCall:
        """Target and stop varied by a tenth either way; days either stay or fall to seven."""
        rng = np.random.default_rng(seed)
        target, stop = rng.uniform(0.9, 1.1, 2)
        return LongCall(max(7, self.days * int(rng.uniform(0.8, 1.2))), self.target * target, self.stop * stop, self.most_open)

    def enters(self, day) -> bool:
        return day.vol_regime in ("low", "very_low") and day.distance_to_support is not None and day.distance_to_support <= 5

    def opens(self, day) -> tuple[float, float]:
        """(strike, premium): the strike to the nearest 50, half to even."""
        strike = round(day.close / 50) * 50
        return float(strike), premium(day.close, strike, day.volatility / 100, self.days)

    def exits(self, pnl: float, days_left: int) -> bool:
        return pnl >= self.target or pnl <= -abs(self.stop) or days_left <= 7


def premium(spot: float, strike: float, volatility: float, days: int) -> float:
    """A call's intrinsic value, and spot * volatility * sqrt(years) * 0.4 before expiry."""
    intrinsic = max(spot - strike, 0.0)
    return intrinsic if days <= 0 else intrinsic + spot * volatility * sqrt(days / 365) * 0.4


def backtest(contexts: DataFrame, strategies: dict[str, object]) -> DataFrame:
    """Trades of each strategy on each asset.

    contexts: (asset, date, close, volatility, vol_regime, distance_to_support), a row per day.  On each day exits come
    first, then at most one entry; on the last day all that is open is closed.  Days are streamed in order, so a history of
    any length needs the memory of one batch and the open trades.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, day, s, open_ = None, None, None, []
        columns = ["asset", "params", "entry_date", "exit_date", "strike", "premium", "pnl"]

        def worth(t: tuple) -> float:
            return premium(day.close, t[1], day.volatility / 100, s.days - (day.date - t[0]).days) - t[2]

        def closed(t: tuple) -> tuple:
            return (day.asset, day.params, t[0], day.date, t[1], t[2], worth(t))

        for batch in batches:
            rows = []
            for row in batch.itertuples():
                if (row.asset, row.params) != key:
                    rows += map(closed, open_)
                    key, s, open_ = (row.asset, row.params), strategies[row.params], []
                day = row
                ends = [t for t in open_ if s.exits(worth(t), s.days - (day.date - t[0]).days)]
                rows += map(closed, ends)
                open_ = [t for t in open_ if t not in ends]
                if len(open_) < s.most_open and s.enters(day):
                    open_.append((day.date, *s.opens(day)))
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(list(map(closed, open_)), columns=columns)

    dealt = contexts.withColumn("params", F.explode(F.array(*[F.lit(k) for k in strategies])))
    return dealt.repartition("asset", "params").sortWithinPartitions("asset", "params", "date").mapInPandas(run, TRADES)


def ordered_fold(df: DataFrame, key: str, order: list[str], step: Callable[[dict, dict], dict], state: dict, schema: str) -> DataFrame:
    """Fold each key's rows in order through `step(state, row) -> output row`, which changes the state in place.

    Rows are streamed in Arrow batches, so a key of any length needs the memory of one batch and its state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = None, dict(state)
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row[key] != last:
                    last, now = row[key], {k: type(v)(v) if isinstance(v, (list, dict)) else v for k, v in state.items()}
                out.append(step(now, row))
            if out:
                yield pd.DataFrame(out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def fold_to_one(df: DataFrame, key: str, order: list[str], step: Callable[[dict | None, dict], dict]) -> DataFrame:
    """One row of df's columns per key: what step(kept row or None, next row) leaves after all of the key's rows in order.

    Rows are streamed in Arrow batches, so a key of any length needs the memory of one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if some and row[key] == held[key]:
                    held = step(held, row)
                else:
                    if some:
                        out.append(held)
                    held, some = step(None, row), True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
            schema = batch.schema
        if some:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, df.schema)

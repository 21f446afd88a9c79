"""Alerts under limits, as a stateful stream operator whose state is evicted by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: At most so many alerts in a clock hour, and seconds between alerts of one signature.
MOST, COOLDOWN = 10, 300
#: Seconds after which a signature's last alert, and an hour's count, are forgotten.
SIGNATURE_TTL, COUNT_TTL = 3_600, 86_400
OUT = "asset string, event_id long, signature string, sent boolean, sent_24h long"
#: transformWithState keeps its state in RocksDB only.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertLimits(StatefulProcessor):
    """Per channel: alerts sent by clock hour, and each signature's last alert.

    A micro-batch's rows are dealt to their hours in the state first and then worked off hour by hour in order of time, so
    an hour of a channel is what is held in memory.  A timer an hour behind each alert forgets its signature, and one a day behind
    forgets the count of its hour; timers run when the watermark has passed them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getMapState("sent", "hour long", "n long")
        self.last = handle.getMapState("last", "signature string", "t long")
        self.waiting = handle.getMapState("waiting", "hour long", "t array<long>, event_id array<long>, signature array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hours: set[int] = set()
        for batch in rows:
            for hour, part in batch.groupby(batch["t"] // 3600):
                hour = int(hour)
                cols = [part[c].tolist() for c in ("t", "event_id", "signature")]
                if self.waiting.containsKey((hour,)):
                    cols = [list(a) + b for a, b in zip(self.waiting.getValue((hour,)), cols, strict=True)]
                self.waiting.updateValue((hour,), tuple(cols))
                hours.add(hour)
        for hour in sorted(hours):
            yield self._work_off(key[0], hour)

    def _work_off(self, asset: str, hour: int) -> pd.DataFrame:
        held = sorted(zip(*self.waiting.getValue((hour,)), strict=True))
        self.waiting.removeKey((hour,))
        n = self.sent.getValue((hour,))[0] if self.sent.containsKey((hour,)) else 0
        day = sum(v[0] for k, v in self.sent.iterator() if hour - COUNT_TTL // 3600 < k[0] < hour)
        names = {s for _, _, s in held}
        last = {s: self.last.getValue((s,))[0] for s in names if self.last.containsKey((s,))}
        out, sent = [], {}
        for t, event, signature in held:
            ok = n < MOST and t - last.get(signature, t - COOLDOWN) >= COOLDOWN
            if ok:
                n += 1
                last[signature] = sent[signature] = t
                self.handle.registerTimer((t + SIGNATURE_TTL) * 1000)
            out.append((asset, event, signature, ok, day + n))
        for signature, t in sent.items():
            self.last.updateValue((signature,), (t,))
        if sent:
            self.sent.updateValue((hour,), (n,))
            self.handle.registerTimer((hour * 3600 + COUNT_TTL) * 1000)
        return pd.DataFrame(out, columns=["asset", "event_id", "signature", "sent", "sent_24h"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        for signature, (t,) in list(self.last.iterator()):
            if t + SIGNATURE_TTL <= now:
                self.last.removeKey(signature)
        for hour, _ in list(self.sent.iterator()):
            if hour[0] * 3600 + COUNT_TTL <= now:
                self.sent.removeKey(hour)
        yield pd.DataFrame({"asset": pd.Series(dtype=str), "event_id": pd.Series(dtype="int64"), "signature": pd.Series(dtype=str), "sent": pd.Series(dtype=bool), "sent_24h": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def limited(alerts: DataFrame) -> DataFrame:
    """A stream (asset, event_id, t: seconds, signature, and a watermarked time) with `sent`, whether the limits let a row through,
    and sent_24h, the channel's alerts of the 24 clock hours up to it, itself included.

    Rows of one micro-batch are taken in order of time and id.  The session must use the ROCKSDB state store.
    """
    return alerts.groupBy("asset").transformWithStateInPandas(AlertLimits(), OUT, "append", "eventTime")

"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of w[i] + sum over pairs of <v[i], v[j]>) over a text's distinct terms: the factors v learn
which terms matter together (an insult with a group mention), which weights alone can't.  The pair sum costs no more
than the linear one: half of |sum of v|^2 - sum of |v|^2.

The machine is fitted on a bounded sample of labelled rows, `train_rows` of them (those with the smallest hash), in one
task; its table has a fixed size and is broadcast.  Every row is scored, on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textkit import TERM, slices, words

FEATURES, FACTORS = 1 << 17, 4
TRAIN_ROWS = 8_000
#: Terms in a smaller share of training rows, or in fewer, have no weight: they'd learn single documents by heart.
LEAST_SHARE, LEAST_ROWS = 0.002, 4
#: Bytes of the word beginnings that are terms beside the word: forms of one stem share them.
STEMS = (4, 5)
#: Passes over the sample with weights alone, then with factors; step size; penalties on |w|, above a chance term's mean
#: gradient (a tenth of it once the terms are chosen), and on |v|^2.
ALONE, STEPS, RATE, SPARSE, DECAY = 60, 100, 0.3, 3e-3, 1e-2


def terms(texts: pa.Array, active: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Each text's distinct hashed terms: lower-cased runs of letters and digits, and their beginnings; only active ones, if given."""
    for first, last, data, offs in slices(texts):
        h, at, _ = words(data, offs, of=TERM)
        more = [words(data, offs, of=TERM, upto=k)[0] for k in STEMS]
        ids = (np.stack([h, *more], axis=1).reshape(-1) >> np.uint64(40)).astype(np.int64) % FEATURES
        at = at * (1 + len(STEMS))
        if active is not None:
            use = active[ids]
            at = np.concatenate([[0], np.cumsum(use)])[at]
            ids = ids[use]
        for i in range(last - first):
            yield np.unique(ids[at[i] : at[i + 1]])


class Machine:
    """bias, w and v; fit() by proximal Adagrad on the logistic loss, which leaves most terms out."""

    def __init__(self) -> None:
        self.bias, self.w = float(np.log(0.01 / 0.99)), np.zeros(FEATURES, np.float32)
        self.v = np.zeros((FEATURES, FACTORS), np.float32)
        self.active = np.zeros(FEATURES, dtype=bool)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Log odds of rows of active terms."""
        flat, starts = np.concatenate([*rows, np.zeros(1, np.int64)]), np.cumsum([0, *map(len, rows)])
        return self._odds(flat, starts)[0][: len(rows)]

    def _odds(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat has one term more than the rows, so that an empty last row has a place."""
        empty = np.diff(starts) == 0
        v = self.v[flat]
        at = starts[:-1]
        both = np.concatenate([v, v * v, self.w[flat][:, None]], axis=1)
        both[starts[-1] :] = 0
        sums = np.add.reduceat(both, at, axis=0, dtype=np.float64) if len(at) else np.zeros((0, 2 * FACTORS + 1))
        sums[empty] = 0
        s = sums[:, :FACTORS]
        return self.bias + sums[:, -1] + 0.5 * (s * s - sums[:, FACTORS:-1]).sum(axis=1), s, v

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> None:
        if not len(rows):
            return
        seen = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=FEATURES)
        self.active = seen >= max(LEAST_SHARE * len(rows), min(LEAST_ROWS, max(1, len(rows) // 50)))
        rows = [r[self.active[r]] for r in rows]
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6), 1e-6
        for step in range(ALONE + STEPS):
            if step == ALONE:  # factors for the terms that have weights
                self.v[self.active] = np.random.default_rng(seed).normal(0, 0.1, (int(self.active.sum()), FACTORS))
            if step % 10 == 0:  # terms that the penalties hold at zero take no further part
                flat, starts = np.concatenate([*rows, np.zeros(1, np.int64)]), np.cumsum([0, *map(len, rows)])
                of = np.repeat(np.arange(len(rows)), np.diff(starts))
                touched, where = np.unique(flat[:-1], return_inverse=True)
            if step < ALONE:
                odds = self.bias + np.bincount(of, self.w[flat[:-1]], len(rows))
            else:
                odds, s, v = self._odds(flat, starts)
            miss = (1 / (1 + np.exp(-np.clip(odds, -700, 700))) - labels) / len(rows)
            e = miss[of]
            dw = np.bincount(where, e, len(touched))
            gw[touched] += dw * dw
            rate = RATE / np.sqrt(gw[touched])
            moved = self.w[touched] - rate * dw
            self.w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - rate * (SPARSE if step < ALONE else SPARSE / 10), 0)
            if step >= ALONE:
                dv = np.stack([np.bincount(where, e * (s[of, f] - v[:-1, f]), len(touched)) for f in range(FACTORS)], axis=1)
                dv += DECAY * self.v[touched]
                gv[touched] += dv * dv
                self.v[touched] -= RATE * dv / np.sqrt(gv[touched])
            gb += miss.sum() ** 2
            self.bias -= RATE * miss.sum() / np.sqrt(gb)
            if step % 10 == 9 and step < ALONE:
                self.active &= self.w != 0
                rows = [r[self.active[r]] for r in rows]

    def to_bytes(self) -> bytes:
        at = np.flatnonzero(self.active)
        return np.float64(self.bias).tobytes() + np.int64(len(at)).tobytes() + at.tobytes() + self.w[at].tobytes() + self.v[at].tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Machine:
        m = cls()
        m.bias, n = float(np.frombuffer(raw, np.float64, 1)[0]), int(np.frombuffer(raw, np.int64, 1, 8)[0])
        at = np.frombuffer(raw, np.int64, n, 16)
        m.active[at] = True
        m.w[at] = np.frombuffer(raw, np.float32, n, 16 + 8 * n)
        m.v[at] = np.frombuffer(raw, np.float32, n * FACTORS, 16 + 12 * n).reshape(n, FACTORS)
        return m


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> bytes:
    """A machine fitted on at most train_rows labelled rows of docs (doc_id, text); labels: (doc_id, toxic), the larger of several."""
    few = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = few.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("h", "text", "toxic")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, wanted = [], []
        for batch in batches:
            found += list(terms(batch.column(1)))
            wanted += batch.column(2).to_pylist()
        m = Machine()
        m.fit(found, np.array(wanted, dtype=np.float64))
        yield pa.RecordBatch.from_pydict({"model": pa.array([m.to_bytes()], pa.binary())})

    made = rows.repartition(1).sortWithinPartitions("h", "text").mapInArrow(fit, "model binary").first()
    return made["model"] if made else Machine().to_bytes()  # no rows, no task


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Rows whose crc32(doc_id as text) is divisible by `folds` are held out of training.  Null or empty text has the score
    of the bias alone.  Null ids are never trained on and count as not held out.  Without labelled rows every score is 0.01.
    Repeated rows are scored each; extra columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % folds == 0, F.lit(False))
    raw = train(source, labels.where(~held_out("doc_id")), train_rows)
    model = source.sparkSession.sparkContext.broadcast(raw)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.from_bytes(model.value)
        for batch in batches:
            odds = m.score(list(terms(batch.column(1), m.active)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700))))], names=["doc_id", "score"])

    scored = source.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

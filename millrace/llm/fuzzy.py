"""Context-triggered piecewise hashing: fingerprints that survive edits, compared by edit distance.

A rolling hash over 7 bytes ends a piece wherever it is the last residue of the block size; each piece's hash gives one
of 64 characters.  A fingerprint is "block:signature:signature of twice the block".  The block size is the power of two
times 3 at which about 64 pieces are expected, halved until the signature has 32 characters.  Two fingerprints are
compared at each block size they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textkit import _BYTE, mix, powers

BLOCK, PIECES, LEAST, ROLL = 3, 64, 32, 7
#: Text bytes in one range of ids, about.
RANGE_BYTES = 8 << 20
#: Most ranges that ids are cut into; beyond RANGES * RANGE_BYTES ranges grow, and a task sorts and streams more.
RANGES = 20_000
_NONE = -(1 << 63)
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def signature(rolled: np.ndarray, total: np.ndarray, block: int) -> bytes:
    """One character per piece; the last takes what follows the last boundary, and all beyond PIECES - 1 boundaries."""
    n = len(rolled)
    ends = np.flatnonzero(rolled % np.uint32(block) == block - 1)[: PIECES - 1] + 1
    edges = np.concatenate([[0], ends, [n]]) if not len(ends) or ends[-1] < n else np.concatenate([[0], ends])
    if not n:
        return b""
    first, last = edges[:-1], edges[1:]
    _, down = powers(n + 1)
    h = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(raw: bytes) -> str:
    """The fingerprint of a text's bytes; of no bytes, "3::"."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    up, _ = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    # The rolling hash of the last 7 bytes: each byte's value is shifted by its distance, so it ages out by itself.
    values = (_BYTE[data] >> np.uint64(32)).astype(np.uint32)
    rolled = values.copy()
    for k in range(1, min(ROLL, n)):
        rolled[k:] ^= (values[:-k] << np.uint32(k)) | (values[:-k] >> np.uint32(32 - k))
    block = BLOCK
    while block * PIECES < n:
        block *= 2
    while True:
        one = signature(rolled, total, block)
        if len(one) >= LEAST or block == BLOCK:
            break
        block //= 2
    return f"{block}:{one.decode()}:{signature(rolled, total, 2 * block).decode()}"


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Edit distances of many pairs of strings of at most 64 characters: the bit-parallel recurrence, for all pairs at once."""
    m = len(pairs)
    if not m:
        return np.zeros(0, np.int64)
    one, two = (np.zeros((m, PIECES), np.uint8) for _ in range(2))
    size = np.array([[len(a), len(b)] for a, b in pairs])
    for i, (a, b) in enumerate(pairs):
        one[i, : len(a)] = np.frombuffer(a.encode(), np.uint8)
        two[i, : len(b)] = np.frombuffer(b.encode(), np.uint8)
    bit = np.uint64(1) << np.arange(PIECES, dtype=np.uint64)
    top = np.where(size[:, 0] > 0, bit[np.maximum(size[:, 0], 1) - 1], 0).astype(np.uint64)
    plus, minus, score = np.full(m, 2**64 - 1, np.uint64), np.zeros(m, np.uint64), size[:, 0].copy()
    u1 = np.uint64(1)
    for j in range(int(size[:, 1].max())):
        live = j < size[:, 1]
        eq = ((one == two[:, j : j + 1]) * bit).sum(axis=1, dtype=np.uint64)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hn = minus | ~(d0 | plus), d0 & plus
        score += live & ((hp & top) != 0)
        score -= live & ((hn & top) != 0)
        hp = (hp << u1) | u1
        plus, minus = np.where(live, (hn << u1) | ~(d0 | hp), plus), np.where(live, hp & d0, minus)
    return np.where(size[:, 0] == 0, size[:, 1], score)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 - distance / longer signature, the best over the block sizes they share.

    Equal fingerprints: 1.  No shared block size, or an empty signature against another: 0.
    """
    jobs, where = [], []
    out = np.zeros(len(pairs))
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1
            continue
        (a, a1, a2), (b, b1, b2) = x.split(":"), y.split(":")
        a, b = int(a), int(b)
        for p, q in [(a1, b1), (a2, b2)] if a == b else [(a1, b2)] if a == 2 * b else [(a2, b1)] if b == 2 * a else []:
            if p and q:
                jobs.append((p, q))
                where.append(i)
    if jobs:
        longer = np.array([max(len(p), len(q)) for p, q in jobs])
        np.maximum.at(out, where, 1 - distances(jobs) / longer)
    return out


def by_ranges(docs: DataFrame, bytes_each: int = RANGE_BYTES, most: int = RANGES) -> DataFrame:
    """Rows (id, text) dealt to ranges of ids, `slot`; each range also has the first row of the next one, its `guest`.

    The next range after the last is the first.  Ranges are cut at quantiles of the ids; only the cuts and the first id
    of each range, at most `most`, come to the driver.
    """
    spark = docs.sparkSession
    n = min(most, 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bytes_each)
    cuts = np.array(sorted(set(docs.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else [], dtype=np.float64)

    @F.pandas_udf("int")
    def slot_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy()).astype(np.int32))

    rows = docs.withColumn("slot", slot_of("id"))
    firsts = sorted((r["slot"], r["first"]) for r in docs.select("id").withColumn("slot", slot_of("id")).groupBy("slot").agg(F.min("id").alias("first")).collect())
    hosts = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "id long, slot int")
    guests = docs.join(F.broadcast(hosts), "id")
    return rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))


ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its fingerprint, its edited text's, and how alike they and the next document's are.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many (or all) of the next
    document, in order of id and then text; after the last document comes the first.  Null text counts as empty; a null id
    counts as the smallest and stays null.  Repeated rows follow one another.  Extra columns are ignored; an empty table
    gives no rows.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        near: list[tuple[str, str]] = []
        held: tuple | None = None  # the row that waits for the next: slot, id, text, fingerprint

        def flush() -> pa.RecordBatch:
            like = likeness(near)
            cols = [*zip(*rows, strict=True)] or [()] * 5
            out = pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, ROW, strict=False)), pa.array(like[0::2]), pa.array(like[1::2])], schema=ROW)
            rows.clear()
            near.clear()
            return out

        for batch in batches:
            for slot, guest, doc, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                slot, doc, text = slot.as_py(), doc.as_py(), text.as_py()
                if held is None and guest.as_py():
                    continue  # a further row of the guest's id
                own = fingerprint(text.encode())
                if held and held[0] == slot:
                    _, before, old, print_ = held
                    half = len(old) // 2
                    edited = (old[: len(old) - half] + text[:half]).encode()
                    other = fingerprint(edited)
                    rows.append((None if before == _NONE else before, len(old), hashlib.sha256(edited).hexdigest(), print_, other))
                    near += [(print_, other), (print_, own)]
                held = None if guest.as_py() else (slot, doc, text, own)
            if len(rows) >= 1000:
                yield flush()
        yield flush()

    dealt = by_ranges(source).select("slot", "guest", "id", "text").repartition("slot").sortWithinPartitions("slot", "guest", "id", "text")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

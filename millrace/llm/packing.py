"""Harmonic packing of token sequences.

A document's ids are cut into pieces.  Lengths fall into reciprocal-capacity classes: class k holds lengths in
(capacity/(k+1), capacity/k], and each of its bins takes exactly k pieces.  Every Spark task fills bins of its own,
class by class, and shares nothing with other tasks, so there is no shuffle and a lost task is simply run again.

Because documents may be cut freely, all but a short tail of each document is cut at capacity/1, /2, /4, /8, /16:
those pieces fill their class's bins exactly, with no padding.  Only the tails (below capacity/16) can leave padding,
less than one tail in a bin.  Bins that a task leaves unfilled at its end are merged, longest piece first.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
END_ID = 1
#: The classes at which documents are cut.
CUTS = (1, 2, 4, 8, 16)

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("bin_class", T.IntegerType()),
    ]
)


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """Encodes texts with the byte-level BPE in `vocabulary`, a file of `tokenizers`.

    `tiktoken` gives the same ids from the file's own vocabulary at several times the speed (a test holds the two
    against each other).  The file's added tokens, as `<|endoftext|>`, are single ids where their strings stand in a text, as in `tokenizers`.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    if model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError(f"{vocabulary} holds no byte-level BPE")
    added = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
    if any(x.get(k) for x in model.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")) or model.get("normalizer"):
        raise ValueError(f"{vocabulary} has added tokens that take white space or word bounds with them, or a normalizer")
    # Byte-level vocabularies spell each byte as a printable character: printable ones stand for themselves,
    # the others for 256, 257, ... in order.
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spelled = {chr(b): b for b in printable}
    spelled |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(spelled[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths for n ids: whole capacities, then one piece for each set class of CUTS, then the tail."""
    lengths = [capacity] * (n // capacity)
    n %= capacity
    for k in CUTS[1:]:
        if n >= capacity // k:
            lengths.append(capacity // k)
            n -= capacity // k
    return [*lengths, n] if n else lengths


class Bins:
    """One task's bins.  Sequence ids are the task's number and a running count."""

    def __init__(self, task: int, capacity: int) -> None:
        self.base, self.count, self.capacity = task << 32, 0, capacity
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def new_id(self) -> int:
        self.count += 1
        return self.base + self.count - 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """Put a piece (its length is at index 2) in its class's bin; a full bin's rows come back."""
        k = self.capacity // piece[2]
        held = self.open[k]
        held.append(piece)
        if len(held) == k:
            yield from self.close(held, k)
            del self.open[k]

    def close(self, pieces: list[tuple], k: int) -> Iterator[tuple]:
        sequence, offset = self.new_id(), 0
        for p in pieces:
            yield (*p, sequence, offset, k)
            offset += p[2]

    def finish(self) -> Iterator[tuple]:
        """Merge what unfilled bins hold: at most k - 1 pieces of each class, longest first into the fullest room."""
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        self.open.clear()
        bins: list[list[tuple]] = []
        rooms: list[tuple[int, int]] = []  # emptiest bin first
        for p in rest:
            if rooms and -rooms[0][0] >= p[2]:
                room, b = heapq.heappop(rooms)
            else:
                room, b = -self.capacity, len(bins)
                bins.append([])
            bins[b].append(p)
            heapq.heappush(rooms, (room + p[2], b))
        for held in bins:
            yield from self.close(held, 0)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where its ids lie in the document, and where it lies in which sequence.

    Null or empty text: the end id alone.  Repeated rows are packed each; extra columns are ignored; an empty table
    gives no rows.  `capacity` must be divisible by 16.  bin_class is the harmonic class, 0 in a merged last bin.
    """
    if capacity % CUTS[-1]:
        raise ValueError("capacity must be divisible by 16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        bins = Bins(TaskContext.get().partitionId(), capacity)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(PIECES)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if f.dataType == T.IntegerType() else pa.int64()) for c, f in zip(cols, PIECES, strict=True)], names=PIECES.names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "", allowed_special="all")
                ids.append(end_id)
                raw, n, start = np.array(ids, dtype="<u4").tobytes(), len(ids), 0
                for length in cut(n, capacity):
                    rows.extend(bins.add((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n)))
                    start += length
                if len(rows) >= 20_000:
                    yield flush()
        rows.extend(bins.finish())
        yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, ids and padding; a sequence is padded to capacity unless its length is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return whole.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("padding"))

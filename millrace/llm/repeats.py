"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier in the corpus.

1. Equal texts: all copies but the one with the smallest id go whole (if they have 100 bytes).
2. Which strings can be equal?  Each 100-byte window has an anchor: its 32-byte string with the least hash.  Equal windows
   have equal anchors at the same place, so a window whose anchor occurs once in the corpus is unique.  Anchors are
   about one in 35 positions; only their hashes are shuffled and counted.  Neighbouring windows whose anchors have one hash, as in
   a run of one character or of a short period, are one stretch, cut into pieces of PIECE windows.
3. The windows of each repeated anchor, with the bytes around it, go to the anchor's hash partition, and a two-stage
   suffix sort of the partition's strings, block by block, followed by common prefixes of neighbours, finds the
   classes of equal windows: all but the earliest are covered.
4. An anchor that occurs very often is dealt to many sorts by document and place.  Each leaves one earliest window per
   class; their 128-bit hashes are then reduced by min() over the corpus.

So no task holds all occurrences of a common passage, and every document is compared with all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import by_key, dropped, narrowed, written
from millrace.llm.suffixes import same_as_before, sort_suffixes
from millrace.llm.textkit import _BYTE, mix, powers, signed, slices

WINDOW, GRAM = 100, 32
#: Occurrences of an anchor from which it is dealt to several sorts, and how many each of them then gets, about; a stretch counts
#: once for each WEIGHT windows.
HOT, SHARE, WEIGHT = 2_000, 1_000, 128
#: Most windows of a stretch that go to one sort as one string.
PIECE = 1 << 12
#: Bytes in one suffix sort, about.
BLOCK = 1 << 20
_SEEN = 100_000
#: Rows without id get ids below all others, one for each text.
_FIRST, _NONE = -(1 << 63), -(1 << 63) + (1 << 40)


def gram_hashes(data: np.ndarray, size: int, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each position on."""
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of the rows: its hash, the first and last start of the windows that have it, and whether it is several in a row."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none.view(np.uint64), none, none, none.astype(bool)
    h = gram_hashes(data, GRAM)
    # The least of each run of grams that a window holds: by 32 bits of hash, the leftmost of equals.
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, want = 1, WINDOW - GRAM + 1
    while 2 * span <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - WINDOW + 1], low[want - span : want - span + n - WINDOW + 1])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(at) + 1, dtype=np.int32)
    whole = np.diff(offs) >= WINDOW
    np.add.at(inside, offs[:-1][whole], 1)
    np.add.at(inside, offs[1:][whole] - WINDOW + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    # Rows end to end: the last window of a row and the first of the next are never neighbours (99 starts lie between).
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | (at[1:] != at[:-1])
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    return pieces(h[at[first]], first, last)


def pieces(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of one hash as one stretch, and stretches cut into pieces of PIECE windows; the last array marks stretches of
    several anchors, within which windows may be equal."""
    if not len(h):
        return h, first, last, np.zeros(0, bool)
    heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (first[1:] != last[:-1] + 1)]))
    several = np.diff(np.append(heads, len(h))) > 1
    h, first, last = h[heads], first[heads], last[np.append(heads[1:], len(last)) - 1]
    n = (last - first) // PIECE + 1
    start = np.repeat(first, n) + PIECE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return np.repeat(h, n), start, np.minimum(start + PIECE - 1, np.repeat(last, n)), np.repeat(several, n)


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _find(ids: np.ndarray, lows: np.ndarray, counts: np.ndarray, hot: np.ndarray, strings: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Covered runs (id, start, end) in strings of whole groups, and the earliest windows of hot groups (id, start, w1, w2)."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum([len(s) for s in strings])
    begin = np.concatenate([[0], end[:-1]])
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.lexsort((lows, ids))] = np.arange(len(ids))
    tied = (ids[1:] == ids[:-1]) & (lows[1:] == lows[:-1])  # repeated rows: neither is earlier
    if tied.any():
        _, rank = np.unique(np.rec.fromarrays([ids, lows]), return_inverse=True)
    order, words = sort_suffixes(text, begin, begin + counts, end, WINDOW)
    of = np.searchsorted(end, order, side="right")
    heads = np.concatenate([[True], ~same_as_before(order, words, WINDOW)])
    classes = np.cumsum(heads) - 1
    at = rank[of] << 32 | (order - begin[of])  # by string, and within it
    covered = at != np.minimum.reduceat(at, np.flatnonzero(heads))[classes]
    at = np.sort(order[covered])
    runs: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    if len(at):
        heads = np.concatenate([[True], np.diff(at) > 1])
        first, last = at[heads], at[np.concatenate([heads[1:], [True]])]
        k = np.searchsorted(end, first, side="right")
        runs = [ids[k], lows[k] + first - begin[k], lows[k] + last - begin[k] + WINDOW]
    keep = ~covered & hot[of]
    left = order[keep]
    if not len(left):
        return runs, [np.zeros(0, np.int64)] * 4
    k = of[keep]
    w1 = gram_hashes(text, WINDOW)[left]
    w2 = gram_hashes(text, WINDOW, mix(_BYTE))[left]
    return runs, [ids[k], lows[k] + left - begin[k], signed(w1), signed(w2)]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST) + F.pmod(F.xxhash64(text), F.lit(1 << 40))).alias("id"), text.alias("text"))


def _search(source: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, n, sha) of all rows; (sha, rep, copies) of all texts; (id, start, stop) of the covered runs, which may overlap."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x.as_py() or "").encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())], names=["id", "n", "sha"])

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, data, offs in slices(batch.column(1)):
                h, low, high, several = anchors(data, offs)
                row = np.searchsorted(offs, low, side="right") - 1
                # An equal text with a smaller id has given its anchors: copies among a task's rows go now.
                skip = np.zeros(len(offs) - 1, dtype=bool)
                for i, (a, b) in enumerate(pairwise(offs)):
                    key, doc = hashlib.blake2b(data[a:b], digest_size=16).digest(), int(ids[first + i])
                    skip[i] = seen.get(key, doc) < doc
                    if len(seen) < _SEEN:
                        seen.setdefault(key, doc)
                use = ~skip[row]
                h, low, high, several, row = h[use], low[use], high[use], several[use], row[use]
                where = (low - offs[row] << 16) | (several.astype(np.int64) << 15) | (high - low)
                # One row for an anchor and document, however often a line repeats in it.
                order = np.lexsort((where, h, row))
                h, row, where = h[order], row[order], where[order]
                heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else row
                places = pa.ListArray.from_arrays(pa.array(np.append(heads, len(h)), pa.int32()), pa.array(where))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[heads])), pa.array(ids[first + row[heads]]), places], names=["h", "id", "places"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places, hashes, counts in zip(*(batch.column(i) for i in range(5)), strict=True):
                raw = text.as_py().encode()
                places, hashes = places.values.to_numpy(), hashes.values
                low, more = places >> 16, places & 32767
                strings = [raw[a : a + m + WINDOW] for a, m in zip(low.tolist(), more.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([hashes, pa.array(np.full(len(low), doc.as_py())), pa.array(low), pa.array(more + 1), counts.values, pa.array(strings, pa.binary())], names=["h", "id", "low", "windows", "occurs", "bytes"])

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, lows, windows, occurs = (t.column(c).to_numpy() for c in ("id", "low", "windows", "occurs"))
            runs, left = _find(ids, lows, windows, occurs > HOT, t.column("bytes").to_pylist())
            for kind, rows in ((False, runs), (True, left)):
                if len(rows[0]):
                    w = rows[2:] if kind else [None, None]
                    none = pa.nulls(len(rows[0]), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), none if kind else pa.array(rows[2]), *(pa.array(x) if kind else none for x in w)], names=["id", "start", "stop", "w1", "w2"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            h, salt = t.column("h").to_numpy(), t.column("salt").to_numpy()
            cuts = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
            sizes = np.cumsum(pc.binary_length(t.column("bytes")).to_numpy())
            if held and len(h) and (h[0], salt[0]) != key and size >= BLOCK:
                yield from solve(pa.concat_tables(held))
                held, size = [], 0
            done = 0
            for c in cuts:
                if size + sizes[c - 1] - (sizes[done - 1] if done else 0) >= BLOCK:
                    yield from solve(pa.concat_tables([*held, t.slice(done, c - done)]))
                    held, size, done = [], 0, int(c)
            if done < len(t):
                held.append(t.slice(done))
                size += sizes[-1] - (sizes[done - 1] if done else 0)
            if len(h):
                key = (h[-1], salt[-1])
        if held:
            yield from solve(pa.concat_tables(held))

    measured = written(source.mapInArrow(measure, "id long, n long, sha string"), "measured")
    firsts = written(measured.groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "firsts")
    named = measured.groupBy("id").agg(F.min("sha").alias("sha"), F.max("sha").alias("other"), F.max("n").alias("n")).where(f"sha = other AND n >= {WINDOW}")
    reps = named.join(firsts.select(F.col("rep").alias("id"), "sha"), ["id", "sha"]).select("id")

    found = written(source.mapInArrow(find_anchors, "h long, id long, places array<long>"), "anchors")
    weight = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + 1 + F.floor(p.bitwiseAND(32767) / WEIGHT))
    stretched = F.exists("places", lambda p: p.bitwiseAND(32768) != 0)
    repeated = found.groupBy("h").agg(F.sum(weight).alias("occurs"), F.count("*").alias("docs"), F.max(stretched).alias("stretched")).where("occurs > 1 OR stretched").drop("stretched")
    repeated = written(repeated, "repeated")
    counted = by_key(narrowed(found, repeated, "h"), repeated, ["h"], n="docs")
    counted = counted.select("h", "id", F.explode("places").alias("place"), "occurs")
    places = counted.join(reps, "id", "left_semi").groupBy("id").agg(F.collect_list(F.struct("place", "h", "occurs")).alias("x"))
    places = written(places.select("id", F.col("x.place").alias("place"), F.col("x.h").alias("h"), F.col("x.occurs").alias("occurs")), "places")
    dropped(found, repeated)
    strings = narrowed(source, places, "id").hint("merge").join(places, "id").select("id", "text", "place", "h", "occurs").mapInArrow(cut_out, "h long, id long, low long, windows long, occurs long, bytes binary")
    salted = strings.withColumn("salt", F.when(F.col("occurs") > HOT, F.pmod(F.xxhash64("id", "low"), F.ceil(F.col("occurs") / SHARE))).otherwise(F.lit(0)).cast("long"))
    sorted_ = salted.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(sort_blocks, "id long, start long, stop long, w1 long, w2 long")
    sorted_ = written(sorted_, "windows")
    dropped(places)

    runs = sorted_.where("stop IS NOT NULL").select("id", "start", "stop")
    left = sorted_.where("stop IS NULL")
    earliest = left.groupBy("w1", "w2").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = left.join(earliest, ["w1", "w2"]).where("struct(id, start) > first").select("id", "start", (F.col("start") + WINDOW).alias("stop"))
    by_doc = runs.unionByName(late).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("x"))
    by_doc = written(by_doc.select("id", F.col("x.start").alias("start"), F.col("x.stop").alias("stop")), "runs")
    dropped(sorted_)
    return measured, firsts, by_doc


def without_runs(raw: bytes, first: list[int], last: list[int]) -> tuple[bytes, int]:
    """What is left of raw without the runs, and how many maximal ones they are."""
    runs = merge(list(zip(first, last, strict=True)))
    return b"".join(raw[b:a] for (_, b), (a, _) in pairwise([(0, 0), *runs, (len(raw), 0)])), len(runs)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes kept).

    A byte of the UTF-8 text goes if a 100-byte string that covers it also starts earlier: in a document with a smaller
    id, or earlier in the same one.  Strings may overlap, never cross documents, and are judged on the input.
    Null text counts as empty.  Repeated rows count as one document, so neither is earlier; an id must name one text:
    rows of an id with several texts go whole where they are copies and else stay whole.  Rows without id count as
    earlier than all others, each text as a document of its own (in the order of a hash of theirs), and their id stays null.  Extra columns are ignored; an empty table gives no rows.
    """
    source = _source(docs, id_col, text_col)
    measured, firsts, by_doc = _search(source)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, first, last in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = text.as_py().encode()
                left, runs = without_runs(raw, first.as_py(), last.as_py())
                rows.append((doc.as_py(), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, types, strict=True)], names=["id", "removed", "spans", "kept"])

    cut = narrowed(source, by_doc, "id").hint("merge").join(by_doc, "id").select("id", "text", "start", "stop").mapInArrow(remove, "id long, removed long, spans long, kept string").dropDuplicates(["id"])
    out = by_key(measured, firsts, ["sha"], n="copies").select("id", "n", "sha", F.expr(f"id <> rep AND n >= {WINDOW}").alias("copy"))
    out = out.join(cut, "id", "left")
    empty = hashlib.sha256(b"").hexdigest()
    copy = F.col("copy")
    return out.select(
        F.when(F.col("id") >= _NONE, F.col("id")).alias("doc_id"),
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, empty).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def changes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id that loses something by repeats(): doc_id, copies (SHA-256 of its texts that go whole), start and stop (runs of
    bytes that go from its one text, which may overlap).  Rows without id aren't listed."""
    measured, firsts, by_doc = _search(_source(docs, id_col, text_col))
    copies = by_key(measured, firsts, ["sha"], n="copies").where(f"id <> rep AND n >= {WINDOW}").groupBy("id").agg(F.collect_set("sha").alias("copies"))
    both = copies.join(by_doc, "id", "full")
    none = F.array().cast("array<long>")
    return both.where(F.col("id") >= _NONE).select(F.col("id").alias("doc_id"), F.coalesce("copies", F.array().cast("array<string>")).alias("copies"), F.coalesce("start", none).alias("start"), F.coalesce("stop", none).alias("stop"))


def text_without(text: Column, start: Column, stop: Column) -> Column:
    """A text without runs of its UTF-8 bytes; what a cut leaves of a character goes too.  Null stays null."""

    # Not declared deterministic, so that filters on the result don't have it worked out twice.
    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_runs(t.encode(), list(a), list(b))[0].decode(errors="ignore") for t, a, b in zip(texts, starts, stops, strict=True)], dtype=object)

    return cut.asNondeterministic()(text, start, stop)

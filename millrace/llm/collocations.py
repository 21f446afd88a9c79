"""Phrases whose words occur together more often than apart, per language, with exact counts.

1. Words are counted by Spark.  A phrase of 10 occurrences or more has words of 10 or more only, so these are the vocabulary; each
   gets a number, its rank by 64-bit hash.  All words of the corpus are tested for the hash of one of them, so hashes are exact.
2. A pass over the texts packs the numbers of two and three neighbouring words into keys, gathers some millions of them,
   and turns them into counting quotient filters (see `quotient`), one for each range of mapped keys.
3. The filters of a range meet in one task, which merges them and keeps what occurs 10 times or more.  A range holds
   some millions of occurrences whatever the corpus or the language: no task gets a language whole.
4. Scores need the counts of a phrase's parts, which are words or phrases of step 3: joins in which hot keys are broadcast.

The vocabulary that is sent to all tasks is bounded: words beyond the `NUMBERED` most frequent keep their hash as number, and phrases with such a
word have keys of 64 bits a word, in filters of their own.  Nothing else changes for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import quotient
from millrace.llm.shared import by_key, distilled, written
from millrace.llm.textkit import _BYTE, mix, signed, slices, words

LEAST, BEST, COVERED = 10, 2_000, 50
#: Most words with a number of their own: three numbers fill 63 bits, and 16 MB go to every task.
NUMBERED = (1 << 21) - 1
#: Bits of the map of other frequent words' hashes: 8 MB at most.
MAP_BITS = 1 << 26
#: Keys that a task holds before it makes filters of them, and occurrences of a language that fall into one range, about.
SHARD, RANGE = 1 << 22, 1 << 22
#: Parts into which a language's phrases are dealt to be ranked.
_DEALT = 256

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IN_WORD = ~_SEPARATOR
_IN_WORD[[0x20, 0x09]] = False


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D\x20\x09]+"))


def _hashed(counted: DataFrame, table: np.ndarray) -> DataFrame:
    """Distinct words with the hash that the second pass will find in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in slices(batch.column(1)):
                hashes, at, _ = words(data, offs, of=_IN_WORD, table=table)
                yield pa.RecordBatch.from_arrays([*(c[first:last] for c in batch.columns), pa.array(signed(hashes[at[:-1]]))], names=["lang", "word", "c", "h"])

    return counted.mapInArrow(run, "lang string, word string, c long, h long")


class Numbers:
    """The numbers of frequent words."""

    def __init__(self, hashes: np.ndarray, others: np.ndarray | None) -> None:
        self.hashes, self.others = hashes, others
        self.bits = max(1, len(hashes).bit_length())

    def of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number, -1 if it has none, and whether it may be frequent."""
        n = len(self.hashes)
        at = np.minimum(np.searchsorted(self.hashes, found), max(0, n - 1))
        number = np.where(self.hashes[at] == found, at, -1) if n else np.full(len(found), -1)
        if self.others is None:
            return number, number >= 0
        place = signed(found) % MAP_BITS
        return number, (number >= 0) | (self.others[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _numbers(frequent: DataFrame) -> Numbers:
    by_hash = written(frequent.groupBy("h").agg(F.sum("c").alias("c")), "by-hash")
    step = F.floor(8 * F.log2(F.col("c").cast("double")))
    levels = sorted(((r.s, r.n) for r in by_hash.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 512 rows at most
    total, least = 0, None
    for s, n in levels:
        if total + n > NUMBERED:
            break
        total, least = total + n, s
    numbered = by_hash.where(step >= least) if least is not None else by_hash.limit(0)
    hashes = np.sort(numbered.select("h").toArrow().column(0).to_numpy().view(np.uint64))  # NUMBERED rows at most
    if total == sum(n for _, n in levels):
        return Numbers(hashes, None)
    place = F.pmod("h", F.lit(MAP_BITS)) + 1
    rest = by_hash.where(step < least) if least is not None else by_hash
    others = np.zeros(MAP_BITS >> 3, np.uint8)
    for r in rest.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toLocalIterator():  # 2,048 rows at most
        others[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return Numbers(hashes, others)


def _ranges(n: int) -> int:
    """Bits that name a range of a language with n words."""
    return max(0, (n // RANGE).bit_length())


def _phrases(source: DataFrame, numbers: Numbers, large: dict[str, int], table: np.ndarray, least: int) -> DataFrame:
    """(lang, h1, h2, h3, f) of all phrases of two words (h3 null) or three with f >= least; the h are hashes of words."""
    sent = source.sparkSession.sparkContext.broadcast((numbers, large))
    first_of_wide = lambda k: (k[0] ^ mix(sum(mix(x + np.uint64(i)) for i, x in enumerate(k[1:]))), *k[1:])  # noqa: E731  one-to-one, and its own inverse

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, large = sent.value
        b = np.uint64(numbers.bits)
        held: dict[tuple[str, int, bool], list[quotient.Keys]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, n, wide), parts in held.items():
                bits, ranges = (64 if wide else n * numbers.bits), large.get(lang, 0)
                ranges = min(ranges, bits - 1)
                keys = tuple(np.concatenate(k) for k in zip(*parts, strict=True))
                parts.clear()
                keys, counts = quotient.added(first_of_wide(keys) if wide else (quotient.permuted(keys[0], bits),))
                own = np.uint64((1 << (bits - ranges)) - 1)
                rows = [(k, quotient.encode((keys[0][x:y] & own, *(c[x:y] for c in keys[1:])), counts[x:y], bits - ranges)) for k, x, y in quotient.by_range(keys[0], bits, ranges)]
                for i in range(0, len(rows), 1_000):
                    part = rows[i : i + 1_000]
                    same = lambda v, t, m=len(part): pa.array([v] * m, t)
                    yield pa.RecordBatch.from_arrays([same(lang, pa.string()), same(n, pa.int32()), same(wide, pa.bool_()), same(ranges, pa.int32()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], names=["lang", "n", "wide", "ranges", "range", "filter"])
            held.clear()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code_of, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            for first, last, data, offs in slices(batch.column(1)):
                found, at, begin = words(data, offs, of=_IN_WORD, table=table)
                number, maybe = numbers.of(found)
                row = np.repeat(np.arange(first, last), np.diff(at))
                piece = np.cumsum(_SEPARATOR[data], dtype=np.int64)[begin]
                code = code_of[row]
                # Neighbours in one piece of one text.
                both = maybe[1:] & maybe[:-1] & (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
                for n, ok in ((2, both), (3, both[1:] & both[:-1])):
                    start = np.flatnonzero(ok)
                    narrow = np.logical_and.reduce([number[start + i] >= 0 for i in range(n)])
                    for wide, these in ((False, start[narrow]), (True, start[~narrow])):
                        if not len(these):
                            continue
                        if wide:
                            keys = tuple(found[these + i] for i in range(n))
                        else:
                            key = np.zeros(len(these), np.uint64)
                            for i in range(n):
                                key = key << b | number[these + i].astype(np.uint64)
                            keys = (key,)
                        which = code[these]
                        order = np.argsort(which, kind="stable")
                        cuts = np.flatnonzero(np.diff(which[order])) + 1
                        for part in np.split(order, cuts):
                            held.setdefault((names[which[part[0]]], n, wide), []).append(tuple(k[part] for k in keys))
                        size += len(these) * len(keys)
                if size >= SHARD:
                    yield from flush()
                    size = 0
        yield from flush()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, _ = sent.value
        key, held = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            lang, n, wide, ranges, top = key
            bits = 64 if wide else n * numbers.bits
            keys, counts = quotient.merged(held)
            keep = counts >= least
            keys, counts = tuple(k[keep] for k in keys), counts[keep]
            if not len(counts):
                return
            whole = keys[0] | np.uint64(top << (bits - ranges))
            if wide:
                hashes = first_of_wide((whole, *keys[1:]))
            else:
                whole, own = quotient.restored(whole, bits), np.uint64((1 << numbers.bits) - 1)
                hashes = [numbers.hashes[((whole >> np.uint64(numbers.bits * (n - 1 - i))) & own).astype(np.int64)] for i in range(n)]
            columns = [pa.array(signed(h)) for h in hashes] + [pa.nulls(len(counts), pa.int64())] * (3 - n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), *columns, pa.array(counts.astype(np.int64))], names=["lang", "h1", "h2", "h3", "f"])

        for batch in batches:
            for *now, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tuple(now) != key and held:
                    yield from solve()
                    held.clear()
                key = tuple(now)
                held.append(raw)
        if held:
            yield from solve()

    by = ["lang", "n", "wide", "ranges", "range"]
    filters = source.mapInArrow(count, "lang string, n int, wide boolean, ranges int, range long, filter binary")
    return filters.repartition(*by).sortWithinPartitions(*by).mapInArrow(add_up, "lang string, h1 long, h2 long, h3 long, f long")


def _with(rows: DataFrame, on: list[str], values: DataFrame) -> DataFrame:
    """rows with the values of their key, one row a key; hot keys are broadcast."""
    stats = written(rows.groupBy(*on).agg(F.count("*").alias("_n")).join(values, on), "stats")
    return by_key(rows, stats, on, n="_n").drop("_n")


def score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in whole decimals of 38 digits: counts may have 15."""
    d = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    return F.expr(f"CAST((1000000BD * {d(a)} * {d(a)}) div ({d(l)} * {d(r)}) AS BIGINT)")


def _collocations(docs: DataFrame, lang_col: str, text_col: str, least: int, best: int, covered: int) -> DataFrame:
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = written(source.select("lang", _words(F.col("text")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("c")), "words")
    table = _BYTE
    for attempt in range(4):
        hashed = written(_hashed(counted, table), "hashed")
        clash = hashed.groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b"), F.max("c").alias("c")).where(f"a <> b AND c >= {least}")
        if clash.isEmpty():
            break
        table = mix(table + np.arange(256 * attempt + 1, 256 * attempt + 257, dtype=np.uint64))
    else:
        raise ValueError("frequent words have one hash under four hash functions")
    totals = written(counted.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    large = {r.lang: _ranges(r.n) for r in totals.where(F.col("n") >= RANGE).collect()}  # one row for each RANGE words at most
    frequent = hashed.where(F.col("c") >= least)
    found = written(_phrases(source, _numbers(frequent), large, table, least), "phrases")

    one = lambda k: frequent.select("lang", F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("c").alias(f"c{k}"))
    pairs = found.where("h3 IS NULL").select("lang", "h1", "h2", "f")
    pairs = written(_with(_with(pairs, ["lang", "h1"], one(1)), ["lang", "h2"], one(2)), "pairs")
    triples = found.where("h3 IS NOT NULL")
    head = pairs.withColumnsRenamed({"f": "f12"}).select("lang", "h1", "h2", "f12", "w1", "c1", "w2")
    tail = pairs.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("f").alias("f23"), F.col("w2").alias("w3"), F.col("c2").alias("c3"))
    triples = written(_with(_with(triples, ["lang", "h1", "h2"], head), ["lang", "h2", "h3"], tail), "triples")

    within = triples.select("lang", "h1", "h2", "f").unionByName(triples.select("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2"), "f"))
    within = within.groupBy("lang", "h1", "h2").agg(F.max("f").alias("longer"))
    alone = pairs.join(within, ["lang", "h1", "h2"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * f")
    two = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("c1").alias("l"), F.col("c2").alias("r"), score("f", "c1", "c2").alias("score"))
    cut = triples.withColumn("s1", score("f", "c1", "f23")).withColumn("s2", score("f", "f12", "c3"))
    first = F.col("s1") <= F.col("s2")
    three = cut.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.when(first, F.col("c1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("c3")).alias("r"), F.least("s1", "s2").alias("score"))

    # The best of each part of a language, then the best of those: no task ranks a language whole.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_DEALT))
    near = two.unionByName(three).withColumn("_part", part).withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, best: int = BEST, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `best` phrases of two or three words with `least` occurrences or more.

    A-Z are lower-cased; texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`.  score is
    floor(1000000 * a * a / (l * r)) at the cut of the phrase where that is least (the first of equal ones): a counts the phrase, l and r its
    parts, n all words of the language.  A phrase of which a longer one with `least` occurrences has `covered` percent
    of its occurrences or more is left out.  Order: score and a descending, then the phrase's bytes.

    A null language is `und`; null and empty texts hold no words; repeated rows count each.  Extra columns are ignored; an
    empty table gives no rows.
    """
    return distilled(lambda: _collocations(docs, lang_col, text_col, least, best, covered), "collocations")

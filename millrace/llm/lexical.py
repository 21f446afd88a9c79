"""Ranked lexical search of a query set over all documents, each distinct bag of words scored once.

1. A document is cut down to the words that some item has: its tf vector over the items' vocabulary.  Words are looked up by hash
   and then compared byte by byte.  With its number m, which stands for its length, the vector is all that a score depends on.
2. Documents with one m and vector are one class, found by grouping on the vector itself.
3. Tasks score classes, block by block, against all items and keep ten classes of each item: those with the highest scores, ties
   by the smallest doc id.  Ten documents come from ten classes at most, so nothing is lost.
4. The classes that are left are expanded to their members, found by a hash of the vector and verified against it, in order of doc id.

What moves is vectors and scores, never texts.  The items are a stated query set: they go to all tasks in groups of a bounded
number, one pass for each group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import distilled, written
from millrace.llm.textkit import TERM, _LOWER, slices, words

TOP = 10
#: Items that are sent to the tasks together; more take more passes.
ITEMS = 2_000
#: Scores (classes times items) that a task works out at once.
_CELLS = 1 << 20
#: Terms that are spread over their items at once, about.
_SPREAD = 1 << 20
_NULL = -(1 << 63)


class Vocabulary:
    """The items' words, found in bytes by hash and verified."""

    def __init__(self, terms: list[bytes]) -> None:
        text = np.frombuffer(b" ".join(terms), np.uint8) if terms else np.zeros(0, np.uint8)
        hashes, _, begin = words(text, np.array([0, len(text)]), of=TERM)
        order = np.argsort(hashes)
        self.hashes, begin = hashes[order], begin[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words of the items have one hash")
        self.names = order  # place in sorted hashes -> term
        self.size = np.array([len(t) for t in terms], np.int64)[order] if terms else np.zeros(0, np.int64)
        self.begin, self.text = begin, np.concatenate([text, np.zeros(8, np.uint8)])

    def find(self, data: np.ndarray, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are in the vocabulary, and their terms."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == size))
        at = at[found]
        lower = _LOWER[data]
        same = np.ones(len(found), bool)
        left, k = np.arange(len(found)), 0
        while len(left):
            same[left] &= lower[begin[found[left]] + k] == self.text[self.begin[at[left]] + k]
            k += 1
            left = left[self.size[at[left]] > k]
        return found[same], self.names[at[same]]


def vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every row: its words with repeats, and the vocabulary's among them in order, with counts."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(sent.value)
        for batch in batches:
            for first, last, data, offs in slices(batch.column(1)):
                hashes, at, begin = words(data, offs, of=TERM)
                n = np.diff(at)
                row = np.repeat(np.arange(last - first), n)
                size = _word_sizes(data, begin, offs, row)
                where, term = known.find(data, hashes, begin, size)
                key, counts = np.unique(row[where] << 32 | term, return_counts=True)
                cuts = pa.array(np.searchsorted(key, np.arange(last - first + 1) << 32), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def _word_sizes(data: np.ndarray, begin: np.ndarray, offs: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Bytes of the word that starts at each place: up to the next byte of no word, or its row's end."""
    stops = np.append(np.flatnonzero(~TERM[data]), len(data))
    return np.minimum(stops[np.searchsorted(stops, begin)], offs[1:][row]) - begin


class Items:
    """The items' words as postings: term -> the items that have it, and the term's weight."""

    def __init__(self, of: list[np.ndarray], weights: np.ndarray) -> None:
        item = np.repeat(np.arange(len(of)), [len(x) for x in of])
        term = np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.items, self.weights, self.n = item[order], weights, len(of)
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def scores(self, m: np.ndarray, offs: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(classes, items) of scores; every number is a whole one in 64 bits."""
        k = np.repeat(np.arange(len(m)), np.diff(offs))
        tf = counts.astype(np.int64)
        value = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[k]))
        out = np.zeros(len(m) * self.n, np.int64)
        n = self.start[terms + 1] - self.start[terms]
        upto = np.cumsum(n)
        cuts = [0, *np.searchsorted(upto, np.arange(_SPREAD, upto[-1] if len(upto) else 0, _SPREAD), side="right").tolist(), len(terms)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                each = n[a:b]
                step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                np.add.at(out, np.repeat(k[a:b] * self.n, each) + self.items[np.repeat(self.start[terms[a:b]], each) + step], np.repeat(value[a:b], each))
        return out.reshape(len(m), self.n)


def best(classes: DataFrame, items: list[np.ndarray], weights: np.ndarray, top: int) -> DataFrame:
    """(item, score, first, key, m, terms, counts): of each item the `top` classes that each task has found, by score, then first."""
    sent = classes.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(*sent.value)
        step = max(1, _CELLS // max(1, known.n))
        # Of each item, the best classes so far, and their rows.
        score, least = np.zeros((top, known.n), np.int64), np.full((top, known.n), np.iinfo(np.int64).max)
        place = np.full((top, known.n), -1)
        held: dict[int, tuple] = {}
        upto = 0
        for batch in batches:
            first, key, m = (batch.column(c).to_numpy() for c in ("first", "key", "m"))
            for a in range(0, len(m), step):
                b = min(a + step, len(m))
                seen, upto = upto, upto + b - a
                terms, counts = batch.column("terms").slice(a, b - a), batch.column("counts").slice(a, b - a)
                offs = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
                found = known.scores(m[a:b], offs, terms.flatten().to_numpy(), counts.flatten().to_numpy())
                # Only what reaches an item's lowest held score can enter.
                ci, ii = np.nonzero((found >= score[-1]) & (found > 0))
                if not len(ci):
                    continue
                s, f, i, p = (np.concatenate(x) for x in ((score.ravel(), found[ci, ii]), (least.ravel(), first[a:b][ci]), (np.tile(np.arange(known.n), top), ii), (place.ravel(), seen + ci)))
                order = np.lexsort((f, -s, i))
                s, f, i, p = s[order], f[order], i[order], p[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                keep = rank < top
                # Every item has `top` places held at least, empty ones with score 0.
                score, least, place = (x[keep].reshape(known.n, top).T.copy() for x in (s, f, p))
                now = set(place.ravel().tolist())
                for j in now & set((seen + np.unique(ci)).tolist()):
                    held[j] = (int(key[a + j - seen]), int(m[a + j - seen]), *(np.array(x[j - seen].values) for x in (terms, counts)))
                if len(held) > 2 * len(now) + 1000:
                    held = {j: held[j] for j in held.keys() & now}
        at = np.argwhere(score > 0)
        for a in range(0, len(at), 2_000):
            rows = [(int(i), int(score[r, i]), int(least[r, i]), *held[int(place[r, i])]) for r, i in at[a : a + 2_000].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int32())] * 2), strict=True)], names=["item", "score", "first", "key", "m", "terms", "counts"])

    return classes.mapInArrow(run, "item int, score long, first long, key long, m long, terms array<int>, counts array<int>")


def _terms_of(text: Column) -> Column:
    """The distinct words of a text, only A-Z lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)))


def _searched(docs: DataFrame, items: list[tuple], id_col: str, text_col: str, top: int) -> DataFrame:
    """The ranked documents of one group of items, (item, terms) each."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in items for t in terms})
    number = {t: k for k, t in enumerate(vocabulary)}
    reduced = written(vectors(docs, [t.encode() for t in vocabulary], id_col, text_col), "vectors")
    n, length = reduced.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = reduced.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row a term of the items
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counted:
        weights[r.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
    m = F.lit(10) + F.expr(f"(n * {90 * n}L) div {max(1, length)}L")
    bags = reduced.where(F.size("terms") > 0).withColumn("m", m).withColumn("key", F.xxhash64("m", "terms", "counts"))
    classes = bags.groupBy("key", "m", "terms", "counts").agg(F.min("doc_id").alias("first"))
    found = best(classes, [np.array([number[t] for t in terms], np.int64) for _, terms in items], weights, top)
    found = written(found, "found")
    by = W.partitionBy("item").orderBy(F.desc("score"), "first")
    winners = found.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= top).drop("_rank", "first")
    # At most `top` classes an item, so both sides of what follows are bounded by the items.
    winners = written(winners, "winners")
    same = ["key", "m", "terms", "counts"]
    members = bags.join(F.broadcast(winners.select("key").distinct()), "key", "left_semi")
    members = members.withColumn("_rank", F.row_number().over(W.partitionBy(*same).orderBy("doc_id"))).where(F.col("_rank") <= top)
    ranked = winners.join(members.select(*same, "doc_id"), same).withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` highest-scoring documents with a score above 0, equal scores by ascending doc id.

    Every row of docs is a document, repeated ones too; one without id counts as the smallest id.  Null and empty texts
    are in no result and don't count.  Rows of items with one id are one item with the words of all; an item without words has
    no rows.  Extra columns are ignored; an empty table on either side gives no rows.
    """
    own = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(_terms_of(F.col(item_text).cast("string"))).alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    out, group = [], []
    rank = lambda: out.append(distilled(lambda: _searched(docs, group, id_col, text_col, top), "ranked"))
    for r in own.orderBy("item_id").toLocalIterator():
        group.append((r.item_id, r.terms))
        if len(group) == ITEMS:
            rank()
            group.clear()
    if group or not out:
        rank()
    return reduce(DataFrame.unionByName, out)

"""The language model with a restaurant for every previous word, whatever their number.

P(word | previous word) comes from the previous word's restaurant; all of them share one parent over the words, whose base is
uniform with one place for all unknown words.  Both are seated by Gibbs as in `pitmanyor`, whose parameters they take.

Pairs of words are dealt to buckets by the previous word; those of the SPREAD most frequent previous words by both, so that
no bucket gets all of one.  A bucket's pairs are counted once and stay where they are.  In each sweep buckets seat their
pairs and send each word's new tables to the word's own bucket, which seats the parent and sends back what it serves.  Only
these numbers move: lists of words went ahead once.  A pair seen once has one table always and takes no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pitmanyor import BURN, DISCOUNT, KEEP, STRENGTH, before, class_of, seat, tokens, vocabulary_of
from millrace.llm.shared import dropped, written
from millrace.llm.textkit import mix
from millrace.sources.scratch import fresh

#: Words that travel as numbers (the most frequent; all others as hashes), and previous words whose pairs are dealt by both words.
FREQUENT, SPREAD = 50_000, 511
#: Tokens of a bucket and bytes of text that a token takes, about, and buckets of pairs to one of words: they write to each other in every sweep.
BUCKET, TOKEN_BYTES, WRITERS = 2_000_000, 6, 8
#: Bytes of token hashes that are dealt together, about: a task holds some twenty arrays of that size.
GROUP_BYTES = 6 << 20
SALT = np.uint64(0x5851F42D4C957F2D)

#: What a row holds: a bucket's pairs and where they stand, its pairs seen twice, lists of words or answers to them, tables, a sum, documents.
PAIRS, LIVE, WORDS, STATE, SUM, DOCS = range(6)
ROW = "kind int, part long, to long, n long, data binary, big binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of floats, or of whole numbers from 0, in as few bytes as these take, compressed."""
    arrays = tuple(x if x.dtype.kind == "f" else x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) for x in arrays)
    data = b"".join([" ".join(f"{x.dtype.str}:{len(x)}" for x in arrays).encode(), b"\n", *(x.tobytes() for x in arrays)])
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays; whole numbers as int64, or uint64 where they were."""
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    at, out = data.index(b"\n") + 1, []
    for kind, n in (x.split(":") for x in data[: at - 1].decode().split(" ")):
        x = np.frombuffer(data, kind, int(n), at)
        at += x.nbytes
        out.append(x.copy() if x.dtype.kind == "f" or x.dtype.itemsize == 8 else x.astype(np.int64))
    return out


def _rows(rows: list[tuple]) -> pa.Table:
    """(kind, part, to, n, data, big) as a table."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["kind", "part", "to", "n", "data", "big"]
    return pa.table([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], names=names)


def _of(rows: pa.Table, kind: int) -> list[tuple[int, list[np.ndarray]]]:
    """(sender, arrays) of the rows of one kind, by sender."""
    found = [(p, d) for k, p, d in zip(*(rows.column(x).to_pylist() for x in ("kind", "part", "data")), strict=True) if k == kind]
    return [(p, unpack(d)) for p, d in sorted(found)]


def _joined(parts: list[np.ndarray], dtype: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *parts])


def _cut(x: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    return np.split(x, np.cumsum(lengths)[:-1]) if len(lengths) else []


def _served(sent: np.ndarray, above: np.ndarray, totals: tuple[int, int], unit: float) -> np.ndarray:
    """What the parent serves each word with: sent customers at `above` tables, of totals[0] at totals[1]; unit is the base's."""
    return (sent - DISCOUNT * above + (STRENGTH + DISCOUNT * totals[1]) * unit) / (STRENGTH + totals[0])


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df written to the shared folder in buckets by `part` and read back: joins by `part` move only their other side."""
    spark, name = df.sparkSession, f"contexts_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "part").option("path", fresh(spark, "contexts")).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, and `out` knows them
    return out


def _frequent(vocabulary: DataFrame) -> list:
    """(h, c) of at most FREQUENT words, most frequent first: all from the least eighth of an octave of counts with no more above it."""
    octave = F.floor(F.log2("c") * 8)
    words, least = 0, None
    for r in vocabulary.groupBy(octave.alias("at")).count().orderBy(F.desc("at")).collect():
        words += r["count"]
        if words > FREQUENT:
            break
        least = r["at"]
    found = vocabulary.where(octave >= least).collect() if least is not None else []
    return sorted(found, key=lambda r: (-r["c"], r["h"]))


def score(source: DataFrame, left_out: int, burn: int = BURN, keep: int = KEEP, seed: int = 3) -> DataFrame:
    """(doc_id, fold, n_tokens, n_known, train_tokens, base_score, score) for rows of (doc_id, text, fold)."""
    spark = source.sparkSession
    vocabulary = vocabulary_of(source.where(F.col("fold") != left_out).select("text"))
    whole = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_words = whole["n"], whole["v"]
    unit = 1 / (n_words + 1)
    most = _frequent(vocabulary)
    dropped(vocabulary)
    top = np.array([r["h"] for r in most], dtype=np.int64).view(np.uint64)
    top_count = np.array([r["c"] for r in most], dtype=np.int64)
    known = len(top)
    size = source.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / TOKEN_BYTES + 1), F.lit(0))).first()[0]
    buckets = 1 + int(size) // BUCKET
    word_buckets = 1 + buckets // WRITERS
    spread = min(SPREAD, known)
    shared = spark.sparkContext.broadcast((top, top_count, np.argsort(top)))

    def hashes(code: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.concatenate([shared.value[0], others])[code]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each group of rows: its rows' sums of what frequent words add, and for each bucket its pairs and where they stand."""
        from pyspark import TaskContext

        top, top_count, order = shared.value
        logs = np.log10(np.append(top_count, 0) + 1.0)
        g = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, folds = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
            h, n = (np.concatenate([x[i] for x in held]) for i in (2, 3))
            held.clear()
            at = np.concatenate([[0], np.cumsum(n)])
            code = class_of(h, top[order], order, known).astype(np.int64)
            sums = [np.add.reduceat(x, at[:-1]) for x in ((code < known).astype(np.int64), logs[code])]
            fold = folds.fill_null(255).to_numpy(zero_copy_only=False).astype(np.int64)
            learned = (fold != left_out) & (fold != 255)
            doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            out = [(-1 - g, g, pack(doc_ids, ids.is_valid().to_numpy(zero_copy_only=False), fold, n, *sums))]
            rare = code == known
            others, where = np.unique(h[rare], return_inverse=True)
            code[rare] = known + where
            del h, rare
            width = known + len(others)
            pair, where = np.unique(before(code, at, int(code[at[1] - 1])) * width + code, return_inverse=True)
            del code
            entry, times = np.unique(np.repeat(np.arange(len(n)), n) * len(pair) + where, return_counts=True)
            doc, entry = np.divmod(entry, len(pair))
            u, w = np.divmod(pair, width)
            del where, pair
            key = mix(hashes(u, others))
            both = u < spread
            key[both] = mix(key[both] ^ mix(hashes(w[both], others) + SALT))
            b = (key % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            place = np.empty_like(by)
            place[by] = np.arange(len(by))
            of = b[entry]
            along = np.argsort(of, kind="stable")
            ends, stands = np.cumsum(np.bincount(b, minlength=buckets)), np.cumsum(np.bincount(of, minlength=buckets))
            for bucket in np.unique(b):
                first, last = ends[bucket - 1] if bucket else 0, ends[bucket]
                mine, own = by[first:last], along[stands[bucket - 1] if bucket else 0 : stands[bucket]]
                rest = np.unique(np.concatenate([u[mine], w[mine]]))
                rest = rest[rest >= known]
                codes = [np.where(x < known, x, known + np.searchsorted(rest, x)) for x in (u[mine], w[mine])]
                out.append((int(bucket), g, pack(others[rest - known], *codes, place[entry[own]] - first, doc[own], times[own], learned[doc[own]])))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "g", "data"])

        for batch in batches:
            for first, last, h, at in tokens(batch.column(1)):
                held.append((batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), h, np.diff(at)))
                size += 8 * len(h)
                if size > GROUP_BYTES:
                    yield flush()
                    held, size, g = [], 0, g + 1
        if held:
            yield flush()

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        """A bucket's pairs, counted; the lists of words it asks for; the tables of contexts that other buckets have too."""
        b = key[0].as_py()
        if b < 0:
            return _rows([(DOCS, b, g, None, d, None) for g, d in zip(rows.column("g").to_pylist(), rows.column("data").to_pylist(), strict=True)])
        groups, parts = zip(*sorted(zip(rows.column("g").to_pylist(), rows.column("data").to_pylist(), strict=True)), strict=True)
        parts = [unpack(x) for x in parts]
        others = np.unique(np.concatenate([x[0].astype(np.uint64) for x in parts]))
        width = known + len(others)
        found = []
        for x in parts:
            to = np.concatenate([np.arange(known), known + np.searchsorted(others, x[0].astype(np.uint64))])
            found.append(to[x[1]] * width + to[x[2]])
        start = np.cumsum([0, *map(len, found)])
        pair, where = np.unique(np.concatenate(found), return_inverse=True)
        at = where[np.concatenate([x[3] + s for x, s in zip(parts, start)])]
        doc, times, learned = (np.concatenate([x[i] for x in parts]) for i in (4, 5, 6))
        c = np.bincount(at, times * learned, len(pair)).astype(np.int64)
        u, w = np.divmod(pair, width)
        word = np.unique(w)
        h = hashes(word, others)
        v = (mix(h ^ SALT) % np.uint64(word_buckets)).astype(np.int64)
        by = np.lexsort((h, v))
        word, h, v = word[by], h[by], v[by]
        place = np.zeros(width, dtype=np.int64)
        place[word] = np.arange(len(word))
        w = place[w]
        add = lambda at, x, n: np.bincount(at, x, n).astype(np.int64)
        ones, live = add(w, c == 1, len(word)), add(w, c > 1, len(word)) > 0
        context, u = np.unique(u, return_inverse=True)
        hot = np.where(context < spread, context + 1, 0)
        customers = add(u, c, len(context))
        customers[hot > 0] = shared.value[1][context[hot > 0]]
        lengths = np.array([len(x[3]) for x in parts])
        big = pack(np.array(groups), lengths, at, doc, times, np.bincount(u, minlength=len(context)), hot, customers, w, c, word >= known)
        twice = c > 1
        to, lives = np.unique(v[live], return_counts=True)
        number = np.cumsum(live) - 1
        out = [(PAIRS, b, b, None, None, big)]
        out.append((LIVE, b, b, None, pack(to, lives, add(u, twice, len(context)), hot, add(u, c == 1, len(context)), number[w[twice]], c[twice]), None))
        asked, n = np.unique(v, return_counts=True)
        for to, *lists in zip(asked.tolist(), *(_cut(x, n) for x in (h, add(w, c, len(word)), ones, live)), strict=True):
            out.append((WORDS, b, to, None, pack(*lists), None))
        out += [(SUM, b, int(x) - 1, int(t), None, None) for x, t in zip(hot, add(u, c > 0, len(context)), strict=True) if x]
        return _rows(out)

    def open_words(key: tuple, rows: pa.Table) -> pa.Table:
        """A bucket's words: how often each was seen, and which of them every other bucket asked for, in its order."""
        v, parts = key[0].as_py(), _of(rows, WORDS)
        asked, where = np.unique(np.concatenate([x[0].astype(np.uint64) for _, x in parts]), return_inverse=True)
        c, ones, live = (np.concatenate([x[i] for _, x in parts]) for i in (1, 2, 3))
        c, ones = (np.bincount(where, x, len(asked)).astype(np.int64) for x in (c, ones))
        lives = [(b, int(x[3].sum())) for b, x in parts if x[3].any()]
        to, n = np.array(lives, dtype=np.int64).reshape(-1, 2).T
        askers, lengths = np.array([b for b, _ in parts]), np.array([len(x[0]) for _, x in parts])
        return _rows([(PAIRS, v, v, None, None, pack(askers, lengths, where, c)), (LIVE, v, v, None, pack(to, n, where[live > 0], ones, c > 0), None)])

    def sit(sweep: int, tables: np.ndarray, totals: tuple[int, int]) -> Callable:
        """Seats a bucket's pairs; `tables` are those of the contexts dealt to many buckets, `totals` the parent's."""

        def run(_: tuple, pairs: pa.Table, sent: pa.Table) -> pa.Table:
            (b, (to, lives, runs, hot, ones, w, c)) = _of(pairs, LIVE)[0]
            u = np.repeat(np.arange(len(runs)), runs)
            t, kept, past = _of(sent, STATE)[0][1] if sweep else (np.ones_like(c), np.zeros_like(c), np.zeros(0, np.int64))
            own = lambda t: ones + np.bincount(u, t, len(runs)).astype(np.int64)
            all_ = own(t)
            all_[hot > 0] = tables[hot[hot > 0] - 1]
            p = np.full(len(c), unit)
            if sweep:
                answers = [x for _, x in _of(sent, WORDS)]
                p = _served(_joined([x[0] for x in answers]), _joined([x[1] for x in answers]), totals, unit)[w]
            t = seat(c, all_[u] - t, p, np.random.default_rng([seed, sweep, b])).astype(np.int64)
            all_ = own(t)
            if sweep >= burn:
                kept, past = kept + t, _joined([past, all_[(runs > 0) & (hot == 0)]])
            out = [(STATE, b, b, None, pack(t, kept, past), None)]
            out += [(WORDS, b, int(v), None, pack(x), None) for v, x in zip(to, _cut(np.bincount(w, t, int(lives.sum())).astype(np.int64), lives), strict=True)]
            return _rows(out + [(SUM, b, int(x) - 1, int(n), None, None) for x, n in zip(hot, all_, strict=True) if x])

        return run

    def serve(sweep: int, above_all: int) -> Callable:
        """Seats the parent's customers, who came from the buckets' tables, and tells every bucket what it asked for."""

        def run(_: tuple, words: pa.Table, sent: pa.Table) -> pa.Table:
            (v, (to, n, where, ones, seen)) = _of(words, LIVE)[0]
            above, past = _of(sent, STATE)[0][1] if sweep else (seen, np.zeros(0, np.int64))
            came = ones + np.bincount(where, _joined([x[0] for _, x in _of(sent, WORDS)]), len(ones)).astype(np.int64)
            above = seat(came, above_all - above, np.full(len(came), unit), np.random.default_rng([seed + 1, sweep, v])).astype(np.int64)
            if sweep >= burn:
                past = _joined([past, came, above])
            out = [(STATE, v, v, None, pack(above, past), None), (SUM, v, 0, int(came.sum()), None, None), (SUM, v, 1, int(above.sum()), None, None)]
            out += [(WORDS, v, int(b), None, pack(x, y), None) for b, x, y in zip(to, _cut(came[where], n), _cut(above[where], n), strict=True)]
            return _rows(out)

        return run

    def tell(_: tuple, words: pa.Table, sent: pa.Table) -> pa.Table:
        """For all words that buckets asked for: their count, and the parent's customers and tables in the kept sweeps."""
        v, (to, n, where, c) = words.column("part")[0].as_py(), unpack(words.column("big")[0].as_py())
        past = _of(sent, STATE)[0][1][1].reshape(2 * keep, len(c))
        return _rows([(WORDS, v, int(b), None, pack(c[at], past[:, at].ravel()), None) for b, at in zip(to, _cut(where, n), strict=True)])

    def add_up(tables: list[np.ndarray], totals: list[tuple[int, int]]) -> Callable:
        """The log probabilities of a bucket's pairs, averaged over the kept sweeps, added up for each document."""

        def run(_: tuple, pairs: pa.Table, sent: pa.Table) -> pa.Table:
            b = pairs.column("part")[0].as_py()
            groups, lengths, at, doc, times, runs, hot, customers, w, c, rare = unpack(pairs.column("big")[0].as_py())
            answers = [x for _, x in _of(sent, WORDS)]
            count = _joined([x[0] for x in answers])
            past = np.concatenate([x[1].reshape(2 * keep, -1) for x in answers], axis=1)
            _, kept, tables_of = _of(sent, STATE)[0][1]
            u = np.repeat(np.arange(len(runs)), runs)
            t = (c > 0).astype(float)
            t[c > 1] = kept / keep
            moving = (np.bincount(u, c > 1, len(runs)) > 0) & (hot == 0)
            tables_of = tables_of.reshape(keep, -1)
            up = np.zeros(len(c))
            all_ = np.bincount(u, c == 1, len(runs))
            for k in range(keep):
                all_[moving] = tables_of[k]
                all_[hot > 0] = tables[k][hot[hot > 0] - 1]
                up += (STRENGTH + DISCOUNT * all_)[u] * _served(past[2 * k], past[2 * k + 1], totals[k], unit)[w]
            logs = np.log10((c - DISCOUNT * t + up / keep) / (STRENGTH + customers[u]))
            out = []
            base, old = np.where(rare, np.log10(count + 1.0), 0), rare.astype(bool) & (count > 0)
            for g, at, doc, times in zip(groups.tolist(), *(_cut(x, lengths) for x in (at, doc, times)), strict=True):
                docs, of = np.unique(doc, return_inverse=True)
                sums = [np.bincount(of, times * x[at]) for x in (old[w], base[w], logs)]
                out.append((STATE, b, g, None, pack(docs, sums[0].astype(np.int64), *sums[1:]), None))
            return _rows(out)

        return run

    def finish(_: tuple, docs: pa.Table, sums: pa.Table) -> pa.Table:
        ids, valid, fold, n, old, base = unpack(docs.column("data")[0].as_py())
        total = np.zeros(len(n))
        old, base = old.astype(float), base.copy()
        for _, (at, *more) in _of(sums, STATE):
            for x, y in zip((old, base, total), more, strict=True):
                x[at] += y
        return pa.table(
            {
                "doc_id": pa.array(ids.astype(np.uint64).view(np.int64), mask=valid == 0),
                "fold": pa.array(fold.astype(np.int32), mask=fold == 255),
                "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": pa.array(old.astype(np.int64)),
                "base_score": pa.array(base - n * np.log10(n_tokens + n_words + 1)),
                "score": pa.array(total),
            }
        )

    def meet(own: DataFrame, sent: DataFrame, run: Callable) -> DataFrame:
        return own.groupBy("part").cogroup(sent.groupBy("to")).applyInArrow(run, ROW)

    def summed(df: DataFrame, n: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        for r in df.where(F.col("kind") == SUM).groupBy("to").agg(F.sum("n").alias("n")).collect():
            out[r["to"]] = r["n"]
        return out

    dealt = source.select("doc_id", "text", F.col("fold").cast("int").alias("fold")).mapInArrow(deal, "part long, g long, data binary")
    made = _bucketed(dealt.groupBy("part").applyInArrow(gather, ROW), buckets)
    small = made.select("kind", "part", "to", "n", "data", F.lit(None).cast("binary").alias("big"))
    pairs, words = small.where(F.col("kind") == LIVE), _bucketed(small.where(F.col("kind") == WORDS).groupBy("to").applyInArrow(open_words, ROW), word_buckets)
    lists = words.select("kind", "part", "to", "n", "data", F.lit(None).cast("binary").alias("big")).where(F.col("kind") == LIVE)
    tables, totals = summed(small, spread), (0, n_words)
    asked = served = small.where("false")
    all_tables, all_totals = [], []
    for sweep in range(burn + keep):
        only = lambda df, kind: df.where(F.col("kind") == kind)
        sent = written(meet(pairs, only(asked, STATE).unionByName(only(served, WORDS)), sit(sweep, tables, totals)), "tables")
        answer = written(meet(lists, only(served, STATE).unionByName(only(sent, WORDS)), serve(sweep, totals[1])), "served")
        if sweep:
            dropped(asked, served)
        asked, served = sent, answer
        tables, totals = summed(asked, spread), tuple(summed(served, 2).tolist())
        if sweep >= burn:
            all_tables.append(tables)
            all_totals.append(totals)
    told = meet(words.where(F.col("kind") == PAIRS), served.where(F.col("kind") == STATE), tell)
    sums = meet(made.where(F.col("kind") == PAIRS), asked.where(F.col("kind") == STATE).unionByName(told), add_up(all_tables, all_totals))
    docs = small.where(F.col("kind") == DOCS)
    done = docs.groupBy("to").cogroup(sums.groupBy("to")).applyInArrow(finish, "doc_id long, fold int, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(n_tokens).cast("long"))

"""Language-model scores from a hierarchical Pitman-Yor model.

A text is its words and one end.  The M most frequent tokens of the training texts are classes of their own, all other
words are the class "rare"; a token's class is drawn given the previous token's class, and a rare word given that it is
rare.  Each previous class has a context restaurant, all context restaurants share one parent, whose base is uniform;
rare words have a restaurant of their own over a uniform base with one place for all unknown words.  So the context table
has at most (M + 1)^2 cells whatever the corpus, while the words' counts grow with it and stay distributed.

Seating is sampled by Gibbs: in each sweep the customers of every dish of every restaurant leave, and how many tables they
take when they come back is drawn from its distribution given the tables of all other dishes and the parent; tables send
customers to the parent, which is seated in turn.  The distribution is the exact one for up to EXACT customers; more come in
one by one, then in groups.  All dishes of a sweep see the tables of the sweep before, so that tasks needn't wait for one
another; a test holds the averages against a chain that moves one customer at a time.  Predictive probabilities are averaged
over the kept sweeps.  Rare words with equal counts are exchangeable, so their tables are drawn together, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import written
from millrace.llm.textkit import per_slice, signed

DISCOUNT, STRENGTH = 0.75, 1.0
BURN, KEEP = 4, 6
#: Text bytes whose words are looked up together, about.
GROUP_BYTES = 12 << 20
END = np.uint64(1)


#: Customers of a dish up to which its number of tables is drawn from the exact distribution.
EXACT = 256


@lru_cache(maxsize=4)
def log_ways(d: float, most: int = EXACT) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t): ways, by weight, in which c customers sit at t tables of one dish."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - d * t, 0)) + out[c, 1 : c + 2]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


def log_weights(c: int, others: np.ndarray, p: np.ndarray, d: float, a: float) -> np.ndarray:
    """For each pair: the log weight of t = 1 .. c tables of its c customers, given the tables of all other dishes and the parent."""
    t = np.arange(c)
    return log_ways(d)[c, 1 : c + 1] + (t + 1) * np.log(p)[:, None] + np.cumsum(np.log(a + d * (others[:, None] + t)), axis=1)


def shares(w: np.ndarray) -> np.ndarray:
    w = np.exp(w - w.max(axis=1, keepdims=True))
    return w / w.sum(axis=1, keepdims=True)


def seat(c: np.ndarray, others: np.ndarray, p: np.ndarray, rng: np.random.Generator, d: float = DISCOUNT, a: float = STRENGTH) -> np.ndarray:
    """Tables of c customers of one dish each, when all of them leave and are seated anew.

    `others` tables of other dishes stand in the restaurant, and the parent serves the dish with p.  Up to EXACT customers
    their number is drawn from its exact distribution; more customers come in one by one, and beyond that in groups of a
    sixteenth of those seated.
    """
    t = np.zeros(c.shape)
    at = np.flatnonzero(c > 0)
    order = at[np.argsort(c[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(c[order])) + 1
    for same in np.split(order, cuts) if len(order) else ():
        n = int(c[same[0]])
        if n == 1:
            t[same] = 1
        elif n <= EXACT:
            for part in np.array_split(same, 1 + len(same) * n // 1_000_000):
                total = np.cumsum(shares(log_weights(n, others[part].astype(float), p[part], d, a)), axis=1)
                t[part] = 1 + (total[:, :-1] < rng.random(len(part))[:, None]).sum(axis=1)
    at = at[c[at] > EXACT]
    c, others, p = c[at].astype(float), others[at].astype(float), p[at]
    tables, seated = np.ones(len(at)), np.ones(len(at))
    live = np.arange(len(at))
    while len(live):
        n, k = seated[live], tables[live]
        step = np.minimum(np.where(n < EXACT, 1, n // 16), c[live] - n)
        new = (a + d * (others[live] + k)) * p[live]
        tables[live] = k + rng.binomial(step.astype(np.int64), new / (n - d * k + new))
        seated[live] = n + step
        live = live[seated[live] < c[live]]
    t[at] = tables
    return t


def seat_alike(c: int, k: int, others: float, p: float, rng: np.random.Generator, d: float = DISCOUNT, a: float = STRENGTH) -> float:
    """Tables of k dishes with c customers each, c <= EXACT, all given the same: the dishes are dealt to numbers of tables at once."""
    if c == 1:
        return float(k)
    share = shares(log_weights(c, np.array([others]), np.array([p]), d, a))[0]
    return float((rng.multinomial(k, share) * np.arange(1, c + 1)).sum())


def context_matrix(counts: np.ndarray, burn: int = BURN, keep: int = KEEP, seed: int = 1, d: float = DISCOUNT, a: float = STRENGTH) -> np.ndarray:
    """Averaged predictive probabilities [previous class, class] for the counts [previous class, class]."""
    rng = np.random.default_rng(seed)
    m = len(counts)
    tables = (counts > 0).astype(float)
    parent = np.full(m, 1 / m)
    above = (tables.sum(axis=0) > 0).astype(float)  # the parent's tables
    rows = counts.sum(axis=1)[:, None]
    total = np.zeros(counts.shape)
    for sweep in range(burn + keep):
        others = tables.sum(axis=1)[:, None] - tables
        tables = seat(counts.ravel(), others.ravel(), np.broadcast_to(parent, counts.shape).ravel(), rng, d, a).reshape(counts.shape)
        sent = tables.sum(axis=0)  # the parent's customers
        above = seat(sent, above.sum() - above, np.full(m, 1 / m), rng, d, a)
        parent = (sent - d * above + (a + d * above.sum()) / m) / (a + sent.sum())
        if sweep >= burn:
            total += (counts - d * tables + (a + d * tables.sum(axis=1)[:, None]) * parent) / (a + rows)
    return total / keep


#: Words of one count that one task's row seats.
SEATED = 100_000


def rare_probabilities(sizes: DataFrame, burn: int = BURN, keep: int = KEEP, seed: int = 2, d: float = DISCOUNT, a: float = STRENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(counts, P(word | rare) for a word of each count, and last for all unknown words together).

    sizes: (c, words), how many words have each count, one row for each count.  In every sweep all words leave and sit down
    again, each given the tables of all others in the sweep before; the work is dealt to tasks by count and number, and a
    sweep's tables for each count come back to the driver: as many rows as there are distinct counts, below sqrt(2 n).
    """
    rows = sorted((r["c"], r["words"]) for r in sizes.collect())
    c, words = (np.array(x, dtype=np.float64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0), np.zeros(0))
    parts = sizes.select("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1) / SEATED))).alias("i"), "words")
    parts = parts.select("c", "i", F.least(F.lit(SEATED), F.col("words") - F.col("i") * SEATED).alias("k")).repartition("c", "i")
    total, base = float((c * words).sum()), 1 / (float(words.sum()) + 1)
    mean = np.ones(len(c))
    out = np.zeros(len(c) + 1)
    for sweep in range(burn + keep if rows else keep):
        tables = float((mean * words).sum())

        def sit(batches: Iterator[pa.RecordBatch], sweep: int = sweep, tables: float = tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, i, k = (x.to_numpy() for x in batch.columns)
                found = np.zeros(len(n))
                for at in np.flatnonzero(n <= EXACT):
                    found[at] = seat_alike(int(n[at]), int(k[at]), tables, base, np.random.default_rng([seed, sweep, int(n[at]), int(i[at])]), d, a)
                # Words of larger counts come in together, all counts at once.
                many = np.flatnonzero(n > EXACT)
                many = many[np.lexsort((i[many], n[many]))]
                if len(many):
                    c = np.repeat(n[many], k[many])
                    rng = np.random.default_rng([seed, sweep, *(int(x) for x in (n[many[0]], n[many[-1]], len(c)))])
                    t = seat(c, np.full(len(c), tables), np.full(len(c), base), rng, d, a)
                    found[many] = np.add.reduceat(t, np.cumsum(k[many]) - k[many])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["c", "tables"])

        if rows:
            made = {r["c"]: r["tables"] for r in parts.mapInArrow(sit, "c long, tables double").groupBy("c").agg(F.sum("tables").alias("tables")).collect()}
            mean = np.array([made[int(x)] for x in c]) / words
        tables = float((mean * words).sum())
        if sweep >= burn or not rows:
            new = (a + d * tables) / (a + total) * base
            out[:-1] += (c - d * mean) / (a + total) + new
            out[-1] += new
    return c.astype(np.int64), out / keep


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: (first, last, hashes of words and ends, row offsets in them)."""
    for first, last, h, at in per_slice(texts):
        ends = at[1:] + np.arange(last - first)
        out = np.full(len(h) + last - first, END, dtype=np.uint64)
        own = np.ones(len(out), dtype=bool)
        own[ends] = False
        out[own] = h
        yield first, last, out, np.concatenate([[0], ends + 1])


def class_of(h: np.ndarray, top: np.ndarray, order: np.ndarray, rest: int) -> np.ndarray:
    """The class of each hash: top is sorted, order has its classes; others get `rest`."""
    if not len(top):
        return np.full(len(h), rest)
    at = np.searchsorted(top, h)
    at[at == len(top)] = 0
    return np.where(top[at] == h, order[at], rest)


def before(k: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """The class before each token; before a text's first stands the end."""
    out = np.empty_like(k)
    out[1:] = k[:-1]
    out[at[:-1]] = end
    return out


def vocabulary_of(train: DataFrame) -> DataFrame:
    """(h, c): every distinct token of the texts in the one column, and its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held] + [np.zeros(0, np.uint64)])
            n = np.concatenate([x for _, x in held] + [np.zeros(0, np.int64)])
            h, where = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.bincount(where, n, len(h)).astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for _, _, h, _ in tokens(batch.column(0)):
                held.append(np.unique(h, return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return written(train.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "vocabulary")


def score(docs: DataFrame, folds: int = 7, left_out: int = 2, classes: int | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id as text) mod folds is left_out, and rows without id, aren't learned from; only the former are
    held_out.  score: log10 of the model's probability of the text; base_score: of add-one unigrams.  A null text
    counts as empty: one end.  Repeated rows are learned from and scored each; extra columns are ignored; an empty table gives
    no rows.  Words are told apart by 64-bit hashes.  Every previous word has a restaurant (`contexts`); given `classes`, only
    that many classes of tokens have, rare words share one, and the table of pairs is bounded by their square.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("fold", fold)
    held_out = F.coalesce(F.col("fold") == left_out, F.lit(False)).alias("held_out")
    if classes is None:
        from millrace.llm import contexts

        return contexts.score(source, left_out).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    train = source.where(F.col("fold") != left_out).select("text")

    vocabulary = vocabulary_of(train)
    whole = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_words = whole["n"], whole["v"]
    most = vocabulary.orderBy(F.desc("c"), "h").limit(classes - 1).collect()
    top = np.array([r["h"] for r in most], dtype=np.int64).view(np.uint64)
    top_count = np.array([r["c"] for r in most], dtype=np.int64)
    order = np.argsort(top)
    lookup = (top[order], order, classes - 1)
    end = int(class_of(np.array([END]), *lookup)[0])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            for _, _, h, at in tokens(batch.column(0)):
                k = class_of(h, *lookup)
                total += np.bincount(before(k, at, end) * classes + k, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(classes * classes)
        for batch in batches:
            counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        yield pa.RecordBatch.from_pydict({"p": pa.array([np.log10(context_matrix(counts.reshape(classes, classes))).tobytes()], pa.binary())})

    cells = train.mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    made = cells.repartition(1).mapInArrow(sample, "p binary").first()
    matrix = np.frombuffer(made["p"]).reshape(classes, classes) if made else np.full((classes, classes), -np.log10(classes))

    # Rare words: how many have each count.  Distinct counts are far fewer than words; they are bounded by sqrt(2 n).
    sizes = vocabulary.where(~F.col("h").isin([r["h"] for r in most])).groupBy("c").agg(F.count("*").alias("words"))
    size_of, rare = rare_probabilities(written(sizes, "sizes"))
    log_rare = np.log10(rare)
    shared = spark.sparkContext.broadcast((lookup, top_count, matrix))
    schema = "g long, h long, i int, doc_id long, fold int, n int, known int, score double, base double, words array<int>, times array<int>"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["g", "h", "i", "doc_id", "fold", "n", "known", "score", "base", "words", "times"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each group of rows: its distinct rare words once, and its rows with what needs no lookup."""
        from pyspark import TaskContext

        lookup, top_count, matrix = shared.value
        g = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def rows(made: dict, length: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([made[x].cast(t) if x in made else pa.nulls(length, t) for x, t in zip(names, types, strict=True)], names=names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal g
            distinct = np.unique(np.concatenate([x[2] for x in held]))
            yield rows({"g": pa.array(np.full(len(distinct), g)), "h": pa.array(signed(distinct)), "i": pa.array(np.arange(len(distinct)))}, len(distinct))
            for ids, folds_, found, of, sums in held:
                m = len(ids)
                cell, times = np.unique(of * len(distinct) + np.searchsorted(distinct, found), return_counts=True)
                at = np.searchsorted(cell // max(1, len(distinct)), np.arange(m + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(at, pa.array((x).astype(np.int32))) for x in (cell % max(1, len(distinct)), times)]
                yield rows({"g": pa.array(np.full(m, g)), "doc_id": ids, "fold": folds_, **{k: pa.array(x) for k, x in sums.items()}, "words": lists[0], "times": lists[1]}, m)
            g += 1

        for batch in batches:
            for first, last, h, at in tokens(batch.column(1)):
                k = class_of(h, *lookup)
                is_top = k < classes - 1
                steps = matrix[before(k, at, end), k]
                logs = np.zeros(len(h))
                logs[is_top] = np.log10(top_count[k[is_top]] + 1)
                of = np.repeat(np.arange(last - first), np.diff(at))
                add = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every row has an end
                sums = {"n": np.diff(at), "known": add(is_top.astype(np.int64)), "score": add(steps), "base": add(logs)}
                held.append((batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), h[~is_top], of[~is_top], sums))
                size += 8 * len(h)
                if size > GROUP_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    asked = written(source.select("doc_id", "text", "fold").mapInArrow(ask, schema), "asked")
    answers = asked.where("h IS NOT NULL").select("g", "h", "i").join(vocabulary, "h").select("g", "i", "c")
    waiting = asked.where("h IS NULL").drop("h", "i").withColumnRenamed("g", "group")

    def finish(_: tuple, found: pa.Table, rows: pa.Table) -> pa.Table:
        count = np.zeros(1 + max([0, *found.column("i").to_numpy()]), dtype=np.int64)
        count[found.column("i").to_numpy()] = found.column("c").to_numpy()
        words, times = rows.column("words").combine_chunks(), rows.column("times").combine_chunks()
        i, n = words.flatten().to_numpy(), times.flatten().to_numpy()
        c = np.where(i < len(count), count[np.minimum(i, len(count) - 1)], 0)
        of = np.repeat(np.arange(len(rows)), pc.list_value_length(words).to_numpy())
        p = np.where(c > 0, log_rare[np.minimum(np.searchsorted(size_of, c), len(log_rare) - 1)], log_rare[-1])
        add = lambda x: np.bincount(of, x, len(rows))
        total = rows.column("n").to_numpy()
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "fold": rows.column("fold"),
                "n_tokens": pa.array(total.astype(np.int64)),
                "n_known": pa.array((rows.column("known").to_numpy() + add(n * (c > 0))).astype(np.int64)),
                "base_score": pa.array(rows.column("base").to_numpy() + add(n * np.log10(c + 1.0)) - total * np.log10(n_tokens + n_words + 1)),
                "score": pa.array(rows.column("score").to_numpy() + add(n * p)),
            }
        )

    done = answers.groupBy("g").cogroup(waiting.groupBy("group")).applyInArrow(finish, "doc_id long, fold int, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", held_out, "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")

"""N-gram Jaccard join: which documents' shingle sets are similar, exactly, and the components that such links form.

1. Each document becomes its set of distinct word shingles; equal sets collapse to the smallest id.
2. Sets that can be similar must meet.  A set of n shingles keeps at least percent/100 of them in any similar set, so under
   one order of all shingles similar sets share one of their first n - ceil(percent * n / 100) + 1.  Those are a set's
   keys, each with the band of sizes in which a similar set can lie.  The order puts shingles that are common in the corpus last (by a sketch of counts over all documents, of fixed
   size), so a common line or passage brings no documents together that are otherwise different.  Any order is exact;
   the sketch only saves work.  The smallest id with a key is the key's pivot; documents that share a pivot form its block.
3. A block's members whose bitmaps rule out every partner in it, by a dual traversal of signature trees over the bitmaps,
   leave it.  (Blocks of more than TILE members keep all.)
4. Texts move.  Each document goes first to the block of its smallest pivot only; blocks are dealt in chunks of bounded
   size, each with the pivot, and each chunk is joined by a signature tree.  The links form components.
5. A link that is still missing joins two components, so one of its ends isn't connected to the pivot of their block.
   Those ends are joined with all members of the block that bitmaps allow and that lie in other components.

Only connecting links are kept (a group of n copies has n - 1), so groups of any size stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import sigtree
from millrace.llm.shared import by_key, components, dropped, narrowed, written
from millrace.llm.textkit import mix, per_slice, signed

#: Shingles in a chunk of a block, about: what one task's tree holds at once.
CHUNK = 400_000
#: Members of a block whose bitmaps one task compares at once.
TILE = 2_000
#: Most pivots of large blocks that are broadcast.
LARGE = 100_000
#: Counters of the sketch, a byte each in a task: how common shingles are.
SKETCH, SKETCH_ROW = 1 << 20, 1 << 14
_SEEN = 100_000


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text with fewer than n words has one shingle, without words none."""
    for first, last, w, at in per_slice(texts):
        rows = mix(w)
        full = rows[: max(0, len(w) - n + 1)].copy()
        for k in range(1, n):
            full = mix(full * np.uint64(0xD1B54A32D192ED03) + w[k : len(w) - n + 1 + k])
        for i in range(last - first):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= n:
                yield np.unique(full[a : b - n + 1])
            elif b > a:
                h = rows[a : a + 1].copy()
                for k in range(a + 1, b):
                    h = mix(h * np.uint64(0xD1B54A32D192ED03) + w[k : k + 1])
                yield h + np.uint64(b - a)
            else:
                yield rows[:0]


def commonness(counts: np.ndarray) -> np.ndarray:
    """A class for each counter of the sketch: 0 for what is about as common as the mean, more for each doubling."""
    return np.log2(1 + counts / (2 * counts.mean() + 8)).astype(np.uint8)


def counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64) % SKETCH


def size_bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Least sizes of bands about (100 / percent)^4 wide."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * (100 / max(percent, 50)) ** 4)))
    return np.array(edges, dtype=np.int64)


def keys(s: np.ndarray, percent: int, classes: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The keys of a set: two sets of the asked similarity share one.

    A key is a shingle and a band of sizes: the set's own, and the next one if a similar set can be so large.
    """
    n = len(s)
    first = n + percent * n // -100 + 1  # n - ceil(percent * n / 100) + 1
    order = np.lexsort((s, classes[counter(s)]))
    chosen = s[order[:first]]
    band = int(np.searchsorted(bands, n, side="right"))
    last = int(np.searchsorted(bands, 100 * n // percent, side="right"))
    return np.concatenate([mix(chosen + np.uint64(b * 0x9E3779B97F4A7C15 % 2**64)) for b in range(band, last + 1)])


def _set_key(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables of one group each."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        cols = [t.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if len(t) else []
        for a, b in pairwise([0, *cuts, len(t)]):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def _tree_links(members: DataFrame, by: list[str], n: int, percent: int, sides: bool = False) -> DataFrame:
    """Join each group of members (id, text) by a signature tree: rows (a, b).  sides: members also have side and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for t in _grouped(batches, by):
            ids = t.column("id").to_pylist()
            sets = list(shingle_sets(t.column("text"), n))
            side, label = (t.column("side").to_numpy(), t.column("label").to_numpy()) if sides else (None, None)
            for i, j in sigtree.links(sets, percent, side, label):
                a.append(ids[i])
                b.append(ids[j])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    cols = [*by, "id", "text", *["side", "label"] * sides]
    return members.select(*cols).repartition(*by).sortWithinPartitions(*by, "id").mapInArrow(run, "a long, b long")


def _possible(rows: DataFrame, by: list[str], percent: int, sides: bool = False) -> DataFrame:
    """The rows (pivot, id, size and, with sides, label, side) of each group that may have a partner in it, by their `bits`."""
    cols = ["pivot", "id", "size", *["label", "side"] * sides]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, by):
            maps = [np.frombuffer(x, np.uint64) for x in t.column("bits").to_pylist()]
            side, label = (t.column("side").to_numpy(), t.column("label").to_numpy()) if sides else (None, None)
            found = sigtree.partners(maps, t.column("size").to_numpy(), percent, side, label)
            yield from t.select(cols).filter(pa.array(found)).to_batches()

    made = rows.select(*dict.fromkeys([*by, *cols, "bits"])).repartition(*by).sortWithinPartitions(*by)
    return made.mapInArrow(run, "pivot long, id long, size long" + ", label long, side boolean" * sides)


def _with_partners(pivots: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(pivot, id, size) of the blocks' members that may have a partner in the block; pivots has the others (id, pivot)."""
    counts = written(pivots.groupBy("pivot").agg(F.count("*").alias("n")), "counts")
    small = counts.where(F.col("n") < TILE).select("pivot")
    large = counts.where(F.col("n") >= TILE).select("pivot")
    hosts = small.select(F.col("pivot").alias("id"), "pivot")
    found = _possible(pivots.join(small, "pivot", "left_semi").unionByName(hosts).join(reps, "id"), ["pivot"], percent)
    whole = pivots.join(F.broadcast(large), "pivot", "left_semi") if large.count() <= LARGE else pivots.join(large, "pivot", "left_semi")
    return found.unionByName(whole.join(reps.select("id", "size"), "id").select("pivot", "id", "size")).where("id <> pivot").distinct()


def _dealt(c: str, n: str) -> Column:
    return F.expr(f"cast(pmod(xxhash64({c}), {n}) AS int)")


def _all_of(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _meetings(rows: DataFrame, each: str, most: int) -> DataFrame:
    """Deal blocks so that each row with side meets all rows without: rows by (pivot, part, chunk); `each` is a row's load."""
    load = lambda side: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("side") == side, F.expr(each)).otherwise(0)) / most)).cast("int")
    n = rows.groupBy("pivot").agg(load(True).alias("parts"), load(False).alias("chunks"))
    rows = rows.join(n, "pivot")
    left = rows.where("side").withColumn("part", _dealt("id", "parts")).withColumn("chunk", _all_of("chunks"))
    right = rows.where("NOT side").withColumn("part", _all_of("parts")).withColumn("chunk", _dealt("id", "chunks"))
    return left.unionByName(right).drop("parts", "chunks")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds the distinct n-word shingles, or with fewer words the
    whole sequence as one.  Two documents link when 100 * |intersection| >= percent * |union|.  component_id is the
    smallest id reachable by links.  Null, empty and blank texts have an empty set and are linked with nothing.
    Repeated rows are all kept; rows of one id with several texts are one document that links by each of its texts; rows with a null id are kept, with their size and a null component, and link nothing.
    Extra columns are ignored; an empty table gives no rows.  Shingles are told apart by 64-bit hashes.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.int64)
        names = ["id", "size", "hi", "lo", "bits", "part"]
        for batch in batches:
            size, hi, lo, bits = [], [], [], []
            for s in shingle_sets(batch.column(1), n):
                size.append(len(s))
                bits.append(sigtree.bitmap(s, sigtree.width_of(len(s))).tobytes())
                np.add.at(counts, counter(s), 1)
                h, g = _set_key(s)
                hi.append(h)
                lo.append(g)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, hi, lo)), pa.array(bits, pa.binary()), pa.nulls(len(size), pa.int32())], names=names)
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(-1, SKETCH_ROW)
        part = np.flatnonzero(parts.any(axis=1)).astype(np.int32)
        none = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([parts[i].tobytes() for i in part], pa.binary()), pa.array(part)], names=names)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a task's rows of counters."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.frombuffer(raw.as_py(), np.uint8)
                sums[part] = sums[part] + row if part in sums else row.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "sums"])

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        rank, bands = shared.value, size_bands(percent)
        for batch in batches:
            made, ids = [], []
            held = 0
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                if not len(s) or seen.get(k := _set_key(s), doc + 1) <= doc:
                    continue  # an equal set with a smaller id has given these keys
                if len(seen) < _SEEN:
                    seen[k] = doc
                made.append(keys(s, percent, rank, bands))
                ids.append(doc)
                held += len(made[-1])
                if held > 100_000:
                    yield _pairs(made, ids)
                    made, ids, held = [], [], 0
            if made:
                yield _pairs(made, ids)

    measured = written(source.mapInArrow(measure, "id long, size long, hi long, lo long, bits binary, part int"), "sets")
    sets = measured.where("part IS NULL").drop("part")
    counts = np.zeros((SKETCH // SKETCH_ROW, SKETCH_ROW), dtype=np.int64)
    rows = measured.where("part IS NOT NULL").select("part", "bits").repartition("part").mapInArrow(add_up, "part int, sums binary")
    for row in rows.toLocalIterator():  # SKETCH counters in all
        counts[row["part"]] += np.frombuffer(row["sums"], np.int64)
    shared = source.sparkSession.sparkContext.broadcast(commonness(counts.reshape(-1)))
    full = sets.where("size > 0 AND id IS NOT NULL")
    first = written(full.groupBy("hi", "lo", "size").agg(F.min("id").alias("rep"), F.any_value("bits").alias("bits"), F.count("*").alias("n")), "firsts")
    reps = first.select(F.col("rep").alias("id"), "size", "bits")

    keyed = written(narrowed(source.where("id IS NOT NULL"), reps, "id").select("id", "text").mapInArrow(key_rows, "key long, id long"), "keys")
    met = written(keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "met")
    pivots = by_key(narrowed(keyed, met, "key"), met, ["key"]).where("id <> pivot").select("id", "pivot").distinct()
    pivots = written(pivots.join(reps.select("id"), "id", "left_semi"), "pivots")
    dropped(keyed, met)
    candidates = written(_with_partners(pivots, reps, percent), "candidates")
    dropped(pivots)

    once = candidates.groupBy("id").agg(F.min("pivot").alias("pivot"), F.max("size").alias("size"))
    blocks = once.groupBy("pivot").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("chunks"))
    members = once.join(blocks, "pivot").select("pivot", _dealt("id", "chunks").alias("chunk"), "id")
    hosts = blocks.select("pivot", _all_of("chunks").alias("chunk"), F.col("pivot").alias("id"))
    members = written(members.unionByName(hosts), "members")
    links = written(_tree_links(members.hint("merge").join(narrowed(source, members, "id"), "id"), ["pivot", "chunk"], n, percent), "links")
    classes = written(components(links), "classes")
    dropped(members)

    label = lambda c, name: classes.select(F.col("id").alias(c), F.col("component_id").alias(name))
    rest = candidates.join(label("id", "own"), "id", "left").withColumn("label", F.coalesce("own", "id"))
    rest = rest.join(label("pivot", "theirs"), "pivot", "left").withColumn("side", F.col("label") != F.coalesce("theirs", "pivot"))
    rest = written(rest.select("pivot", "id", "size", "label", F.coalesce("theirs", "pivot").alias("theirs"), "side"), "rest")
    mixed = written(rest.where("side").groupBy("pivot").agg(F.any_value("theirs").alias("label")), "mixed")
    if not mixed.isEmpty():
        host = mixed.select("pivot", F.col("pivot").alias("id"), "label").join(reps.select("id", "size"), "id").withColumn("side", F.lit(False))
        apart = rest.where("side").drop("theirs")
        both = rest.join(mixed.select("pivot"), "pivot", "left_semi").drop("theirs").withColumn("side", F.lit(False)).unionByName(host).unionByName(apart)
        found = _possible(_meetings(both, "1", TILE).join(reps.select("id", "bits"), "id"), ["pivot", "part", "chunk"], percent, sides=True)
        found = written(found.distinct(), "found")
        meetings = written(_meetings(found, "size", CHUNK), "meetings")
        more = _tree_links(meetings.hint("merge").join(narrowed(source, meetings, "id"), "id"), ["pivot", "part", "chunk"], n, percent, sides=True)
        more = written(more, "links")
        done, classes = classes, written(components(links.unionByName(more)), "classes")
        dropped(done, found, meetings, more)
    dropped(rest, mixed, candidates, links)

    named = first.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("hi", "lo", "size", "n", F.coalesce("component_id", "rep").alias("component_id"))
    named = written(named, "named")
    known = by_key(sets.where("size > 0").select("id", "hi", "lo", "size"), named, ["hi", "lo", "size"], how="left").select("id", "size", "component_id")
    known = known.unionByName(sets.where("size = 0").select("id", "size", F.col("id").alias("component_id")))
    return known.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _pairs(made: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(made))), pa.array(np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in made]))], names=["key", "id"])

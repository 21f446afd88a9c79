"""Each stage of the pipeline against plain Python, row by row, on what the stage before kept."""

import math
import random
import zlib

import numpy as np
import pytest
from test_operators import classes, covered, prose, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, cut_text string, slot int"


def planted():
    r = random.Random(9)
    passage = prose(45, r)
    rows = []
    for i in range(70):
        t = prose(r.randint(15, 120), r)
        if i % 9 == 4:
            t = t + " " + passage + " " + prose(20, r)
        if i % 11 == 3:
            t = prose(4, r)  # too short
        if i % 13 == 5:
            t = " ".join(["spam spam spam eggs spam"] * 12)  # repeats itself
        rows.append((i, t))
    for i in (6, 8, 21):  # near copies
        w = rows[i][1].split()
        w[len(w) // 2] = "edited"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, rows[10][1]), (201, rows[10][1]), (202, None), (203, ""), (None, prose(40, r)), rows[12]]
    return [(i, t, "en", None if k % 10 == 0 else f"s{k % 3}", len(t or ""), "x", 7) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(0, 70)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage(spark, folder, tmp_path):
    import corpus_pipeline as P
    import public_tokenizers
    import xxhash
    from millrace.llm.quality import BUCKETS, THRESHOLD
    from tokenizers import Tokenizer

    stages = dict(P.STAGES)
    docs = planted()

    # Quality: length and repetition, then the ratio of two multinomials over hashed words and pairs.
    s = lambda x: x - 2**64 if x >= 2**63 else x

    def grams(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(t, lower=False)]
        pair = lambda x, y: s(xxhash.xxh64_intdigest(y.to_bytes(8, "little"), xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42)))
        return [s(x) % BUCKETS for x in h] + [pair(x, y) % BUCKETS for x, y in zip(h, h[1:])]

    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, t, *_ in docs:
        for x in grams(t):
            raw[x] += 1
            target[x] += i is not None and i < 70 and i % 2 == 0
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))

    def kept(t):
        w = words(t, lower=False)
        five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {k for j, x in enumerate(five) if five.count(x) > 1 for k in range(j, j + 5)}
        return len(w) >= 10 and 100 * len(twice) <= 20 * len(w) and ratio[grams(t)].mean() >= THRESHOLD

    frame = spark.createDataFrame(docs, COLUMNS).repartition(3)
    want = [d for d in docs if kept(d[1])]
    got = stages["quality_rules"](spark, frame, folder)
    assert got.columns == frame.columns and rows_of(got) == sorted(want, key=str)
    assert 20 < len(want) < len(docs)

    # Near copies: the smallest id of each class; one row for an id.
    docs = want + [(300 + k, "", "en", "s1", 0, "x", 7) for k in range(2)]
    component = {(i, n): c for i, n, c in classes([(d[0], d[1]) for d in docs], 5, 80)}
    first = {c for (i, _), c in component.items() if i is not None and i == c}
    want = list({(d[0] if d[0] is not None else (k,)): d for k, d in enumerate(docs) if d[0] is None or d[0] in first}.values())
    got = rows_of(stages["near_duplicates"](spark, spark.createDataFrame(docs, COLUMNS).repartition(3), folder))
    assert got == sorted(want, key=str) and len(want) < len(docs)

    # Repeated passages: bytes covered by 100-byte strings that also start earlier.
    r = random.Random(10)
    passage = prose(45, r)
    docs = want + [(400 + k, prose(20, r) + "\n" + passage + "\n" + prose(10 * k, r), "en", "s2", 1, "x", 7) for k in range(3)] + [(410, passage, "en", "s2", 1, "x", 7)]
    gone = covered([(d[0], d[1]) for d in docs])
    seen, want = set(), []
    for d in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        b = (d[1] or "").encode()
        cut = set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cut |= set(range(k, k + 100))
            seen.add(b[k : k + 100])
        assert gone[-(2**63) if d[0] is None else d[0], d[1] or ""][1] == len(cut)
        t = bytes(x for k, x in enumerate(b) if k not in cut).decode(errors="ignore")
        if not cut or d[0] is None:
            want.append(d)
        elif t:
            want.append((d[0], t, *d[2:4], len(t), *d[5:]))
    got = rows_of(stages["repeated_passages"](spark, spark.createDataFrame(docs, COLUMNS).repartition(3), folder))
    assert got == sorted(want, key=str) and want != sorted(docs, key=lambda d: -1 if d[0] is None else d[0])

    # The mix keeps every row; few characters are one block for each source, in the order of the schedule.
    docs = want
    mixed = stages["source_weights"](spark, spark.createDataFrame(docs, COLUMNS).repartition(3), folder)
    out = [tuple(r) for r in mixed.collect()]
    assert sorted(out, key=str) == sorted(docs, key=str)
    order = [d[3] or "" for d in out]
    runs = [x for k, x in enumerate(order) if not k or order[k - 1] != x]
    assert len(runs) == len(set(runs))
    sizes = {x: sum(len(d[1] or "") for d in docs if (d[3] or "") == x) for x in runs}
    q = {x: max(1, math.floor(sizes[x] ** 0.9 * 1000 / sum(v**0.9 for v in sizes.values()) + 1e-9)) for x in runs}
    n = sum(q.values())
    assert runs == sorted(runs, key=lambda x: (-(-n // q[x]), x))

    # Packing: the ids of every document, once, gapless in their sequences.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stages["packing"](spark, spark.createDataFrame(out, COLUMNS).repartition(3), folder).collect()
    ids = {d[0]: [*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 1] for d in out}
    at = {}
    for x in sorted(pieces, key=lambda x: (x.doc_id or -1, x.start)):
        assert x.start == at.get(x.doc_id, 0) and x.doc_tokens == len(ids[x.doc_id])
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert x.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        at[x.doc_id] = x.start + x.length
    assert at == {i: len(v) for i, v in ids.items()}
    ends = {}
    for x in sorted(pieces, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    assert max(ends.values()) <= 2048


def test_empty_tables(spark, folder):
    import corpus_pipeline as P

    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in P.STAGES:
        assert stage(spark, empty, folder).collect() == [], name


def test_rows_without_ids_and_repeated_ones(spark, folder):
    import corpus_pipeline as P

    r = random.Random(4)
    long, other = prose(80, r), prose(80, r)
    rows = [(None, long, "en", None, 1, "x", 7)] * 2 + [(1, other, "en", "s", 1, "x", 7)] * 2 + [(1, long, "en", "s", 1, "x", 7), (5, long, "en", "s", 1, "x", 7)]
    docs = spark.createDataFrame(rows, COLUMNS)
    near = P.near_duplicates(spark, docs, folder)
    assert sorted(str(x.doc_id) for x in near.collect()) == ["1", "None", "None"]
    cut = P.repeated_passages(spark, docs, folder)
    got = sorted((str(x.doc_id), x.text) for x in cut.collect())
    assert got.count(("None", long)) == 2 and not any(i == "5" for i, _ in got)
    assert P.source_weights(spark, docs, folder).count() == len(rows)

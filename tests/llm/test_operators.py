"""The training-data operators on small tables: awkward rows, and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, h long, run int"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choices(VOCABULARY, k=n))


def corpus():
    base, passage = prose(120), prose(40)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), None, "", " \n\t ", "one", "one two", "one two", passage + "\n" + prose(50), prose(60) + " " + passage, prose(4000), prose(30).upper(), "a b c d e f g h i j " * 20]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 50, prose(rng.randint(10, 80))) for i in range(20)]
    return [*rows, rows[0], rows[9], (None, prose(30)), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", 1, "x", 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


def words(t, lower=True):
    t = t or ""
    if lower:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(rows, n, percent):
    ids = [i for i, _ in rows]
    sets = [shingles(t, n) for _, t in rows]
    up = {i: i for i in ids if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets)), key=str)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, empty, rows, n, percent):
    from millrace.llm.jaccard import jaccard_join

    assert sorted((tuple(r) for r in jaccard_join(docs, n=n, percent=percent).collect()), key=str) == classes(rows, n, percent)
    assert jaccard_join(empty).collect() == []


def test_jaccard_chains_of_near_copies(spark, monkeypatch):
    """Long chains, where most members are far from the smallest id, with chunks so small that blocks are split."""
    from millrace.llm import jaccard

    monkeypatch.setattr(jaccard, "CHUNK", 700)
    r = random.Random(3)
    rows, w = [], prose(60, r).split()
    for i in range(60):
        w = list(w)
        w[r.randrange(60)] = f"w{i}"
        rows.append((i * 7 % 60, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (80, 90):
        got = sorted((tuple(x) for x in jaccard.jaccard_join(df, n=2, percent=percent).collect()), key=str)
        assert got == classes(rows, 2, percent)


def test_keys_meet_whatever_the_edit():
    from millrace.llm.jaccard import SKETCH, commonness, keys, size_bands

    g = np.random.default_rng(5)
    for classes in (np.zeros(SKETCH, np.uint8), commonness(g.integers(0, 300, SKETCH))):
        for percent in (80, 90):
            for _ in range(300):
                n = int(g.integers(1, 300))
                s = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
                out = g.integers(0, max(1, int(len(s) * (100 - percent) / 100)) + 1)
                t = np.unique(np.concatenate([g.permutation(s)[out:], g.integers(0, 2**63, int(g.integers(0, 1 + n // 10))).astype(np.uint64)]))
                both = len(np.intersect1d(s, t))
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    assert np.intersect1d(keys(s, percent, classes, size_bands(percent)), keys(t, percent, classes, size_bands(percent))).size, (n, percent)


def test_quality_measures(docs, empty, rows, labels):
    from millrace.llm.quality import quality

    def expected(t):
        w = words(t, lower=False)
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {j for i, x in enumerate(five) if five.count(x) > 1 for j in range(i, i + 5)} if len(w) < 1000 else set()
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    made = quality(docs, labels)
    assert {"lang", "source"} <= set(made.columns)
    got = made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr").collect()
    want = sorted(((i, *expected(t)) for i, t in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= -0.1)
    assert quality(empty, labels).collect() == []


def test_quality_ratio_is_that_of_the_multinomials(spark):
    import math

    import xxhash
    from millrace.llm.quality import quality

    r = random.Random(1)
    rows = [(i, prose(30, r)) for i in range(30)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1) for i in range(0, 30, 3)], "doc_id long, quality int")
    b = 64

    def grams(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(t, lower=False)]
        s = lambda x: x - 2**64 if x >= 2**63 else x
        pair = lambda x, y: s(xxhash.xxh64_intdigest(y.to_bytes(8, "little"), xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42)))
        return [s(x) % b for x in h] + [pair(x, y) % b for x, y in zip(h, h[1:])]

    raw, target = np.zeros(b), np.zeros(b)
    for i, t in rows:
        for x in grams(t):
            raw[x] += 1
            target[x] += i % 3 == 0
    ratio = np.log((target + 1) / (target.sum() + b)) - np.log((raw + 1) / (raw.sum() + b))
    for row in quality(docs, labels, buckets=b).collect():
        assert math.isclose(row.llr, ratio[grams(rows[row.doc_id][1])].mean(), abs_tol=1e-9)


def test_fingerprints(docs, empty, rows):
    from millrace.llm.fuzzy import fingerprint, fingerprints

    order = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        want.append((None if i < -1 else i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t.encode()), fingerprint(e.encode())))
    got = fingerprints(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprints(empty).collect() == []


def test_edit_distances():
    from millrace.llm.fuzzy import distances

    def slow(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[j - 1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(2)
    pairs = [("".join(r.choices("abc", k=r.randint(0, 64))), "".join(r.choices("abc", k=r.randint(0, 64)))) for _ in range(200)]
    assert distances(pairs).tolist() == [slow(a, b) for a, b in pairs]


def covered(rows):
    """Brute force: which bytes go, by id; rows that share an id count once."""
    seen, out = set(), {}
    for i, t in sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}):
        b, cov = t.encode(), set()
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cov |= set(range(s, s + 100))
            seen.add(w)
        spans = sum(x - 1 not in cov for x in cov)
        out[i, t] = (len(b), len(cov), spans, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in cov)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats(docs, empty, rows, monkeypatch, hot):
    from millrace.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARE", 1)
    monkeypatch.setattr(repeats, "BLOCK", 500)
    one = [r for r in rows if r[0] is not None]
    want = covered(one)
    got = repeats.repeats(docs.where("doc_id IS NOT NULL")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *want[i, t or ""]) for i, t in one)
    # The runs and whole copies that changes() lists take away the same bytes.
    lost = {r.doc_id: r for r in repeats.changes(docs.where("doc_id IS NOT NULL")).collect()}
    for i, t in one:
        raw, gone = (t or "").encode(), lost.get(i)
        if gone and hashlib.sha256(raw).hexdigest() in gone.copies:
            left = b""
        else:
            left = repeats.without_runs(raw, gone.start, gone.stop)[0] if gone else raw
        assert hashlib.sha256(left).hexdigest() == want[i, t or ""][3]
    assert len(repeats.repeats(docs).collect()) == len(rows)
    assert repeats.repeats(empty).collect() == []


def test_suffix_sort():
    from millrace.llm.suffixes import same_as_before, sort_suffixes

    g = np.random.default_rng(1)
    for _ in range(200):
        depth, m = int(g.integers(3, 12)), int(g.integers(1, 12))
        strings = [bytes(g.integers(97, 97 + int(g.integers(1, 4)), depth + int(g.integers(0, 9))).astype(np.uint8)) for _ in range(m)]
        text, end = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
        begin = end - [len(s) for s in strings]
        order, table = sort_suffixes(text, begin, end - depth + 1, end, depth)
        found = [bytes(text[p : p + depth]) for p in order]
        assert found == sorted(found)
        assert sorted(order.tolist()) == [p for b, e in zip(begin, end) for p in range(b, e - depth + 1)]
        assert same_as_before(order, table, depth).tolist() == [a == b for a, b in zip(found, found[1:])]


def test_licenses(spark, docs, empty):
    from millrace.llm.licenses import ALL_SENTENCES, LINES, MARKS, NAMED, RULES, scan

    assert all(any(m in s for m in MARKS) for s in ALL_SENTENCES)
    known = {y for x in ALL_SENTENCES.values() for y in x.split()} | {f"{x.lower()}-under" for x in NAMED.values()} | {f"spdx-{x}" for x in LINES.values()}
    assert {x for _, ids in RULES for x in ids} <= known
    texts = ["Prose. Released under the MIT  License.\nAll-Rights reserved.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3", "you may obtain a copy of the License at\nReleased under the MIT License", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.sentences, r.licenses, r.unmatched) for r in scan(df).collect()}
    assert got[0] == ("mit-under reserved", "MIT All-Rights-Reserved", 0)
    assert got[1][2] == 1
    assert got[2] == ("license-copy-at mit-under", "MIT", 1)
    assert got[3] == got[4] == ("", "", 0)
    assert scan(docs).count() == docs.count()
    assert scan(empty).collect() == []


def test_toxicity_learns_words_stems_and_pairs(spark, docs, empty, labels):
    from millrace.llm.toxicity import Machine, toxicity

    r = random.Random(4)
    rows, marks = [], []
    for i in range(1500):
        w = r.choices(VOCABULARY, k=60)
        bad = i % 5 == 0
        if bad:
            for k in range(3):
                w[r.randrange(60)] = r.choice(["nastyword", "grublol" + r.choice("abcdefgh") * 2])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    out = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    held = [x for x in out if x.held_out]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) / len(held) > 0.95
    # A pair that matters where neither term does: exclusive or.
    m, g = Machine(), np.random.default_rng(0)
    pairs = [np.array(x) for x in ([1, 2], [3], [1, 4], [2, 4])] * 50
    m.fit(pairs, np.array([1, 0, 0, 0] * 50, float))
    odds = m.score([p[m.active[p]] for p in pairs[:4]])
    assert odds[0] > max(odds[1:])
    assert (Machine.from_bytes(m.to_bytes()).score(pairs[:1]) == m.score(pairs[:1])).all()
    assert toxicity(docs, labels).count() == docs.count()
    assert toxicity(empty, labels).collect() == []
    assert all(x.predicted == 0 for x in toxicity(docs, labels.limit(0)).collect())


def test_language_model(docs, empty, rows, spark):
    import math
    from collections import Counter

    from millrace.llm.pitmanyor import context_matrix, rare_probabilities, score

    tokens = [(i, [*words(t), "\0"]) for i, t in rows]
    train = Counter(x for i, t in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for x in t)
    n, v = sum(train.values()), len(train)
    want = sorted(((i, len(t), sum(train[x] > 0 for x in t), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t), 6)) for i, t in tokens), key=str)
    got = score(docs).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score < 0 for r in got)
    assert score(empty).collect() == []
    # Probabilities sum to one.
    p = context_matrix(np.random.default_rng(1).poisson(2, (20, 20)).astype(float))
    assert np.allclose(p.sum(axis=1), 1)
    sizes, n_words = spark.createDataFrame([(2, 40), (50, 3), (1, 100)], "c long, words long"), np.array([100, 40, 3])
    c, q = rare_probabilities(sizes)
    assert c.tolist() == [1, 2, 50]
    assert math.isclose((q[:-1] * n_words).sum() + q[-1], 1)
    assert rare_probabilities(sizes.limit(0))[1].tolist() == [1.0]


def test_language_model_beats_unigrams_held_out(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        w = []
        for _ in range(40):
            w += ["the", r.choice(VOCABULARY)] if r.random() < 0.6 else ["of", "a"]
        rows.append((i, " ".join(w)))
    from millrace.llm.pitmanyor import score

    held = [x for x in score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_mixing(docs, empty, spark):
    from collections import Counter

    from millrace.llm.mixing import mix, period, quotas
    from pyspark.sql import functions as F

    out = mix(docs, block_chars=300).collect()
    assert len(out) == docs.count()
    assert {r.source for r in out} == {"", "s0", "s1", "s2"}
    assert mix(empty).collect() == []
    sizes = spark.createDataFrame([(f"s{i}", 1000 * (i + 1) ** 2) for i in range(9)], "source string, chars long")
    table = period(quotas(sizes, parts=200)).orderBy("slot").collect()
    n, done = table[0].n, Counter()
    q = {r.source: r.q for r in table}
    assert [r.slot for r in table] == list(range(n))
    for t, r in enumerate(table, 1):
        done[r.source] += 1
        assert all(abs(done[s] - t * q[s] / n) < 1 for s in q)


def test_warc(spark, empty, tmp_path):
    from millrace.llm import warc

    long = "".join(rng.choices("abé\r\nWARC/1.1 ", k=200_000))
    rows = [(1, "http://a/ b", long, "x"), (2, None, long, "x"), (3, "u", None, None), (4, "u", "", "x"), (5, "u", "short", "x"), (6, "u", "short", "x"), (7, "u", "é" * 600, "x"), (9, "u", "é" * 600, "x"), (9, "u", "é" * 600, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    warc.write(pages, f"file://{tmp_path}/w")
    got = sorted(warc.read(spark, f"file://{tmp_path}/w").collect(), key=lambda r: r.page_id)
    assert [r.page_id for r in got] == [1, 2, 3, 4, 5, 6, 7, 9, 9]
    assert [(r.record_type, r.refers_to) for r in got] == [("revisit", 2), *[("response", None)] * 5, ("revisit", 9), *[("response", None)] * 2]
    for r, (_, _, html, _) in zip(got, rows):
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.digest_ok) == (len(raw), hashlib.sha1(raw).hexdigest(), True)
        assert r.record_type == "revisit" or bytes(r.payload) == raw
    parts = warc.read_records(spark, f"file://{tmp_path}/w")
    assert parts.where("segment > 1").count() > 2
    broken = warc.reassemble(parts.where("segment <> 2")).where("NOT whole")
    assert broken.count() == 1
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_packing(docs, empty, rows, spark):
    import public_tokenizers
    from millrace.llm.packing import pack, padding
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    found = sorted(pack(docs, path).collect(), key=str)
    ids = {}
    for i, text in rows:
        ids.setdefault(i, []).append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    assert sum(r.length for r in found) == sum(len(x) for v in ids.values() for x in v)
    for r in found:
        assert any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in ids[r.doc_id])
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(empty, path).collect() == []
    assert padding(pack(docs, path)).count() == 1


def test_pipeline_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out, kept = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        if name != "packing":
            assert out.columns == kept
            out.write.parquet(f"{tmp_path}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{name}")
            ids = [r.doc_id for r in out.where("doc_id IS NOT NULL").select("doc_id").collect()]
            if name != "quality_rules":
                assert len(ids) == len(set(ids))
                assert not {1, 2} & set(ids)
    assert out.count() > 0

"""Token files: ids, starts and doc ids read back equal those of `tokenizers`; Elias-Fano lists against plain lists."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import tokenfile
from millrace.llm.eliasfano import EliasFano, encode
from millrace.sources.scratch import fresh

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, start int, shard long"
rng = random.Random(3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**64 - 1)), max_size=700))
def test_lists_give_back_every_number(values):
    values.sort()
    raw = encode(np.array(values, dtype=np.uint64))
    got = EliasFano(raw + b"more behind it")
    assert got.size == len(raw) and len(got) == len(values)
    assert got.all().tolist() == values
    assert [got[i] for i in range(len(values))] == values
    for v in (0, 25, 2**63, *values[:5]):
        assert got.first_not_below(v) == sum(x < v for x in values)


def test_lists_are_small_and_their_gaps_may_be_wide():
    ends = np.cumsum(np.array([rng.randint(1, 800) for _ in range(100_000)])).astype(np.uint64)
    raw = encode(ends)
    assert len(raw) * 8 / len(ends) < 2 + np.log2(400) + 0.5  # 64 in a plain table
    wide = np.array([0] * 3000 + [2**40] * 3000, dtype=np.uint64)
    got = EliasFano(encode(wide))
    assert [got[i] for i in (0, 2999, 3000, 5999)] == [0, 0, 2**40, 2**40]
    with pytest.raises(ValueError):
        encode(np.array([2, 1], dtype=np.uint64))
    with pytest.raises(IndexError):
        got[6000]


def corpus():
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(1, 9))) for _ in range(200)]
    rows = [(rng.choice([-1, 1]) * i * i * 10**9, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    odd = [None, "", " \n\t\n ", "a<|endoftext|>b", "x" * 100_000, "\x00 \U0001f600", "word " * 30_000]
    rows += [(-(2**63) + i if i % 2 else 2**63 - 1 - i, t) for i, t in enumerate(odd)]
    return [*rows, rows[7], rows[7], (rows[9][0], "other text"), (rows[9][0], None), (None, "no id"), (None, "a"), (None, None)]


@pytest.mark.parametrize("shards", [None, 1, 7])
def test_files_hold_the_ids_of_tokenizers_in_order(spark, shards):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    path = fresh(spark, "tokens")
    listed = tokenfile.write(docs, path, VOCABULARY, shards=shards).collect()
    got = sorted((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfile.read(spark, path).collect())
    t = Tokenizer.from_file(VOCABULARY)
    want, start = [], 0
    order = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, (r[1] or "").encode())))
    for doc, text in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((start, doc, len(ids), ids))
        start += len(ids)
    assert [g[1:] for g in got] == [w[1:] for w in want]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(r.docs for r in listed) == len(rows) and sum(r.tokens for r in listed) == start
    # One document by its rank, and by its id, from the files themselves.
    for r in listed:
        shard = tokenfile.open_shard(path, r.file)
        assert len(shard) == r.docs
        for i in {0, r.docs // 2, r.docs - 1}:
            _, doc, _, ids = want[r.first_doc + i]
            assert shard.doc_id(i) == doc and shard.document(i).tolist() == ids
            if doc is not None:
                assert shard.doc_id(shard.find(doc)) == doc
        assert shard.find(123456789) is None


def test_query_columns_and_an_empty_table(spark):
    from millrace.llm.queries import QUERIES

    got = QUERIES["op12_token_files"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    t, start, want = Tokenizer.from_file(VOCABULARY), 0, []
    for d in docs:
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got.collect())) == want
    path = fresh(spark, "tokens")
    tokenfile.write(spark.createDataFrame([], SCHEMA), path, VOCABULARY)
    assert tokenfile.read(spark, path).collect() == []


def test_a_cut_off_file_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    r = tokenfile.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path, VOCABULARY).first()
    raw = (tmp_path / "t" / r.file).read_bytes()
    (tmp_path / "t" / "cut").write_bytes(raw[:-3])
    with pytest.raises(ValueError):
        tokenfile.open_shard(path, "cut")

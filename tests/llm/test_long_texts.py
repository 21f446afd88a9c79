"""Texts of a megabyte and more: prose, one word, one letter, line ends, no space at all."""

import random
import zlib

import numpy as np
import pytest

rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 8))) for _ in range(3000)]
TEXTS = [" ".join(rng.choices(WORDS, k=200_000)), "word " * 250_000, "x" * 1_500_000, "\n" * 700_000, ". ".join(rng.choices(WORDS, k=150_000)) + "\n", "é" * 600_000, "short one", None]


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    docs = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(WORDS[:30])), (1, "word"), (2, "x" * 1_500_000)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", ["op1_jaccard", "op2_quality", "op3_fingerprints", "op5_licenses", "op6_toxicity", "op8_mixing"])
def test_a_row_for_each_text(spark, long, name):
    from millrace.llm.queries import QUERIES

    assert sorted(r.doc_id for r in QUERIES[name](spark, long).collect()) == list(range(len(TEXTS)))


def test_language_model(spark, long):
    from millrace.llm.queries import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op7_language_model"](spark, long).collect()}
    assert [rows[i].n_tokens for i in range(8)] == [len((t or "").split()) + 1 for t in TEXTS]


def test_ids(spark, long):
    from millrace.llm.queries import QUERIES

    packed = QUERIES["op10_packing"](spark, long).collect()
    files = {r.doc_id: r for r in QUERIES["op12_token_files"](spark, long).collect()}
    by_doc = {}
    for p in packed:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
    start = 0
    for i in range(len(TEXTS)):
        at = 0
        for a, n in sorted(by_doc[i]):
            assert a == at
            at += n
        assert at == files[i].n_tokens and files[i].start == start  # both have one id behind the text
        start += files[i].n_tokens
    assert files[7].ids_crc32 == zlib.crc32(np.zeros(1, "<u4").tobytes())


def test_phrases_and_search(spark, long):
    from millrace.llm.queries import QUERIES

    phrases = {r.phrase: r for r in QUERIES["op11_collocations"](spark, long).collect()}
    assert phrases["word word word"].a == 250_000 - 2 and "word word" not in phrases
    found = QUERIES["op13_search"](spark, long).collect()
    assert {(r.item_id, r.doc_id) for r in found if r.item_id > 0} == {(1, 1), (2, 2)}
    assert {r.doc_id for r in found if r.item_id == 0} == {0, 4}

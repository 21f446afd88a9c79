"""Ids of texts with added tokens, against `tokenizers` as it comes."""

import zlib

import numpy as np


def test_added_tokens_are_single_ids(spark):
    import public_tokenizers
    from millrace.llm.packing import pack
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    added = list(t.get_added_tokens_decoder().values())
    assert added
    texts = [f"a {x.content} b" for x in added] + [f"{x.content}{x.content}\n {x.content}  tail" for x in added] + ["<|endoftext|", "<|endoftext|>", "plain words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in pack(docs, path, capacity=1 << 20).collect() if r.start == 0}
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert found[i] == (len(ids), zlib.crc32(ids.tobytes()))

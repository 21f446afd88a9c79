"""The mix with sources far smaller than the rest."""


def test_small_sources_do_not_end_the_mix(spark):
    import corpus_pipeline
    from millrace.llm.mixing import mix

    rows = [(i, "x" * 50_000, "en", "big" if i % 3 else "other", 50_000) for i in range(300)]
    rows += [(1000, "tiny", "en", "tiny", 4), (1001, "no source", "en", None, 9), (None, "no id", "en", "big", 5), (None, "no id", "en", "big", 5), (None, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = corpus_pipeline.source_weights(spark, docs, "").collect()
    assert sorted((tuple(r) for r in out), key=str) == sorted(rows, key=str)
    # Several periods at ten parts; the order is that of the slots, and sources keep their weights among themselves.
    found = {(r.doc_id, r.source): r for r in mix(docs, whole=True, parts=10).collect()}
    assert all(r.in_mix for r in found.values())
    assert max(r.slot for r in found.values()) > 3 * 12
    places = {r.doc_id: r.slot for r in mix(docs, whole=True).collect() if r.doc_id is not None}
    slots = [places[r.doc_id] for r in out if r.doc_id is not None]
    assert slots == sorted(slots)
    at = [r.source for r in out if r.source in ("big", "other") and r.text and len(r.text) > 9]
    sizes = {"big": 200 * 50_000 + 10, "other": 100 * 50_000}
    share = sizes["big"] ** 0.9 / sum(x**0.9 for x in sizes.values())
    live = max(k for k, x in enumerate(at) if x == "other") + 1 if at[-1] == "big" else max(k for k, x in enumerate(at) if x == "big") + 1
    assert all(abs(at[:k].count("big") - share * k) < 6 for k in range(live))
    # Given weights: only a source that has one ends the mix.
    w = spark.createDataFrame([("big", 0.5), ("other", 0.5)], "source string, weight double")
    ends = {r.doc_id: r.in_mix for r in mix(docs, weights=w, parts=10).collect() if r.doc_id is not None}
    assert sum(ends.values()) > 190 and not all(ends.values()) and ends[1000] and ends[1001]

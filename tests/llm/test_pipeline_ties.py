"""Rows with one id in the stage of near duplicates: which of them stays."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_of_rows_with_one_id_the_smallest_text_stays(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(1, "b one two three four five six", "en", "s", 1), (1, "a quite other words than those there", "en", "t", 1), (1, "a quite other words than those there", "de", "t", 1), (2, None, "en", "s", 0), (2, "text", "en", "s", 4), (3, "alone here with some more words", "en", "s", 1), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1)]
    for n in (1, 4):
        got = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(n), str(tmp_path)).collect()
        assert sorted(map(tuple, got), key=str) == sorted([rows[2], rows[3], rows[5], rows[6], rows[7]], key=str)

"""The queries that apply the training-data operators to their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), n=3, percent=90)


#: All pairs with a common shingle, then the smallest id that each document reaches.
ORACLES["op1_jaccard"] = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id
"""


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import quality

    measured = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.repeats import repeats

    return repeats(table(spark, sf_dir, "documents"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.fuzzy import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.pitmanyor import score

    return score(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import warc
    from millrace.sources.scratch import fresh

    path = fresh(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


ORACLES["op9_warc"] = """
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to, true AS digest_ok
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS payload_digest,
  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def _licenses_sql() -> str:
    from millrace.llm.licenses import sql

    return sql()


ORACLES["op5_licenses"] = _licenses_sql()


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def _mixing_sql() -> str:
    from millrace.llm.mixing import sql

    return sql()


ORACLES["op8_mixing"] = _mixing_sql()


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm import tokenfile
    from millrace.sources.scratch import fresh

    path = fresh(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_search"] = r"""
WITH lowered AS (SELECT doc_id, row_number() OVER () AS r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
doc_terms AS MATERIALIZED (SELECT doc_id, r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered),
item_terms AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT r, count(*) AS n FROM doc_terms GROUP BY r),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
ms AS (SELECT r, 10 + (90 * n * docs) // length AS m FROM sizes, totals),
tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term),
scored AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item_terms JOIN tf USING (term) JOIN w USING (term) JOIN ms USING (r) GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) <= 10
"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM ws) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM ws)) GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM ws)) GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.x || ' ' || p.y AS phrase, 1 AS k, p.f AS a, b.f AS l, c.f AS r FROM f2 p JOIN f1 b ON b.lang = p.lang AND b.x = p.x JOIN f1 c ON c.lang = p.lang AND c.x = p.y
    LEFT JOIN longer g ON g.lang = p.lang AND g.x = p.x AND g.y = p.y WHERE p.f >= 10 AND coalesce(100 * g.f < 50 * p.f, true)
  UNION ALL SELECT p.lang, p.x || ' ' || p.y || ' ' || p.z, 1, p.f, b.f, c.f FROM f3 p JOIN f1 b ON b.lang = p.lang AND b.x = p.x JOIN f2 c ON c.lang = p.lang AND c.x = p.y AND c.y = p.z
  UNION ALL SELECT p.lang, p.x || ' ' || p.y || ' ' || p.z, 2, p.f, b.f, c.f FROM f3 p JOIN f2 b ON b.lang = p.lang AND b.x = p.x AND b.y = p.y JOIN f1 c ON c.lang = p.lang AND c.x = p.z),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM least JOIN totals USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""

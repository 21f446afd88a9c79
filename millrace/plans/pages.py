"""Articles read out of whole pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.html import articles_of
from millrace.plans.registry import query
from millrace.tables import load

_TEXT = r"""replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')"""


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<article>(.*)</article>', 1, 's') AS inner_html FROM pages)
SELECT page_id, trim({_TEXT.format('h1')}) AS title, 'unknown' AS author, '' AS summary, CAST(NULL AS TIMESTAMP) AS published,
  array_to_string(list_filter(list_transform(string_split({_TEXT.format('inner_html')}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10) || chr(10)) AS body FROM p""")
def html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, author, summary, date and body of every page, by selectors in order of preference."""
    return articles_of(load(spark, sf_dir, "pages"), "page_id", "html")

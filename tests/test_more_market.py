"""Edge rules of image records, validators and dates on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F


def one(spark, column, **values):
    types = {k: "string" if v is None or isinstance(v, str) else "double" if isinstance(v, float) else "long" for k, v in values.items()}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in types.items()))
    return df.select(column.alias("x")).first().x


def test_image_types_and_dates(spark):
    from millrace.functions import images as I

    kind = lambda t, u="": one(spark, I.image_type(F.col("t"), F.col("u")), t=t, u=u)
    assert kind("nothing here") == "unknown"
    assert kind("gamma and theta by strike", "flow.png") == "greeks_chart"
    assert kind("delta flow") == "greeks_chart"  # of equals the first
    assert kind("", "skew.png") == "skew_chart"
    day = lambda t: one(spark, I.found_date(F.col("t")), t=t)
    assert day("seen 2024-02-29 twice") == dt.date(2024, 2, 29)
    assert day("on 3/7/30") == dt.date(2030, 3, 7) and day("on 3/7/31") == dt.date(1931, 3, 7)
    assert day("12/25/2023") == dt.date(2023, 12, 25)
    assert day("2/30/2024") is None and day("none") is None and day(None) is None


def test_two_readings(spark):
    from millrace.functions import images as I

    both = lambda a, b: one(spark, I.fused(F.col("a"), F.col("b")), a=a, b=b)
    assert [both("bullish", "bullish"), both("bullish", "neutral"), both("bullish", "bearish"), both("bearish", None), both(None, None)] == ["bullish", "bullish", "neutral", "bearish", "neutral"]


def test_json_replies(spark):
    from millrace.functions import images as I

    raws = ['{"a": 1}', '```json\n{"a": 1}\n```', '{"a": 1,}', '{"a": 1,\n}', '```\n{"a": [1,]}\n```', "not json", None]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, r string")
    got = df.select("i", F.coalesce(*(F.try_parse_json(x) for x in I.json_attempts(F.col("r")))).isNotNull().alias("ok")).orderBy("i").collect()
    assert [x.ok for x in got] == [True] * 5 + [False] * 2


def test_dates_in_many_spellings(spark):
    from millrace.functions import validate as V

    spelled = ["2025-08-03 20:48:34", "2025-08-03T20:48:34", "2025-08-03T20:48:34Z", "2025-08-03", "2025/08/03", "03/08/2025", "August 3, 2025"]
    for s in spelled:
        x = one(spark, V.parsed_date([F.col("a"), F.col("b")]), a=" ", b=s)
        assert x.date() == dt.date(2025, 8, 3), s
    assert one(spark, V.parsed_date([F.col("a"), F.col("b")]), a="3rd of August", b="2025-08-03") is None
    iso = lambda s: one(spark, V.utc_iso(F.col("s")), s=s)
    assert iso("2025-08-03 20:48:34") == "2025-08-03T20:48:34+00:00"
    assert iso("2025-08-03T20:48:34+02:00") == "2025-08-03T18:48:34+00:00"
    assert iso("soon") is None and iso(None) is None
    month = lambda s: one(spark, V.month_number(F.col("s")), s=s)
    assert [month("March"), month("mar"), month("dec"), month("Marchx"), month("foo"), month(None)] == [3, 3, 12, None, None, None]


def test_records_that_lack_something(spark):
    from millrace.functions import validate as V

    errors = lambda u, t, b: list(one(spark, V.structure_errors(F.col("u"), F.col("t"), F.col("b"), ["example.org"]), u=u, t=t, b=b))
    assert errors("https://www.Example.org/a", "t", "b") == []
    assert errors(None, "", None) == ["no url", "no title", "no content"]
    assert errors("example.org/a", "t", "b") == ["bad url", "foreign host"]
    assert errors("https://other.net", "t", "b") == ["foreign host"]


def test_text_for_models(spark):
    from millrace.functions import validate as V

    made = lambda t: one(spark, V.for_model(F.col("t"), [("gamma squeeze", "rapid move")]), t=t)
    assert made(" BTC gamma squeeze at 45k strike, IV up ") == "Bitcoin rapid move at 45000 dollar strike price, implied volatility up"
    assert made(None) == "" and len(made("x" * 5000)) == 2000
    about = lambda t: one(spark, V.asset_sentences(F.col("t"), ["eth"]), t=t)
    assert about("One. ETH rose. Two. Methods help") == "ETH rose. Methods help"
    assert about("Nothing. Here") == "Nothing. Here" and about(None) == ""
    clean = one(spark, V.cleaned(F.col("t")), t="<b>Pay</b>  $5 to me@x.org\nat https://a.b/c?d=1 now é€")
    assert clean == "Pay $5 to at now €"


def test_prediction_accuracy(spark):
    from millrace.plans.studies import prediction_accuracy

    cases = [("bullish", 0.1, 1.0, 0.9), ("bullish", 0.5, 1.0, 1.0), ("bearish", -0.1, 0.5, 0.7), ("neutral", 0.04, 1.0, 0.8), ("bullish", -0.06, 1.0, 0.2), ("bullish", -0.01, 1.0, 0.4), ("bearish", 0.2, 0.0, 0.5)]
    df = spark.createDataFrame(cases, "b string, r double, c double, want double")
    assert all(abs(x.got - x.want) < 1e-9 for x in df.select(prediction_accuracy(F.col("b"), F.col("r"), F.col("c")).alias("got"), "want").collect())

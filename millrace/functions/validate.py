"""Validator scores, text preparation and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms, phrase replacements in order, date formats in order of trial, month names.
OPTION_TERMS = ["call", "put", "option", "strike", "expiry", "delta", "gamma", "theta", "vega", "volatility", "premium", "exercise", "assignment"]
STRATEGY_TERMS = ["spread", "straddle", "strangle", "butterfly", "condor", "collar", "covered call", "protective put"]
UP_TERMS = ["bullish", "call buying", "upside", "squeeze"]
DOWN_TERMS = ["bearish", "put buying", "downside", "hedge", "protection"]
ABBREVIATIONS = [("BTC", "Bitcoin"), ("ETH", "Ethereum"), ("IV", "implied volatility"), ("OI", "open interest")]
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MMMM d, yyyy"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
PRICE_RANGES = {"BTC": (10_000, 200_000), "ETH": (500, 10_000)}
OVERALL = {"content": 0.35, "url": 0.15, "images": 0.20, "market": 0.15, "relevance": 0.15}
MODEL_CHARS, SENTENCE_CHARS = 2_000, 1_000
# End of fixed values.


def held(value: Column, points: float) -> Column:
    return F.when(value, points).otherwise(0.0)


def url_score(url: Column, wanted: str, title_share: Column, author: Column, expected: Column, published: Column, as_of: Column) -> Column:
    """0 to 100: a wanted URL, a title like the URL, an expected author, and a date that isn't in the future or over a year old.

    title_share: the share of the title's words that stand in the URL, null without a title.
    """
    score = (
        100.0
        - held(~F.coalesce(F.lower(url).contains(wanted), F.lit(False)), 15)
        - held(F.coalesce(title_share < 0.3, F.lit(False)), 10)
        - F.when(F.coalesce(author, F.lit("")) == "", 10).when(~expected, 5).otherwise(0)
        - F.when(published.isNull(), 15).when(published > as_of, 20).when(F.datediff(as_of, published) > 365, 5).otherwise(0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def asset_score(price: Column, low: Column, high: Column, seconds_off: Column, returns: list[Column]) -> Column:
    """Points of one asset's market data; from 50 on it is valid."""
    some = F.lit(False)
    extreme = F.lit(0)
    for r in returns:
        some = some | r.isNotNull()
        extreme = extreme + F.when(F.abs(r) > 0.5, 10).otherwise(0)
    base = F.when(price.isNull() | (price == 0), 40).otherwise(F.when(price <= 0, 30).otherwise(0) + F.when(~price.between(low, high), 25).otherwise(0) + F.when(seconds_off > 3600, 15).otherwise(0))
    return 100 - base - extreme - F.when(some, 0).otherwise(20)


def fresh(published: Column, as_of: Column, days: int = 30) -> Column:
    """At most so many days old; true without a date."""
    return F.coalesce(F.datediff(as_of, published) <= days, F.lit(True))


def structure_errors(url: Column, title: Column, body: Column, domains: list[str]) -> Column:
    """What a record lacks: URL, title, content, a whole URL, a host of an allowed domain."""
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    there = F.coalesce(url, F.lit("")) != ""
    allowed = F.lit(False)
    for d in domains:
        allowed = allowed | host.contains(d)
    return F.array_compact(F.array(
        F.when(~there, "no url"), F.when(F.coalesce(title, F.lit("")) == "", "no title"), F.when(F.coalesce(body, F.lit("")) == "", "no content"),
        F.when(there & (host == ""), "bad url"), F.when(there & ~allowed, "foreign host")))


def cleaned(text: Column) -> Column:
    """Without tags, URLs and e-mail addresses, in single spaces, without what isn't ASCII but for money signs."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")
    s = F.regexp_replace(s, r"https?://[!-;=?-~]+", "")
    s = F.regexp_replace(s, r"[^ \t\r\n\f\x0B]+@[^ \t\r\n\f\x0B]+", "")
    s = F.regexp_replace(s, r"[ \t\r\n\f\x0B]+", " ")
    return F.trim(F.regexp_replace(s, "[^\x01-\x7f€£¥]+", ""))


def for_model(text: Column, phrases: list[tuple[str, str]] = ()) -> Column:
    """Phrases and abbreviations spelled out, in order, "45k strike" as dollars, and cut to what a model takes."""
    s = F.trim(F.coalesce(text, F.lit("")))
    for old, new in [*phrases, *ABBREVIATIONS]:
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.substring(F.regexp_replace(s, "([0-9]+)[kK] strike", "$1" + "000 dollar strike price"), 1, MODEL_CHARS)


def asset_sentences(text: Column, words: list[str]) -> Column:
    """The sentences that name the asset, joined by ". "; if none does, the text's beginning."""
    found = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\."), lambda s: _any(F.lower(s), words)), lambda s: F.trim(s))
    return F.when(F.size(found) > 0, F.array_join(found, ". ")).otherwise(F.substring(F.coalesce(text, F.lit("")), 1, SENTENCE_CHARS)) if words else text


def _any(s: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms that stand in the text, also inside words, in their order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda x: text.contains(x))


def parsed_date(fields: list[Column]) -> Column:
    """The first field that isn't empty, read in the first format that fits it; null if none does."""
    s = F.coalesce(*(F.when(F.trim(f) != "", f) for f in fields))
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS))


def utc_iso(s: Column) -> Column:
    """A time as ISO text in UTC; one without zone is UTC already."""
    t = F.coalesce(F.try_to_timestamp(F.trim(s), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.trim(s)))
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def month_number(name: Column) -> Column:
    """1 to 12 for a month's name or its first three letters; null for others."""
    n = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.lower(F.substring(name, 1, 3)))
    whole = F.lower(name)
    return F.when((n > 0) & ((F.length(name) == 3) | whole.isin(MONTHS)), n.cast("int"))

"""Text features as column expressions: plain words, weighted lexicons, numbers, cleaning, and the validator's scores.

Words are ASCII: a text is lower-cased and everything but a-z, 0-9 and _ separates words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Lexicons and vocabularies of options commentary.
BULLISH = ["bullish", "bull", "upside", "rally", "surge", "spike", "call buying", "call flow", "upside betting", "squeeze", "gamma squeeze", "short squeeze", "breakout", "momentum", "accumulation", "positioning", "optimism", "confident", "aggressive calls", "call spreads", "protective puts selling"]
BEARISH = ["bearish", "bear", "downside", "decline", "drop", "crash", "put buying", "put flow", "downside protection", "hedging", "hedge", "covering", "fear", "panic", "defensive", "protective puts", "put spreads", "call selling", "overwriting"]
GREEK = ["delta", "gamma", "theta", "vega", "rho", "delta neutral", "gamma hedging", "theta decay", "vega risk", "pin risk", "assignment risk"]
VOLATILITY = ["volatility", "vol", "iv", "implied vol", "realized vol", "vol surface", "vol smile", "vol skew", "vol crush", "vix", "fear index", "complacency"]
VOCABULARY = {
    "option_types": ["call", "calls", "put", "puts", "option", "options", "strike", "strikes", "expiry", "expiries", "expiration"],
    "strategies": ["spread", "spreads", "straddle", "strangle", "butterfly", "condor", "collar", "protective", "covered", "naked"],
    "actions": ["buying", "selling", "bought", "sold", "writing", "wrote", "exercising", "assigned", "expired", "closing", "rolling"],
    "size_terms": ["whale", "large", "massive", "huge", "big", "small", "retail", "institutional", "block", "sweep"],
    "urgency": ["aggressive", "passive", "urgent", "rushed", "calm", "steady", "panic", "frantic", "systematic"],
}
SENTIMENT = {
    "bullish": ["bullish", "upside", "rally", "surge", "breakout", "momentum up", "call buying", "gamma squeeze", "resistance break", "higher highs"],
    "bearish": ["bearish", "downside", "drop", "fall", "breakdown", "momentum down", "put buying", "sell pressure", "support break", "lower lows"],
    "neutral": ["neutral", "sideways", "range", "consolidation", "flat", "mixed signals", "uncertain", "wait and see"],
}
OPTION_WORDS = ["call", "put", "option", "strike", "expiry", "delta", "gamma", "theta", "vega", "volatility", "premium", "exercise", "assignment", "otm", "itm", "atm", "spread", "straddle", "strangle", "collar", "butterfly", "condor"]
SPAM = ["click here", "subscribe now", "limited time", "act now", "free trial", "guaranteed profit"]
COMMON = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "before", "after", "above", "below", "between", "among", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might"]
NUMBER = r"[0-9,]+(?:\.[0-9]+)?"
STRIKE = rf"\$?({NUMBER})[ \t\r\n]*(?:strike|k)"
NOTIONAL = rf"\$({NUMBER})[ \t\r\n]*(thousand|million|billion|k|m|b)\b"
PERCENT = r"([0-9]+(?:\.[0-9]+)?)[ \t\r\n]*%"
# End of fixed values.


def lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def searchable(text: Column) -> Column:
    """A text in lower case, for patterns of ASCII letters: other letters change too, but none becomes an ASCII one (as those two would)."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u0138")))


def plain(text: Column) -> Column:
    """Words with one space between."""
    # \W is what isn't a-z, A-Z, 0-9 or _; written as a class of ranges it takes nine times as long.
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\W+", " ")))


def word_list(p: Column) -> Column:
    """The words of a plain text."""
    return F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(p, " "))


def occurrences(p: Column, phrase: str) -> Column:
    return (F.length(p) - F.length(F.replace(p, F.lit(phrase), F.lit("")))) / len(phrase)


def word_count(p: Column) -> Column:
    """Words of a plain text."""
    return F.when(p == "", 0).otherwise(F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) + 1)


def any_of(terms: list[str]) -> str:
    """A pattern of plain words that shares their beginnings, so that a word is given up at its first letter that leads nowhere."""
    rest: dict[str, list[str]] = {}
    for t in sorted(set(terms)):
        rest.setdefault(t[:1], []).append(t[1:])
    ends = rest.pop("", None) is not None
    parts = "|".join(c + any_of(tails) for c, tails in rest.items())
    return f"(?:{parts})?" if ends and parts else f"(?:{parts})" if len(rest) > 1 else parts


def hits(p: Column, *lexicons: list[str]) -> Column:
    """The words of a plain text that are in any of the lexicons, in order: one scan of the text for all of them together."""
    words = {t for terms in lexicons for t in terms if " " not in t}
    return F.regexp_extract_all(F.concat(F.lit(" "), p, F.lit(" ")), F.lit(f" ({any_of(sorted(words))})(?= )"), F.lit(1))


def words_among(p: Column, terms: list[str], found: Column | None = None) -> Column:
    """How many words of a plain text are among terms; found: its hits(), of which terms is one lexicon, so that only they are looked at."""
    if found is not None:
        return F.size(F.filter(found, lambda x: x.isin(terms)))
    return F.regexp_count(F.concat(F.lit(" "), p, F.lit(" ")), F.lit(f" {any_of(terms)}(?= )"))


def counted(p: Column, terms: list[str], phrase: float = 1, found: Column | None = None) -> Column:
    """Words of a plain text that are among terms, and `phrase` for each occurrence of a term of several words."""
    out = words_among(p, [t for t in terms if " " not in t], found).cast("double")
    for t in terms:
        if " " in t:
            out = out + phrase * occurrences(p, t)
    return out


def sentence_count(t: Column) -> Column:
    """Pieces between runs of .!? that aren't blank."""
    return F.regexp_count(t, F.lit("[ \\n\\r\\t]*+[^ \\n\\r\\t.!?][^.!?]*+"))


def numbers(text: Column, pattern: str, group: int = 1) -> Column:
    """The numbers that a pattern's group finds, without their commas; what isn't a number is left out."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(",")).try_cast("double")), lambda x: x.isNotNull())


def notionals(text: Column) -> Column:
    """Dollar amounts with their units multiplied out."""
    amounts = F.regexp_extract_all(text, F.lit(NOTIONAL), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(NOTIONAL), F.lit(2))
    scale = lambda u: F.when(u.startswith("b"), 1e9).when(u.startswith("m"), 1e6).otherwise(1e3)
    return F.filter(F.zip_with(amounts, units, lambda a, u: F.replace(a, F.lit(",")).try_cast("double") * scale(u)), lambda x: x.isNotNull())


def trading_number(s: Column) -> Column:
    """"1,234.5K" and the like as a double: K, M and B multiply, % is only cut off; blanks and N/A are null; the suffix is upper case."""
    t = F.trim(F.regexp_replace(s, '[",]', ""))
    n = F.regexp_replace(t, "[KMB%]$", "").try_cast("double")
    return n * F.when(t.endswith("K"), 1e3).when(t.endswith("M"), 1e6).when(t.endswith("B"), 1e9).otherwise(1.0)


def trading_date(s: Column) -> Column:
    """dd-MM-yyyy, else any date that the engine reads; a byte-order mark and quotes are cut off."""
    t = F.trim(F.regexp_replace(s, '["﻿]', ""))
    return F.coalesce(F.to_date(F.try_to_timestamp(t, F.lit("dd-MM-yyyy"))), F.to_date(F.try_to_timestamp(t)))


def stripped(html: Column) -> Column:
    """Tags out, runs of white space to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "), r"[ \t\r\n\f\x0B]+", " "))


def without_noise(text: Column) -> Column:
    """A text without its boiler-plate sections: from a header line to the next blank or ruled line."""
    header = lambda x: F.trim(lower(x)).isin("disclaimer", "author(s)", "recent articles")
    ends = lambda x: (F.trim(x) == "") | x.rlike(r"^-{2,}|={2,}|\*{2,}")
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        skip = F.when(header(x), True).when(a["skip"] & ends(x), False).otherwise(a["skip"])
        keep = ~header(x) & ~a["skip"]
        return F.struct(skip.alias("skip"), F.when(keep, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))

    return F.array_join(F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step, lambda a: a["out"]), "\n")


def english(p: Column, found: Column | None = None) -> Column:
    """More than a tenth of a plain text's words are common English ones; null without words."""
    return F.try_divide(words_among(p, COMMON, found), word_count(p)) > 0.1


def relevance(p: Column, found: Column | None = None) -> Column:
    """Option words per hundred words of a plain text, at most one."""
    n = word_count(p)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), words_among(p, OPTION_WORDS, found) / F.greatest(n / 100, F.lit(1.0))))


def structure(text: Column) -> Column:
    """0 to 100: less for under two paragraphs, under three sentences, or sentences under 5 or over 50 words on average."""
    t = F.coalesce(text, F.lit(""))
    sentences = sentence_count(t)
    mean = F.try_divide(F.regexp_count(t, F.lit("[^ \\n\\r\\t.!?]+")), sentences)
    score = 100.0 - F.when(F.size(F.split(t, "\n\n")) < 2, 20).otherwise(0) - F.when(sentences < 3, 30).otherwise(0) - F.when(mean < 5, 15).when(mean > 50, 10).otherwise(0)
    return F.when(sentences == 0, F.when(F.trim(F.translate(t, "\n\r\t", "   ")) == "", 0.0).otherwise(score)).otherwise(score)


def content_quality(text: Column, title: Column, p: Column, is_english: Column, structured: Column) -> Column:
    """0 to 100: length, title, spam, place-holder text and language, four fifths; structure (structured), one fifth."""
    n, m = F.length(F.trim(text)), F.length(F.trim(title))
    spam = sum((p.contains(s).cast("int") for s in SPAM), F.lit(0))
    score = (
        100.0
        - F.when(n < 100, 30).when(n > 50_000, 10).otherwise(0)
        - F.when(m < 10, 15).when(m > 200, 5).otherwise(0)
        - F.least(spam * 15, F.lit(45))
        - F.when(p.contains("lorem ipsum") | p.contains("test test") | (n <= 50), 25).otherwise(0)
        - F.when(is_english, 0).otherwise(20)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.8 * score + 0.2 * structured))

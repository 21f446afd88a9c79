"""Queries without SQL among outcomes, against plain Python; weekly notes; prices of the same day; children and rows kept."""

import datetime as dt
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.functions.stats import t_two_sided
from millrace.plans import outcomes
from millrace.plans.returns import facts
from millrace.plans.timing import price_at
from millrace.plans.weekly import felt, is_weekly

SF = "/root/testdata/sf0.001"


def test_correlation_and_its_p(spark):
    got = {r.days: r for r in outcomes.correlation_tests(spark, SF).collect()}
    rows = defaultdict(list)
    for r in facts(spark, SF).where("ret IS NOT NULL").collect():
        rows[r.days].append((r.signal, r.ret))
    assert set(got) == set(rows)
    for days, xy in rows.items():
        n = len(xy)
        mx, my = sum(x for x, _ in xy) / n, sum(y for _, y in xy) / n
        r = sum((x - mx) * (y - my) for x, y in xy) / math.sqrt(sum((x - mx) ** 2 for x, _ in xy) * sum((y - my) ** 2 for _, y in xy))
        assert got[days].n == n and got[days].r == pytest.approx(r, abs=1e-9)
        t = r * math.sqrt((n - 2) / (1 - r * r))
        # The area under Student's density beyond t, in small steps.
        c = math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2)) / math.sqrt((n - 2) * math.pi)
        area = sum(c * (1 + (abs(t) + (k + 0.5) * 0.002) ** 2 / (n - 2)) ** (-(n - 1) / 2) * 0.002 for k in range(20_000))
        assert got[days].p == pytest.approx(2 * area, abs=1e-5) and got[days].p == pytest.approx(t_two_sided(t, n - 2))


def test_trades_and_their_extremes(spark):
    trades = outcomes.trade_summary(spark, SF).collect()
    by = defaultdict(list)
    for t in trades:
        by[t.asset, t.params].append(t)
        assert t.days == (t.exit_date - t.entry_date).days and (t.outcome == "win") == (t.pnl > 0)
    got = {(r.asset, r.params): r for r in outcomes.trade_extremes(spark, SF).collect()}
    assert set(got) == set(by)
    for k, ts in by.items():
        pnl, g = [t.pnl for t in ts], got[k]
        wins, losses = [p for p in pnl if p > 0], [p for p in pnl if p < 0]
        assert (g.trades, g.best, g.worst, g.wins, g.losses) == (len(pnl), max(pnl), min(pnl), len(wins), len(losses))
        assert sorted(t.trade for t in ts) == list(range(1, len(ts) + 1))
        assert g.mean_win == (pytest.approx(sum(wins) / len(wins)) if wins else None)
        if wins and losses:
            assert g.payoff == pytest.approx(sum(wins) / len(wins) / -(sum(losses) / len(losses)))


def test_performance_of_models(spark, monkeypatch):
    real = facts(spark, SF).where("days = 7 AND ret IS NOT NULL").orderBy("article_id").limit(60).select("article_id", "asset", "date", "ret").collect()
    said = [(r.article_id, r.asset, r.date, float(k % 3 == 0), 0.1 - 0.1 * (k % 2)) for k, r in enumerate(real)]
    monkeypatch.setattr(outcomes, "stored_predictions", lambda s, d: s.createDataFrame(said, "article_id long, asset string, date date, p_one double, r_two double"))
    got = {r.model: r for r in outcomes.model_performance(spark, SF).collect()}
    for name, side in (("one", lambda s: 1 if s[3] > 0.5 else -1), ("two", lambda s: 1 if s[4] > 0 else -1)):
        days = defaultdict(list)
        for s, r in zip(said, real, strict=True):
            days[r.date].append((side(s) * r.ret, r.ret))
        x = [sum(a for a, _ in days[d]) / len(days[d]) for d in sorted(days)]
        total, top, fall = 0, 0, 0
        for v in x:
            total += v
            top = max(top, total)
            fall = min(fall, total - top)
        mean = sum(x) / len(x)
        sd = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
        g = got[name]
        assert (g.days, g.total, g.max_drawdown) == (len(x), pytest.approx(total), pytest.approx(fall))
        assert g.sharpe == pytest.approx(mean / sd * math.sqrt(52)) and g.win_rate == pytest.approx(sum(v > 0 for v in x) / len(x))


def test_weekly_notes_and_sentiment(spark):
    cases = [("https://x.y/a/Option-Flows/1", None, True), ("https://x.y/option-flow-3?q", "", True), ("https://x.y/?u=/option-flows/", None, False), ("https://x.y/b", " Option Flow ", True), ("https://x.y/b", "the weekly notes", True), ("", "weekly notes", False), (None, "weekly notes", False), ("/option-flows/", None, True), ("https://x.y/news", "news", False)]
    got = spark.createDataFrame([(i, u, c) for i, (u, c, _) in enumerate(cases)], "i int, u string, c string").select("i", is_weekly(F.col("u"), F.col("c")).alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [w for *_, w in cases]
    texts = ["a rally, a rally and call buying", "drop", "", None, "nothing of it", "rally drop"]
    rows = {r.i: r for r in felt(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], F.col("t")).collect()}
    assert (rows[0].sentiment, rows[0].p_positive, rows[0].scalar) == ("bullish", pytest.approx(4 / 6, abs=1e-6), pytest.approx(0.5))
    assert (rows[1].sentiment, rows[1].scalar) == ("bearish", -0.25)
    for k in (2, 3):
        assert (rows[k].sentiment, rows[k].confidence, rows[k].p_neutral) == ("neutral", 0.0, 0.34)
    assert (rows[4].sentiment, rows[5].sentiment) == ("bullish", "bullish")  # of equal counts the first


def test_prices_of_the_same_day_come_first(spark):
    at = lambda h, m=0, d=1: dt.datetime(2024, 1, d, h, m)
    prices = spark.createDataFrame([(1, "a", at(23, 50), 1.0), (2, "a", at(3, 0, 2), 2.0), (3, "a", at(3, 0, 2), 9.0), (4, "b", at(23, 50), 4.0)], "event_id long, asset string, ts timestamp, price double")
    points = spark.createDataFrame([(1, "a", at(0, 10, 2)), (2, "a", at(3, 30, 2)), (3, "b", at(0, 10, 2)), (4, "b", at(1, 10, 2)), (5, "c", at(1)), (6, "a", at(0, 10, 3))], "id long, asset string, at timestamp")
    got = {r.id: r.price for r in price_at(points, prices, ["id"]).collect()}
    assert got == {1: None, 2: 2.0, 3: 4.0, 4: None, 5: None, 6: None}

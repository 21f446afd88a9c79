"""Queries without SQL, against plain Python."""

import math
from collections import Counter, defaultdict

import pytest

SF = "/root/testdata/sf0.001"


def folded(rows):
    from millrace.plans.scores import alert_step

    out, states = [], {}
    for r in sorted(rows, key=lambda r: (r["t"], r["event_id"])):
        s = states.setdefault(r["asset"], {"hour": -1, "sent": 0, "last": {}})
        done = alert_step(s, r)
        out.append((done["asset"], done["event_id"], done["signature"], done["sent"]))
    return sorted(out)


def test_alert_rate_limit(spark):
    from millrace.plans.scores import alert_rate_limit, alert_rows

    got = sorted((r.asset, r.event_id, r.signature, r.sent) for r in alert_rate_limit(spark, SF).collect())
    assert got == folded([r.asDict() for r in alert_rows(spark, SF).collect()])
    assert any(x[3] for x in got)


def test_stream_of_alerts(spark):
    from millrace.streaming.queries import stream_alerts
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{SF}/events.parquet").where("value > 20")
    rows = e.select(F.col("event_type").alias("asset"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.concat_ws("_", "event_type", F.round(F.col("value") / 50, 1).cast("string")).alias("signature"))
    got = sorted((r.asset, r.event_id, r.signature, r.sent) for r in stream_alerts(spark, SF).collect())
    assert got == folded([r.asDict() for r in rows.collect()])


def test_backtest(spark):
    """Trade by trade, with the days of each asset walked through again."""
    from millrace.operators.simulate import premium
    from millrace.plans.scores import STRATEGIES, backtest_long_call, backtest_summary, contexts

    days = defaultdict(list)
    for r in contexts(spark, SF).collect():
        days[r.asset].append(r)
    want = []
    for asset, rows in days.items():
        rows.sort(key=lambda r: r.date)
        for name, s in STRATEGIES.items():
            held = []
            for r in rows:
                value = lambda t: premium(r.close, t[1], r.volatility / 100, s.days - (r.date - t[0]).days) - t[2]  # noqa: B023, E731
                for t in list(held):
                    if value(t) >= s.target or value(t) <= -abs(s.stop) or s.days - (r.date - t[0]).days <= 7:
                        want.append((asset, name, t[0], r.date, round(value(t), 4)))
                        held.remove(t)
                if len(held) < s.most_open and r.vol_regime in ("low", "very_low") and r.distance_to_support is not None and r.distance_to_support <= 5:
                    strike = round(r.close / 50) * 50
                    held.append((r.date, strike, premium(r.close, strike, r.volatility / 100, s.days)))
            want += [(asset, name, t[0], r.date, round(value(t), 4)) for t in held]
    got = [(r.asset, r.params, r.entry_date, r.exit_date, round(r.pnl, 4)) for r in backtest_long_call(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    by = defaultdict(list)
    for asset, name, _, _, pnl in want:
        by[asset, name].append(pnl)
    summary = {(r.asset, r.params): r for r in backtest_summary(spark, SF).collect()}
    assert set(summary) == set(by)
    for k, pnl in by.items():
        assert summary[k].trades == len(pnl) and summary[k].pnl == pytest.approx(sum(pnl), abs=0.01)
        assert summary[k].win_rate == pytest.approx(sum(x > 0 for x in pnl) / len(pnl))


def test_event_study_p_values(spark):
    """Against the density of Student's t, summed up in small steps."""
    from millrace.plans.analysis import event_study

    def p(t, df):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        n = 20_000
        h = abs(t) / n
        inside = sum((1 if k in (0, n) else 4 if k % 2 else 2) * c * (1 + (k * h) ** 2 / df) ** (-(df + 1) / 2) for k in range(n + 1)) * h / 3
        return 1 - 2 * inside

    rows = event_study(spark, SF).collect()
    assert rows
    for r in rows[:8]:
        if r.t is not None:
            assert r.p == pytest.approx(p(r.t, r.n - 1), abs=1e-4)
            assert r.significant == (r.p < 0.05)


def test_term_weights(spark):
    """Each weight is the term's count times log((documents + 1) / (documents with it + 1)), and the five heaviest are there."""
    from millrace.plans.more import tfidf_terms
    from millrace.plans.texts import _words
    from pyspark.ml.feature import StopWordsRemover

    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    docs = {}
    for r in _words(spark, SF).collect():
        w = [x for x in r.w if x not in stop]
        docs[r.doc_id] = Counter(w + [" ".join(x) for x in zip(w, w[1:])])
    n = len(docs)
    in_docs = Counter(t for c in docs.values() for t in c)
    total = Counter()
    for c in docs.values():
        total.update(c)
    usable = sorted((total[t] for t in in_docs if 2 <= in_docs[t] <= 0.95 * n), reverse=True)
    edge = usable[min(999, len(usable) - 1)]
    got = defaultdict(dict)
    for r in tfidf_terms(spark, SF).collect():
        got[r.doc_id][r.term] = r.weight
    assert got
    for i, weights in got.items():
        assert len(weights) <= 5
        for t, w in weights.items():
            assert w == pytest.approx(docs[i][t] * math.log((n + 1) / (in_docs[t] + 1)), abs=1e-5)
            assert total[t] >= edge and 2 <= in_docs[t] <= 0.95 * n
        sure = sorted((docs[i][t] * math.log((n + 1) / (in_docs[t] + 1)) for t in docs[i] if total[t] > edge and 2 <= in_docs[t] <= 0.95 * n), reverse=True)[:5]
        assert all(a >= b - 1e-5 for a, b in zip(sorted(weights.values(), reverse=True), sure))


def test_clusters_are_those_of_the_nearest_mean(spark):
    from millrace.plans.scores import monthly_clusters

    rows = monthly_clusters(spark, SF).collect()
    sd = [math.sqrt(sum((r[k] - sum(x[k] for x in rows) / len(rows)) ** 2 for r in rows) / (len(rows) - 1)) for k in ("ret", "vol")]
    points = [((r.ret / sd[0], r.vol / sd[1]), r.cluster) for r in rows]
    means = {c: tuple(sum(p[k] for p, d in points if d == c) / sum(d == c for _, d in points) for k in (0, 1)) for c in {c for _, c in points}}
    assert len(means) == 3
    near = sum(c == min(means, key=lambda m: math.dist(p, means[m])) for p, c in points)
    assert near >= 0.97 * len(points)


def test_classifier_measures(spark):
    from millrace.plans.scores import dataset, evaluate, model_comparison

    pairs = [(1.0, 1.0)] * 3 + [(1.0, 0.0)] * 2 + [(0.0, 1.0)] + [(0.0, 0.0)] * 4
    r = evaluate(spark.createDataFrame(pairs, "label double, prediction double"), "x").first()
    assert (r.n, r.accuracy, r.precision, r.recall) == (10, pytest.approx(0.7), pytest.approx(0.75), pytest.approx(0.6))
    assert r.f1 == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    d = dataset(spark, SF).select("fold", "label").collect()
    test = [x.label for x in d if x.fold == 4]
    got = {x.model: x for x in model_comparison(spark, SF).collect()}
    assert set(got) == {"boosted_trees", "forest", "logistic"}
    for x in got.values():
        assert x.n == len(test) and x.accuracy >= 0.8 * max(sum(test), len(test) - sum(test)) / len(test)


def test_dates_of_the_fold(spark):
    """Keys with ties in time are folded in order of id."""
    from millrace.operators.simulate import ordered_fold

    rows = [("a", 1, 3), ("a", 1, 1), ("a", 0, 9), ("b", 5, 2)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    step = lambda s, r: s.update(n=s["n"] + 1) or {"k": r["k"], "i": r["i"], "n": s["n"]}
    got = sorted(tuple(r) for r in ordered_fold(df, "k", ["t", "i"], step, {"n": 0}, "k string, i long, n long").collect())
    assert got == [("a", 1, 2), ("a", 3, 3), ("a", 9, 1), ("b", 2, 1)]


def test_quantiles(spark):
    import random

    import numpy as np
    from millrace.operators.carry import quantiles

    r = random.Random(2)
    rows = [("a", r.gauss(0, 1)) for _ in range(3000)] + [("b", float(r.randrange(3))) for _ in range(50)] + [("c", 4.0), ("d", None), ("e", 1.0), ("e", None), ("e", 2.0)]
    got = {x.k: (x.lo, x.hi) for x in quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"lo": 0.05, "hi": 0.75}, bins=40).collect()}
    want = {k: tuple(np.quantile([v for x, v in rows if x == k and v is not None], q) for q in (0.05, 0.75)) for k in "abce"}
    assert {k: tuple(map(pytest.approx, v)) for k, v in want.items()} == got


def test_return_regression(spark):
    from millrace.plans.extras import return_regression

    rows = sorted(return_regression(spark, SF).collect(), key=lambda r: r.part)
    assert [r.part for r in rows] == [1, 2, 3] and all(r.n > 100 for r in rows)
    for r in rows:
        assert r.mae <= math.sqrt(r.mse) + 1e-9 and r.r2 < 1 and 0 <= r.confidence <= 1
        assert sum(v for k, v in r.asDict().items() if k.endswith("_importance")) == pytest.approx(1)

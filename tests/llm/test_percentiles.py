import datetime as dt

import numpy as np

from tessella.llm import percentiles as P

DAY = dt.date(2026, 1, 1)


def test_rank_error_is_bounded_whatever_the_order():
    rng = np.random.default_rng(3)
    for values in (np.arange(50_000.0), np.arange(50_000.0)[::-1], rng.lognormal(5, 2, 50_000), np.full(50_000, 7.0)):
        sketch = P.Buffers(256)
        for at in range(0, len(values), 777):
            sketch.add(values[at : at + 777])
        rows = sketch.rows()
        weights = np.concatenate([np.full(len(v), 1 if level < 0 else 1 << level) for level, _, v in rows])
        kept = np.concatenate([v for _, _, v in rows])
        assert weights.sum() == len(values)
        order, error = np.argsort(kept), sum(e for _, e, _ in rows)
        assert error <= len(values) / 512 * 8
        ranks = np.cumsum(weights[order])
        for q in (0.1, 0.5, 0.99):
            value = kept[order][np.searchsorted(ranks, q * len(values))]
            low, high = (values < value).sum(), (values <= value).sum()
            assert low - error <= q * len(values) <= high + error + 1


def test_days_combine_to_the_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i % 3}" if i % 11 else None, DAY + dt.timedelta(days=int(i % 5)), float(v)) for i, v in enumerate(rng.exponential(100, 6000))]
    df = spark.createDataFrame([*rows, ("r0", None, None), ("r0", None, float("nan"))], "route string, day date, v double").repartition(6)
    daily = P.merge_sketches(P.sketch_values(df, ["route", "day"], "v", 128), ["route", "day"], 6, 128)
    got = P.percentiles(P.combine_days(daily, 128), ["route"]).collect()
    for r in got:
        values = np.sort([v for k, _, v in rows if k == r.route])
        assert r.n == len(values)
        rank = np.searchsorted(values, r.value, "right")
        assert abs(rank - np.ceil(r.quantile * r.n)) <= r.max_rank_error + 1
    assert {r.route for r in got} == {"r0", "r1", "r2", None}


def test_bound_of_values_that_all_fill_buffers(spark):
    values = np.random.default_rng(5).permutation(64 * 16).astype(float)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0)], "route string, v double").repartition(4)
    sketches = P.merge_sketches(P.sketch_values(df, ["route"], "v", 64), ["route"], 4, 64)
    error = {r.route: r.error for r in sketches.groupBy("route").agg({"error": "sum"}).toDF("route", "error").collect()}
    got = P.percentiles(sketches, ["route"]).collect()
    assert error["a"] > 0 and {(r.route, r.n, r.max_rank_error) for r in got} == {("a", 1024, error["a"]), ("b", 1, 0)}
    # The value v has the rank v + 1.
    assert all(abs(r.value + 1 - np.ceil(r.quantile * r.n)) <= r.max_rank_error for r in got if r.route == "a")


def test_no_usable_values(spark):
    schema = "run_id string, question_id string, route_taken string, latency_ms int, recorded_at timestamp, route string"
    rows = [("a", "q", "x", None, None, "z"), ("a", "q", "x", -1, None, "z"), ("a", "q", None, P.SENTINEL, None, None)]
    assert P.daily_sketches(spark.createDataFrame(rows, schema)).count() == 0
    twice = [("a", "q", " X", 5, dt.datetime(2026, 1, 1), "z")] * 2
    got = P.percentiles(P.daily_sketches(spark.createDataFrame(twice, schema)), ["route", "day"]).collect()
    assert {(r.route, r.n, r.value) for r in got} == {("x", 1, 5.0)}

"""Indicators, joins, signals and trades against brute force on small series."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock, indicators as ind
from tidemark.operators import asof, levels, shapes, signals, trades
from tidemark.plans import account, report
from tidemark.sources import bars as src

HOUR = src.HOUR


def series(n=200, seed=1, symbols=("AA", "BB")):
    r, out = random.Random(seed), []
    for s in symbols:
        c = 100.0
        for i in range(n):
            o = c
            c = round(o + r.uniform(-3, 3), 2)
            out.append((s, i * HOUR, o, round(max(o, c) + r.uniform(0, 2), 2), round(min(o, c) - r.uniform(0, 2), 2), c, float(r.randint(1, 50))))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(series(), "symbol string, t_ms long, o double, h double, l double, c double, v double")


def one(df, symbol="AA"):
    return df.where(F.col("symbol") == symbol).orderBy("t_ms").toPandas()


def test_hold_golden(spark):
    closes = [10, 9, 11, 12, 8]
    b = spark.createDataFrame([("S", i * clock.DAY, float(o), float(max(o, c)), float(min(o, c)), float(c), 1.0) for i, (o, c) in enumerate(zip([10, 10, 9, 12, 8], closes))], "symbol string, t_ms long, o double, h double, l double, c double, v double")
    t = trades.hold_while(ind.sma(b, 2), F.col("c") > F.col("sma")).collect()
    assert [(r.entry_i, r.entry, r.exit_i, r.exit, r.reason) for r in t] == [(3, 12.0, 4, 8.0, "end-of-test")]


def test_psar_supertrend_adx(bars):
    x = one(ind.directional(ind.supertrend(ind.parabolic_sar(bars))))
    assert x.sar[1:].notna().all() and set(x.sar_trend.dropna()) <= {1.0, -1.0}
    for i in range(2, len(x)):  # the stop is on the other side of the bar unless it has just turned
        assert x.sar_flip[i] == 1 or (x.l[i] >= x.sar[i] if x.sar_trend[i] > 0 else x.h[i] <= x.sar[i])
    up = x[x.st_trend > 0]
    assert (up.c >= up.supertrend - 1e-9).mean() > 0.95
    assert x.adx.dropna().between(0, 100).all() and x.adx.notna().sum() > 150


@pytest.mark.parametrize("strict,forward", [(False, False), (True, False), (False, True)])
def test_asof(spark, strict, forward):
    r = random.Random(3)
    left = [(r.choice("ab"), r.randint(0, 50)) for _ in range(80)]
    right = [(r.choice("ab"), t, float(k)) for k, t in enumerate(r.sample(range(60), 30))]
    got = asof.asof(spark.createDataFrame(left, "symbol string, t long"), spark.createDataFrame(right, "symbol string, q long, x double"), ["symbol"], "t", "q", ["q", "x"], strict=strict, forward=forward, max_age=10)
    want = []
    for s, t in left:
        ok = [(q, x) for z, q, x in right if z == s and (q >= t if forward else q < t if strict else q <= t)]
        best = (min if forward else max)(ok, default=None)
        want.append((s, t, *(best if best and abs(best[0] - t) <= 10 else (None, None))))
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(map(str, want))


def test_brackets(bars):
    s = signals.donchian_breakout(ind.donchian(ind.atr(bars), 10), 1.0)
    got = {r.entry_i: r for r in trades.brackets(s, most_bars=15, target_r=1.5).where("symbol = 'AA'").collect()}
    x = one(s)
    i, busy, seen = 0, -1, 0
    for i in range(len(x) - 1):
        if x.side[i] is None or i < busy:
            continue
        way = 1 if x.side[i] == "long" else -1
        fill, stop = x.o[i + 1], x.stop[i]
        if (fill - stop) * way <= 0:
            continue
        goal = fill + way * 1.5 * abs(fill - stop)
        for j in range(i + 1, len(x)):
            worst, best = (x.l[j], x.h[j]) if way > 0 else (x.h[j], x.l[j])
            done = None
            if j > i + 1 and (x.o[j] - stop) * way <= 0:
                done = (x.o[j], "stop-gap")
            elif (worst - stop) * way <= 0:
                done = (stop, "stop")
            elif (best - goal) * way >= 0:
                done = (goal, "target")
            elif j - i >= 15:
                done = (x.c[j], "time")
            elif j == len(x) - 1:
                done = (x.c[j], "end-of-test")
            if done:
                r = got[i + 1]
                assert (r.exit_i, r.exit, r.reason) == (j, *done)
                busy, seen = j, seen + 1
                break
    assert seen == len(got) > 3


def test_all_cost_modes(spark):
    t = spark.createDataFrame([("long", 10.0, 12.0)], "side string, entry double, exit double")
    costs = spark.range(trades.FEW + 200).select(F.col("id").cast("string").alias("label"), F.col("id").cast("double").alias("fee"), F.lit(0.0).alias("slippage"), F.lit(0.0).alias("slippage_bps"))
    assert {r.label: r.pnl for r in trades.with_costs(t, costs).collect()} == {str(i): 2.0 - i for i in range(trades.FEW + 200)}


def test_managed(spark, bars):
    rows = [  # o, h, l, c: a limit at 10 with its stop at 8 fills on bar 2, takes half at 12, and leaves at the entry
        (11, 12, 10.5, 11, "long"), (11, 11.5, 10.5, 11, None), (10.5, 11, 9, 10.5, None), (10.5, 12.5, 10.2, 12, None), (12, 12, 9.5, 11, None), (11, 12, 11, 12, "short"), (12, 12, 11, 11, None),
    ]
    b = spark.createDataFrame([("S", i, *map(float, x[:4]), x[4], {"long": 8.0, "short": 13.0}.get(x[4]), {"long": 10.0, "short": 20.0}.get(x[4]), 1.0) for i, x in enumerate(rows)], "symbol string, t_ms long, o double, h double, l double, c double, side string, stop double, limit double, atr double")
    got = trades.managed(b, trades.Management(expiry=3, breakeven_r=1.0, partial_r=1.0, risk=100.0)).collect()
    assert [(r.entry_i, r.entry, r.exit_i, r.exit, r.reason, r.stop, r.size, r.points, r.partial) for r in got] == [(2, 10.0, 4, 10.0, "stop", 8.0, 50.0, 1.0, True)]
    trail = trades.managed(b.drop("limit"), trades.Management(trail_atr=1.0)).collect()
    assert [(r.entry_i, r.exit_i, r.exit, r.reason) for r in trail] == [(1, 2, 10.0, "stop"), (6, 6, 11.0, "end-of-test")]
    s = signals.donchian_breakout(ind.donchian(ind.atr(bars), 10), 1.0)
    same = ["symbol", "entry_i", "entry", "exit_i", "exit", "reason", "stop", "target"]
    plain = trades.managed(s, trades.Management(most_bars=15, target_r=1.5, cooldown=2)).select(same).collect()
    assert sorted(plain) == sorted(trades.brackets(s, most_bars=15, target_r=1.5, cooldown=2).select(same).collect()) and len(plain) > 6


FAMILIES = {
    "momentum": lambda b: signals.price_momentum(ind.rate_of_change(b, 5), 3),
    "failed": lambda b: signals.failed_breakout(b),
    "hold": lambda b: signals.hold_beyond(levels.prior_session(b, "asia"), "asia_h", "asia_l"),
    "reclaim": lambda b: signals.day_open_reclaim(levels.day_context(b)),
    "retest": lambda b: signals.break_retest(levels.day_context(b), "pd_h", "pd_l"),
    "fib": lambda b: signals.fib_continuation(b),
    "flag": lambda b: signals.flag_continuation(b, least=0.5, depth=0.9),
    "keltner": lambda b: signals.keltner_reversion(ind.keltner(b)),
    "expansion": lambda b: signals.keltner_expansion(ind.keltner(b, k=0.3)),
    "volume": lambda b: signals.volume_exhaustion(shapes.candles(ind.volume_stats(b))),
    "nine": lambda b: signals.counter_nine(ind.setup_counter(b)),
    "double": lambda b: signals.double_extreme(shapes.swings(b)),
    "weekend": lambda b: signals.weekend_fade(b),
    "shock": lambda b: signals.down_shock(b),
    "pullback": lambda b: signals.trend_pullback(ind.ema(shapes.regime(ind.efficiency(b)), 10)),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_signals_do_not_look_ahead(spark, bars, name):
    """A prefix of the series gives the same signals on its bars."""
    cut = 150 * HOUR
    run = lambda b: {(r.symbol, r.t_ms, r.side) for r in FAMILIES[name](ind.atr(b)).where("side is not null").collect() if r.t_ms < cut}
    whole = run(bars)
    assert whole == run(bars.where(F.col("t_ms") < cut))


def test_swings_and_counter(bars):
    x = one(ind.setup_counter(shapes.swings(bars, 2)))
    run = 0
    for i in range(len(x)):
        s = 0 if i < 4 else int(np.sign(x.c[i] - x.c[i - 4]))
        run = 0 if s == 0 else run + s if run * s > 0 else s
        assert x.counter[i] == run
        p = i - 2
        high = x.h[p] if p >= 2 and x.h[p] > max(x.h[p - 2], x.h[p - 1], x.h[p + 1], x.h[i]) else None
        assert (high is None and np.isnan(x.swing_high[i])) or x.swing_high[i] == high


def brute_zone(x, i, least, most, width=3.0, contain=0.85, touches=3, touch=0.5, drift=0.5, crossings=4, buffer=0.25, least_width=1.0):
    """Bars, high and low of the zone that ends at bar i, bar by bar; None without one."""
    top, bottom, atr = np.maximum(x.o, x.c), np.minimum(x.o, x.c), x.atr[i]
    a, hi, lo = i, top[i], bottom[i]
    while a > 0 and i - a + 2 <= most and max(hi, top[a - 1]) - min(lo, bottom[a - 1]) <= width * atr:
        a, hi, lo = a - 1, max(hi, top[a - 1]), min(lo, bottom[a - 1])
    n, sides, seen = i - a + 1, [s for s in np.sign(x.c[a : i + 1] - (hi + lo) / 2) if s], []
    for near in (lambda j: top[j] >= hi - touch * atr, lambda j: bottom[j] <= lo + touch * atr):
        seen.append([])
        for j in range(a, i + 1):
            if near(j) and (not seen[-1] or j - seen[-1][-1] > 1):
                seen[-1].append(j)
    far = max(touch, buffer) * atr
    out = sum(x.h[j] > hi + far or x.l[j] < lo - far for j in range(a, i + 1))
    fits = n >= least and hi > lo and hi - lo >= least_width * atr and abs(x.c[i] - x.c[a]) <= drift * (hi - lo) and sum(p != q for p, q in zip(sides, sides[1:])) >= crossings
    fits = fits and min(map(len, seen)) >= touches and out <= n - math.ceil(contain * n)
    return (n, hi + buffer * atr, lo - buffer * atr) if fits else None


@pytest.mark.parametrize("kw", [{}, {"contain": 1.0}, {"touches": 5}, {"drift": 0.1}, {"crossings": 9}, {"least_width": 2.3}, {"touch": 0.2, "contain": 0.95}])
def test_narrow_ranges(spark, kw):
    r, rows = random.Random(8), []
    for s in ("AA", "BB"):
        c = 100.0
        for i in range(500):  # a mean that moves now and then, so that stretches of all lengths come up
            o, c = c, 100 + 6 * (i // 90) + r.uniform(-2, 2)
            wick = lambda: r.uniform(0, 4) if r.random() < 0.1 else r.uniform(0, 0.5)
            rows.append((s, i * HOUR, o, max(o, c) + wick(), min(o, c) - wick(), c, 1.0))
    b = ind.atr(spark.createDataFrame(rows, "symbol string, t_ms long, o double, h double, l double, c double, v double"))
    x = one(shapes.narrow_ranges(b, 6, 40, **kw))
    want = [brute_zone(x, i, 6, 40, **kw) for i in range(len(x))]
    got = [None if np.isnan(n) else (int(n), hi, lo) for n, hi, lo in zip(x.zone_bars, x.zone_high, x.zone_low)]
    assert [g and g[0] for g in got] == [w and w[0] for w in want]
    assert all(g == pytest.approx(w) for g, w in zip(got, want) if w)
    assert any(want) and (kw or {w[0] for w in want if w} - {6, 7, 10, 13, 17, 23, 30, 40})


def test_profile_and_area(spark, bars):
    b = bars.withColumn("day", clock.day_utc(F.col("t_ms")))
    p = shapes.volume_profile(b, 1.0, ["symbol", "day"])
    total = p.agg(F.sum("volume")).first()[0]
    assert abs(total - bars.agg(F.sum("v")).first()[0]) < 1e-6
    for r in shapes.value_area(p, 1.0, ["symbol", "day"]).collect():
        assert r.area_low < r.poc < r.area_high


def test_sources(spark, tmp_path):
    x = np.arange(18, dtype="<f8").reshape(6, 3)
    (tmp_path / "XAUUSD").mkdir()
    (tmp_path / "XAUUSD/5m.bin").write_bytes(struct.pack("<4I", src.MAGIC, src.VERSION, 3, 6) + x.tobytes())
    got = src.read_binary_bars(spark, f"file://{tmp_path}").collect()
    assert [(r.symbol, r.tf, r.t_ms, r.o, r.v) for r in got] == [("XAUUSD", "5m", k, 3.0 + k, 15.0 + k) for k in range(3)]
    spark.dataSource.register(src.BarFiles)
    rows = spark.read.format("tidemark_bars").load(str(tmp_path / "XAUUSD/5m.bin"))
    assert rows.count() == 3
    rows.write.format("tidemark_bars").mode("append").save(str(tmp_path / "out"))
    again = ",".join(str(p) for p in (tmp_path / "out").iterdir())
    assert sorted(map(tuple, spark.read.format("tidemark_bars").load(again).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        src.decode_columns(b"nothing of the kind")
    (tmp_path / "f.json").write_text(json.dumps({"symbol": "S", "timeframe": "1d", "bars": [[1, 2, 3, 1, 2, 5], [2, 2]]}))
    assert [tuple(r) for r in src.read_fixtures(spark, str(tmp_path / "f.json")).collect()] == [("S", "1d", 1, 2.0, 3.0, 1.0, 2.0, 5.0)]
    (tmp_path / "q.csv").write_text("eventMS,bid,ask\n1,1.0,1.2\n2,3.0,2.0\n")
    assert [r.t_ms for r in src.read_quotes(spark, str(tmp_path / "q.csv")).collect()] == [1]


def test_reports(spark):
    t = spark.createDataFrame([("S", 0, 1, 0, 1.0, "long"), ("S", 1, 3, 1, -2.0, "long"), ("S", 2, 4, 2, 4.0, "short")], "symbol string, entry_i long, exit_i long, entry_t long, pnl double, side string").withColumn("mode", F.lit("x"))
    r = report.cost_rows(t, ["mode"], 10.0).first()
    assert (r.trades, r.net, r.profit_factor) == (3, 3.0, 2.5) and abs(r.drawdown - 100 * 2 / 13) < 1e-9
    d = report.drawdown(t, ["mode"], 10.0).first()
    assert abs(d.max_drawdown - 2 / 11) < 1e-9 and (d.win_streak, d.loss_streak) == (1, 1)
    q = report.ranked(t, ["mode"], "pnl", [0.5]).first()
    assert q.q_50 == 1.0
    m = report.resample_trades(t, 50, 3, 10.0)
    assert m.count() == 50 and sorted(map(tuple, m.collect())) == sorted(map(tuple, report.resample_trades(t, 50, 3, 10.0).collect()))
    assert report.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6


def test_marks_of_trades_within_a_bar(spark):
    """A trade is open while entry_i <= i < exit_i: not at all if it leaves on the bar of its entry."""
    c = [10.0, 12.0, 11.0, 15.0, 13.0, 16.0, 14.0, 18.0]
    t = [(1, 11.0, 1, "long", 0.5), (2, 12.0, 4, "short", -2.0), (4, 14.0, 4, "long", -1.0), (4, 13.5, 6, "long", 1.0), (7, 14.0, 7, "short", -4.0)]
    b = spark.createDataFrame([("S", i, i * HOUR, x) for i, x in enumerate(c)], "symbol string, i long, t_ms long, c double")
    got = account.marked(b, spark.createDataFrame([("S", *x) for x in t], "symbol string, entry_i long, entry double, exit_i long, side string, pnl double").withColumn("exit", F.lit(0.0)), 100.0)
    peak = 100.0
    for r in got.orderBy("i").collect():
        realized = sum(x[4] for x in t if x[2] <= r.i)
        profit = sum((1 if x[3] == "long" else -1) * (c[r.i] - x[1]) for x in t if x[0] <= r.i < x[2])
        peak = max(peak, 100 + realized + profit)
        assert (r.realized, r.open_profit, r.equity) == (realized, profit, 100 + realized + profit) and abs(r.drawdown - (peak - r.equity) / peak) < 1e-12, r.i
    assert got.count() == len(c)


def test_streams_replay_batch(spark, bars, tmp_path):
    from tidemark.streaming import replay

    rows = bars.where("symbol = 'AA'").orderBy("t_ms").collect()
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], bars.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(bars.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, made in (("held", replay.hold_events(stream, 5)), ("counted", replay.counter_events(stream))):
        query = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    batch = trades.hold_while(ind.sma(bars.where("symbol = 'AA'"), 5), F.col("c") > F.col("sma")).orderBy("entry_t").collect()
    seen = spark.table("held").orderBy("t_ms").collect()
    assert [(e.t_ms, e.price) for e in seen if e.event == "entry"] == [(b.entry_t, b.entry) for b in batch]
    assert [(e.t_ms, e.price) for e in seen if e.event == "exit"] == [(b.exit_t, b.exit) for b in batch if b.reason == "rule"]
    want = [(r.t_ms, float(r.counter)) for r in ind.setup_counter(bars.where("symbol = 'AA'")).orderBy("t_ms").collect()]
    assert [(e.t_ms, e.price) for e in spark.table("counted").orderBy("t_ms").collect()] == want


def test_tick_stream(spark, tmp_path):
    ticks = spark.sql("select 'S' as s, timestamp_seconds(id * 60) as ts, cast(id % 7 as double) as p, id from range(300)")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    from tidemark.streaming import replay

    live = replay.bar_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), "s", "ts", "p", ["id"], "1 hour", "0 seconds")
    query = live.writeStream.format("memory").queryName("ticks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    batch = src.bars_from_ticks(ticks, "s", F.unix_millis("ts"), "p", ["id"], HOUR)
    got = {tuple(r) for r in spark.table("ticks").collect()}
    assert got and got <= {tuple(r) for r in batch.collect()}

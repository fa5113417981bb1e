"""Gates, clocks, quotes and reports against plain Python."""

import datetime as dt
import hashlib
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import asof, gates
from tidemark.plans import report
from tidemark.sources import bars as src


def test_local_minutes(spark):
    """Skipped and repeated minutes of the year's clock changes are refused, all others are right."""
    days = ["2024-03-10", "2024-03-31", "2024-11-03", "2024-10-27", "2024-07-01", "1999-12-31", None]
    rows = [(d, m) for d in days for m in (0, 60, 90, 125, 150, 185, 1439, 1440, -1)]
    df = spark.createDataFrame(rows, "d string, m int").select("d", "m", F.col("d").cast("date").alias("date"))
    seen = set()
    for zone in clock.ZONES:
        t, status = clock.local_minute(F.col("date"), zone, F.col("m"))
        for r in df.select("d", "m", t.alias("t"), status.alias("s")).collect():
            want = "invalid"
            if r.d and r.d >= "2000" and 0 <= r.m < 1440:
                wall = dt.datetime.fromisoformat(r.d) + dt.timedelta(minutes=r.m)
                both = {wall.replace(tzinfo=ZoneInfo(zone), fold=f).astimezone(dt.UTC) for f in (0, 1)}
                fits = {x for x in both if x.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == wall}
                want = {0: "nonexistent", 1: "ok", 2: "ambiguous"}[len(fits)]
                if want == "ok":
                    assert r.t == int(fits.pop().timestamp() * 1000)
            assert r.s == want, (zone, r)
            assert want == "ok" or r.t is None
            seen.add(r.s)
    assert seen == {"ok", "invalid", "nonexistent", "ambiguous"}


def test_higher_gates(spark):
    rows = [(s, x) for s in ("long", "short") for x in (1, 0, -1, None)]
    got = spark.createDataFrame(rows, "side string, htf_trend int").select("side", "htf_trend", gates.higher_not_against(F.col("side")).alias("n"), gates.higher_agrees(F.col("side")).alias("a"), gates.higher_fades(F.col("side")).alias("f")).collect()
    for r in got:
        way = 1 if r.side == "long" else -1
        assert (r.n, r.a, r.f) == (r.htf_trend in (0, way), r.htf_trend == way, r.htf_trend in (0, -way))


def test_day_theme(spark):
    schema = "regime string, trend_dir int, open_location string, pd_h double, pd_l double, c double"
    rows = [("trending", 1, "pd_h", 2.0, 1.0, 1.0), ("trending", 0, "pd_h", 2.0, 1.0, 1.0), ("ranging", 1, "asia_l", 2.0, 1.0, 2.0), ("ranging", 0, None, 2.0, 1.0, 1.38), ("ranging", 0, None, 2.0, 1.0, 1.62), ("ranging", 0, None, 2.0, 1.0, 1.5), ("ranging", 0, None, None, 1.0, 1.0), ("ranging", 0, None, 1.0, 1.0, 1.0)]
    got = [r.day_theme for r in gates.day_theme(spark.createDataFrame(rows, schema)).collect()]
    assert got == ["join_momentum", "sell_highs", "buy_lows", "buy_lows", "sell_highs", "stand_aside", "stand_aside", "stand_aside"]


def test_frozen_windows(spark):
    """Missing and repeated slots give no prices."""
    width = 300_000
    bars = [("A", k * width, 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k) for k in range(12) if k != 8] + [("A", 3 * width, 9.0, 9.0, 9.0, 9.0)]
    b = spark.createDataFrame(bars, "symbol string, t_ms long, o double, h double, l double, c double")
    decisions = spark.createDataFrame([("A", 2 * width), ("A", 6 * width + 1), ("A", 14 * width)], "symbol string, t_ms long")
    got = {r.t_ms: r for r in gates.frozen_windows(decisions, b.where("o < 9"), width, 6, False).collect()}
    assert [got[t].status for t in (2 * width, 6 * width + 1, 14 * width)] == ["missing", "ok", "missing"]
    assert tuple(got[6 * width + 1])[4:] == (1.0, 7.0, 0.5, 6.5) and got[2 * width].o is None
    assert {r.status for r in gates.frozen_windows(decisions.where(f"t_ms = {6 * width + 1}"), b, width, 6, True).collect()} == {"duplicate"}


def test_known_quotes(spark):
    """A quote counts from when it is known, its age from its own time."""
    r = random.Random(7)
    quotes = [("A", t, t + r.randint(0, 400), float(t)) for t in r.sample(range(2000), 60)]
    at = [("A", t) for t in range(0, 2500, 37)]
    q = spark.createDataFrame(quotes, "symbol string, t_ms long, available_ms long, mid double")
    d = spark.createDataFrame(at, "symbol string, t_ms long")
    before, after = ({x.t_ms: x.quote_ms for x in df.collect()} for df in (asof.known_before(d, q, 300), asof.known_after(d, q, 200, 250)))
    for _, t in at:
        known = max(((av, q_) for _, q_, av, _ in quotes if av < t), default=None)
        assert before[t] == (known[1] if known and t - known[1] <= 300 else None)
        later = min((av for _, _, av, _ in quotes if av >= t), default=None)
        same = [q_ for _, q_, av, _ in quotes if av == later]
        if later is None or later - t > 200:
            assert after[t] is None
        elif len(same) == 1:
            assert after[t] == (same[0] if later - same[0] <= 250 else None)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_of_a_hot_key(spark, monkeypatch, forward, strict):
    """One symbol holds most rows, a null one some; blocks of time, with holes between them, change nothing."""
    monkeypatch.setattr(asof, "BLOCK", 50)
    r = random.Random(9)
    key = lambda: "hot" if r.random() < 0.9 else r.choice(["cold", None])
    right = [(key(), t, r.randint(0, 99)) for t in r.choices([*range(100, 400), *range(900, 1000)], k=150)]
    left = [(key(), t, k) for k, t in enumerate(r.choices(range(1200), k=300))]
    df = asof.asof(spark.createDataFrame(left, "symbol string, t_ms long, k int"), spark.createDataFrame(right, "symbol string, at long, v int"), ["symbol"], "t_ms", "at", ["at", "v"], strict=strict, forward=forward, max_age=400)
    got = {x.k: (x.at, x.v) for x in df.collect()}
    for s, t, k in left:
        fits = [(a, v) for q, a, v in right if q == s and ((a > t if strict else a >= t) if forward else (a < t if strict else a <= t))]
        near = (min(a for a, _ in fits) if forward else max(a for a, _ in fits)) if fits else None
        want = (near, max(v for a, v in fits if a == near)) if fits and abs(near - t) <= 400 else (None, None)
        assert got[k] == want
    assert len(got) == 300


def test_equity_by_blocks(spark, monkeypatch):
    """One label holds nearly all trades; blocks change nothing, a null label included."""
    r = random.Random(2)
    rows = [("hot" if k % 20 else None, k * 7_000_000 + r.randint(0, 3), f"s{k % 3}", k, float(r.randint(-90, 100))) for k in range(400)]
    df = spark.createDataFrame(rows, "label string, entry_t long, symbol string, entry_i int, pnl double")
    monkeypatch.setattr(report, "BLOCK", 100_000_000)
    got = {(x.label, x.entry_i): (x.equity, x.peak) for x in report.equity(df, ["label"], 100.0).collect()}
    for label in ("hot", None):
        e = peak = 100.0
        for _, _, _, i, pnl in sorted((x for x in rows if x[0] == label), key=lambda x: x[1:4]):
            e += pnl
            peak = max(peak, e)
            assert got[label, i] == (e, peak)
    assert len(got) == 400
    numbers = [x.entry_i for x in report.numbered(df).orderBy("number").collect()]
    assert numbers == [x[3] for x in sorted(rows, key=lambda x: x[1:4])]


def test_pinned_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"content")
    good = hashlib.sha256(b"content").hexdigest()
    assert bytes(src.read_pinned(spark, str(tmp_path), good).first().content) == b"content"
    with pytest.raises(Exception, match="pinned"):
        src.read_pinned(spark, str(tmp_path), "0" * 64).select("content").collect()


def test_quote_defects(spark, tmp_path):
    (tmp_path / "q.csv").write_text("eventMS,bid,ask\n1,1.0,1.1\n2,x,1.1\n3,1.2,1.1\n4,0,1\n5,1,1\n")
    assert tuple(src.quote_defects(spark, str(tmp_path)).first()) == (5, 1, 2)
    assert src.read_quotes(spark, str(tmp_path)).count() == 2

"""Shapes of price: candles, swings, gaps, ranges, channels, seasonality and session statistics."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock
from ..functions.indicators import fold, lag, last, series

NEVER = Window.unboundedPreceding


def candles(bars: DataFrame) -> DataFrame:
    """Booleans bull_pin, bear_pin, bull_engulf, bear_engulf, outside; where the close lies in the bar (0 to 1; 0.5 in a flat one)."""
    span = F.col("h") - F.col("l")
    top, bottom = F.greatest("o", "c"), F.least("o", "c")
    po, pc, ph, pl = lag("o"), lag("c"), lag("h"), lag("l")
    body, low, high = F.abs(F.col("c") - F.col("o")), bottom - F.col("l"), F.col("h") - top
    wide = F.greatest(F.lit(0.00001), span)
    pin = lambda tail, other: (tail >= 0.45 * wide) & (tail >= 1.5 * body) & (other <= 0.35 * wide)
    out = bars.withColumn("close_location", F.when(span > 0, (F.col("c") - F.col("l")) / span).otherwise(0.5))
    out = out.withColumn("bull_pin", pin(low, high) & (F.col("c") >= F.col("o"))).withColumn("bear_pin", pin(high, low) & (F.col("c") <= F.col("o")))
    yes = lambda x: F.coalesce(x, F.lit(False))
    out = out.withColumn("bull_engulf", yes((F.col("c") > F.col("o")) & (pc < po) & (F.col("c") >= po) & (F.col("o") <= pc)))
    out = out.withColumn("bear_engulf", yes((F.col("c") < F.col("o")) & (pc > po) & (F.col("c") <= po) & (F.col("o") >= pc)))
    return out.withColumn("outside", yes((F.col("h") > ph) & (F.col("l") < pl)))


def swings(bars: DataFrame, k: int = 3, high: str = "h", low: str = "l", right_equal: bool = False) -> DataFrame:
    """Fractals of k bars on either side, known k bars later: swing_high and swing_low on the bar that confirms them, and the last of each.

    Strictly beyond all neighbours; with right_equal later neighbours may be equal.
    """
    before, after = series().rowsBetween(-k, -1), series().rowsBetween(1, k)
    out = bars.withColumn("_hb", F.max(high).over(before)).withColumn("_ha", F.max(high).over(after)).withColumn("_lb", F.min(low).over(before)).withColumn("_la", F.min(low).over(after))
    out = out.withColumn("_n", F.count(high).over(series().rowsBetween(-k, k)))
    later_h = F.col(high) >= F.col("_ha") if right_equal else F.col(high) > F.col("_ha")
    later_l = F.col(low) <= F.col("_la") if right_equal else F.col(low) < F.col("_la")
    out = out.withColumn("_ph", F.when((F.col("_n") == 2 * k + 1) & (F.col(high) > F.col("_hb")) & later_h, F.col(high)))
    out = out.withColumn("_pl", F.when((F.col("_n") == 2 * k + 1) & (F.col(low) < F.col("_lb")) & later_l, F.col(low)))
    out = out.withColumn("swing_high", lag("_ph", k)).withColumn("swing_low", lag("_pl", k)).drop("_hb", "_ha", "_lb", "_la", "_n", "_ph", "_pl")
    w = series().rowsBetween(NEVER, 0)
    return out.withColumn("last_high", F.last("swing_high", True).over(w)).withColumn("last_low", F.last("swing_low", True).over(w))


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Three-bar gaps on the bar that completes them: side, gap_low, gap_high, size in ATRs (needs atr)."""
    h2, l2 = lag("h", 2), lag("l", 2)
    out = bars.withColumn("_h2", h2).withColumn("_l2", l2)
    side = F.when(F.col("l") > F.col("_h2"), "long").when(F.col("h") < F.col("_l2"), "short")
    out = out.withColumn("side", side).withColumn("gap_low", F.when(side == "long", F.col("_h2")).when(side == "short", F.col("h"))).withColumn("gap_high", F.when(side == "long", F.col("l")).when(side == "short", F.col("_l2")))
    return out.where("side is not null").withColumn("size_atr", F.when(F.col("atr") > 0, (F.col("gap_high") - F.col("gap_low")) / F.col("atr"))).drop("_h2", "_l2")


def first_touch(zones: DataFrame, bars: DataFrame, most: int) -> DataFrame:
    """zones (symbol, i, side, gap_low, gap_high) with the first of the next `most` bars that comes back into each, unless one closed beyond its far edge before."""
    later = bars.select("symbol", F.col("i").alias("_j"), F.col("h").alias("_h"), F.col("l").alias("_l"), F.col("c").alias("_c"))
    block = lambda x: F.floor(x / most).cast("long")
    z = zones.withColumn("_block", F.explode(F.array(block(F.col("i")), block(F.col("i")) + 1)))
    hit = z.join(later.withColumn("_block", block(F.col("_j"))), ["symbol", "_block"]).where("_j > i and _j <= i + %d" % most)
    long = F.col("side") == "long"
    touch = F.when(long, F.col("_l") <= F.col("gap_high")).otherwise(F.col("_h") >= F.col("gap_low"))
    lost = F.when(long, F.col("_c") < F.col("gap_low")).otherwise(F.col("_c") > F.col("gap_high"))
    got = hit.groupBy("symbol", "i").agg(F.min(F.when(touch, F.col("_j"))).alias("touch_i"), F.min(F.when(lost, F.col("_j"))).alias("lost_i"))
    return zones.join(got, ["symbol", "i"], "left").withColumn("touch_i", F.when(F.col("lost_i").isNull() | (F.col("touch_i") <= F.col("lost_i")), F.col("touch_i")))


def range_stats(bars: DataFrame, key: Column, lookback: int = 10) -> DataFrame:
    """Range so far of each island of equal key (null: none), mean range of the last islands before it, share used."""
    out = bars.withColumn("scope", key)
    w = Window.partitionBy("symbol", "scope").orderBy("t_ms").rowsBetween(NEVER, 0)
    out = out.withColumn("live_range", F.when(F.col("scope").isNotNull(), F.max("h").over(w) - F.min("l").over(w)))
    islands = out.where("scope is not null").groupBy("symbol", "scope").agg((F.max("h") - F.min("l")).alias("whole"), F.min("t_ms").alias("begin"))
    islands = islands.withColumn("avg_range", F.avg("whole").over(Window.partitionBy("symbol").orderBy("begin").rowsBetween(-lookback, -1)))
    out = out.join(islands.select("symbol", "scope", "avg_range"), ["symbol", "scope"], "left")
    return out.withColumn("used_pct", F.when(F.col("avg_range") > 0, 100 * F.col("live_range") / F.col("avg_range")))


def seasonality(bars: DataFrame, bucket: Column, least: int = 5, days: int | None = None) -> DataFrame:
    """Bullish, bearish and flat bars of the same bucket before this one (in the last days, if given), bullish share and its class."""
    out = bars.withColumn("bucket", bucket).withColumn("_b", (F.col("c") > F.col("o")).cast("long")).withColumn("_s", (F.col("c") < F.col("o")).cast("long"))
    w = Window.partitionBy("symbol", "bucket").orderBy("t_ms")
    w = w.rowsBetween(NEVER, -1) if days is None else w.rangeBetween(-days * clock.DAY, -1)
    n = F.count("*").over(w)
    out = out.withColumn("n_seen", n).withColumn("n_bull", F.coalesce(F.sum("_b").over(w), F.lit(0))).withColumn("n_bear", F.coalesce(F.sum("_s").over(w), F.lit(0)))
    out = out.withColumn("bull_pct", F.when(F.col("n_seen") >= least, 100.0 * F.col("n_bull") / F.col("n_seen")))
    p = F.col("bull_pct")
    name = F.when(p >= 76, "strong-bull").when(p >= 56, "bull").when(p >= 45, "neutral").when(p >= 26, "bear").when(p.isNotNull(), "strong-bear")
    return out.withColumn("season", name).drop("_b", "_s")


def session_bias(bars: DataFrame, name: str = "london") -> DataFrame:
    """Direction of a session so far (needs atr): displacement in ATRs, share of net bodies; up, down, mixed or pause."""
    rows = bars.where(clock.in_session(F.col("t_ms"), name)).withColumn("day", clock.day_utc(F.col("t_ms")))
    w = Window.partitionBy("symbol", "day").orderBy("t_ms").rowsBetween(NEVER, 0)
    body = F.col("c") - F.col("o")
    out = rows.withColumn("displacement", F.when(F.col("atr") > 0, (F.col("c") - F.first("o").over(w)) / F.col("atr")))
    total = F.sum(F.abs(body)).over(w)
    out = out.withColumn("body_net", F.when(total > 0, F.sum(body).over(w) / total).otherwise(0.0))
    up = (F.col("displacement") >= 0.25) & (F.col("body_net") >= 0.2)
    down = (F.col("displacement") <= -0.25) & (F.col("body_net") <= -0.2)
    pause = (F.abs("displacement") < 0.15) & (F.abs("body_net") < 0.15)
    return out.withColumn("bias", F.when(up, "up").when(down, "down").when(pause, "pause").otherwise("mixed"))


def regime(bars: DataFrame, enter: float = 0.4, leave: float = 0.4) -> DataFrame:
    """Needs er: trending from er >= enter until er < leave; elsewhere ranging."""
    mark = F.when(F.col("er") >= enter, 1).when(F.col("er") < leave, 0)
    out = bars.withColumn("_m", mark)
    return out.withColumn("regime", F.when(F.coalesce(F.last("_m", True).over(series().rowsBetween(NEVER, 0)), F.lit(0)) == 1, "trending").otherwise("ranging")).drop("_m")


def narrow_ranges(
    bars: DataFrame, least: int = 24, most: int = 160, width: float = 3.0, contain: float = 0.85,
    touches: int = 3, touch: float = 0.5, drift: float = 0.5, crossings: int = 4, buffer: float = 0.25, least_width: float = 1.0,
) -> DataFrame:
    """Needs atr: the longest stretch back from each bar, at most `most` bars, whose bodies are no wider than width ATRs; zone_high, zone_low, zone_bars.

    It is a zone if it has at least `least` bars, bodies at least least_width ATRs wide, closes that end within drift of
    the width from where they began and cross its middle `crossings` times, each edge touched `touches` times (bodies
    within touch ATRs of it, not two bars in a row), and the share contain of its bars, wicks included, within the edges
    and the larger of touch and buffer ATRs. Its edges are those of the bodies, moved out by buffer ATRs.

    A shorter stretch is not tried if the longest fails. A bar without prices or ATR is in no zone.
    """

    def count_touches(on: np.ndarray) -> np.ndarray:
        """Every other bar of each run counts, its first one included."""
        at = np.arange(on.shape[1])
        before = np.maximum.accumulate(np.where(on, -1, at), axis=1)
        return (on & ((at - before) % 2 == 1)).sum(1)

    def count_changes(sign: np.ndarray) -> np.ndarray:
        """Changes of sign, zeros left out."""
        held = np.maximum.accumulate(np.where(sign != 0, np.arange(sign.shape[1]), 0), axis=1)
        sign = np.take_along_axis(sign, held, 1)
        return (sign[:, 1:] * sign[:, :-1] < 0).sum(1)

    def make(x):
        size = len(x["c"])
        top, bottom = np.maximum(x["o"], x["c"]), np.minimum(x["o"], x["c"])
        back = lambda v: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(most - 1, np.nan), v]), most)[:, ::-1]  # noqa: E731  row i: v[i], v[i - 1], ...
        tops, bottoms, highs, lows, closes = back(top), back(bottom), back(x["h"]), back(x["l"]), back(x["c"])
        out = {n: np.full(size, np.nan) for n in ("zone_bars", "zone_high", "zone_low")}
        for a in range(0, size, 2048):
            i = np.arange(a, min(a + 2048, size))
            hi, lo = np.maximum.accumulate(tops[i], axis=1), np.minimum.accumulate(bottoms[i], axis=1)
            n = 1 + (hi - lo <= width * x["atr"][i, None])[:, 1:].sum(1)  # width only grows with length
            hi, lo = hi[np.arange(len(i)), n - 1], lo[np.arange(len(i)), n - 1]
            on = (n >= least) & (hi > lo) & (hi - lo >= least_width * x["atr"][i]) & (np.abs(x["c"][i] - x["c"][i - n + 1]) <= drift * (hi - lo))
            i, n, hi, lo = i[on], n[on], hi[on], lo[on]
            h, w, atr, held = hi[:, None], lo[:, None], x["atr"][i, None], np.arange(most) < n[:, None]
            on = count_changes(np.where(held, np.sign(closes[i] - (h + w) / 2), 0)) >= crossings
            on &= (count_touches(held & (tops[i] >= h - touch * atr)) >= touches) & (count_touches(held & (bottoms[i] <= w + touch * atr)) >= touches)
            far = max(touch, buffer) * atr
            on &= (held & ((highs[i] > h + far) | (lows[i] < w - far))).sum(1) <= n - np.ceil(contain * n)
            i, atr = i[on], x["atr"][i[on]]
            out["zone_bars"][i], out["zone_high"][i], out["zone_low"][i] = n[on], hi[on] + buffer * atr, lo[on] - buffer * atr
        return out

    return fold(bars, make, "zone_bars", "zone_high", "zone_low").withColumn("zone_bars", F.col("zone_bars").cast("int"))


def channels(bars: DataFrame, lookback: int = 60) -> DataFrame:
    """Least-squares line of the last closes on their number, and how far highs and lows reach from it: rail_high, rail_low at this bar, slope a bar."""
    w = last(lookback)
    x = F.col("i").cast("double")
    out = bars.withColumn("_x", x).withColumn("_slope", F.regr_slope("c", "_x").over(w)).withColumn("_mid", F.regr_intercept("c", "_x").over(w))
    out = out.withColumn("_pts", F.collect_list(F.struct("_x", "h", "l")).over(w))
    off = lambda c, f: f(F.transform("_pts", lambda p: p[c] - (F.col("_mid") + F.col("_slope") * p["_x"])))
    at = F.col("_mid") + F.col("_slope") * F.col("_x")
    full_ = F.size("_pts") == lookback
    out = out.withColumn("rail_high", F.when(full_, at + off("h", F.array_max))).withColumn("rail_low", F.when(full_, at + off("l", F.array_min))).withColumn("rail_slope", F.when(full_, F.col("_slope")))
    return out.drop("_x", "_slope", "_mid", "_pts")


def volume_profile(bars: DataFrame, size: float, key: list[str]) -> DataFrame:
    """Volume by price bin of the given size: each bar's volume goes to the bins that it spans, by overlap."""
    a, b = F.floor(F.col("l") / size), F.floor(F.col("h") / size)
    rows = bars.withColumn("bin", F.explode(F.sequence(a.cast("long"), b.cast("long"))))
    low = F.col("bin") * size
    share = F.when(F.col("h") > F.col("l"), (F.least(F.col("h"), low + size) - F.greatest(F.col("l"), low)) / (F.col("h") - F.col("l"))).otherwise(1.0)
    return rows.groupBy(*key, "bin").agg(F.sum(F.col("v") * share).alias("volume"))


def value_area(profile: DataFrame, size: float, key: list[str], share: float = 0.7) -> DataFrame:
    """Point of control (ties: the higher price) and the area about it that holds that share of the volume, grown by the heavier neighbour."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        bins, v = table.column("bin").to_numpy(), table.column("volume").to_numpy()
        poc = int(np.flatnonzero(v >= v.max() - 1e-10)[-1])
        a = b = poc
        held, want = v[poc], share * v.sum()
        while held < want and (a > 0 or b < len(v) - 1):
            below, above = v[a - 1] if a > 0 else -1.0, v[b + 1] if b < len(v) - 1 else -1.0
            if above >= below:
                b, held = b + 1, held + above
            else:
                a, held = a - 1, held + below
        row = {k: table.column(k)[:1] for k in key}
        return pa.table({**row, "poc": [(bins[poc] + 0.5) * size], "area_low": [float(bins[a] * size)], "area_high": [float((bins[b] + 1) * size)]})

    kinds = ", ".join(f"{k} {profile.schema[k].dataType.simpleString()}" for k in key)
    return profile.groupBy(*key).applyInArrow(run, f"{kinds}, poc double, area_low double, area_high double")


def run_lengths(bars: DataFrame) -> DataFrame:
    """streak: how many bars in a row closed up (+) or down (-)."""

    def make(x):
        out = np.zeros(len(x["c"]))
        for i, s in enumerate(np.sign(x["c"] - x["o"])):
            out[i] = s if i == 0 or np.sign(out[i - 1]) != s else out[i - 1] + s
        return {"streak": out}

    return fold(bars, make, "streak")

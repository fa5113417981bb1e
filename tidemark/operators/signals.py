"""Setup signals: each takes bars with the columns it names and adds side ("long", "short" or null), and where it has them stop and target.

All are expressions over moving frames, so any number of them shares one shuffle by symbol. Gates are boolean columns.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock
from ..functions.indicators import lag, last, series


def _side(long: Column, short: Column) -> Column:
    return F.when(F.coalesce(long, F.lit(False)), "long").when(F.coalesce(short, F.lit(False)), "short")


def gated(signals: DataFrame, **gates: Column) -> DataFrame:
    """side where all gates hold; each gate stays as a column gate_<name>, so that a funnel can be counted."""
    out = signals
    for name, gate in gates.items():
        out = out.withColumn(f"gate_{name}", F.coalesce(gate, F.lit(False)))
    passed = reduce(lambda a, b: a & b, [F.col(f"gate_{n}") for n in gates], F.lit(True))
    return out.withColumn("side", F.when(passed, F.col("side")))


def funnel(signals: DataFrame, names: list[str]) -> DataFrame:
    """How many bars pass the gates up to each, in order: step, gate, n."""
    passed, cells = F.lit(True), []
    for k, n in enumerate(names):
        passed = passed & F.col(f"gate_{n}")
        cells.append(F.struct(F.lit(k).alias("step"), F.lit(n).alias("gate"), F.sum(passed.cast("long")).alias("n")))
    return signals.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def price_momentum(bars: DataFrame, threshold: float) -> DataFrame:
    """Needs roc."""
    return bars.withColumn("side", _side(F.col("roc") >= threshold, F.col("roc") <= -threshold))


def donchian_breakout(bars: DataFrame, stop_atr: float = 2.0) -> DataFrame:
    """Needs dc_high, dc_low, atr: a close beyond the channel; stop at stop_atr ATRs."""
    out = bars.withColumn("side", _side(F.col("c") > F.col("dc_high"), F.col("c") < F.col("dc_low")))
    return out.withColumn("stop", F.when(F.col("side") == "long", F.col("c") - stop_atr * F.col("atr")).when(F.col("side") == "short", F.col("c") + stop_atr * F.col("atr")))


def sma_cross(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """cross: 1 where the fast mean comes above the slow one, -1 where it comes below; equality keeps the state."""
    out = bars.withColumn("_f", F.when(F.count("c").over(last(fast)) == fast, F.avg("c").over(last(fast)))).withColumn("_s", F.when(F.count("c").over(last(slow)) == slow, F.avg("c").over(last(slow))))
    out = out.withColumn("_d", F.col("_f") - F.col("_s")).withColumn("_p", lag("_d"))
    return out.withColumn("cross", F.when((F.col("_d") > 0) & (F.col("_p") <= 0), 1).when((F.col("_d") < 0) & (F.col("_p") >= 0), -1).otherwise(0)).drop("_f", "_s", "_d", "_p")


def keltner_reversion(bars: DataFrame) -> DataFrame:
    """Needs kc_low, kc_high, kc_mid: a bar that pierces a band and closes back inside; target the middle."""
    out = bars.withColumn("side", _side((F.col("l") < F.col("kc_low")) & (F.col("c") > F.col("kc_low")), (F.col("h") > F.col("kc_high")) & (F.col("c") < F.col("kc_high"))))
    return out.withColumn("target", F.when(F.col("side").isNotNull(), F.col("kc_mid")))


def keltner_expansion(bars: DataFrame) -> DataFrame:
    """Two closes in a row beyond a band."""
    up, down = F.col("c") > F.col("kc_high"), F.col("c") < F.col("kc_low")
    out = bars.withColumn("_u", up.cast("int")).withColumn("_d", down.cast("int"))
    return out.withColumn("side", _side((F.col("_u") == 1) & (lag("_u") == 1), (F.col("_d") == 1) & (lag("_d") == 1))).drop("_u", "_d")


def failed_breakout(bars: DataFrame, n: int = 20, within: int = 3, depth: float = 0.1) -> DataFrame:
    """Needs atr: within the last bars a sweep of the extreme of n bars before them by depth ATRs, and a close back inside."""
    high, low = F.max("h").over(last(n, within)), F.min("l").over(last(n, within))
    out = bars.withColumn("edge_high", high).withColumn("edge_low", low).withColumn("_h", F.max("h").over(last(within))).withColumn("_l", F.min("l").over(last(within)))
    short = (F.col("_h") >= F.col("edge_high") + depth * F.col("atr")) & (F.col("c") < F.col("edge_high"))
    long = (F.col("_l") <= F.col("edge_low") - depth * F.col("atr")) & (F.col("c") > F.col("edge_low"))
    out = out.withColumn("side", F.when(F.coalesce(short, F.lit(False)), "short").when(F.coalesce(long, F.lit(False)), "long"))
    return out.withColumn("stop", F.when(F.col("side") == "short", F.col("_h")).when(F.col("side") == "long", F.col("_l"))).drop("_h", "_l")


def hold_beyond(bars: DataFrame, high: str, low: str, n: int = 2) -> DataFrame:
    """n closes in a row beyond a level (session range, channel rail, inside day): the first such bar after one that was not."""
    up, down = F.col("c") > F.col(high), F.col("c") < F.col(low)
    out = bars.withColumn("_u", F.coalesce(up, F.lit(False)).cast("int")).withColumn("_d", F.coalesce(down, F.lit(False)).cast("int"))
    out = out.withColumn("_su", F.sum("_u").over(last(n))).withColumn("_sd", F.sum("_d").over(last(n)))
    fresh = lambda s, m: (F.col(s) == n) & (F.coalesce(F.lag(m, n).over(series()), F.lit(0)) == 0)
    return out.withColumn("side", _side(fresh("_su", "_u"), fresh("_sd", "_d"))).drop("_u", "_d", "_su", "_sd")


def inside_day(bars: DataFrame, n: int = 1) -> DataFrame:
    """Needs pd_* and ppd_*: after a day inside the one before, closes beyond it."""
    inside = (F.col("pd_h") < F.col("ppd_h")) & (F.col("pd_l") > F.col("ppd_l"))
    out = bars.withColumn("_hi", F.when(inside, F.col("pd_h"))).withColumn("_lo", F.when(inside, F.col("pd_l")))
    return hold_beyond(out, "_hi", "_lo", n).drop("_hi", "_lo")


def day_open_reclaim(bars: DataFrame, stretch: float = 1.0, within: int = 4) -> DataFrame:
    """Needs day_open, day, atr: a stretch of so many ATRs from the day's open within the last bars, then a close back across it."""
    w = Window.partitionBy("symbol", "day").orderBy("t_ms").rowsBetween(-within, 0)
    out = bars.withColumn("_h", F.max("h").over(w)).withColumn("_l", F.min("l").over(w)).withColumn("_pc", F.lag("c").over(Window.partitionBy("symbol", "day").orderBy("t_ms")))
    long = (F.col("day_open") - F.col("_l") >= stretch * F.col("atr")) & (F.col("_pc") <= F.col("day_open")) & (F.col("c") > F.col("day_open"))
    short = (F.col("_h") - F.col("day_open") >= stretch * F.col("atr")) & (F.col("_pc") >= F.col("day_open")) & (F.col("c") < F.col("day_open"))
    return out.withColumn("side", _side(long, short)).drop("_h", "_l", "_pc")


def vwap_fade(bars: DataFrame, distance: float = 1.2) -> DataFrame:
    """Needs vwap, atr: the close stands so many ATRs from the VWAP; target the VWAP."""
    d = (F.col("c") - F.col("vwap")) / F.col("atr")
    out = bars.withColumn("side", F.when(F.col("atr") > 0, _side(d <= -distance, d >= distance)))
    return out.withColumn("target", F.when(F.col("side").isNotNull(), F.col("vwap")))


def break_retest(bars: DataFrame, high: str, low: str, run: float = 1.0, tolerance: float = 0.25, within: int = 12) -> DataFrame:
    """Needs atr: price has run past a level by so many ATRs within the last bars, comes back to it, and closes beyond it again."""
    out = bars.withColumn("_h", F.max("h").over(last(within, 1))).withColumn("_l", F.min("l").over(last(within, 1)))
    long = (F.col("_h") >= F.col(high) + run * F.col("atr")) & (F.abs(F.col("l") - F.col(high)) <= tolerance * F.col("atr")) & (F.col("c") > F.col(high))
    short = (F.col("_l") <= F.col(low) - run * F.col("atr")) & (F.abs(F.col("h") - F.col(low)) <= tolerance * F.col("atr")) & (F.col("c") < F.col(low))
    return out.withColumn("side", _side(long, short)).drop("_h", "_l")


def trend_pullback(bars: DataFrame, ema: str = "ema") -> DataFrame:
    """Needs regime and an EMA: in a trend, a bar that dips to the EMA and closes back on its side."""
    rising = F.col(ema) > lag(ema, 3)
    out = bars.withColumn("_r", rising)
    trend = F.col("regime") == "trending"
    return out.withColumn("side", _side(trend & F.col("_r") & (F.col("l") <= F.col(ema)) & (F.col("c") > F.col(ema)), trend & ~F.col("_r") & (F.col("h") >= F.col(ema)) & (F.col("c") < F.col(ema)))).drop("_r")


def fib_continuation(bars: DataFrame, leg: int = 12, least: float = 2.0, zone: tuple[float, float] = (0.5, 0.618)) -> DataFrame:
    """Needs atr: a leg of so many ATRs whose end came after its start, a pullback into the zone, and a close with the leg."""
    w = last(leg, 1)
    when = lambda c, top: (F.max_by if top else F.min_by)("t_ms", c).over(w)
    out = bars.withColumn("_h", F.max("h").over(w)).withColumn("_l", F.min("l").over(w)).withColumn("_th", when("h", True)).withColumn("_tl", when("l", False))
    span = F.col("_h") - F.col("_l")
    back_long, back_short = (F.col("_h") - F.col("l")) / span, (F.col("h") - F.col("_l")) / span
    big = span >= least * F.col("atr")
    long = big & (F.col("_th") > F.col("_tl")) & back_long.between(*zone) & (F.col("c") > F.col("o"))
    short = big & (F.col("_th") < F.col("_tl")) & back_short.between(*zone) & (F.col("c") < F.col("o"))
    return out.withColumn("side", _side(long, short)).drop("_h", "_l", "_th", "_tl")


def flag_continuation(bars: DataFrame, pole: int = 12, least: float = 1.5, flags: tuple[int, int] = (3, 10), depth: float = 0.34) -> DataFrame:
    """Needs atr: a pole of so many ATRs, a shallow flag of some length after it (the shortest that fits wins), and a close beyond the flag."""
    side = stop = F.lit(None)
    for n in range(flags[1], flags[0] - 1, -1):
        top, bottom = F.max("h").over(last(n, 1)), F.min("l").over(last(n, 1))
        start_low, start_high = F.min("l").over(last(pole, n + 1)), F.max("h").over(last(pole, n + 1))
        full_ = F.count("c").over(last(pole, n + 1)) == pole
        long = full_ & (start_high - start_low >= least * F.col("atr")) & (start_high - bottom <= depth * (start_high - start_low)) & (F.lag("c", n + 1).over(series()) >= start_high - 0.25 * (start_high - start_low)) & (F.col("c") > top)
        short = full_ & (start_high - start_low >= least * F.col("atr")) & (top - start_low <= depth * (start_high - start_low)) & (F.lag("c", n + 1).over(series()) <= start_low + 0.25 * (start_high - start_low)) & (F.col("c") < bottom)
        side = F.when(F.coalesce(long, F.lit(False)), "long").when(F.coalesce(short, F.lit(False)), "short").otherwise(side)
        stop = F.when(F.coalesce(long, F.lit(False)), bottom).when(F.coalesce(short, F.lit(False)), top).otherwise(stop)
    return bars.withColumn("side", side).withColumn("stop", stop)


def opening_range(bars: DataFrame, first: int = 2) -> DataFrame:
    """Needs day: the range of the day's first bars, and the first close beyond it that day."""
    w = Window.partitionBy("symbol", "day").orderBy("t_ms")
    out = bars.withColumn("_k", F.row_number().over(w))
    early = F.col("_k") <= first
    all_day = Window.partitionBy("symbol", "day")
    out = out.withColumn("or_high", F.max(F.when(early, F.col("h"))).over(all_day)).withColumn("or_low", F.min(F.when(early, F.col("l"))).over(all_day))
    out = out.withColumn("_x", F.when(~early & (F.col("c") > F.col("or_high")), "long").when(~early & (F.col("c") < F.col("or_low")), "short"))
    seen = F.count("_x").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("_seen", seen).withColumn("side", F.when(F.col("_seen") == 0, F.col("_x"))).drop("_k", "_x", "_seen")


def volume_exhaustion(bars: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Needs vol_ratio, close_location: unusual volume on a bar that closes at its other end."""
    loud = F.col("vol_ratio") >= ratio
    return bars.withColumn("side", _side(loud & (F.col("close_location") >= 0.7) & (F.col("c") < lag("c", 3)), loud & (F.col("close_location") <= 0.3) & (F.col("c") > lag("c", 3))))


def counter_nine(bars: DataFrame, count: int = 9) -> DataFrame:
    """Needs counter: the ninth bar (or `count`) of a count, whose low (high) is under (over) those of the second and third bar before."""
    low, high = F.least(lag("l", 2), lag("l", 3)), F.greatest(lag("h", 2), lag("h", 3))
    return bars.withColumn("side", _side((F.col("counter") == -count) & (F.col("l") <= low), (F.col("counter") == count) & (F.col("h") >= high)))


def double_extreme(bars: DataFrame, tolerance: float = 0.3, apart: int = 72, within: int = 12, k: int = 3) -> DataFrame:
    """Needs swings of k bars, atr: two swings in a row near each other (tolerance ATRs), at most `apart` bars apart, and
    at most `within` bars after the second one is known the first close beyond the neck, the opposite extreme between them."""
    so_far, before = series().rowsBetween(Window.unboundedPreceding, 0), series().rowsBetween(Window.unboundedPreceding, -1)
    out = bars.withColumn("_k", F.row_number().over(series())).withColumn("_pc", lag("c"))
    hits = {}
    for name, swing, other, neck in (("short", "swing_high", "l", F.array_min), ("long", "swing_low", "h", F.array_max)):
        out = out.withColumn("_s", F.when(F.col(swing).isNotNull(), F.struct(F.col("_k").alias("k"), F.col(swing).alias("p")))).withColumn("_q", F.last("_s", ignorenulls=True).over(before))
        out = out.withColumn("_gap", F.col("_s.k") - F.col("_q.k")).withColumn("_x", F.collect_list(other).over(series().rowsBetween(-apart - k, 0)))
        between = F.slice("_x", F.greatest(F.size("_x") - k - F.col("_gap"), F.lit(1)), F.col("_gap") + 1)
        pair = F.struct(F.col("_s.k").alias("k"), F.abs(F.col("_s.p") - F.col("_q.p")).alias("d"), F.when(F.col("_gap") <= apart, neck(between)).alias("neck"))
        out = out.withColumn("_p", F.last(F.when(F.col("_gap").isNotNull(), pair), ignorenulls=True).over(so_far))
        ready = (F.col("_p.d") <= tolerance * F.col("atr")) & (F.col("_k") - F.col("_p.k") <= within)
        level = F.col("_p.neck")
        broken = (F.col("c") < level) & (F.col("_pc") >= level) if name == "short" else (F.col("c") > level) & (F.col("_pc") <= level)
        out = out.withColumn(f"_{name}", ready & broken)
        hits[name] = F.col(f"_{name}")
    return out.withColumn("side", _side(hits["long"], hits["short"])).drop("_k", "_pc", "_s", "_q", "_gap", "_x", "_p", "_long", "_short")


def weekend_fade(bars: DataFrame) -> DataFrame:
    """Monday's first bar: fade the weekend's (Saturday and Sunday, UTC) extreme in which it closed."""
    out = bars.withColumn("week", clock.week_utc(F.col("t_ms"))).withColumn("_d", clock.weekday_utc(F.col("t_ms")))
    ends = out.where("_d >= 5").groupBy("symbol", "week").agg(F.max("h").alias("we_h"), F.min("l").alias("we_l"), F.max_by("c", "t_ms").alias("we_c"), F.count("*").alias("we_n")).withColumn("week", F.col("week") + 1)
    out = out.join(ends, ["symbol", "week"], "left")
    first = F.row_number().over(Window.partitionBy("symbol", "week").orderBy("t_ms")) == 1
    where = (F.col("we_c") - F.col("we_l")) / (F.col("we_h") - F.col("we_l"))
    return out.withColumn("_first", first & (F.col("_d") == 0)).withColumn("side", F.when(F.col("_first"), _side(where <= 0.2, where >= 0.8))).drop("_first", "_d")


def down_shock(bars: DataFrame, n: int = 20, z: float = 2.0) -> DataFrame:
    """A fall of z robust deviations (median absolute) of the last n changes before it."""
    out = bars.withColumn("_r", F.log(F.col("c") / lag("c"))).withColumn("_a", F.abs("_r"))
    out = out.withColumn("_m", F.percentile("_a", 0.5).over(last(n, 1))).withColumn("_n", F.count("_a").over(last(n, 1)))
    return out.withColumn("side", F.when((F.col("_n") == n) & (F.col("_r") <= -z * 1.4826 * F.col("_m")), "long")).drop("_r", "_a", "_m", "_n")


def clock_breakout(bars: DataFrame, ranges: DataFrame, end_hour: float) -> DataFrame:
    """Needs day: the first bar after a day's clock range (levels.clock_ranges, accepted only) that passes its high or low; both: the nearer to its open."""
    r = ranges.where("status = 'accepted'").select("symbol", "day", F.col("h").alias("range_high"), F.col("l").alias("range_low"))
    out = bars.join(r, ["symbol", "day"])
    up, down = F.col("h") > F.col("range_high"), F.col("l") < F.col("range_low")
    near = F.when(F.col("range_high") - F.col("o") <= F.col("o") - F.col("range_low"), "long").otherwise("short")
    later = clock.hour_utc(F.col("t_ms")) >= end_hour
    out = out.withColumn("_x", F.when(later & up & down, near).when(later & up, "long").when(later & down, "short"))
    seen = F.count("_x").over(Window.partitionBy("symbol", "day").orderBy("t_ms").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("_seen", seen).withColumn("side", F.when(F.col("_seen") == 0, F.col("_x"))).drop("_x", "_seen")


def named_sweep(bars: DataFrame, names: list[str], margin: float = 0.0) -> DataFrame:
    """A wick through a named level and a close back: highs short, lows long; the first name in the given order wins. Adds level."""
    hits = []
    for n in names:
        high = n.endswith("_h")
        level = F.col(n)
        hit = (F.col("h") > level + margin) & (F.col("c") < level) & (F.col("o") < level) if high else (F.col("l") < level - margin) & (F.col("c") > level) & (F.col("o") > level)
        hits.append(F.when(hit, F.struct(F.lit(n).alias("level"), F.lit("short" if high else "long").alias("side"))))
    return bars.withColumn("_s", F.coalesce(*hits)).withColumn("level", F.col("_s.level")).withColumn("side", F.col("_s.side")).drop("_s")


def supply_demand(bars: DataFrame, base: int = 3, narrow: float = 1.0, leave: float = 1.5) -> DataFrame:
    """Needs atr: a base of narrow bars and a departure of so many ATRs: zone_low and zone_high of the base; side of the zone."""
    w = last(base, 1)
    out = bars.withColumn("_hi", F.max("h").over(w)).withColumn("_lo", F.min("l").over(w)).withColumn("_wide", F.max(F.col("h") - F.col("l")).over(w)).withColumn("_n", F.count("c").over(w))
    calm = (F.col("_n") == base) & (F.col("_wide") <= narrow * F.col("atr"))
    out = out.withColumn("side", _side(calm & (F.col("c") - F.col("_hi") >= leave * F.col("atr")), calm & (F.col("_lo") - F.col("c") >= leave * F.col("atr"))))
    on = F.col("side").isNotNull()
    return out.withColumn("zone_low", F.when(on, F.col("_lo"))).withColumn("zone_high", F.when(on, F.col("_hi"))).drop("_hi", "_lo", "_wide", "_n")


def triple_screen(bars: DataFrame, ema: str = "ema") -> DataFrame:
    """Needs htf_trend, an EMA: with the higher trend and the EMA's slope, a bar that touches the EMA and closes beyond the bar before."""
    out = bars.withColumn("_up", F.col(ema) > lag(ema)).withColumn("_ph", lag("h")).withColumn("_pl", lag("l"))
    long = (F.col("htf_trend") > 0) & F.col("_up") & (F.col("l") <= F.col(ema)) & (F.col("c") > F.col("_ph"))
    short = (F.col("htf_trend") < 0) & ~F.col("_up") & (F.col("h") >= F.col(ema)) & (F.col("c") < F.col("_pl"))
    return out.withColumn("side", _side(long, short)).drop("_up", "_ph", "_pl")


def dual_ema_resumption(bars: DataFrame, fast: str = "fast", slow: str = "slow") -> DataFrame:
    """Fast above slow and rising: a close under the fast EMA, then one above it."""
    out = bars.withColumn("_under", F.col("c") < F.col(fast)).withColumn("_was", lag("_under")).withColumn("_rise", F.col(fast) > lag(fast))
    return out.withColumn("side", F.when((F.col(fast) > F.col(slow)) & F.col("_rise") & F.col("_was") & (F.col("c") > F.col(fast)), "long")).drop("_under", "_was", "_rise")


def ema_ribbon(bars: DataFrame, names: list[str]) -> DataFrame:
    """EMAs from fast to slow: side where they come into order (all falling apart upwards, or downwards)."""
    up = reduce(lambda a, b: a & b, [F.col(a) > F.col(b) for a, b in zip(names, names[1:], strict=False)])
    down = reduce(lambda a, b: a & b, [F.col(a) < F.col(b) for a, b in zip(names, names[1:], strict=False)])
    out = bars.withColumn("ribbon", F.when(up, 1).when(down, -1).otherwise(0)).withColumn("_p", lag("ribbon"))
    return out.withColumn("side", _side((F.col("ribbon") == 1) & (F.col("_p") != 1), (F.col("ribbon") == -1) & (F.col("_p") != -1))).drop("_p")


def range_fake(bars: DataFrame) -> DataFrame:
    """Needs zone_high, zone_low of the bar before: a wick out of the zone and a close back in; target its middle."""
    out = bars.withColumn("_zh", lag("zone_high")).withColumn("_zl", lag("zone_low"))
    out = out.withColumn("side", _side((F.col("l") < F.col("_zl")) & (F.col("c") > F.col("_zl")), (F.col("h") > F.col("_zh")) & (F.col("c") < F.col("_zh"))))
    return out.withColumn("target", F.when(F.col("side").isNotNull(), (F.col("_zh") + F.col("_zl")) / 2)).drop("_zh", "_zl")


def triple_push(bars: DataFrame) -> DataFrame:
    """Needs swings: three rising highs (falling lows), the second step smaller than the first, confirmed on this bar: fade it."""
    w = series().rowsBetween(-120, 0)
    out = bars.withColumn("_hs", F.slice(F.reverse(F.collect_list("swing_high").over(w)), 1, 3)).withColumn("_ls", F.slice(F.reverse(F.collect_list("swing_low").over(w)), 1, 3))
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    steps = lambda c, way: (way * (at(c, 2) - at(c, 3)) > 0) & (way * (at(c, 1) - at(c, 2)) > 0) & (way * (at(c, 1) - at(c, 2)) < way * (at(c, 2) - at(c, 3)))
    short = F.col("swing_high").isNotNull() & steps("_hs", 1)
    long = F.col("swing_low").isNotNull() & steps("_ls", -1)
    return out.withColumn("side", F.when(F.coalesce(short, F.lit(False)), "short").when(F.coalesce(long, F.lit(False)), "long")).drop("_hs", "_ls")


def regime_cross(bars: DataFrame) -> DataFrame:
    """Needs hma, st_trend, vol_ratio: the close crosses the HMA with the Supertrend on more than usual volume."""
    out = bars.withColumn("_d", F.col("c") - F.col("hma")).withColumn("_p", lag("_d"))
    loud = F.col("vol_ratio") > 1
    return out.withColumn("side", _side(loud & (F.col("_d") > 0) & (F.col("_p") <= 0) & (F.col("st_trend") > 0), loud & (F.col("_d") < 0) & (F.col("_p") >= 0) & (F.col("st_trend") < 0))).drop("_d", "_p")


def streak_canary(bars: DataFrame, n: int = 2) -> DataFrame:
    """n bars in a row that close the same way: follow them, once a streak."""
    up = F.sum(F.when(F.col("c") > F.col("o"), 1).otherwise(0)).over(last(n))
    down = F.sum(F.when(F.col("c") < F.col("o"), 1).otherwise(0)).over(last(n))
    out = bars.withColumn("_u", up).withColumn("_d", down).withColumn("_pu", lag("_u")).withColumn("_pd", lag("_d"))
    return out.withColumn("side", _side((F.col("_u") == n) & (F.col("_pu") != n), (F.col("_d") == n) & (F.col("_pd") != n))).drop("_u", "_d", "_pu", "_pd")

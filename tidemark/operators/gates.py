"""Gates: boolean columns that admit a side ("long" or "short" in a column, or a literal) on a bar. Null counts as no.

Each needs the columns that it names. `signals.gated` combines them and counts a funnel.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock
from ..functions.indicators import series

#: Open locations (levels.REFERENCES) that say to sell highs or to buy lows.
HIGHS, LOWS = ("pd_h", "asia_h", "london_h", "overnight_h"), ("pd_l", "asia_l", "london_l", "overnight_l")
#: Pip size by instrument; others have none.
PIPS = {
    "XAUUSD": 0.1, "USDJPY": 0.01, "GBPJPY": 0.01, "LIGHTCMDUSD": 0.01, "BRENTCMDUSD": 0.01, "BTCUSDT": 0.01, "GASCMDUSD": 0.001,
    "AUS200": 1.0, "NAS100": 1.0, "US500": 1.0, "EURUSD": 0.0001, "GBPUSD": 0.0001, "AUDUSD": 0.0001, "EURGBP": 0.0001,
}


def yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def pip_size(symbol: Column) -> Column:
    """Null for an instrument without one, so that money rules fail closed."""
    return F.create_map(*[F.lit(x) for pair in PIPS.items() for x in pair])[symbol]


def stop_distance(entry: Column, stop: Column, least: float, most: float) -> Column:
    """Needs atr: the stop is least to most ATRs away."""
    d = F.abs(entry - stop)
    return yes((F.col("atr") != 0) & (d >= least * F.col("atr")) & (d <= most * F.col("atr")))


def trigger(side: Column) -> Column:
    """Needs candles: a pin or engulfing bar of the side, or an outside bar that closes its way."""
    long = F.col("bull_pin") | F.col("bull_engulf") | (F.col("outside") & (F.col("c") > F.col("o")))
    short = F.col("bear_pin") | F.col("bear_engulf") | (F.col("outside") & (F.col("c") < F.col("o")))
    return yes(F.when(side == "long", long).when(side == "short", short))


def close_location(side: Column) -> Column:
    """Where the close lies in the bar, 1 at the side's own end; 0.5 in a flat bar."""
    span = F.col("h") - F.col("l")
    return F.when(span <= 0, 0.5).when(side == "short", (F.col("h") - F.col("c")) / span).otherwise((F.col("c") - F.col("l")) / span)


def tail_rejection(side: Column) -> Column:
    """The share of the bar that is the tail against the side; 0 in a flat bar."""
    span = F.col("h") - F.col("l")
    tail = F.when(side == "short", F.col("h") - F.greatest("o", "c")).otherwise(F.least("o", "c") - F.col("l"))
    return F.when(span <= 0, 0.0).otherwise(tail / span)


def candle_quality(side: Column, tail: float = 0.0, close: float = 0.0) -> Column:
    return (close_location(side) >= close) & (tail_rejection(side) >= tail)


def _way(side: Column) -> Column:
    return F.when(side == "long", 1).when(side == "short", -1)


def higher_not_against(side: Column) -> Column:
    """Needs htf_trend: flat or the side's own; no (fresh) higher bar: no."""
    return yes((F.col("htf_trend") == 0) | (F.col("htf_trend") == _way(side)))


def higher_agrees(side: Column) -> Column:
    return yes(F.col("htf_trend") == _way(side))


def higher_fades(side: Column) -> Column:
    """For counter-trend setups: flat, or against the side."""
    return yes((F.col("htf_trend") == 0) | (F.col("htf_trend") == -_way(side)))


def movement(most: float) -> Column:
    """Needs er: no more directed movement than that."""
    return F.coalesce(F.col("er"), F.lit(0.0)) <= most


def day_types(allowed: list[str], escape: float) -> Column:
    """Needs regime, er: the regime is allowed, or so little moves that it does not matter."""
    return yes(F.col("regime").isin(*allowed)) | movement(escape)


def range_used(most: float) -> Column:
    """Needs range_used: room is left in the usual range; unknown usage is no room."""
    return yes(F.col("range_used") <= most)


def biased(side: Column) -> Column:
    """Needs bias (shapes.session_bias): the session goes the side's way."""
    return yes(F.col("bias") == F.when(side == "long", "up").when(side == "short", "down"))


def seasonal(side: Column) -> Column:
    """Needs season: the class leans the side's way."""
    return yes(F.when(side == "long", F.col("season").isin("bull", "strong-bull")).when(side == "short", F.col("season").isin("bear", "strong-bear")))


def quiet(most: float) -> Column:
    """Needs rmv: volatility of at most that."""
    return yes(F.col("rmv") <= most)


def microstructure(column: str, most: float) -> Column:
    """A value of at most that; where it is missing the filter does not apply (missing is not zero)."""
    return F.col(column).isNull() | (F.col(column) <= most)


def hours_utc(first: float, end: float) -> Column:
    """From one hour of the UTC day to another, over midnight if the end comes first."""
    h = clock.hour_utc(F.col("t_ms"))
    return (h >= first) & (h < end) if first <= end else (h >= first) | (h < end)


def local_time(hours: list[int], weekdays: list[int]) -> Column:
    """Whole hours and weekdays (0 is Monday) of the local day."""
    return F.floor(clock.hour_local(F.col("t_ms"))).isin(*hours) & clock.weekday_local(F.col("t_ms")).isin(*weekdays)


def day_theme(bars: DataFrame) -> DataFrame:
    """Needs regime, trend_dir (1, -1, 0), open_location, pd_h, pd_l: join_momentum, sell_highs, buy_lows or stand_aside.

    A trend comes first, then where the day opened, then where the close stands in the previous day's range.
    """
    span = F.col("pd_h") - F.col("pd_l")
    at = F.when(span > 0, (F.col("c") - F.col("pd_l")) / span)
    theme = F.when((F.col("regime") == "trending") & (F.col("trend_dir") != 0), "join_momentum").when(F.col("open_location").isin(*HIGHS), "sell_highs").when(F.col("open_location").isin(*LOWS), "buy_lows")
    return bars.withColumn("day_theme", theme.when(at <= 0.38, "buy_lows").when(at >= 0.62, "sell_highs").otherwise("stand_aside"))


def theme_admits(side: Column) -> Column:
    """Needs day_theme, trend_dir: momentum goes with the trend, lows are bought, highs are sold."""
    theme = F.col("day_theme")
    return yes(F.when(theme == "join_momentum", F.col("trend_dir") == _way(side)).when(theme == "buy_lows", side == "long").when(theme == "sell_highs", side == "short"))


def carried(bars: DataFrame, active: Column, columns: list[str]) -> DataFrame:
    """last_<column> of the latest bar on which active held, and last_age: 0 there, then one more each bar; null before any."""
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    out = bars.withColumn("_on", yes(active)).withColumn("_k", F.row_number().over(series()))
    for c in columns:
        out = out.withColumn(f"last_{c}", F.last(F.when(F.col("_on"), F.col(c)), ignorenulls=True).over(so_far))
    at = F.last(F.when(F.col("_on"), F.col("_k")), ignorenulls=True).over(so_far)
    return out.withColumn("last_age", (F.col("_k") - at).cast("int")).drop("_on", "_k")


def newest_zone(bars: DataFrame) -> DataFrame:
    """Needs side, zone_low, zone_high of formations (signals.supply_demand): the newest zone formed before each bar, its age and whether the bar touches it."""
    before = series().rowsBetween(Window.unboundedPreceding, -1)
    k = F.row_number().over(series())
    out = bars.withColumn("_k", k).withColumn("_z", F.when(F.col("side").isNotNull(), F.struct("side", "zone_low", "zone_high", F.col("_k").alias("k"))))
    out = out.withColumn("_z", F.last("_z", ignorenulls=True).over(before))
    touch = (F.col("l") <= F.col("_z.zone_high")) & (F.col("h") >= F.col("_z.zone_low"))
    return out.select(*[c for c in bars.columns if c not in ("side", "zone_low", "zone_high")], F.col("_z.side").alias("side"), F.col("_z.zone_low").alias("zone_low"), F.col("_z.zone_high").alias("zone_high"), (F.col("_k") - F.col("_z.k")).cast("int").alias("zone_age"), touch.alias("touched"))


def first_of(*signals: DataFrame) -> DataFrame:
    """One order for each bar of a series: that of the first of the given signal tables (symbol, t_ms, side) that has one; rank tells which."""
    both = None
    for k, s in enumerate(signals):
        one = s.where("side is not null").select("symbol", "t_ms", "side", F.lit(k).alias("rank"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy("symbol", "t_ms").agg(F.min(F.struct("rank", "side")).alias("x")).select("symbol", "t_ms", "x.rank", "x.side")


def level_names(wanted: Column, include: list[str], exclude: list[str]) -> Column:
    """Candidate level names: those wanted and included, each once, without the excluded ones, in that order."""
    listed = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return F.array_except(F.array_union(wanted, listed(include)), listed(exclude))


def episodes(bars: DataFrame, width: int) -> DataFrame:
    """episode: a number that grows at each hole that no weekend explains; what was unfinished there is dropped. episode_bar counts from 0."""
    gap = F.col("t_ms") - F.lag("t_ms").over(series())
    holed = (gap > width) & ~clock.spans_weekend(F.col("t_ms") - gap + width, F.col("t_ms"))
    out = bars.withColumn("_new", F.coalesce(holed, F.lit(False)).cast("int")).withColumn("episode", F.sum("_new").over(series()))
    return out.withColumn("episode_bar", F.row_number().over(Window.partitionBy("symbol", "episode").orderBy("t_ms")) - 1).drop("_new")


def native_availability(bars: DataFrame) -> DataFrame:
    """available_ms: a bar is known when the next one of its series begins; the last one is not known yet (null)."""
    return bars.withColumn("available_ms", F.lead("t_ms").over(series()))


def frozen_windows(decisions: DataFrame, bars: DataFrame, width: int, n: int, aligned: bool) -> DataFrame:
    """Per decision (symbol, t_ms): OHLC of the n bars that end at or before it, on the bars' own grid or (aligned) the window's.

    status: ok; missing if a slot has no bar; duplicate if one has two. Only an ok window has prices. Slots meet bars on
    equal keys, so there is no range join.
    """
    grid = n * width if aligned else width
    end = F.floor(F.col("t_ms") / grid) * grid
    slots = decisions.select("symbol", "t_ms", end.cast("long").alias("end_ms")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    slots = slots.withColumn("bar_ms", F.col("end_ms") - n * width + F.col("slot") * width)
    b = bars.select("symbol", F.col("t_ms").alias("bar_ms"), *"ohlc")
    got = slots.join(b, ["symbol", "bar_ms"], "left").groupBy("symbol", "t_ms", "end_ms").agg(
        F.count("c").alias("n_bars"), F.countDistinct(F.when(F.col("c").isNotNull(), F.col("slot"))).alias("n_slots"), F.min_by("o", "slot").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "slot").alias("c")
    )
    status = F.when(F.col("n_bars") > F.col("n_slots"), "duplicate").when(F.col("n_slots") < n, "missing").otherwise("ok")
    out = got.withColumn("status", status)
    return out.select("symbol", "t_ms", "end_ms", "status", *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in "ohlc"])


def daily_flush_failure(bars: DataFrame, flush: float = 1.0, location: float = 0.35) -> DataFrame:
    """Needs atr: after a bar that falls by so many ATRs and closes near its low, one that goes lower and closes up and above it. Long; stop under both lows."""
    p = {c: F.lag(c).over(series()) for c in ("o", "h", "l", "c", "atr")}
    span = p["h"] - p["l"]
    where = F.when(span > 0, (p["c"] - p["l"]) / span).otherwise(1.0)
    hit = (p["c"] < p["o"]) & (span >= flush * p["atr"]) & (where <= location) & (F.col("l") < p["l"]) & (F.col("c") > F.col("o")) & (F.col("c") > p["c"])
    return bars.withColumn("side", F.when(yes(hit), "long")).withColumn("stop", F.when(yes(hit), F.least(F.col("l"), p["l"])))


def hour_run_exhaustion(bars: DataFrame, width: int, candles: int, run: int, least: float = 0.5, location: float = 0.5) -> DataFrame:
    """Needs atr: on the last bar of a span of `candles` bars, a run of `run` bars before it, all one way and without holes, of so many ATRs.

    The bar pokes beyond the run's extreme and closes back (its location at most that, seen along the run): fade it.
    """
    lags = {c: [F.lag(c, k).over(series()) for k in range(run, 0, -1)] for c in "ohlc"}
    t = [F.lag("t_ms", k).over(series()) for k in range(run, 0, -1)]
    last = F.pmod(F.col("t_ms"), F.lit(candles * width)) == (candles - 1) * width
    whole = last & (F.col("t_ms") - t[0] == run * width)
    up = down = whole
    for o, c in zip(lags["o"], lags["c"], strict=True):
        up, down = up & (c > o), down & (c < o)
    far = lambda way: way * (lags["c"][-1] - lags["o"][0]) >= least * F.col("atr")
    most, fewest = (F.greatest, F.least) if run > 1 else (lambda x: x, lambda x: x)
    short = up & far(1) & (F.col("h") > most(*lags["h"])) & (close_location(F.lit("long")) <= location)
    long = down & far(-1) & (F.col("l") < fewest(*lags["l"])) & (close_location(F.lit("short")) <= location)
    return bars.withColumn("side", F.when(yes(short), "short").when(yes(long), "long"))

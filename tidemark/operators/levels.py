"""Price levels of days, weeks and sessions, and where bars stand to them."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock
from ..functions.indicators import series
from .asof import asof

def _days():
    return Window.partitionBy("symbol").orderBy("day")


def days(bars: DataFrame, lookback: int = 10, local: bool = False) -> DataFrame:
    """One row a day: o, h, l, c; the previous and second previous observed day; mean range of the last days before."""
    key = clock.day_local if local else clock.day_utc
    out = bars.groupBy("symbol", key(F.col("t_ms")).alias("day")).agg(F.min_by("o", "t_ms").alias("day_o"), F.max("h").alias("day_h"), F.min("l").alias("day_l"), F.max_by("c", "t_ms").alias("day_c"), F.count("*").alias("n_bars"))
    for name, k in (("pd", 1), ("ppd", 2)):
        for c in "ohlc":
            out = out.withColumn(f"{name}_{c}", F.lag(f"day_{c}", k).over(_days()))
    return out.withColumn("avg_range", F.avg(F.col("day_h") - F.col("day_l")).over(_days().rowsBetween(-lookback, -1)))


def camarilla(d: DataFrame) -> DataFrame:
    """Levels about the previous day's close, at 1.1 of its range over 12, 6, 4 and 2."""
    span = (F.col("pd_h") - F.col("pd_l")) * 1.1
    for k, part in enumerate((12, 6, 4, 2), 1):
        d = d.withColumn(f"r{k}", F.col("pd_c") + span / part).withColumn(f"s{k}", F.col("pd_c") - span / part)
    return d


def prior_day_type(d: DataFrame) -> DataFrame:
    """outside, trend, wide, narrow or range: what the previous day was like."""
    span = F.col("pd_h") - F.col("pd_l")
    outside = (F.col("pd_h") > F.col("ppd_h")) & (F.col("pd_l") < F.col("ppd_l"))
    body = F.when(span > 0, F.abs(F.col("pd_c") - F.col("pd_o")) / span).otherwise(0.0)
    usual = F.lag("avg_range").over(_days())
    kind = F.when(outside, "outside").when(body >= 0.45, "trend").when(span >= 1.45 * usual, "wide").when(span <= 0.65 * usual, "narrow").otherwise("range")
    return d.withColumn("prior_day_type", F.when(F.col("pd_h").isNotNull(), kind))


def day_context(bars: DataFrame, lookback: int = 10) -> DataFrame:
    """Bars with the day so far (dev_h, dev_l, day_open, is_new_day), its session VWAP, the levels of the previous days and how much of the usual range is used."""
    bars = bars.withColumn("day", clock.day_utc(F.col("t_ms")))
    w = Window.partitionBy("symbol", "day").orderBy("t_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = bars.withColumn("dev_h", F.max("h").over(w)).withColumn("dev_l", F.min("l").over(w)).withColumn("day_open", F.first("o").over(w)).withColumn("is_new_day", F.count("*").over(w) == 1)
    out = out.withColumn("_cv", F.sum(F.col("c") * F.col("v")).over(w)).withColumn("_v", F.sum("v").over(w))
    out = out.withColumn("vwap", F.when(F.col("_v") > 0, F.col("_cv") / F.col("_v"))).drop("_cv", "_v")
    known = prior_day_type(camarilla(days(bars.drop("day"), lookback))).drop("day_o", "day_h", "day_l", "day_c", "n_bars")
    out = out.join(known, ["symbol", "day"], "left")
    return out.withColumn("range_used", F.when(F.col("avg_range") > 0, (F.col("dev_h") - F.col("dev_l")) / F.col("avg_range")))


def session_runs(bars: DataFrame, name: str) -> DataFrame:
    """One row for each day's session: its first bar, last bar's close time does not count; h, l, o, c, end_ms."""
    a, b = clock.SESSIONS[name]
    rows = bars.where(clock.in_session(F.col("t_ms"), name)).withColumn("day", clock.day_utc(F.col("t_ms")))
    runs = rows.groupBy("symbol", "day").agg(F.min_by("o", "t_ms").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t_ms").alias("c"), F.count("*").alias("n_bars"))
    return runs.withColumn("end_ms", F.col("day") * clock.DAY + b * clock.HOUR)


def prior_session(bars: DataFrame, name: str) -> DataFrame:
    """Bars with o, h, l, c of the last session of that name which has ended."""
    return asof(bars, session_runs(bars, name), ["symbol"], "t_ms", "end_ms", ["o", "h", "l", "c"], prefix=f"{name}_")


def overnight(bars: DataFrame) -> DataFrame:
    """High and low from 20:00 to 08:00 UTC, by the day on which it ends, known from 08:00."""
    shifted = F.col("t_ms") + 4 * clock.HOUR
    rows = bars.where(F.pmod(shifted, F.lit(clock.DAY)) < 12 * clock.HOUR)
    runs = rows.groupBy("symbol", clock.day_utc(shifted).alias("day")).agg(F.max("h").alias("h"), F.min("l").alias("l"), F.count("*").alias("n_bars"))
    return runs.withColumn("end_ms", F.col("day") * clock.DAY + 8 * clock.HOUR)


def prior_week(bars: DataFrame) -> DataFrame:
    """Bars with high and low of the local week before."""
    bars = bars.withColumn("week", clock.week_local(F.col("t_ms")))
    weeks = bars.groupBy("symbol", "week").agg(F.max("h").alias("pw_h"), F.min("l").alias("pw_l")).withColumn("week", F.col("week") + 1)
    return bars.join(weeks, ["symbol", "week"], "left")


#: The order in which references win a tie.
REFERENCES = ("pd_h", "pd_l", "pd_c", "pd_o", "r3", "r4", "s3", "s4", "r1", "r2", "s1", "s2")


def open_location(bars: DataFrame, tolerance: float = 0.65) -> DataFrame:
    """Needs day_context and atr: the reference nearest to the day's open, within tolerance ATRs; else null."""
    near = [F.struct((F.abs(F.col("day_open") - F.col(c)) / F.col("atr")).alias("d"), F.lit(k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(REFERENCES)]
    best = F.array_min(F.filter(F.array(*near), lambda x: x["d"].isNotNull() & (x["d"] <= tolerance)))
    return bars.withColumn("open_location", F.when(F.col("atr") > 0, best["name"]))


def level_priority(side: str, names: list[str], tolerance: float) -> Column:
    """Name of the first level, in the given order, within tolerance ATRs of the bar's low (long) or high (short)."""
    price = F.col("l") if side == "long" else F.col("h")
    return F.coalesce(*[F.when(F.abs(price - F.col(n)) <= tolerance * F.col("atr"), F.lit(n)) for n in names])


def clock_ranges(bars: DataFrame, start_hour: float, end_hour: float, width: int, least: float = 0.9) -> DataFrame:
    """Per day: high and low between two UTC hours, if at least that share of its bars is there and the range is not flat."""
    hour = clock.hour_utc(F.col("t_ms"))
    rows = bars.where((hour >= start_hour) & (hour < end_hour))
    want = (end_hour - start_hour) * clock.HOUR / width
    out = rows.groupBy("symbol", clock.day_utc(F.col("t_ms")).alias("day")).agg(F.max("h").alias("h"), F.min("l").alias("l"), F.count("*").alias("n_bars"))
    status = F.when(F.col("n_bars") < least * want, "rejected-coverage").when(F.col("h") <= F.col("l"), "rejected-flat").otherwise("accepted")
    return out.withColumn("status", status)


def developing(bars: DataFrame, column: str) -> DataFrame:
    return bars.withColumn(f"last_{column}", F.last(column, ignorenulls=True).over(series()))

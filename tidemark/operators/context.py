"""What higher bars and calendars say about a bar: bias, snapshots, extremes, scheduled trades, slot statistics."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock, indicators as ind
from .asof import asof


def _closing(higher: DataFrame, higher_width: int) -> DataFrame:
    return higher.withColumn("htf_close", F.col("t_ms") + higher_width)


def higher_bias(bars: DataFrame, higher: DataFrame, width: int, higher_width: int, back: int = 24, share: float = 0.5) -> DataFrame:
    """htf_bias: 1 or -1 if the latest closed higher bar's close lies share ATRs from that `back` bars before; else 0, null before so many bars."""
    h = ind.atr(_closing(higher, higher_width)).withColumn("_d", F.col("c") - ind.lag("c", back))
    bias = F.when(F.col("_d") >= share * F.col("atr"), 1).when(F.col("_d") <= -share * F.col("atr"), -1).when(F.col("_d").isNotNull(), 0)
    out = asof(bars.withColumn("t_close", F.col("t_ms") + width), h.withColumn("htf_bias", bias), ["symbol"], "t_close", "htf_close", ["htf_bias"])
    return out.drop("t_close")


def snapshots(bars: DataFrame, higher: DataFrame, width: int, higher_width: int) -> DataFrame:
    """Close of the latest higher bar that has closed by the bar's close (historical_c), and by its open (stable_c)."""
    h = _closing(higher, higher_width)
    out = asof(bars.withColumn("t_close", F.col("t_ms") + width), h, ["symbol"], "t_close", "htf_close", ["c"], prefix="historical_")
    return asof(out.drop("t_close"), h, ["symbol"], "t_ms", "htf_close", ["c"], prefix="stable_")


def higher_extremes(bars: DataFrame, higher: DataFrame, width: int, higher_width: int, n: int = 12) -> DataFrame:
    """Highest high and lowest low of the last n higher bars that have closed by the bar's close: top, bottom."""
    h = _closing(higher, higher_width).withColumn("top", F.max("h").over(ind.last(n))).withColumn("bottom", F.min("l").over(ind.last(n)))
    return asof(bars.withColumn("t_close", F.col("t_ms") + width), h, ["symbol"], "t_close", "htf_close", ["top", "bottom"]).drop("t_close")


def scheduled_trades(bars: DataFrame, calendar: DataFrame, distance: float) -> DataFrame:
    """calendar (symbol, entry_t, exit_t, side): in at the open of the bar at entry_t, out at the open of the one at exit_t.

    A stop at distance from the entry goes first; a bar that opens beyond it leaves at that open. Missing bars give a
    status instead. Trades are cut to the days that they touch, so the join is on equal keys.
    """
    at = lambda t, p: bars.select("symbol", F.col("t_ms").alias(t), F.col("o").alias(p))
    way = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    t = calendar.join(at("entry_t", "entry"), ["symbol", "entry_t"], "left").join(at("exit_t", "due"), ["symbol", "exit_t"], "left")
    t = t.withColumn("stop", F.col("entry") - way * distance)
    days = F.sequence(clock.day_utc(F.col("entry_t")), clock.day_utc(F.col("exit_t")))
    later = bars.select("symbol", clock.day_utc(F.col("t_ms")).alias("_day"), F.col("t_ms").alias("_t"), F.col("o").alias("_o"), F.col("h").alias("_h"), F.col("l").alias("_l"))
    met = t.where("entry is not null and due is not null").withColumn("_day", F.explode(days)).join(later, ["symbol", "_day"]).where("_t >= entry_t and _t < exit_t")
    hit = F.when(F.col("side") == "long", F.col("_l") <= F.col("stop")).otherwise(F.col("_h") >= F.col("stop"))
    gap = (F.col("_t") > F.col("entry_t")) & F.when(F.col("side") == "long", F.col("_o") <= F.col("stop")).otherwise(F.col("_o") >= F.col("stop"))
    price = F.when(gap, F.col("_o")).otherwise(F.col("stop"))
    stopped = met.where(hit).groupBy("symbol", "entry_t", "side").agg(F.min("_t").alias("stop_t"), F.min_by(price, "_t").alias("stop_price"))
    out = t.join(stopped, ["symbol", "entry_t", "side"], "left")
    status = F.when(F.col("entry").isNull(), "missing-entry").when(F.col("due").isNull(), "missing-exit").when(F.col("stop_t").isNotNull(), "stopped").otherwise("held")
    return out.withColumn("status", status).withColumn("exit", F.when(F.col("status") == "stopped", F.col("stop_price")).when(F.col("status") == "held", F.col("due"))).withColumn("points", way * (F.col("exit") - F.col("entry")))


def slot_median(bars: DataFrame, value: Column, slot: Column, n: int = 20) -> DataFrame:
    """slot_median: median of value in the last n bars of the same slot before this one."""
    w = Window.partitionBy("symbol", "_slot").orderBy("t_ms").rowsBetween(-n, -1)
    return bars.withColumn("_slot", slot).withColumn("_v", value).withColumn("slot_median", F.percentile("_v", 0.5).over(w)).drop("_slot", "_v")


def parkinson(bars: DataFrame, keep: float = 0.94) -> DataFrame:
    """range_var: exponentially weighted variance from high-low ranges, seeded with the first."""

    def make(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = np.log(x["h"] / x["l"]) ** 2 / (4 * np.log(2))
        for i in range(1, len(out)):
            out[i] = keep * out[i - 1] + (1 - keep) * out[i]
        return {"range_var": out}

    return ind.fold(bars, make, "range_var")


def ema_product(bars: DataFrame, n: int, name: str = "ema") -> DataFrame:
    """The EMA as a sum of two products (its last digits differ from those of indicators.ema)."""

    def make(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        k, out = 2 / (n + 1), np.array(x["c"], float)
        for i in range(1, len(out)):
            out[i] = out[i] * k + out[i - 1] * (1 - k)
        return {name: out}

    return ind.fold(bars, make, name)

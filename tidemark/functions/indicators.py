"""Indicators of bar series. Each takes bars and returns them with one or more columns more.

Moving frames are window functions over (symbol, t_ms): after one shuffle by symbol, all of them share it. Recurrences
(EMA, Wilder, PSAR, Supertrend) are ordered folds: a short numpy loop on one series at a time, Arrow in and out.
Null is "not yet known".
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

def series() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("t_ms")


def last(n: int, skip: int = 0) -> WindowSpec:
    """The last n rows, this one included unless skipped."""
    return series().rowsBetween(-(n - 1) - skip, -skip)


def full(n: int, value: Column, column: str = "c", skip: int = 0) -> Column:
    """value where n rows are there."""
    return F.when(F.count(column).over(last(n, skip)) == n, value)


def lag(column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(series())


def indexed(bars: DataFrame) -> DataFrame:
    """With i, the number of the bar in its series, from 0."""
    return bars.withColumn("i", F.row_number().over(series()) - 1)


def true_range(bars: DataFrame) -> DataFrame:
    before = F.coalesce(lag("c"), F.col("c"))
    return bars.withColumn("tr", F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Simple mean of the true range; of what there is, before n bars."""
    return true_range(bars).withColumn("atr", F.avg("tr").over(last(n)))


def atr_full(bars: DataFrame, n: int = 14) -> DataFrame:
    return true_range(bars).withColumn("atr_full", full(n, F.avg("tr").over(last(n))))


def relative_volatility(bars: DataFrame, n: int = 14, lookback: int = 20) -> DataFrame:
    """100 (ATR - least) / (most - least) over lookback bars; null when flat or too early."""
    low, high = F.min("atr").over(last(lookback)), F.max("atr").over(last(lookback))
    out = indexed(atr(bars, n)).withColumn("_low", low).withColumn("_high", high)
    value = F.when((F.col("i") >= n + lookback - 2) & (F.col("_high") > F.col("_low")), 100 * (F.col("atr") - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return out.withColumn("rmv", value).drop("_low", "_high", "i")


def efficiency(bars: DataFrame, n: int = 10) -> DataFrame:
    """er: net change over the sum of changes; er_tr: over the sum of true ranges; 0 before n bars."""
    out = indexed(true_range(bars)).withColumn("_d", F.abs(F.col("c") - lag("c"))).withColumn("_net", F.abs(F.col("c") - lag("c", n)))
    out = out.withColumn("_path", F.sum("_d").over(last(n))).withColumn("_tr", F.sum("tr").over(last(n)))
    ratio = lambda below: F.when((F.col("i") >= n) & (F.col(below) > 0), F.col("_net") / F.col(below)).otherwise(0.0)
    return out.withColumn("er", ratio("_path")).withColumn("er_tr", ratio("_tr")).drop("_d", "_net", "_path", "_tr", "i")


def slope(bars: DataFrame, column: str = "c", n: int = 5) -> DataFrame:
    return bars.withColumn("slope", F.col(column) - lag(column, n))


def sma(bars: DataFrame, n: int, name: str = "sma") -> DataFrame:
    return bars.withColumn(name, full(n, F.avg("c").over(last(n))))


def wma_of(column: str, n: int) -> Column:
    """Weighted mean of the last n values, the newest with weight n."""
    total = None
    for k in range(n):
        part = F.lag(column, k).over(series()) * (n - k)
        total = part if total is None else total + part
    return total / (n * (n + 1) / 2)


def hma(bars: DataFrame, n: int = 9) -> DataFrame:
    """WMA, over about sqrt(n) bars, of twice the WMA of n/2 bars less the WMA of n bars."""
    root = int(np.floor(np.sqrt(n) + 0.5))
    out = bars.withColumn("_raw", 2 * wma_of("c", n // 2) - wma_of("c", n))
    return out.withColumn("wma", wma_of("c", n)).withColumn("hma", wma_of("_raw", root)).drop("_raw")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    out = bars.withColumn("bb_mid", full(n, F.avg("c").over(last(n)))).withColumn("_sd", full(n, F.stddev_pop("c").over(last(n))))
    return out.withColumn("bb_high", F.col("bb_mid") + k * F.col("_sd")).withColumn("bb_low", F.col("bb_mid") - k * F.col("_sd")).drop("_sd")


def choppiness(bars: DataFrame, n: int = 14) -> DataFrame:
    out = true_range(bars).withColumn("_sum", F.sum("tr").over(last(n))).withColumn("_high", F.max("h").over(last(n))).withColumn("_low", F.min("l").over(last(n)))
    span = F.col("_high") - F.col("_low")
    return out.withColumn("chop", full(n, F.when(span > 0, 100 * F.log10(F.col("_sum") / span) / float(np.log10(n))))).drop("_sum", "_high", "_low")


def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    """Highest high and lowest low of the n bars before this one."""
    return bars.withColumn("dc_high", full(n, F.max("h").over(last(n, 1)), skip=1)).withColumn("dc_low", full(n, F.min("l").over(last(n, 1)), skip=1))


def recent_extremes(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("recent_high", F.max("h").over(last(n))).withColumn("recent_low", F.min("l").over(last(n)))


def rate_of_change(bars: DataFrame, n: int) -> DataFrame:
    before = lag("c", n)
    return bars.withColumn("roc", F.when(before != 0, 100 * (F.col("c") / before - 1)))


def volume_stats(bars: DataFrame, n: int = 20, m: int = 50) -> DataFrame:
    """Mean volume of the n bars before, this one's ratio to it, and its z-score among the m before; bars without a valid volume do not count."""
    valid = F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") >= 0)
    good = bars.where(valid)
    good = good.withColumn("vol_sma", full(n, F.avg("v").over(last(n, 1)), "v", 1))
    good = good.withColumn("_n", F.count("v").over(last(m, 1))).withColumn("_mean", F.avg("v").over(last(m, 1))).withColumn("_sd", F.stddev_pop("v").over(last(m, 1)))
    z = F.when(F.col("_n") >= 2, F.when(F.col("_sd") > 0, (F.col("v") - F.col("_mean")) / F.col("_sd")).otherwise(0.0))
    good = good.withColumn("vol_ratio", F.when(F.col("vol_sma") > 0, F.col("v") / F.col("vol_sma"))).withColumn("vol_z", z).drop("_n", "_mean", "_sd")
    rest = bars.where(~valid)
    for c in ("vol_sma", "vol_ratio", "vol_z"):
        rest = rest.withColumn(c, F.lit(None).cast("double"))
    return good.unionByName(rest)


def effort(bars: DataFrame) -> DataFrame:
    """Needs atr and vol_ratio: spread and body in ATRs, volume ratio for each ATR of spread."""
    spread = F.when(F.col("atr") > 0, (F.col("h") - F.col("l")) / F.col("atr"))
    out = bars.withColumn("spread_atr", spread).withColumn("body_atr", F.when(F.col("atr") > 0, F.abs(F.col("c") - F.col("o")) / F.col("atr")))
    return out.withColumn("effort", F.col("vol_ratio") / F.greatest(F.col("spread_atr"), F.lit(0.1)))


def setup_counter(bars: DataFrame, back: int = 4) -> DataFrame:
    """Run length of closes above (+) or below (-) the close `back` bars before; equal resets to 0; wraps as a signed byte."""
    sign = F.coalesce(F.signum(F.col("c") - lag("c", back)).cast("int"), F.lit(0))
    out = bars.withColumn("_s", sign)
    out = out.withColumn("_new", (F.col("_s") != F.coalesce(lag("_s"), F.lit(0))).cast("int")).withColumn("_run", F.sum("_new").over(series()))
    run = F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("t_ms")) * F.col("_s")
    return out.withColumn("counter", F.pmod(run + 128, F.lit(256)).cast("int") - 128).drop("_s", "_new", "_run")


def fold(bars: DataFrame, make: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], *names: str) -> DataFrame:
    """bars with what make returns for one series, in time order; names are its columns (doubles, NaN is null)."""
    columns = bars.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t_ms")
        made = make({c: table.column(c).to_numpy() for c in ("o", "h", "l", "c", "atr") if c in columns})
        for n in names:
            table = table.append_column(n, pa.array(made[n], from_pandas=True))
        return table

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema] + [f"{n} double" for n in names])
    return bars.groupBy("symbol").applyInArrow(run, kinds)


def ema_of(x: np.ndarray, n: int) -> np.ndarray:
    """Seeded with the first value."""
    k, out = 2 / (n + 1), np.array(x, float)
    for i in range(1, len(out)):
        out[i] = out[i - 1] + k * (out[i] - out[i - 1])
    return out


def rma_of(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean: seeded with the mean of the first n finite values; null before."""
    out, seen, total, value = np.full(len(x), np.nan), 0, 0.0, 0.0
    for i, v in enumerate(x):
        if np.isfinite(v):
            seen += 1
            if seen <= n:
                total += v
                value = total / n
            else:
                value = (value * (n - 1) + v) / n
        out[i] = value if seen >= n else np.nan
    return out


def _true_range(x: dict[str, np.ndarray]) -> np.ndarray:
    before = np.concatenate([x["c"][:1], x["c"][:-1]])
    return np.maximum(x["h"] - x["l"], np.maximum(np.abs(x["h"] - before), np.abs(x["l"] - before)))


def ema(bars: DataFrame, n: int, name: str = "ema") -> DataFrame:
    return fold(bars, lambda x: {name: ema_of(x["c"], n)}, name)


def wilder_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return fold(bars, lambda x: {"wilder_atr": rma_of(_true_range(x), n)}, "wilder_atr")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """From Wilder's means of ups and downs; null while both are zero."""

    def make(x):
        d = np.diff(x["c"], prepend=np.nan)
        up, down = rma_of(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n), rma_of(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            return {"rsi": np.where(up + down > 0, 100 * up / (up + down), np.nan)}

    return fold(bars, make, "rsi")


def keltner(bars: DataFrame, n: int = 20, k: float = 1.5, m: int = 14) -> DataFrame:
    """Bands of k ATR (simple, m bars) about the EMA; null for the first 2 n bars."""

    def make(x):
        mid, tr = ema_of(x["c"], n), _true_range(x)
        sums = np.concatenate([[0], np.cumsum(tr)])
        i = np.arange(len(tr))
        a = (sums[i + 1] - sums[np.maximum(i + 1 - m, 0)]) / np.minimum(i + 1, m)
        early = i < 2 * n
        return {"kc_mid": np.where(early, np.nan, mid), "kc_high": np.where(early, np.nan, mid + k * a), "kc_low": np.where(early, np.nan, mid - k * a)}

    return fold(bars, make, "kc_mid", "kc_high", "kc_low")


def supertrend(bars: DataFrame, n: int = 10, factor: float = 3.0) -> DataFrame:
    """Bands of factor Wilder ATRs about the middle that only tighten; the trend flips when the close passes one."""

    def make(x):
        a, mid = rma_of(_true_range(x), n), (x["h"] + x["l"]) / 2
        line, trend = np.full(len(mid), np.nan), np.full(len(mid), np.nan)
        up = down = np.nan
        way = 1.0
        for i in range(len(mid)):
            if np.isnan(a[i]):
                continue
            high, low = mid[i] + factor * a[i], mid[i] - factor * a[i]
            if not np.isnan(up):
                high = high if high < up or x["c"][i - 1] > up else up
                low = low if low > down or x["c"][i - 1] < down else down
                way = 1.0 if x["c"][i] > up and way < 0 else -1.0 if x["c"][i] < down and way > 0 else way
            up, down = high, low
            line[i], trend[i] = (low if way > 0 else high), way
        return {"supertrend": line, "st_trend": trend}

    return fold(bars, make, "supertrend", "st_trend")


def parabolic_sar(bars: DataFrame, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """Stop and reverse: follows the extreme by a growing factor, flips when a bar passes it."""

    def make(x):
        h, low, c = x["h"], x["l"], x["c"]
        n = len(c)
        sar, trend, flip = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
        way, value, extreme, factor = 1, 0.0, 0.0, start
        for i in range(1, n):
            turned = False
            if i == 1:
                way = 1 if c[1] >= c[0] else -1
                value, extreme = (low[0], h[1]) if way > 0 else (h[0], low[1])
            else:
                value += factor * (extreme - value)
                value = min(value, low[i - 1], low[i - 2]) if way > 0 else max(value, h[i - 1], h[i - 2])
                turned = low[i] < value if way > 0 else h[i] > value
                if turned:
                    way, value, factor = -way, extreme, start
                    extreme = h[i] if way > 0 else low[i]
                elif (h[i] > extreme) if way > 0 else (low[i] < extreme):
                    extreme, factor = (h[i] if way > 0 else low[i]), min(most, factor + step)
            sar[i], trend[i], flip[i] = value, way, float(turned)
        return {"sar": sar, "sar_trend": trend, "sar_flip": flip}

    return fold(bars, make, "sar", "sar_trend", "sar_flip")


def directional(bars: DataFrame, n: int = 14) -> DataFrame:
    """ADX: Wilder's mean of DX, from Wilder's means of directional moves."""

    def make(x):
        up, down = np.diff(x["h"], prepend=np.nan), -np.diff(x["l"], prepend=np.nan)
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        plus[:1], minus[:1] = np.nan, np.nan
        p, m = rma_of(plus, n), rma_of(minus, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            dx = np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), np.where(np.isnan(p), np.nan, 0.0))
        return {"dx": dx, "adx": rma_of(dx, n)}

    return fold(bars, make, "dx", "adx")

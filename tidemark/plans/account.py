"""Accounts over time: equity marked on each bar, by day and by month, and resampled blocks of days."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import clock


def marked(bars: DataFrame, trades: DataFrame, start: float = 10_000.0) -> DataFrame:
    """Per bar: realized and open profit of one-position trades, equity and drawdown from its peak (share).

    bars: symbol, i, t_ms, c; trades: symbol, entry_i, entry, exit_i, exit, side, pnl. Entries and exits are stacked with
    the bars and carried along, so no range join is needed.
    """
    way = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    none = F.lit(None).cast("double")
    # A trade that leaves on the bar of its entry is open at no mark; only its exit counts.
    ins = trades.where("entry_i < exit_i").select("symbol", F.col("entry_i").cast("long").alias("i"), F.lit(0).alias("_k"), F.col("entry").alias("_e"), way.alias("_w"), F.lit(0.0).alias("_p"), none.alias("c"), F.lit(None).cast("long").alias("t_ms"))
    outs = trades.select("symbol", F.col("exit_i").cast("long").alias("i"), F.lit(1).alias("_k"), none.alias("_e"), F.lit(0.0).alias("_w"), F.col("pnl").alias("_p"), none.alias("c"), F.lit(None).cast("long").alias("t_ms"))
    rows = bars.select("symbol", F.col("i").cast("long").alias("i"), F.lit(2).alias("_k"), none.alias("_e"), F.lit(None).cast("double").alias("_w"), F.lit(0.0).alias("_p"), "c", "t_ms")
    # An exit at a bar comes before an entry there.
    order = F.when(F.col("_k") == 1, 0).when(F.col("_k") == 0, 1).otherwise(2)
    w = Window.partitionBy("symbol").orderBy("i", order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(ins).unionByName(outs)
    out = out.withColumn("realized", F.sum("_p").over(w)).withColumn("_way", F.coalesce(F.last("_w", True).over(w), F.lit(0.0))).withColumn("_at", F.last("_e", True).over(w)).where("_k = 2")
    out = out.withColumn("open_profit", F.when(F.col("_way") != 0, F.col("_way") * (F.col("c") - F.col("_at"))).otherwise(0.0))
    out = out.withColumn("equity", start + F.col("realized") + F.col("open_profit"))
    peak = F.greatest(F.lit(start), F.max("equity").over(Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("peak", peak).select("symbol", "i", "t_ms", "realized", "open_profit", "equity", ((F.col("peak") - F.col("equity")) / F.col("peak")).alias("drawdown"))


def monthly(trades: DataFrame, by: list[str]) -> DataFrame:
    month = F.date_format(F.timestamp_millis(F.col("entry_t")), "yyyy-MM")
    return trades.groupBy(*by, month.alias("month")).agg(F.count("*").alias("trades"), F.sum((F.col("pnl") > 0).cast("long")).alias("wins"), F.sum("pnl").alias("net"))


def daily(trades: DataFrame, by: list[str], start: float = 10_000.0) -> DataFrame:
    """Net by day of exit, equity at its end, its return on the day before, and the fall from the peak so far (share)."""
    days = trades.groupBy(*by, clock.day_utc(F.col("exit_t")).alias("day")).agg(F.sum("pnl").alias("net"))
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumn("equity", start + F.sum("net").over(w)).withColumn("growth", F.col("net") / (F.col("equity") - F.col("net")))
    out = out.withColumn("_peak", F.greatest(F.lit(start), F.max("equity").over(w)))
    return out.withColumn("drawdown", (F.col("_peak") - F.col("equity")) / F.col("_peak")).drop("_peak")


def block_bootstrap(days: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """Total growth of resampled histories: days (day_no, growth) met by a matrix of block starts (replicate, piece, start).

    The matrix is an input, so that several streams can share it and runs can be repeated anywhere.
    """
    picks = starts.withColumn("day_no", F.explode(F.sequence(F.col("start"), F.col("start") + block - 1)))
    return picks.join(days, "day_no").groupBy("replicate").agg(F.count("*").alias("days"), (F.exp(F.sum(F.log1p("growth"))) - 1).alias("total"))


def paired(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Differences of two streams, replicate by replicate."""
    return a.select("replicate", F.col(value).alias("a")).join(b.select("replicate", F.col(value).alias("b")), "replicate").withColumn("difference", F.col("a") - F.col("b"))

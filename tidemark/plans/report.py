"""Summaries of trades: cost rows, groupings, holdout, drawdown, Monte Carlo, quantiles and overfit checks."""

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock

START = 10_000.0
#: Milliseconds of a block of trades that one task puts in order.
BLOCK = 30 * clock.DAY


def _blocks(trades: DataFrame) -> Column:
    """Blocks of time in which trades are put in order apart."""
    return F.floor(F.col("entry_t") / BLOCK).alias("_block")


def equity(trades: DataFrame, by: list[str], start: float = START) -> DataFrame:
    """trades with equity and its peak so far (start included), by entry_t, then symbol and entry_i.

    Each block of time is summed apart and the blocks' sums and peaks are carried along, a row for each block, so that
    one label's trades are spread over tasks.
    """
    trades = trades.withColumn("_block", _blocks(trades))
    w = Window.partitionBy(*by, "_block").orderBy("entry_t", "symbol", "entry_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("_sum", F.sum("pnl").over(w)).withColumn("_top", F.max("_sum").over(w))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, "_block").agg(F.sum("pnl").alias("_all"), F.max("_top").alias("_most"))
    ends = ends.withColumn("_base", F.lit(start) + F.coalesce(F.sum("_all").over(before), F.lit(0.0)))
    ends = ends.withColumn("_peak0", F.greatest(F.lit(start), F.max(F.col("_base") + F.col("_most")).over(before))).select(*[F.col(c).alias(f"_of_{c}") for c in (*by, "_block")], "_base", "_peak0")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, "_block")])
    own = [c for c in trades.columns if c != "_block"]
    return rows.join(ends, same).select(*own, (F.col("_base") + F.col("_sum")).alias("equity"), F.greatest("_peak0", F.col("_base") + F.col("_top")).alias("peak"))


def numbered(trades: DataFrame) -> DataFrame:
    """trades with number, from 0 by entry_t, symbol and entry_i: by blocks of time, so that no task holds them all."""
    rows = trades.withColumn("_block", _blocks(trades))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_block").orderBy("entry_t", "symbol", "entry_i")) - 1)
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(sizes, "_block").withColumn("number", F.col("_first") + F.col("_k")).drop("_block", "_k", "_first")


def cost_rows(trades: DataFrame, by: list[str], start: float = START) -> DataFrame:
    """trades, win_rate (%), profit_factor (null without a loss, 0 without trades won or lost), net, expectancy, drawdown (% of the final peak)."""
    win, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") > 0, 0.0).otherwise(F.abs("pnl")))
    out = equity(trades, by, start).groupBy(*by).agg(
        F.count("*").alias("trades"), (100.0 * F.sum((F.col("pnl") > 0).cast("int")) / F.count("*")).alias("win_rate"), win.alias("_win"), loss.alias("_loss"),
        F.max(F.col("peak") - F.col("equity")).alias("_dd"), F.max("peak").alias("_peak"),
    )
    factor = F.when(F.col("_loss") > 0, F.col("_win") / F.col("_loss")).when(F.col("_win") > 0, F.lit(None)).otherwise(0.0)
    out = out.withColumn("profit_factor", factor).withColumn("net", F.col("_win") - F.col("_loss")).withColumn("expectancy", F.col("net") / F.col("trades"))
    return out.withColumn("drawdown", F.when(F.col("_peak") > 0, 100 * F.col("_dd") / F.col("_peak")).otherwise(0.0)).drop("_win", "_loss", "_dd", "_peak")


def groupings(trades: DataFrame) -> DataFrame:
    """Trades by session phase of the entry, side, exit reason and year, each on its own: one pass over grouping sets."""
    rows = trades.withColumn("session", clock.session_phase(F.col("entry_t"))).withColumn("year", F.year(F.timestamp_millis(F.col("entry_t"))))
    sets = [["session"], ["side"], ["reason"], ["year"]]
    keys = ["session", "side", "reason", "year"]
    out = rows.groupingSets(sets, *keys).agg(F.count("*").alias("trades"), F.sum("pnl").alias("net"), F.sum((F.col("pnl") > 0).cast("long")).alias("wins"), *[F.grouping(k).alias(f"g_{k}") for k in keys])
    name = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.lit(k)) for k in keys])
    value = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.col(k).cast("string")) for k in keys])
    return out.select(name.alias("grouping"), value.alias("value"), "trades", "wins", "net")


def holdout(trades: DataFrame, from_ms: int) -> DataFrame:
    """Cost rows before and from a time on, each with an account of its own."""
    return cost_rows(trades.withColumn("part", F.when(F.col("entry_t") >= from_ms, "holdout").otherwise("train")), ["part"])


def previous_outcome(trades: DataFrame, by: list[str]) -> DataFrame:
    before = F.lag("pnl").over(Window.partitionBy(*by).orderBy("entry_t", "entry_i"))
    return trades.withColumn("after", F.when(before.isNull(), "first").when(before > 0, "after-win").otherwise("after-loss"))


def drawdown(trades: DataFrame, by: list[str], start: float = START) -> DataFrame:
    """Largest fall as a share of the peak at that time, streaks and mean bars held."""
    w = Window.partitionBy(*by).orderBy("entry_t", "symbol", "entry_i")
    out = equity(trades, by, start).withColumn("_won", (F.col("pnl") > 0).cast("int"))
    out = out.withColumn("_turn", (F.col("_won") != F.coalesce(F.lag("_won").over(w), F.lit(-1))).cast("int")).withColumn("_streak", F.sum("_turn").over(w))
    out = out.withColumn("_len", F.count("*").over(Window.partitionBy(*by, "_streak")))
    return out.groupBy(*by).agg(
        F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("max_drawdown"), F.max(F.when(F.col("_won") == 1, F.col("_len")).otherwise(0)).alias("win_streak"),
        F.max(F.when(F.col("_won") == 0, F.col("_len")).otherwise(0)).alias("loss_streak"), F.avg(F.col("exit_i") - F.col("entry_i")).alias("avg_bars"),
    )


def ranked(df: DataFrame, by: list[str], column: str, quantiles: list[float], how: str = "nearest") -> DataFrame:
    """Elements of the sorted column at round(q (n - 1)), ceil(q n) - 1 or floor(q (n - 1)): q_<percent>. No list is gathered: rows are numbered."""
    w = Window.partitionBy(*by)
    rows = df.where(F.col(column).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(column)) - 1).withColumn("_n", F.count("*").over(w))
    place = {"nearest": lambda q: F.floor(q * (F.col("_n") - 1) + 0.5), "ceil": lambda q: F.ceil(q * F.col("_n")) - 1, "floor": lambda q: F.floor(q * (F.col("_n") - 1))}[how]
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("_r") == place(F.lit(q)), F.col(column))).alias(f"q_{round(100 * q)}") for q in quantiles])


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of a share, within 0 and 1."""
    p = wins / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def bits(iteration: Column, k: Column, seed: int) -> Column:
    """The first 32 bits of an MD5: the same in any engine, and in a repeated task."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), iteration.cast("string"), k.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def resample_trades(trades: DataFrame, iterations: int, seed: int, start: float = START) -> DataFrame:
    """Per iteration: drawdown of the trades in a random order (order_dd), and drawdown and net of as many drawn with replacement.

    Draws are rows (iteration, k) that meet the trades by number, so nothing passes through the driver. An iteration's
    path is one ordered window; iterations are spread over tasks.
    """
    t = numbered(trades.where("pnl is not null")).select("number", "pnl")
    n = t.agg(F.count("*").alias("n"))
    runs = trades.sparkSession.range(iterations).select(F.col("id").alias("iteration"))
    drawn = runs.crossJoin(F.broadcast(n)).where("n > 0").select("iteration", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    drawn = drawn.select("iteration", "k", F.floor(bits(F.col("iteration"), F.col("k"), seed).cast("double") * F.col("n") / 2.0**32).cast("long").alias("number"), bits(F.col("iteration"), F.col("k"), seed + 1).alias("_at"))
    both = drawn.join(t.select(F.col("number").alias("k"), F.col("pnl").alias("_own")), "k").join(t, "number")
    falls = {}
    for name, value, order in (("order_dd", "_own", ["_at", "k"]), ("bootstrap_dd", "pnl", ["k"])):
        w = Window.partitionBy("iteration").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn(f"_e_{name}", start + F.sum(value).over(w)).withColumn(f"_p_{name}", F.greatest(F.lit(start), F.max(f"_e_{name}").over(w)))
        falls[name] = F.max((F.col(f"_p_{name}") - F.col(f"_e_{name}")) / F.col(f"_p_{name}")).alias(name)
    out = both.groupBy("iteration").agg(*falls.values(), F.sum("pnl").alias("bootstrap_net"))
    return runs.join(out, "iteration", "left").select("iteration", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("order_dd", "bootstrap_dd", "bootstrap_net")])


def yearly(trades: DataFrame, by: list[str]) -> DataFrame:
    """Net, trades and share of all gains of each year, and warnings: thin (under 30 trades), concentrated (over half of all gains), losing."""
    rows = trades.withColumn("year", F.year(F.timestamp_millis(F.col("entry_t"))))
    gain = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0))
    out = rows.groupBy(*by, "year").agg(F.count("*").alias("trades"), F.sum("pnl").alias("net"), gain.alias("gains"))
    out = out.withColumn("share", F.col("gains") / F.sum("gains").over(Window.partitionBy(*by)))
    return out.withColumn("thin", F.col("trades") < 30).withColumn("concentrated", F.col("share") > 0.5).withColumn("losing", F.col("net") < 0).drop("gains")


def grid(spark, **values: list) -> DataFrame:
    """All combinations of the parameters: variant, and a column for each."""
    out = None
    for name, xs in values.items():
        one = spark.createDataFrame([(x,) for x in xs], [name])
        out = one if out is None else out.crossJoin(one)
    return out.withColumn("variant", F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in values]))


def fifteen_digits(x: pd.Series) -> pd.Series:
    """Rounded to 15 significant digits; what is not finite becomes 0."""
    return x.map(lambda v: float(f"{v:.15g}") if math.isfinite(v) else 0.0)


def signal_id(strategy: str, version: int, t: str = "entry_t") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(strategy), F.lit(str(version)), "symbol", F.col(t).cast("string"), "side"), 256)


def selected(rows: DataFrame, key: str, baseline: str, least: int) -> DataFrame:
    """Cost rows with eligible (trades enough, no more drawdown than the baseline's row) and chosen: the best net among them, ties to the first key."""
    base = rows.where(F.col(key) == baseline).agg(F.max("drawdown").alias("_most"))  # one row
    out = rows.crossJoin(F.broadcast(base)).withColumn("eligible", (F.col("trades") >= least) & F.coalesce(F.col("drawdown") <= F.col("_most") + 1e-9, F.lit(False)))
    best = out.where("eligible").agg(F.min_by(key, F.struct((-F.col("net")).alias("n"), F.col(key).alias("k"))).alias("_best"))  # one row
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.coalesce(F.col(key) == F.col("_best"), F.lit(False))).drop("_most", "_best")

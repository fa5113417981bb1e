"""Trades from signals: islands of a rule, timed trades, and bracket orders with one position at a time."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.indicators import series

#: More cost modes than this are not broadcast.
FEW = 1000


def hold_while(bars: DataFrame, rule: Column) -> DataFrame:
    """Long while rule holds: in at the next open after it first does, out at the next open after it first does not.

    Trades are islands of the rule, so no state is carried from trade to trade. An island that begins on the last bar
    is not filled; one that still holds there ends at the last close. Columns: entry_i, entry_t, entry, exit_i, exit_t, exit, reason.
    """
    w = series()
    out = bars.withColumn("_s", F.coalesce(rule, F.lit(False)).cast("int")).withColumn("i", F.row_number().over(w) - 1)
    out = out.withColumn("_was", F.coalesce(F.lag("_s").over(w), F.lit(0))).withColumn("_no", F.lead("o").over(w)).withColumn("_nt", F.lead("t_ms").over(w))
    out = out.withColumn("_isle", F.sum(F.when((F.col("_s") == 1) & (F.col("_was") == 0), 1).otherwise(0)).over(w))
    all_ = Window.partitionBy("symbol")
    out = out.withColumn("_end_c", F.max_by("c", "t_ms").over(all_)).withColumn("_end_t", F.max("t_ms").over(all_)).withColumn("_end_i", F.max("i").over(all_))
    on = F.col("_s") == 1
    off = (F.col("_s") == 0) & (F.col("_was") == 1)
    isles = out.where(on | off).groupBy("symbol", "_isle").agg(
        F.min(F.when(on, F.col("i"))).alias("first"), F.min_by(F.when(on, F.col("_no")), F.when(on, F.col("i"))).alias("entry"), F.min_by(F.when(on, F.col("_nt")), F.when(on, F.col("i"))).alias("entry_t"),
        F.max(F.when(off, F.col("i"))).alias("last"), F.max(F.when(off, F.col("_no"))).alias("_xo"), F.max(F.when(off, F.col("_nt"))).alias("_xt"),
        F.first("_end_c").alias("_end_c"), F.first("_end_t").alias("_end_t"), F.first("_end_i").alias("_end_i"),
    ).where("entry is not null")
    by_rule = F.col("_xo").isNotNull()
    return isles.select(
        "symbol", (F.col("first") + 1).alias("entry_i"), "entry_t", "entry", F.when(by_rule, F.col("last") + 1).otherwise(F.col("_end_i")).alias("exit_i"), F.coalesce("_xt", "_end_t").alias("exit_t"),
        F.coalesce("_xo", "_end_c").alias("exit"), F.when(by_rule, "rule").otherwise("end-of-test").alias("reason"), F.lit("long").alias("side"),
    )


def timed_trades(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """calendar: symbol, entry_t, exit_t. Log return from the entry bar's open to the exit bar's open; a missing bar gives a status instead."""
    at = lambda t, p: bars.select("symbol", F.col("t_ms").alias(t), F.col("o").alias(p))
    out = calendar.join(at("entry_t", "entry"), ["symbol", "entry_t"], "left").join(at("exit_t", "exit"), ["symbol", "exit_t"], "left")
    status = F.when(F.col("entry").isNull(), "missing-entry").when(F.col("exit").isNull(), "missing-exit").otherwise("traded")
    return out.withColumn("status", status).withColumn("log_return", F.log(F.col("exit") / F.col("entry")))


def with_costs(trades: DataFrame, costs: DataFrame) -> DataFrame:
    """trades under each cost mode (label, fee, slippage, slippage_bps), all of them, broadcast if at most FEW: fills move against the trade; pnl per unit, less the exit's fee."""
    out = trades.crossJoin(F.broadcast(costs) if costs.limit(FEW + 1).count() <= FEW else costs)
    way = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    slip = lambda p: F.col("slippage") + F.abs(F.col(p)) * F.col("slippage_bps") / 10000
    out = out.withColumn("entry_fill", F.col("entry") + way * slip("entry")).withColumn("exit_fill", F.col("exit") - way * slip("exit"))
    return out.withColumn("pnl", way * (F.col("exit_fill") - F.col("entry_fill")) - F.col("fee"))


TRADE = "entry_i long, entry_t long, entry double, exit_i long, exit_t long, exit double, reason string, side string, stop double, target double"


def brackets(signals: DataFrame, most_bars: int = 0, cooldown: int = 0, risk: float | None = None, target_r: float | None = None) -> DataFrame:
    """Orders of signals (bars with side and, if they have them, stop and target), one position at a time for each symbol.

    In at the next open. On each bar: an open beyond the stop leaves at the open, then the stop goes before the target;
    after most_bars bars (0: never) at the close; what is left at the last close. No entry while in a position, nor
    within cooldown bars of the last entry. Stops on the wrong side of the fill reject the entry. With target_r the
    target is that multiple of the risk. Only bars of one series are folded, in time order.
    """
    has = {c: c in signals.columns for c in ("stop", "target")}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t_ms")
        get = lambda c: table.column(c).to_numpy() if has.get(c, True) else np.full(table.num_rows, np.nan)
        t, o, h, low, c, sides = get("t_ms"), get("o"), get("h"), get("l"), get("c"), table.column("side").to_pylist()
        stops, targets = get("stop").astype(float), get("target").astype(float)
        rows, at, n, last = [], 0, len(t), -(10**9)
        wanted = [i for i, s in enumerate(sides) if s]
        for i in wanted:
            if i < at or i + 1 >= n or i + 1 - last <= cooldown:
                continue
            way = 1 if sides[i] == "long" else -1
            fill, stop, goal = o[i + 1], stops[i], targets[i]
            if not np.isnan(stop) and (fill - stop) * way <= 0 or not np.isnan(goal) and (goal - fill) * way <= 0:
                continue
            if target_r is not None and not np.isnan(stop):
                goal = fill + way * target_r * abs(fill - stop)
            last, out = i + 1, None
            for j in range(i + 1, n):
                if j > i + 1 and (o[j] - stop) * way <= 0:
                    out = (o[j], "stop-gap")
                elif ((low[j] if way > 0 else h[j]) - stop) * way <= 0:
                    out = (stop, "stop")
                elif ((h[j] if way > 0 else low[j]) - goal) * way >= 0:
                    out = (goal, "target")
                elif most_bars and j - i >= most_bars:
                    out = (c[j], "time")
                elif j == n - 1:
                    out = (c[j], "end-of-test")
                if out:
                    rows.append((i + 1, int(t[i + 1]), fill, j, int(t[j]), out[0], out[1], sides[i], None if np.isnan(stop) else stop, None if np.isnan(goal) else goal))
                    at = j
                    break
        names = [x.split()[0] for x in TRADE.split(", ")]
        kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in TRADE.split(", ")]
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        data = {"symbol": pa.array([table.column("symbol")[0].as_py()] * len(rows), pa.string())}
        return pa.table(data | {m: pa.array(list(x), k) for m, k, x in zip(names, kinds, cols, strict=True)})

    return signals.select("symbol", "t_ms", "o", "h", "l", "c", "side", *[c for c in has if has[c]]).groupBy("symbol").applyInArrow(run, f"symbol string, {TRADE}")


@dataclass(frozen=True)
class Management:
    """How orders are entered and positions kept; 0 or None: not at all."""

    expiry: int = 0  # bars for which a limit order stands
    cooldown: int = 0
    most_bars: int = 0
    target_r: float | None = None
    breakeven_r: float | None = None  # the move, in risks, from which the stop stands at the entry
    partial_r: float | None = None  # the move, in risks, at which half is taken
    trail_atr: float | None = None  # the stop follows the close at so many ATRs
    risk: float | None = None  # money lost at the first stop; sizes the position


def managed(signals: DataFrame, m: Management) -> DataFrame:
    """Like brackets, with limit entries (column limit), sizes, partial exits and moving stops (needs stop; trail_atr needs atr).

    A limit order fills from the bar after its signal on, at its price or at a better open, and goes after m.expiry bars;
    no other order is made while it stands. On each bar exits come first, in the order of brackets; then half is taken;
    then, at its close, the stop moves, and only ever closer. points are by unit, the half taken included.
    """
    names = [c for c in ("stop", "limit", "atr") if c in signals.columns]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t_ms")
        get = lambda c: table.column(c).to_numpy().astype(float) if c in table.column_names else np.full(table.num_rows, np.nan)
        t, (o, h, low, c, stops, limits, atr) = table.column("t_ms").to_numpy(), map(get, ("o", "h", "l", "c", "stop", "limit", "atr"))
        sides, n, free, last, rows = table.column("side").to_pylist(), len(t), 0, -(10**9), []
        for i in (i for i, s in enumerate(sides) if s):
            if i < free or i + 1 >= n or i + 1 - last <= m.cooldown:
                continue
            way, j, stop = (1 if sides[i] == "long" else -1), i + 1, stops[i]
            fill = o[j]
            if m.expiry and not np.isnan(limits[i]):
                end = min(i + m.expiry, n - 1)
                j = next((k for k in range(i + 1, end + 1) if ((low[k] if way > 0 else h[k]) - limits[i]) * way <= 0), -1)
                free = end
                if j < 0:
                    continue
                fill = min(o[j], limits[i]) if way > 0 else max(o[j], limits[i])
            if np.isnan(stop) or (fill - stop) * way <= 0:
                continue
            r, first, half, last = abs(fill - stop), stop, None, j
            goal = fill + way * m.target_r * r if m.target_r is not None else np.nan
            for k in range(j, n):
                best = (h[k] if way > 0 else low[k])
                out = None
                if k > j and (o[k] - stop) * way <= 0:
                    out = (o[k], "stop-gap")
                elif ((low[k] if way > 0 else h[k]) - stop) * way <= 0:
                    out = (stop, "stop")
                elif (best - goal) * way >= 0:
                    out = (goal, "target")
                elif m.most_bars and k - j + 1 >= m.most_bars:
                    out = (c[k], "time")
                elif k == n - 1:
                    out = (c[k], "end-of-test")
                if out is None or out[1] == "target":
                    if m.partial_r is not None and half is None and (best - fill) * way >= m.partial_r * r:
                        half = m.partial_r * r
                if out:
                    points = (out[0] - fill) * way
                    points = points if half is None else (points + half) / 2
                    size = m.risk / r if m.risk is not None else 1.0
                    rows.append((j, int(t[j]), fill, k, int(t[k]), out[0], out[1], sides[i], first, None if np.isnan(goal) else goal, size, points, half is not None))
                    free = k
                    break
                if m.breakeven_r is not None and (best - fill) * way >= m.breakeven_r * r:
                    stop = max(stop, fill) if way > 0 else min(stop, fill)
                if m.trail_atr is not None and not np.isnan(atr[k]):
                    stop = max(stop, c[k] - m.trail_atr * atr[k]) if way > 0 else min(stop, c[k] + m.trail_atr * atr[k])
        return pa.Table.from_pylist([dict(zip(schema.names, (table.column("symbol")[0].as_py(), *r), strict=True)) for r in rows], schema)

    kinds = f"symbol string, {TRADE}, size double, points double, partial boolean"
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], arrow[x.split()[1]]) for x in kinds.split(", ")])
    return signals.select("symbol", "t_ms", "o", "h", "l", "c", "side", *names).groupBy("symbol").applyInArrow(run, kinds)


def excursions(trades: DataFrame, bars: DataFrame, after: int = 12) -> DataFrame:
    """trades with mfe and mae (best and worst move from the entry while in it) and post_mfe over `after` bars more; bars: symbol, i, h, l.

    Trades are cut to the blocks of bars that they touch, so the join is on equal keys.
    """
    size = 64
    t = trades.withColumn("_block", F.explode(F.sequence(F.floor(F.col("entry_i") / size), F.floor((F.col("exit_i") + after) / size))))
    b = bars.select("symbol", F.col("i").alias("_i"), F.col("h").alias("_h"), F.col("l").alias("_l"), F.floor(F.col("i") / size).alias("_block"))
    met = t.join(b, ["symbol", "_block"]).where(f"_i >= entry_i and _i <= exit_i + {after}")
    long = F.col("side") == "long"
    best = F.when(long, F.col("_h") - F.col("entry")).otherwise(F.col("entry") - F.col("_l"))
    worst = F.when(long, F.col("entry") - F.col("_l")).otherwise(F.col("_h") - F.col("entry"))
    inside = F.col("_i") <= F.col("exit_i")
    moves = met.groupBy("symbol", "entry_i", "side").agg(F.max(F.when(inside, best)).alias("mfe"), F.max(F.when(inside, worst)).alias("mae"), F.max(F.when(~inside, best)).alias("post_mfe"))
    return trades.join(moves, ["symbol", "entry_i", "side"], "left")

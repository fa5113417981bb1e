"""More registered queries over bars, with their SQL: context of higher bars, gates, scheduled trades, selection."""

from pyspark.sql import Window, functions as F

from ..functions import clock, indicators as ind
from ..operators import context, levels, shapes, trades
from ..sources import bars as src
from . import account, report
from .queries import ALL, ATR, BARS, DAILY, DAY, DAYS, H1, HOLD, HOUR, ISLES, LINES, PNL, S, TRADE_OUT, _reduced, events, frame, held, out, priced, query, rounded


def hourly(spark, sf_dir):
    return src.event_bars(spark, sf_dir, HOUR)


@query(f"with b as ({BARS}) select symbol, t_ms, round(max(h) over {frame(10)}, 6) as recent_high, round(min(l) over {frame(10)}, 6) as recent_low from b")
def recent_extremes(spark, sf_dir):
    return rounded(ind.recent_extremes(events(spark, sf_dir), 10), "symbol", "t_ms", "recent_high", "recent_low")


@query(f"with b as ({LINES}), {ATR}, x as (select *, avg(v) over {frame(20, 1)} as m, count(*) over {frame(20, 1)} as n, case when atr > 0 then (h - l) / atr end as sp from a) select symbol, t_ms, round(sp, 6) as spread_atr, case when atr > 0 then round(abs(c - o) / atr, 6) end as body_atr, round(case when n = 20 and m > 0 then v / m end / greatest(sp, 0.1), 6) as effort from x")
def effort_ratio(spark, sf_dir):
    return rounded(ind.effort(ind.atr(ind.volume_stats(src.lineitem_bars(spark, sf_dir)))), "symbol", "t_ms", "spread_atr", "body_atr", "effort")


def _near(f: str, a: str, b: str) -> str:
    return f"{f}(c) over {S.format(f' rows between {a} and {b}')}"


@query(
    f"with b as ({BARS}), x as (select *, {_near('count', '3 preceding', '3 following')} as n, {_near('max', '3 preceding', '1 preceding')} as hb, {_near('max', '1 following', '3 following')} as ha, {_near('min', '3 preceding', '1 preceding')} as lb, {_near('min', '1 following', '3 following')} as la from b), "
    f"y as (select *, case when n = 7 and c > hb and c >= ha then c end as ph, case when n = 7 and c < lb and c <= la then c end as pl from x) select symbol, t_ms, round(lag(ph, 3) over {ALL}, 6) as swing_high, round(lag(pl, 3) over {ALL}, 6) as swing_low from y"
)
def close_swings(spark, sf_dir):
    """Swings of closes; later neighbours may be equal."""
    return rounded(shapes.swings(events(spark, sf_dir), 3, "c", "c", right_equal=True), "symbol", "t_ms", "swing_high", "swing_low")


H4_CLOSED = f"h as (select *, t_ms + {4 * HOUR} as hc from a)"


def _asof(extra: str, columns: str, at: str = f"b.t_ms + {HOUR}") -> str:
    return f"with b as ({BARS}), {ATR}, {H4_CLOSED}, {extra}, q as ({H1}) select b.symbol, b.t_ms, {columns} from q b asof left join k on b.symbol = k.symbol and {at} >= k.hc"


@query(_asof(f"d as (select *, c - lag(c, 24) over {ALL} as d from h), k as (select symbol, hc, cast(case when d >= 0.5 * atr then 1 when d <= -0.5 * atr then -1 when d is not null then 0 end as integer) as x from d)", "k.x as htf_bias"))
def htf_bias_asof(spark, sf_dir):
    return context.higher_bias(hourly(spark, sf_dir), events(spark, sf_dir), HOUR, 4 * HOUR).select("symbol", "t_ms", "htf_bias")


@query(f"with h as (select symbol, t_ms + {4 * HOUR} as hc, c from ({BARS})), b as ({H1}), x as (select b.*, h.c as hist from b asof left join h on b.symbol = h.symbol and b.t_ms + {HOUR} >= h.hc) select x.symbol, x.t_ms, round(hist, 6) as historical_c, round(h.c, 6) as stable_c from x asof left join h on x.symbol = h.symbol and x.t_ms >= h.hc")
def htf_snapshots(spark, sf_dir):
    return rounded(context.snapshots(hourly(spark, sf_dir), events(spark, sf_dir), HOUR, 4 * HOUR), "symbol", "t_ms", "historical_c", "stable_c")


@query(_asof(f"k as (select symbol, hc, max(h) over {frame(12)} as top, min(l) over {frame(12)} as bottom from h)", "round(k.top, 6) as top, round(k.bottom, 6) as bottom"))
def htf_extremes(spark, sf_dir):
    return rounded(context.higher_extremes(hourly(spark, sf_dir), events(spark, sf_dir), HOUR, 4 * HOUR), "symbol", "t_ms", "top", "bottom")


@query(
    f"with b as ({H1}), cal as (select symbol, t_ms as entry_t, t_ms + {6 * HOUR} as exit_t, case when (t_ms // {DAY}) % 2 = 0 then 'long' else 'short' end as side from b where t_ms % {DAY} = {7 * HOUR}), "
    "t as (select cal.*, e.o as entry, x.o as due, case when side = 'long' then 1.0 else -1.0 end as way from cal left join b e on e.symbol = cal.symbol and e.t_ms = entry_t left join b x on x.symbol = cal.symbol and x.t_ms = exit_t), u as (select *, entry - way * 20.0 as stop from t), "
    "m as (select u.symbol, entry_t, min(b.t_ms) as stop_t, arg_min(case when b.t_ms > entry_t and case when side = 'long' then b.o <= stop else b.o >= stop end then b.o else stop end, b.t_ms) as sp from u join b on b.symbol = u.symbol and b.t_ms >= entry_t and b.t_ms < exit_t where due is not null and case when side = 'long' then b.l <= stop else b.h >= stop end group by 1, 2), "
    "r as (select u.*, stop_t, case when due is null then null when stop_t is not null then sp else due end as ex, case when entry is null then 'missing-entry' when due is null then 'missing-exit' when stop_t is not null then 'stopped' else 'held' end as status from u left join m using (symbol, entry_t)) select symbol, entry_t, side, status, round(ex, 6) as exit, round(way * (ex - entry), 6) + 0.0 as points from r"
)
def scheduled_trades(spark, sf_dir):
    b = hourly(spark, sf_dir)
    t = F.col("t_ms")
    calendar = b.where(F.pmod(t, F.lit(DAY)) == 7 * HOUR).select("symbol", t.alias("entry_t"), (t + 6 * HOUR).alias("exit_t"), F.when(clock.day_utc(t) % 2 == 0, "long").otherwise("short").alias("side"))
    return rounded(context.scheduled_trades(b, calendar, 20.0), "symbol", "entry_t", "side", "status", "exit", "points")


@query(f"with b as ({H1}), x as (select *, (t_ms % {DAY}) // {HOUR} as slot, h - l as span from b) select symbol, t_ms, round(quantile_cont(span, 0.5) over (partition by symbol, slot order by t_ms rows between 20 preceding and 1 preceding), 6) as slot_median from x")
def slot_median(spark, sf_dir):
    return rounded(context.slot_median(hourly(spark, sf_dir), F.col("h") - F.col("l"), F.floor(clock.hour_utc(F.col("t_ms")))), "symbol", "t_ms", "slot_median")


@query(f"with b as ({BARS}), l as (select symbol, t_ms, list(power(ln(h / l), 2) / (4 * ln(2))) over {ALL} as xs from b) select symbol, t_ms, round({_reduced('xs', '0.94 * a + 0.06 * x')}, 6) as range_var from l")
def parkinson_variance(spark, sf_dir):
    return rounded(context.parkinson(events(spark, sf_dir)), "symbol", "t_ms", "range_var")


@query(f"with b as ({BARS}), l as (select symbol, t_ms, list(c) over {ALL} as cs from b) select symbol, t_ms, round({_reduced('cs', 'x * (2.0 / 11) + a * (1 - 2.0 / 11)')}, 6) as ema from l")
def ema_product(spark, sf_dir):
    return rounded(context.ema_product(events(spark, sf_dir), 10), "symbol", "t_ms", "ema")


@query(
    f"with b as ({BARS}), {ATR}, {DAYS}, u as (select *, lag(avg_range) over (partition by symbol order by day) as usual, pd_h - pd_l as span from d), k as (select *, case when pd_h is null then null when pd_h > ppd_h and pd_l < ppd_l then 'outside' when span > 0 and abs(pd_c - pd_o) / span >= 0.45 then 'trend' when span >= 1.45 * usual then 'wide' when span <= 0.65 * usual then 'narrow' else 'range' end as kind from u), "
    f"x as (select a.symbol, a.t_ms, a.atr, a.c, k.kind, k.span, k.pd_h, cast(extract(hour from timezone('America/New_York', timezone('UTC', make_timestamp(a.t_ms * 1000)))) as integer) as ny, (a.t_ms // {DAY} + 3) % 7 as wd, ((a.t_ms + {10 * HOUR}) % {DAY}) / {float(HOUR)} as hl from a left join k on k.symbol = a.symbol and k.day = a.t_ms // {DAY}) "
    "select symbol, t_ms, ny not in (16, 17) as ny_hour, wd < 5 as weekday, hl >= 9 and hl < 18 and not (hl >= 12 and hl < 14) as phase, coalesce(kind not in ('outside', 'wide'), false) as day_type, coalesce(span >= 1.0 * atr, false) as prior_range, coalesce(abs(c - pd_h) <= 2.0 * atr, false) as near_level from x"
)
def market_gates(spark, sf_dir):
    """Each gate as a boolean column, so that any of them can be combined and counted."""
    b = levels.day_context(ind.atr(events(spark, sf_dir)))
    t, yes = F.col("t_ms"), lambda x: F.coalesce(x, F.lit(False))
    return b.select(
        "symbol", "t_ms", (~clock.hour_new_york(t).isin(16, 17)).alias("ny_hour"), (clock.weekday_utc(t) < 5).alias("weekday"), clock.session_phase(t).isin("open", "middle").alias("phase"),
        yes(~F.col("prior_day_type").isin("outside", "wide")).alias("day_type"), yes(F.col("pd_h") - F.col("pd_l") >= F.col("atr")).alias("prior_range"), yes(F.abs(F.col("c") - F.col("pd_h")) <= 2.0 * F.col("atr")).alias("near_level"),
    )


@query(f"with b as ({BARS}), {HOLD}, {ISLES} select symbol, entry_t, sha256('hold|1|' || symbol || '|' || entry_t || '|' || side) as signal_id from tr")
def signal_ids(spark, sf_dir):
    return held(spark, sf_dir).select("symbol", "entry_t", report.signal_id("hold", 1).alias("signal_id"))


@query(
    f"with {PNL}, o as (select label, entry_t, symbol, entry_i, case when pnl > 0 then 1 else 0 end as won, row_number() over (partition by label order by entry_t, symbol, entry_i) as k from pn), gs as (select *, k - row_number() over (partition by label, won order by k) as isle from o), ln as (select label, won, isle, count(*) as n from gs group by 1, 2, 3) "
    "select label, coalesce(max(n) filter (won = 1), 0) as win_streak, coalesce(max(n) filter (won = 0), 0) as loss_streak from ln group by 1"
)
def trade_streaks(spark, sf_dir):
    return report.drawdown(priced(spark, sf_dir), ["label"]).select("label", "win_streak", "loss_streak")


@query(
    f"with {PNL}, ev as (select *, 10000.0 + sum(pnl) over (partition by label order by entry_t, symbol, entry_i rows between unbounded preceding and current row) as eq from pn), pv as (select *, greatest(10000.0, max(eq) over (partition by label order by entry_t, symbol, entry_i rows between unbounded preceding and current row)) as pk from ev), "
    "sv as (select label, count(*) as trades, sum(pnl) as net, 100 * max(pk - eq) / max(pk) as dd from pv group by 1), lv as (select sv.*, trades >= 30 and dd <= (select dd from sv where label = 'realistic') + 1e-9 as ok from sv) select label, trades, round(net, 6) as net, ok as eligible, coalesce(label = (select arg_min(label, (-net, label)) from lv where ok), false) as chosen from lv"
)
def fold_selection(spark, sf_dir):
    """Of the rows with trades enough and no more drawdown than the baseline's, that with the best net; ties keep the first label."""
    rows = report.cost_rows(priced(spark, sf_dir), ["label"])
    return rounded(report.selected(rows, "label", "realistic", 30), "label", "trades", "net", "eligible", "chosen")


@query(
    f"with {PNL}, {DAILY}, n as (select label, row_number() over (partition by label order by day) - 1 as day_no, net / (equity - net) as growth from dd where label in ('raw', 'harsh')), p as (select r.r as replicate, unnest(range((r.r * 7 + k.k * 3) % 5, (r.r * 7 + k.k * 3) % 5 + 4)) as day_no from range(10) r(r) cross join range(3) k(k)), "
    "t as (select label, replicate, exp(sum(ln(1 + growth))) - 1 as total from p join n using (day_no) group by 1, 2) select x.replicate, round(x.total, 6) + 0.0 as a, round(y.total, 6) + 0.0 as b, round(x.total - y.total, 6) + 0.0 as difference from t x join t y on x.replicate = y.replicate and x.label = 'raw' and y.label = 'harsh'"
)
def paired_streams(spark, sf_dir):
    """Two cost modes over one matrix of block starts, replicate by replicate."""
    days = account.daily(priced(spark, sf_dir), ["label"])
    days = days.withColumn("day_no", F.row_number().over(Window.partitionBy("label").orderBy("day")).cast("long") - 1)
    starts = spark.range(30).select(F.floor(F.col("id") / 3).alias("replicate"), (F.col("id") % 3).alias("piece")).withColumn("start", (F.col("replicate") * 7 + F.col("piece") * 3) % 5)
    one = lambda label: account.block_bootstrap(days.where(F.col("label") == label).select("day_no", "growth"), starts, 4)
    return rounded(account.paired(one("raw"), one("harsh"), "total"), "replicate", "a", "b", "difference")


@query()
def managed_trades(spark, sf_dir):
    """Limit entries at the channel's edge with a break-even stop, a half taken at one R and a trailing stop."""
    from ..operators import signals

    s = signals.donchian_breakout(ind.donchian(ind.atr(events(spark, sf_dir))))
    s = s.withColumn("limit", F.when(F.col("side") == "long", F.col("dc_high")).when(F.col("side") == "short", F.col("dc_low")))
    rows = trades.managed(s, trades.Management(expiry=3, breakeven_r=1.0, partial_r=1.0, trail_atr=2.5, risk=100.0, most_bars=30))
    return rounded(rows, *TRADE_OUT.replace("*", "").split(), "size", "points", "partial")

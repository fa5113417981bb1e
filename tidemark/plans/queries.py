"""The registered queries over bars, and for each the same in DuckDB SQL. Doubles are rounded to 6 places on both sides."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import clock, indicators as ind
from ..operators import asof, calendars, levels, shapes, signals, trades
from ..sources import bars as src
from . import account, report

HOUR, DAY = src.HOUR, src.DAY
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Bars in SQL: of events by the hours given, of line items and of orders by day.
_EVENTS = "select event_type as symbol, ((epoch_us(ts) // 1000) // {w}) * {w} as t_ms, arg_min(value, (ts, event_id)) as o, max(value) as h, min(value) as l, arg_max(value, (ts, event_id)) as c, cast(count(*) as double) as v from events group by 1, 2"
BARS = _EVENTS.format(w=4 * HOUR)
LINES = f"select l_returnflag || l_linestatus as symbol, ((epoch_us(l_shipdate) // 1000) // {DAY}) * {DAY} as t_ms, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as o, max(l_extendedprice) as h, min(l_extendedprice) as l, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as c, sum(l_quantity) as v from lineitem group by 1, 2"
ORDERS = f"select o_orderpriority as symbol, ((epoch_us(o_orderdate) // 1000) // {DAY}) * {DAY} as t_ms, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as o, max(o_totalprice) as h, min(o_totalprice) as l, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as c, cast(count(*) as double) as v from orders group by 1, 2"
S = "(partition by symbol order by t_ms{})"
ALL = S.format("")


def frame(n: int, skip: int = 0) -> str:
    return S.format(f" rows between {n - 1 + skip} preceding and {f'{skip} preceding' if skip else 'current row'}")


def query(sql: str | None = None):
    """Registers the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def out(columns: str, source: str, with_: str = f"b as ({BARS})") -> str:
    """SQL that returns columns of source; those marked with * are rounded."""
    cells = [f"round({c[:-1]}, 6) + 0.0 as {c[:-1]}" if c.endswith("*") else c for c in columns.split()]
    return f"with {with_} select {', '.join(cells)} from {source}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_bars(spark, sf_dir)


@query(out("symbol t_ms o* h* l* c* v*", "b"))
def bars_4h(spark, sf_dir):
    return rounded(events(spark, sf_dir), "symbol", "t_ms", *"ohlcv")


@query(out("symbol t_ms o* h* l* c* v*", "b", f"b as ({LINES})"))
def bars_daily_lineitem(spark, sf_dir):
    return rounded(src.lineitem_bars(spark, sf_dir), "symbol", "t_ms", *"ohlcv")


@query(out("symbol t_ms o* h* l* c* v*", "b", f"b as ({ORDERS})"))
def bars_daily_orders(spark, sf_dir):
    return rounded(src.order_bars(spark, sf_dir), "symbol", "t_ms", *"ohlcv")


@query(out("symbol t_ms o* h* l* c* v* n_source complete", "r", f"b as ({BARS}), r as (select symbol, (t_ms // {DAY}) * {DAY} as t_ms, arg_min(o, b.t_ms) as o, max(h) as h, min(l) as l, arg_max(c, b.t_ms) as c, sum(v) as v, count(*) as n_source, count(*) = 6 as complete from b group by 1, 2)"))
def resample_daily(spark, sf_dir):
    return rounded(src.resample(events(spark, sf_dir), DAY, 4 * HOUR), "symbol", "t_ms", *"ohlcv", "n_source", "complete")


@query(f"with b as ({BARS}), t as (select symbol, t_ms, count(*) as n, sum(case when h < l then 1 else 0 end) as x from b group by 1, 2) select symbol, cast(sum(n) as bigint) as n_bars, cast(0 as bigint) as n_broken, cast(sum(x) as bigint) as n_crossed, cast(sum(case when n > 1 then 1 else 0 end) as bigint) as n_repeated from t group by 1")
def bar_defects(spark, sf_dir):
    return src.defects(events(spark, sf_dir))


@query(
    f"with b as ({BARS}), x as (select symbol, t_ms, (t_ms % {DAY}) / {float(HOUR)} as hu, ((t_ms + {10 * HOUR}) % {DAY}) / {float(HOUR)} as hl from b) select symbol, t_ms, t_ms // {DAY} as day, (t_ms // {DAY} + 3) // 7 as week, (t_ms + {10 * HOUR}) // {DAY} as day_local, round(hu, 6) as hour_utc, round(hl, 6) as hour_local, cast((t_ms // {DAY} + 3) % 7 as integer) as weekday, "
    "case when hl < 9 then 'overnight' when hl < 12 then 'open' when hl < 14 then 'lunch' when hl < 18 then 'middle' else 'close' end as phase, case when hl >= 9 and hl < 12 then 'asia' when hl >= 12 and hl < 16 then 'mid' when hl >= 16 and hl < 19 then 'london' when hl >= 21 then 'ny' end as win, "
    "hu >= 0 and hu < 8 as asia, hu >= 7 and hu < 16 as london, hu >= 12 and hu < 21 as ny, cast(extract(hour from timezone('America/New_York', timezone('UTC', make_timestamp(t_ms * 1000)))) as integer) as hour_ny from x"
)
def session_phase(spark, sf_dir):
    t = F.col("t_ms")
    b = events(spark, sf_dir)
    return b.select(
        "symbol", "t_ms", clock.day_utc(t).alias("day"), clock.week_utc(t).alias("week"), clock.day_local(t).alias("day_local"), F.round(clock.hour_utc(t), 6).alias("hour_utc"), F.round(clock.hour_local(t), 6).alias("hour_local"),
        clock.weekday_utc(t).alias("weekday"), clock.session_phase(t).alias("phase"), clock.trade_window(t).alias("win"), *[clock.in_session(t, s).alias(s) for s in clock.SESSIONS], clock.hour_new_york(t).alias("hour_ny"),
    )


@query(f"with b as ({BARS}), x as (select symbol, t_ms, ((t_ms + {10 * HOUR}) % {DAY}) / {float(HOUR)} as hl from b), y as (select *, case when hl >= 9 and hl < 12 then 9 when hl >= 12 and hl < 16 then 12 when hl >= 16 and hl < 19 then 16 when hl >= 21 then 21 end as st from x) select symbol, t_ms, cast(floor((hl - st) * 60 + 1e-6) as bigint) as minutes, case when floor((hl - st) * 60 + 1e-6) < 60 then 'open' when floor((hl - st) * 60 + 1e-6) < 120 then 'middle' when floor((hl - st) * 60 + 1e-6) < 180 then 'close' end as segment from y where st is not null")
def trade_window(spark, sf_dir):
    t = F.col("t_ms")
    return events(spark, sf_dir).where(clock.trade_window(t).isNotNull()).select("symbol", "t_ms", clock.minutes_into_window(t).alias("minutes"), clock.window_segment(t).alias("segment"))


TR = f"p as (select *, coalesce(lag(c) over {ALL}, c) as pc, row_number() over {ALL} - 1 as i from b), tr as (select *, greatest(h - l, abs(h - pc), abs(l - pc)) as tr from p)"
ATR = f"{TR}, a as (select *, avg(tr) over {frame(14)} as atr from tr)"


@query(out("symbol t_ms tr* atr*", "a", f"b as ({BARS}), {ATR}"))
def true_range_atr(spark, sf_dir):
    return rounded(ind.atr(events(spark, sf_dir)), "symbol", "t_ms", "tr", "atr")


@query(f"with b as ({BARS}), {TR}, a as (select *, avg(tr) over {frame(14)} as atr_full from tr) select symbol, t_ms, round(atr_full, 6) as atr_full from a where i >= 13")
def atr_full_window(spark, sf_dir):
    return rounded(ind.atr_full(events(spark, sf_dir)).where("atr_full is not null"), "symbol", "t_ms", "atr_full")


@query(f"with b as ({BARS}), {ATR}, m as (select *, min(atr) over {frame(20)} as lo, max(atr) over {frame(20)} as hi from a) select symbol, t_ms, case when i >= 32 and hi > lo then round(100 * (atr - lo) / (hi - lo), 6) + 0.0 end as rmv from m")
def rmv(spark, sf_dir):
    return rounded(ind.relative_volatility(events(spark, sf_dir)), "symbol", "t_ms", "rmv")


ER = f"{TR}, d as (select *, abs(c - lag(c) over {ALL}) as d1, abs(c - lag(c, 10) over {ALL}) as d10 from tr), e as (select *, sum(d1) over {frame(10)} as path, sum(tr) over {frame(10)} as trs from d), er as (select *, case when i >= 10 and path > 0 then d10 / path else 0.0 end as er, case when i >= 10 and trs > 0 then d10 / trs else 0.0 end as er_tr from e)"


@query(out("symbol t_ms er* er_tr*", "er", f"b as ({BARS}), {ER}"))
def efficiency_ratio(spark, sf_dir):
    return rounded(ind.efficiency(events(spark, sf_dir)), "symbol", "t_ms", "er", "er_tr")


@query(f"with b as ({BARS}) select symbol, t_ms, round(c - lag(c, 5) over {ALL}, 6) + 0.0 as slope, case when lag(c, 10) over {ALL} != 0 then round(100 * (c / lag(c, 10) over {ALL} - 1), 6) + 0.0 end as roc from b")
def slope(spark, sf_dir):
    return rounded(ind.rate_of_change(ind.slope(events(spark, sf_dir)), 10), "symbol", "t_ms", "slope", "roc")


@query(f"with b as ({BARS}) select symbol, t_ms, case when count(*) over {frame(5)} = 5 then round(avg(c) over {frame(5)}, 6) end as sma from b")
def sma(spark, sf_dir):
    return rounded(ind.sma(events(spark, sf_dir), 5), "symbol", "t_ms", "sma")


def _wma(column: str, n: int) -> str:
    return "(" + " + ".join(f"lag({column}, {k}) over {ALL} * {n - k}" for k in range(n)) + f") / {n * (n + 1) / 2}"


@query(f"with b as ({BARS}), w as (select *, 2 * {_wma('c', 4)} - {_wma('c', 9)} as raw, {_wma('c', 9)} as wma from b) select symbol, t_ms, round(wma, 6) as wma, round({_wma('raw', 3)}, 6) as hma from w")
def hma(spark, sf_dir):
    return rounded(ind.hma(events(spark, sf_dir), 9), "symbol", "t_ms", "wma", "hma")


@query(f"with b as ({BARS}), x as (select symbol, t_ms, count(*) over {frame(20)} as n, avg(c) over {frame(20)} as m, stddev_pop(c) over {frame(20)} as s from b) select symbol, t_ms, round(m, 6) as bb_mid, round(m + 2 * s, 6) as bb_high, round(m - 2 * s, 6) as bb_low from x where n = 20")
def bollinger(spark, sf_dir):
    return rounded(ind.bollinger(events(spark, sf_dir)).where("bb_mid is not null"), "symbol", "t_ms", "bb_mid", "bb_high", "bb_low")


@query(f"with b as ({BARS}), {TR}, x as (select symbol, t_ms, i, sum(tr) over {frame(14)} as s, max(h) over {frame(14)} - min(l) over {frame(14)} as r from tr) select symbol, t_ms, round(100 * log10(s / r) / log10(14), 6) as chop from x where i >= 13 and r > 0")
def chop(spark, sf_dir):
    return rounded(ind.choppiness(events(spark, sf_dir)).where("chop is not null"), "symbol", "t_ms", "chop")


DC = f"dc as (select *, case when count(*) over {frame(20, 1)} = 20 then max(h) over {frame(20, 1)} end as dc_high, case when count(*) over {frame(20, 1)} = 20 then min(l) over {frame(20, 1)} end as dc_low from a)"


@query(out("symbol t_ms dc_high* dc_low*", "dc", f"b as ({BARS}), {ATR}, {DC}"))
def donchian(spark, sf_dir):
    return rounded(ind.donchian(events(spark, sf_dir)), "symbol", "t_ms", "dc_high", "dc_low")


@query(f"with b as ({LINES}), x as (select *, count(*) over {frame(20, 1)} as n, avg(v) over {frame(20, 1)} as m, count(*) over {frame(50, 1)} as n5, avg(v) over {frame(50, 1)} as m5, stddev_pop(v) over {frame(50, 1)} as s5 from b) select symbol, t_ms, case when n = 20 then round(m, 6) end as vol_sma, case when n = 20 and m > 0 then round(v / m, 6) end as vol_ratio, case when n5 >= 2 then case when s5 > 0 then round((v - m5) / s5, 6) + 0.0 else 0.0 end end as vol_z from x")
def volume_stats(spark, sf_dir):
    return rounded(ind.volume_stats(src.lineitem_bars(spark, sf_dir)), "symbol", "t_ms", "vol_sma", "vol_ratio", "vol_z")


@query(f"with b as ({BARS}), s as (select *, coalesce(cast(sign(c - lag(c, 4) over {ALL}) as integer), 0) as s from b), n as (select *, case when s != coalesce(lag(s) over {ALL}, 0) then 1 else 0 end as new from s), r as (select *, sum(new) over {ALL} as run from n) select symbol, t_ms, cast(row_number() over (partition by symbol, run order by t_ms) * s as integer) as counter from r")
def setup_counter(spark, sf_dir):
    return ind.setup_counter(events(spark, sf_dir)).select("symbol", "t_ms", "counter")


def _reduced(list_: str, step: str) -> str:
    return f"list_reduce({list_}, lambda a, x: {step})"


PREFIX = f"pre as (select symbol, t_ms, list(c) over {ALL} as cs from b)"


@query(f"with b as ({BARS}), {PREFIX} select symbol, t_ms, round({_reduced('cs', 'a + (2.0 / 11) * (x - a)')}, 6) as ema from pre")
def ema(spark, sf_dir):
    return rounded(ind.ema(events(spark, sf_dir), 10), "symbol", "t_ms", "ema")


def _rma(list_: str, n: int) -> str:
    """Wilder's mean of a list that begins with its first finite value."""
    return f"case when len({list_}) >= {n} then {_reduced(f'list_concat([list_sum({list_}[1:{n}]) / {n}.0], {list_}[{n + 1}:])', f'(a * {n - 1} + x) / {n}')} end"


@query(f"with b as ({BARS}), {TR}, l as (select symbol, t_ms, list(tr) over {ALL} as ts from tr) select symbol, t_ms, round({_rma('ts', 14)}, 6) as wilder_atr from l")
def wilder_atr(spark, sf_dir):
    return rounded(ind.wilder_atr(events(spark, sf_dir)), "symbol", "t_ms", "wilder_atr")


@query(f"with b as ({BARS}), d as (select symbol, t_ms, c - lag(c) over {ALL} as d from b), l as (select symbol, t_ms, list(greatest(d, 0)) over {ALL} as us, list(greatest(-d, 0)) over {ALL} as ds from d where d is not null), r as (select symbol, t_ms, {_rma('us', 14)} as u, {_rma('ds', 14)} as n from l) select symbol, t_ms, round(100 * u / (u + n), 6) as rsi from r where u + n > 0")
def rsi(spark, sf_dir):
    return rounded(ind.rsi(events(spark, sf_dir)).where("rsi is not null"), "symbol", "t_ms", "rsi")


@query()
def supertrend(spark, sf_dir):
    return rounded(ind.supertrend(events(spark, sf_dir)), "symbol", "t_ms", "supertrend", "st_trend")


@query()
def psar(spark, sf_dir):
    return rounded(ind.parabolic_sar(events(spark, sf_dir)), "symbol", "t_ms", "sar", "sar_trend", "sar_flip")


@query()
def adx(spark, sf_dir):
    return rounded(ind.directional(events(spark, sf_dir)), "symbol", "t_ms", "dx", "adx")


@query(f"with b as ({BARS}), {ATR}, e as (select symbol, t_ms, {_reduced(f'list(c) over {ALL}', 'a + (2.0 / 21) * (x - a)')} as m from b) select a.symbol, a.t_ms, round(m, 6) as kc_mid, round(m + 1.5 * atr, 6) as kc_high, round(m - 1.5 * atr, 6) as kc_low from a join e using (symbol, t_ms) where i >= 40")
def keltner(spark, sf_dir):
    return rounded(ind.keltner(events(spark, sf_dir)).where("kc_mid is not null"), "symbol", "t_ms", "kc_mid", "kc_high", "kc_low")


DAYS = f"d0 as (select symbol, t_ms // {DAY} as day, arg_min(o, t_ms) as day_o, max(h) as day_h, min(l) as day_l, arg_max(c, t_ms) as day_c, count(*) as n_bars from b group by 1, 2), d as (select *, " + ", ".join(f"lag(day_{c}, {k}) over (partition by symbol order by day) as {n}_{c}" for n, k in (("pd", 1), ("ppd", 2)) for c in "ohlc") + ", avg(day_h - day_l) over (partition by symbol order by day rows between 10 preceding and 1 preceding) as avg_range from d0)"


@query(out("symbol day day_o* day_h* day_l* day_c* pd_h* pd_l* pd_c* ppd_h* ppd_l* avg_range*", "d", f"b as ({BARS}), {DAYS}"))
def day_levels(spark, sf_dir):
    return rounded(levels.days(events(spark, sf_dir)), "symbol", "day", "day_o", "day_h", "day_l", "day_c", "pd_h", "pd_l", "pd_c", "ppd_h", "ppd_l", "avg_range")


@query(out("symbol day " + " ".join(f"{x}{k}*" for k in (1, 2, 3, 4) for x in "rs"), "m", f"b as ({BARS}), {DAYS}, m as (select *, " + ", ".join(f"pd_c {sign} (pd_h - pd_l) * 1.1 / {p} as {x}{k}" for k, p in enumerate((12, 6, 4, 2), 1) for x, sign in (("r", "+"), ("s", "-"))) + " from d)"))
def camarilla(spark, sf_dir):
    return rounded(levels.camarilla(levels.days(events(spark, sf_dir))), "symbol", "day", *[f"{x}{k}" for k in (1, 2, 3, 4) for x in "rs"])


@query(f"with b as ({BARS}), {DAYS}, u as (select *, lag(avg_range) over (partition by symbol order by day) as usual, pd_h - pd_l as span from d) select symbol, day, case when pd_h is null then null when pd_h > ppd_h and pd_l < ppd_l then 'outside' when span > 0 and abs(pd_c - pd_o) / span >= 0.45 then 'trend' when span >= 1.45 * usual then 'wide' when span <= 0.65 * usual then 'narrow' else 'range' end as prior_day_type from u")
def prior_day_type(spark, sf_dir):
    return levels.prior_day_type(levels.days(events(spark, sf_dir))).select("symbol", "day", "prior_day_type")


W = f"(partition by symbol, t_ms // {DAY} order by t_ms rows between unbounded preceding and current row)"


@query(f"with b as ({BARS}), {DAYS}, x as (select *, t_ms // {DAY} as day, max(h) over {W} as dev_h, min(l) over {W} as dev_l, first(o) over {W} as day_open, count(*) over {W} = 1 as is_new_day, sum(c * v) over {W} / sum(v) over {W} as vwap from b) select x.symbol, x.t_ms, round(dev_h, 6) as dev_h, round(dev_l, 6) as dev_l, round(day_open, 6) as day_open, is_new_day, round(vwap, 3) as vwap, case when avg_range > 0 then round((dev_h - dev_l) / avg_range, 6) end as range_used from x join d using (symbol, day)")
def vwap_day(spark, sf_dir):
    return rounded(levels.day_context(events(spark, sf_dir)).withColumn("vwap", F.round("vwap", 3)), "symbol", "t_ms", "dev_h", "dev_l", "day_open", "is_new_day", "vwap", "range_used")


@query(f"with b as ({BARS}), {ATR}, {DAYS}, f as (select a.*, first(o) over (partition by symbol, t_ms // {DAY} order by t_ms) as day_open, t_ms // {DAY} as day from a), g as (select f.symbol, f.t_ms, f.day_open, f.atr, d.* exclude (symbol, day), (pd_h - pd_l) * 1.1 as sp from f join d on f.symbol = d.symbol and f.day = d.day), k as (select symbol, t_ms, list_filter([" + ", ".join(f"{{'d': abs(day_open - ({e})) / atr, 'k': {k}, 'n': '{n}'}}" for k, (n, e) in enumerate(zip(levels.REFERENCES, ["pd_h", "pd_l", "pd_c", "pd_o", "pd_c + sp / 4", "pd_c + sp / 2", "pd_c - sp / 4", "pd_c - sp / 2", "pd_c + sp / 12", "pd_c + sp / 6", "pd_c - sp / 12", "pd_c - sp / 6"], strict=True))) + "], lambda x: x.d is not null and x.d <= 0.65) as c from g) select symbol, t_ms, list_min(c).n as open_location from k")
def open_location(spark, sf_dir):
    return levels.open_location(levels.day_context(ind.atr(events(spark, sf_dir)))).select("symbol", "t_ms", "open_location")


@query(f"with b as ({BARS}), s as (select symbol, t_ms // {DAY} as day, arg_min(o, t_ms) as o, max(h) as h, min(l) as l, arg_max(c, t_ms) as c, (t_ms // {DAY}) * {DAY} + {8 * HOUR} as end_ms from b where t_ms % {DAY} < {8 * HOUR} group by 1, 2, 7) select b.symbol, b.t_ms, round(s.o, 6) as asia_o, round(s.h, 6) as asia_h, round(s.l, 6) as asia_l, round(s.c, 6) as asia_c from b asof left join s on b.symbol = s.symbol and b.t_ms >= s.end_ms")
def session_runs_asof(spark, sf_dir):
    return rounded(levels.prior_session(events(spark, sf_dir), "asia"), "symbol", "t_ms", "asia_o", "asia_h", "asia_l", "asia_c")


@query(f"with b as ({BARS}) select symbol, (t_ms + {4 * HOUR}) // {DAY} as day, round(max(h), 6) as h, round(min(l), 6) as l, count(*) as n_bars from b where (t_ms + {4 * HOUR}) % {DAY} < {12 * HOUR} group by 1, 2")
def overnight_range(spark, sf_dir):
    return rounded(levels.overnight(events(spark, sf_dir)), "symbol", "day", "h", "l", "n_bars")


@query(f"with b as ({BARS}), k as (select *, ((t_ms + {10 * HOUR}) // {DAY} + 3) // 7 as week from b), w as (select symbol, week + 1 as week, max(h) as pw_h, min(l) as pw_l from k group by 1, 2) select k.symbol, k.t_ms, round(pw_h, 6) as pw_h, round(pw_l, 6) as pw_l from k left join w using (symbol, week)")
def prior_week(spark, sf_dir):
    return rounded(levels.prior_week(events(spark, sf_dir)), "symbol", "t_ms", "pw_h", "pw_l")


@query(f"with b as ({BARS}), r as (select symbol, t_ms // {DAY} as day, max(h) as h, min(l) as l, count(*) as n_bars from b where t_ms % {DAY} < {12 * HOUR} group by 1, 2) select symbol, day, round(h, 6) as h, round(l, 6) as l, n_bars, case when n_bars < 2.7 then 'rejected-coverage' when h <= l then 'rejected-flat' else 'accepted' end as status from r")
def clock_ranges(spark, sf_dir):
    return rounded(levels.clock_ranges(events(spark, sf_dir), 0, 12, 4 * HOUR), "symbol", "day", "h", "l", "n_bars", "status")


H1, D1 = _EVENTS.format(w=HOUR), _EVENTS.format(w=DAY)


@query(f"with b as ({BARS}), h as (select symbol, t_ms + {DAY} as hc, cast(sign(c - o) as integer) as tr from ({D1})) select b.symbol, b.t_ms, case when b.t_ms + {4 * HOUR} - h.hc <= {DAY} then h.tr end as htf_trend from b asof left join h on b.symbol = h.symbol and b.t_ms + {4 * HOUR} >= h.hc")
def htf_trend_asof(spark, sf_dir):
    return asof.completed_trend(events(spark, sf_dir), src.event_bars(spark, sf_dir, DAY), 4 * HOUR, DAY).select("symbol", "t_ms", "htf_trend")


@query(f"with b as ({H1}), s as (select symbol, t_ms + {4 * HOUR} as sc, c from ({BARS})) select b.symbol, b.t_ms, case when b.t_ms + {HOUR} - s.sc < {4 * HOUR} then round(s.c, 6) end as src_c from b asof left join s on b.symbol = s.symbol and b.t_ms + {HOUR} >= s.sc")
def source_projection(spark, sf_dir):
    return rounded(asof.project(src.event_bars(spark, sf_dir, HOUR), events(spark, sf_dir), HOUR, 4 * HOUR, ["c"]), "symbol", "t_ms", "src_c")


QUOTES = "select event_type as symbol, (epoch_us(ts) // 1000) as q_ms, max(value) as mid from events group by 1, 2"


@query(f"with b as ({BARS}), q as ({QUOTES}) select b.symbol, b.t_ms, case when b.t_ms - q_ms <= {2 * HOUR} then q_ms end as quote_ms, case when b.t_ms - q_ms <= {2 * HOUR} then round(mid, 6) end as mid from b asof left join q on b.symbol = q.symbol and b.t_ms > q.q_ms")
def quote_before(spark, sf_dir):
    return rounded(asof.quote_before(events(spark, sf_dir).select("symbol", "t_ms"), _quotes(spark, sf_dir), 2 * HOUR), "symbol", "t_ms", "quote_ms", "mid")


@query(f"with b as ({BARS}), q as ({QUOTES}) select b.symbol, b.t_ms, case when q_ms - b.t_ms <= {2 * HOUR} then q_ms end as quote_ms, case when q_ms - b.t_ms <= {2 * HOUR} then round(mid, 6) end as mid from b asof left join q on b.symbol = q.symbol and b.t_ms <= q.q_ms")
def quote_after(spark, sf_dir):
    return rounded(asof.quote_after(events(spark, sf_dir).select("symbol", "t_ms"), _quotes(spark, sf_dir), 2 * HOUR), "symbol", "t_ms", "quote_ms", "mid")


def _quotes(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), src.epoch_ms("ts").alias("t_ms"), F.col("value").alias("mid"))
    return q.groupBy("symbol", "t_ms").agg(F.max("mid").alias("mid"))


CANDLES = f"q as (select *, lag(o) over {ALL} as po, lag(c) over {ALL} as pc, lag(h) over {ALL} as ph, lag(l) over {ALL} as pl, h - l as span from b), cd as (select *, case when span > 0 then (c - l) / span else 0.5 end as close_location, abs(c - o) as body, least(o, c) - l as lower, h - greatest(o, c) as upper, greatest(0.00001, span) as wide from q)"


@query(f"with b as ({BARS}), {CANDLES} select symbol, t_ms, round(close_location, 6) as close_location, lower >= 0.45 * wide and lower >= 1.5 * body and upper <= 0.35 * wide and c >= o as bull_pin, upper >= 0.45 * wide and upper >= 1.5 * body and lower <= 0.35 * wide and c <= o as bear_pin, coalesce(c > o and pc < po and c >= po and o <= pc, false) as bull_engulf, coalesce(c < o and pc > po and c <= po and o >= pc, false) as bear_engulf, coalesce(h > ph and l < pl, false) as outside from cd")
def candle_patterns(spark, sf_dir):
    return rounded(shapes.candles(events(spark, sf_dir)), "symbol", "t_ms", "close_location", "bull_pin", "bear_pin", "bull_engulf", "bear_engulf", "outside")


def _around(f: str, c: str, a: str, b: str) -> str:
    return f"{f}({c}) over {S.format(f' rows between {a} and {b}')}"


SWINGS = f"s1 as (select *, case when count(*) over {S.format(' rows between 3 preceding and 3 following')} = 7 and h > {_around('max', 'h', '3 preceding', '1 preceding')} and h > {_around('max', 'h', '1 following', '3 following')} then h end as ph, case when count(*) over {S.format(' rows between 3 preceding and 3 following')} = 7 and l < {_around('min', 'l', '3 preceding', '1 preceding')} and l < {_around('min', 'l', '1 following', '3 following')} then l end as pl from b), s2 as (select *, lag(ph, 3) over {ALL} as swing_high, lag(pl, 3) over {ALL} as swing_low from s1), sw as (select *, last_value(swing_high ignore nulls) over {S.format(' rows between unbounded preceding and current row')} as last_high, last_value(swing_low ignore nulls) over {S.format(' rows between unbounded preceding and current row')} as last_low from s2)"


@query(out("symbol t_ms swing_high* swing_low* last_high* last_low*", "sw", f"b as ({BARS}), {SWINGS}"))
def swing_pivots(spark, sf_dir):
    return rounded(shapes.swings(events(spark, sf_dir)), "symbol", "t_ms", "swing_high", "swing_low", "last_high", "last_low")


GAPS = f"g0 as (select *, lag(h, 2) over {ALL} as h2, lag(l, 2) over {ALL} as l2 from a), g as (select *, case when l > h2 then 'long' when h < l2 then 'short' end as side from g0)"


@query(f"with b as ({ORDERS}), {ATR}, {GAPS} select symbol, t_ms, side, round(case side when 'long' then h2 else h end, 6) as gap_low, round(case side when 'long' then l else l2 end, 6) as gap_high, case when atr > 0 then round(case side when 'long' then l - h2 else l2 - h end / atr, 6) end as size_atr from g where side is not null")
def fvg_formations(spark, sf_dir):
    return rounded(shapes.fair_value_gaps(ind.atr(src.order_bars(spark, sf_dir))), "symbol", "t_ms", "side", "gap_low", "gap_high", "size_atr")


@query(f"with b as ({ORDERS}), {ATR}, {GAPS}, z as (select symbol, i, side, case side when 'long' then h2 else h end as gl, case side when 'long' then l else l2 end as gh from g where side is not null), t as (select z.symbol, z.i, min(case when case side when 'long' then a.l <= gh else a.h >= gl end then a.i end) as ti, min(case when case side when 'long' then a.c < gl else a.c > gh end then a.i end) as li from z left join a on a.symbol = z.symbol and a.i > z.i and a.i <= z.i + 8 group by 1, 2) select symbol, cast(i as integer) as i, side, cast(case when li is null or ti <= li then ti end as integer) as touch_i, cast(li as integer) as lost_i from z join t using (symbol, i)")
def fvg_retests(spark, sf_dir):
    b = ind.indexed(ind.atr(src.order_bars(spark, sf_dir)))
    return shapes.first_touch(shapes.fair_value_gaps(b), b, 8).select("symbol", "i", "side", "touch_i", "lost_i")


@query(f"with b as ({BARS}), x as (select *, t_ms // {DAY} as scope, max(h) over {W} - min(l) over {W} as live_range from b), k as (select symbol, t_ms // {DAY} as scope, max(h) - min(l) as whole from b group by 1, 2), y as (select *, avg(whole) over (partition by symbol order by scope rows between 10 preceding and 1 preceding) as avg_range from k) select x.symbol, x.t_ms, round(live_range, 6) as live_range, round(avg_range, 6) as avg_range, case when avg_range > 0 then round(100 * live_range / avg_range, 6) end as used_pct from x join y using (symbol, scope)")
def range_stats_day(spark, sf_dir):
    return rounded(shapes.range_stats(events(spark, sf_dir), clock.day_utc(F.col("t_ms"))), "symbol", "t_ms", "live_range", "avg_range", "used_pct")


def _season(bucket: str, frame_: str, name: str) -> str:
    w = f"(partition by symbol, {bucket} order by t_ms {frame_})"
    return f"with b as ({BARS}), s as (select symbol, t_ms, count(*) over {w} as n_seen, coalesce(sum(case when c > o then 1 else 0 end) over {w}, 0) as n_bull, coalesce(sum(case when c < o then 1 else 0 end) over {w}, 0) as n_bear from b), p as (select *, case when n_seen >= 5 then 100.0 * n_bull / n_seen end as p from s) select symbol, t_ms, n_seen, cast(n_bull as bigint) as n_bull, cast(n_bear as bigint) as n_bear, round(p, 6) as bull_pct, case when p >= 76 then 'strong-bull' when p >= 56 then 'bull' when p >= 45 then 'neutral' when p >= 26 then 'bear' when p is not null then 'strong-bear' end as season from p"


_SEASON = ("symbol", "t_ms", "n_seen", "n_bull", "n_bear", "bull_pct", "season")


@query(_season(f"(t_ms // {DAY} + 3) % 7", "rows between unbounded preceding and 1 preceding", "dow"))
def seasonality_dow(spark, sf_dir):
    return rounded(shapes.seasonality(events(spark, sf_dir), clock.weekday_utc(F.col("t_ms"))), *_SEASON)


@query(_season(f"(t_ms % {DAY}) // {HOUR}", f"range between {14 * DAY} preceding and 1 preceding", "hour"))
def seasonality_hour_lookback(spark, sf_dir):
    return rounded(shapes.seasonality(events(spark, sf_dir), F.floor(clock.hour_utc(F.col("t_ms"))), days=14), *_SEASON)


@query(f"with b as ({BARS}), {ATR}, l as (select *, t_ms // {DAY} as day, c - o as bd from a where t_ms % {DAY} >= {7 * HOUR} and t_ms % {DAY} < {16 * HOUR}), x as (select *, case when atr > 0 then (c - first(o) over {W.replace(f't_ms // {DAY}', 'day')}) / atr end as dp, case when sum(abs(bd)) over {W.replace(f't_ms // {DAY}', 'day')} > 0 then sum(bd) over {W.replace(f't_ms // {DAY}', 'day')} / sum(abs(bd)) over {W.replace(f't_ms // {DAY}', 'day')} else 0.0 end as bn from l) select symbol, t_ms, round(dp, 6) + 0.0 as displacement, round(bn, 6) + 0.0 as body_net, case when dp >= 0.25 and bn >= 0.2 then 'up' when dp <= -0.25 and bn <= -0.2 then 'down' when abs(dp) < 0.15 and abs(bn) < 0.15 then 'pause' else 'mixed' end as bias from x")
def session_bias(spark, sf_dir):
    return rounded(shapes.session_bias(ind.atr(events(spark, sf_dir))), "symbol", "t_ms", "displacement", "body_net", "bias")


@query(f"with b as ({BARS}), {ER}, m as (select *, case when er >= 0.4 then 1 when er < 0.3 then 0 end as m from er) select symbol, t_ms, case when coalesce(last_value(m ignore nulls) over {S.format(' rows between unbounded preceding and current row')}, 0) = 1 then 'trending' else 'ranging' end as regime from m")
def regime_trend(spark, sf_dir):
    return shapes.regime(ind.efficiency(events(spark, sf_dir)), 0.4, 0.3).select("symbol", "t_ms", "regime")


@query()
def narrow_ranges(spark, sf_dir):
    return rounded(shapes.narrow_ranges(ind.atr(events(spark, sf_dir)), 6, 40), "symbol", "t_ms", "zone_bars", "zone_high", "zone_low")


@query(f"with b as ({BARS}), p as (select *, row_number() over {ALL} - 1 as i from b), r as (select *, regr_slope(c, i) over {frame(60)} as rail_slope from p) select symbol, t_ms, case when i >= 59 then round(rail_slope, 6) + 0.0 end as rail_slope from r")
def channel_slope(spark, sf_dir):
    return rounded(shapes.channels(ind.indexed(events(spark, sf_dir))), "symbol", "t_ms", "rail_slope")


@query()
def channel_rails(spark, sf_dir):
    return rounded(shapes.channels(ind.indexed(events(spark, sf_dir))), "symbol", "t_ms", "rail_high", "rail_low")


@query(f"with b as ({BARS}), x as (select symbol, t_ms // {DAY} as day, h, l, v, unnest(range(cast(floor(l / 10) as bigint), cast(floor(h / 10) as bigint) + 1)) as bin from b) select symbol, day, bin, round(sum(v * case when h > l then (least(h, bin * 10 + 10) - greatest(l, bin * 10)) / (h - l) else 1.0 end), 6) as volume from x group by 1, 2, 3")
def volume_profile_bins(spark, sf_dir):
    return rounded(_profile(spark, sf_dir), "symbol", "day", "bin", "volume")


def _profile(spark, sf_dir):
    return shapes.volume_profile(events(spark, sf_dir).withColumn("day", clock.day_utc(F.col("t_ms"))), 10, ["symbol", "day"])


@query()
def value_area(spark, sf_dir):
    return rounded(shapes.value_area(_profile(spark, sf_dir), 10, ["symbol", "day"]), "symbol", "day", "poc", "area_low", "area_high")


@query(f"with b as ({BARS}), r as (select *, 100 * (c / lag(c, 10) over {ALL} - 1) as roc from b) select symbol, t_ms, case when roc >= 20 then 'long' else 'short' end as side from r where roc >= 20 or roc <= -20")
def price_momentum_signals(spark, sf_dir):
    return signals.price_momentum(ind.rate_of_change(events(spark, sf_dir), 10), 20).where("side is not null").select("symbol", "t_ms", "side")


@query(f"with b as ({BARS}), {ATR}, {DC} select symbol, t_ms, case when c > dc_high then 'long' else 'short' end as side, round(case when c > dc_high then c - 2 * atr else c + 2 * atr end, 6) as stop from dc where c > dc_high or c < dc_low")
def donchian_signals(spark, sf_dir):
    return rounded(signals.donchian_breakout(ind.donchian(ind.atr(events(spark, sf_dir)))).where("side is not null"), "symbol", "t_ms", "side", "stop")


def _found(df: DataFrame) -> DataFrame:
    return df.where("side is not null").select("symbol", "t_ms", "side")


@query(f"with b as ({BARS}), {ATR}, x as (select *, max(h) over {frame(20, 3)} as eh, min(l) over {frame(20, 3)} as el, max(h) over {frame(3)} as h3, min(l) over {frame(3)} as l3 from a), s as (select *, case when h3 >= eh + 0.1 * atr and c < eh then 'short' when l3 <= el - 0.1 * atr and c > el then 'long' end as side from x) select symbol, t_ms, side from s where side is not null")
def failed_breakout_signals(spark, sf_dir):
    return _found(signals.failed_breakout(ind.atr(events(spark, sf_dir))))


@query(f"with b as ({BARS}), {DAYS}, x as (select b.symbol, t_ms, c, case when pd_h < ppd_h and pd_l > ppd_l then pd_h end as hi, case when pd_h < ppd_h and pd_l > ppd_l then pd_l end as lo from b join d on b.symbol = d.symbol and b.t_ms // {DAY} = d.day), y as (select *, coalesce(c > hi, false)::int as u, coalesce(c < lo, false)::int as dn from x), z as (select *, coalesce(lag(u) over {ALL}, 0) as pu, coalesce(lag(dn) over {ALL}, 0) as pdn from y) select symbol, t_ms, case when u = 1 and pu = 0 then 'long' else 'short' end as side from z where (u = 1 and pu = 0) or (dn = 1 and pdn = 0)")
def inside_day_signals(spark, sf_dir):
    return _found(signals.inside_day(levels.day_context(events(spark, sf_dir))))


@query(f"with b as ({BARS}), x as (select *, t_ms // {DAY} as day, row_number() over (partition by symbol, t_ms // {DAY} order by t_ms) as k from b), y as (select *, max(case when k <= 2 then h end) over (partition by symbol, day) as oh, min(case when k <= 2 then l end) over (partition by symbol, day) as ol from x), z as (select *, case when k > 2 and c > oh then 'long' when k > 2 and c < ol then 'short' end as side from y), f as (select *, count(side) over (partition by symbol, day order by t_ms rows between unbounded preceding and 1 preceding) as seen from z) select symbol, t_ms, side, round(oh, 6) as or_high, round(ol, 6) as or_low from f where side is not null and seen = 0")
def opening_range_levels(spark, sf_dir):
    b = events(spark, sf_dir).withColumn("day", clock.day_utc(F.col("t_ms")))
    return rounded(signals.opening_range(b).where("side is not null"), "symbol", "t_ms", "side", "or_high", "or_low")


@query(f"with b as ({BARS}), {ATR}, x as (select *, sum(c * v) over {W} / sum(v) over {W} as vwap from a), s as (select symbol, t_ms, vwap, (c - vwap) / atr as d from x where atr > 0) select symbol, t_ms, case when d <= -0.5 then 'long' else 'short' end as side, round(vwap, 6) as target from s where d <= -0.5 or d >= 0.5")
def vwap_fade_signals(spark, sf_dir):
    return rounded(signals.vwap_fade(levels.day_context(ind.atr(events(spark, sf_dir))), 0.5).where("side is not null"), "symbol", "t_ms", "side", "target")


def _family(name: str, make):
    """Registers a family without SQL: symbol, t_ms, side."""

    def run(spark, sf_dir):
        return _found(make(ind.atr(src.event_bars(spark, sf_dir, HOUR))))

    QUERIES[name] = run


_family("break_retest_signals", lambda b: signals.break_retest(levels.day_context(b), "pd_h", "pd_l", 0.3, 0.5))
_family("session_hold_signals", lambda b: signals.hold_beyond(levels.prior_session(b, "asia"), "asia_h", "asia_l", 2))
_family("channel_hold_signals", lambda b: signals.hold_beyond(shapes.channels(ind.indexed(b)).withColumn("_rh", ind.lag("rail_high")).withColumn("_rl", ind.lag("rail_low")), "_rh", "_rl", 1))
_family("day_open_reclaim_signals", lambda b: signals.day_open_reclaim(levels.day_context(b)))
_family("trend_pullback_signals", lambda b: signals.trend_pullback(ind.ema(shapes.regime(ind.efficiency(b)), 10)))
_family("fib_signals", lambda b: signals.fib_continuation(b))
_family("flag_signals", lambda b: signals.flag_continuation(b))
_family("keltner_reversion_signals", lambda b: signals.keltner_reversion(ind.keltner(b)))
_family("keltner_expansion_signals", lambda b: signals.keltner_expansion(ind.keltner(b, k=0.8)))
_family("volume_exhaustion_signals", lambda b: signals.volume_exhaustion(shapes.candles(ind.volume_stats(b))))
_family("counter_nine_signals", lambda b: signals.counter_nine(ind.setup_counter(b), 3))
_family("double_extreme_signals", lambda b: signals.double_extreme(shapes.swings(b)))
_family("weekend_fade_signals", lambda b: signals.weekend_fade(b))
_family("down_shock_signals", lambda b: signals.down_shock(b))

CROSS = f"m as (select *, row_number() over {ALL} - 1 as i, case when count(*) over {frame(3)} = 3 then avg(c) over {frame(3)} end - case when count(*) over {frame(8)} = 8 then avg(c) over {frame(8)} end as d from b), s as (select *, coalesce(d > 0, false)::int as s from m)"
HOLD = f"m as (select *, row_number() over {ALL} - 1 as i, case when count(*) over {frame(5)} = 5 then avg(c) over {frame(5)} end as sma from b), s as (select *, coalesce(c > sma, false)::int as s from m)"
ISLES = f"w as (select *, coalesce(lag(s) over {ALL}, 0) as was, lead(o) over {ALL} as nxo, lead(t_ms) over {ALL} as nxt from s), k as (select *, sum(case when s = 1 and was = 0 then 1 else 0 end) over {ALL} as isle from w), e as (select symbol, arg_max(c, t_ms) as ec, max(t_ms) as et, max(i) as ei from b join (select symbol, t_ms, i from m) using (symbol, t_ms) group by 1), g as (select symbol, isle, min(case when s = 1 then i end) as fi, arg_min(nxo, i) filter (s = 1) as entry, arg_min(nxt, i) filter (s = 1) as entry_t, max(case when s = 0 and was = 1 then i end) as li, max(case when s = 0 and was = 1 then nxo end) as xo, max(case when s = 0 and was = 1 then nxt end) as xt from k where s = 1 or was = 1 group by 1, 2), tr as (select g.symbol, cast(fi + 1 as integer) as entry_i, entry_t, entry, cast(case when xo is not null then li + 1 else ei end as integer) as exit_i, coalesce(xt, et) as exit_t, coalesce(xo, ec) as exit, case when xo is not null then 'rule' else 'end-of-test' end as reason, 'long' as side from g join e using (symbol) where fi is not null and fi < ei)"
TRADE_OUT = "symbol entry_i entry_t entry* exit_i exit_t exit* reason side"


def held(spark, sf_dir):
    b = ind.sma(events(spark, sf_dir), 5)
    return trades.hold_while(b, F.col("c") > F.col("sma"))


@query(out(TRADE_OUT, "tr", f"b as ({BARS}), {HOLD}, {ISLES}"))
def sma_regime_hold_trades(spark, sf_dir):
    return rounded(held(spark, sf_dir), *TRADE_OUT.replace("*", "").split())


@query(out(TRADE_OUT, "tr", f"b as ({BARS}), {CROSS}, {ISLES}"))
def sma_cross_trades(spark, sf_dir):
    b = ind.sma(ind.sma(events(spark, sf_dir), 3, "fast"), 8, "slow")
    return rounded(trades.hold_while(b, F.col("fast") > F.col("slow")), *TRADE_OUT.replace("*", "").split())


@query(f"with b as ({BARS}), cal as (select symbol, t_ms as entry_t, t_ms + {12 * HOUR} as exit_t from b where t_ms % {DAY} = {8 * HOUR} and (t_ms // {DAY} + 3) % 7 = 1) select cal.symbol, entry_t, exit_t, case when e.o is null then 'missing-entry' when x.o is null then 'missing-exit' else 'traded' end as status, round(ln(x.o / e.o), 6) + 0.0 as log_return from cal left join b e on e.symbol = cal.symbol and e.t_ms = entry_t left join b x on x.symbol = cal.symbol and x.t_ms = exit_t")
def timed_return_trades(spark, sf_dir):
    b = events(spark, sf_dir)
    t = F.col("t_ms")
    days = b.where((F.pmod(t, F.lit(DAY)) == 8 * HOUR) & (clock.weekday_utc(t) == 1)).select("symbol", t.alias("entry_t"), (t + 12 * HOUR).alias("exit_t"))
    return rounded(trades.timed_trades(b, days), "symbol", "entry_t", "exit_t", "status", "log_return")


@query()
def donchian_bracket_trades(spark, sf_dir):
    s = signals.donchian_breakout(ind.donchian(ind.atr(events(spark, sf_dir))))
    return rounded(trades.brackets(s, most_bars=20, cooldown=3, target_r=2.0), *TRADE_OUT.replace("*", "").split(), "stop", "target")


COSTS = [("raw", 0.0, 0.0, 0.0), ("realistic", 0.05, 0.02, 1.0), ("harsh", 0.2, 0.1, 5.0)]
COST_SQL = "costs as (select * from (values " + ", ".join(f"('{n}', {a}, {b}, {c})" for n, a, b, c in COSTS) + ") t(label, fee, slippage, slippage_bps))"
PNL = f"b as ({BARS}), {HOLD}, {ISLES}, {COST_SQL}, pn as (select tr.*, costs.label, (exit - (slippage + abs(exit) * slippage_bps / 10000)) - (entry + (slippage + abs(entry) * slippage_bps / 10000)) - fee as pnl from tr cross join costs)"


def priced(spark, sf_dir):
    return trades.with_costs(held(spark, sf_dir), spark.createDataFrame(COSTS, "label string, fee double, slippage double, slippage_bps double"))


EQ = "(partition by label order by entry_t, symbol, entry_i rows between unbounded preceding and current row)"
EQUITY = f"q0 as (select *, 10000.0 + sum(pnl) over {EQ} as equity from pn), eq as (select *, greatest(10000.0, max(equity) over {EQ}) as peak from q0)"


@query(f"with {PNL}, {EQUITY}, x as (select label, count(*) as trades, 100.0 * sum(case when pnl > 0 then 1 else 0 end) / count(*) as win_rate, sum(case when pnl > 0 then pnl else 0.0 end) as w, sum(case when pnl > 0 then 0.0 else abs(pnl) end) as l, max(peak - equity) as dd, max(peak) as pk from eq group by 1) select label, trades, round(win_rate, 6) as win_rate, round(case when l > 0 then w / l when w > 0 then null else 0.0 end, 6) as profit_factor, round(w - l, 6) as net, round((w - l) / trades, 6) as expectancy, round(100 * dd / pk, 6) as drawdown from x")
def cost_row_summary(spark, sf_dir):
    return rounded(report.cost_rows(priced(spark, sf_dir), ["label"]), "label", "trades", "win_rate", "profit_factor", "net", "expectancy", "drawdown")


@query(
    f"with {PNL}, t as (select *, ((entry_t + {10 * HOUR}) % {DAY}) / {float(HOUR)} as hl, cast(year(make_timestamp(entry_t * 1000)) as varchar) as yr from pn where label = 'realistic'), ss as (select *, case when hl < 9 then 'overnight' when hl < 12 then 'open' when hl < 14 then 'lunch' when hl < 18 then 'middle' else 'close' end as session from t), u as ("
    + " union all ".join(f"select '{n}' as grouping, {c} as value, count(*) as trades, cast(sum(case when pnl > 0 then 1 else 0 end) as bigint) as wins, round(sum(pnl), 6) as net from ss group by 2" for n, c in (("session", "session"), ("side", "side"), ("reason", "reason"), ("year", "yr")))
    + ") select * from u"
)
def trade_groupings_sets(spark, sf_dir):
    return rounded(report.groupings(priced(spark, sf_dir).where("label = 'realistic'")), "grouping", "value", "trades", "wins", "net")


@query(f"with {PNL}, {EQUITY} select label, round(max((peak - equity) / peak), 6) as max_drawdown, round(avg(exit_i - entry_i), 6) as avg_bars from eq group by 1")
def max_drawdown(spark, sf_dir):
    return rounded(report.drawdown(priced(spark, sf_dir), ["label"]), "label", "max_drawdown", "avg_bars")


def _rank(place: str) -> str:
    return f"max(case when r = {place} then pnl end)"


@query(f"with {PNL}, n as (select label, pnl, row_number() over (partition by label order by pnl) - 1 as r, count(*) over (partition by label) as n from pn) select label, " + ", ".join(f"round({_rank(f'floor({q} * (n - 1) + 0.5)')}, 6) as q_{round(100 * q)}" for q in (0.05, 0.5, 0.95)) + " from n group by 1")
def nearest_rank_quantiles(spark, sf_dir):
    return rounded(report.ranked(priced(spark, sf_dir), ["label"], "pnl", [0.05, 0.5, 0.95]), "label", "q_5", "q_50", "q_95")


@query(f"with {PNL}, x as (select *, lag(pnl) over (partition by label, symbol order by entry_t, entry_i) as p from pn) select label, symbol, case when p is null then 'first' when p > 0 then 'after-win' else 'after-loss' end as after, count(*) as trades, round(sum(pnl), 6) as net from x group by 1, 2, 3")
def previous_outcome(spark, sf_dir):
    rows = report.previous_outcome(priced(spark, sf_dir), ["label", "symbol"])
    return rounded(rows.groupBy("label", "symbol", "after").agg(F.count("*").alias("trades"), F.sum("pnl").alias("net")), "label", "symbol", "after", "trades", "net")


@query(f"with b as ({BARS}), {HOLD}, {ISLES} select tr.symbol, tr.entry_i, round(max(case when m.i <= exit_i then m.h - entry end), 6) + 0.0 as mfe, round(max(case when m.i <= exit_i then entry - m.l end), 6) + 0.0 as mae, round(max(case when m.i > exit_i then m.h - entry end), 6) + 0.0 as post_mfe from tr join m on m.symbol = tr.symbol and m.i >= entry_i and m.i <= exit_i + 12 group by 1, 2")
def mfe_mae(spark, sf_dir):
    b = ind.indexed(events(spark, sf_dir))
    return rounded(trades.excursions(held(spark, sf_dir), b), "symbol", "entry_i", "mfe", "mae", "post_mfe")


@query("select s.n as fast, l.n as slow, 'fast=' || s.n || ' slow=' || l.n as variant from (values (3), (5)) s(n) cross join (values (8), (13), (21)) l(n)")
def grid_crossjoin(spark, sf_dir):
    return report.grid(spark, fast=[3, 5], slow=[8, 13, 21]).select(F.col("fast").cast("int").alias("fast"), F.col("slow").cast("int").alias("slow"), "variant")


@query(f"with b as ({BARS}), " + ", ".join(f"r{n} as (select symbol, t_ms, {n} as n, case when count(*) over {frame(n)} = {n} then avg(c) over {frame(n)} end as sma, c from b)" for n in (3, 5, 8)) + ", u as (select * from r3 union all select * from r5 union all select * from r8) select n, symbol, count(*) as bars_above from u where c > sma group by 1, 2")
def grid_sma(spark, sf_dir):
    """All variants' means from one shuffle: columns beside each other, then one row a variant."""
    b = events(spark, sf_dir)
    for n in (3, 5, 8):
        b = ind.sma(b, n, f"sma_{n}")
    v = b.select("symbol", "c", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"sma_{n}").alias("sma")) for n in (3, 5, 8)])).alias("x"))
    return v.where("c > x.sma").groupBy(F.col("x.n").alias("n"), "symbol").agg(F.count("*").alias("bars_above"))


@query(f"with {PNL}, y as (select label, cast(year(make_timestamp(entry_t * 1000)) as integer) as year, count(*) as trades, sum(pnl) as net, sum(case when pnl > 0 then pnl else 0.0 end) as g from pn group by 1, 2) select label, year, trades, round(net, 6) as net, round(g / sum(g) over (partition by label), 6) as share, trades < 30 as thin, g / sum(g) over (partition by label) > 0.5 as concentrated, net < 0 as losing from y")
def diagnostics_yearly(spark, sf_dir):
    return rounded(report.yearly(priced(spark, sf_dir), ["label"]), "label", "year", "trades", "net", "share", "thin", "concentrated", "losing")


@query(f"with {PNL}, x as (select label, cast(sum(case when pnl > 0 then 1 else 0 end) as double) as w, cast(count(*) as double) as n from pn group by 1), z as (select *, w / n as p, 1.959963984540054 as z from x) select label, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) as low, round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) as high from z")
def wilson_interval(spark, sf_dir):
    x = priced(spark, sf_dir).groupBy("label").agg(F.sum((F.col("pnl") > 0).cast("double")).alias("w"), F.count("*").cast("double").alias("n"))
    low, high = report.wilson(F.col("w"), F.col("n"))
    return rounded(x.select("label", low.alias("low"), high.alias("high")), "label", "low", "high")


@query(f"with b as ({BARS}), x as (select symbol, t_ms, t_ms - lag(t_ms) over {ALL} as gap from b) select symbol, min(gap) as step_ms, cast(sum(case when gap > {4 * HOUR} then 1 else 0 end) as bigint) as n_gaps from x group by 1")
def bar_gaps(spark, sf_dir):
    b = events(spark, sf_dir).withColumn("gap", F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy("symbol").orderBy("t_ms")))
    return b.groupBy("symbol").agg(F.min("gap").alias("step_ms"), F.sum((F.col("gap") > 4 * HOUR).cast("long")).alias("n_gaps"))


@query(f"with b as ({BARS}), {ATR}, {DC}, g as (select *, case when c > dc_high then 'long' when c < dc_low then 'short' end as side, (t_ms // {DAY} + 3) % 7 < 5 as wk, atr > 0 as vol from dc) select * from (select 0 as step, 'signal' as gate, count(*) filter (side is not null) as n from g union all select 1, 'weekday', count(*) filter (side is not null and wk) from g union all select 2, 'volatile', count(*) filter (side is not null and wk and vol) from g)")
def gate_funnel(spark, sf_dir):
    s = signals.donchian_breakout(ind.donchian(ind.atr(events(spark, sf_dir))))
    names = ["signal", "weekday", "volatile"]
    return signals.funnel(signals.gated(s, signal=F.col("side").isNotNull(), weekday=clock.weekday_utc(F.col("t_ms")) < 5, volatile=F.col("atr") > 0), names)


@query(f"with b as ({H1}), x as (select symbol, t_ms - lag(t_ms) over {ALL} as gap, row_number() over {ALL} as k from b), n as (select symbol, gap, count(*) as n from x where k <= 200 and gap > 0 and gap <= {4 * HOUR} group by 1, 2) select symbol, arg_max(gap, (n, -gap)) as step_ms, max(n) as n from n group by 1")
def timeframe_inference(spark, sf_dir):
    return calendars.timeframe(src.event_bars(spark, sf_dir, HOUR))


@query(f"with b as ({H1}), x as (select symbol, lag(t_ms) over {ALL} + {HOUR} as from_ms, t_ms as to_ms from b), h as (select * from x where to_ms > from_ms) select symbol, from_ms, to_ms, to_ms - from_ms >= {7 * DAY} or cast(floor(((to_ms - 1) // {DAY} - 2) / 7.0) as bigint) > cast(floor((from_ms // {DAY} - 3) / 7.0) as bigint) as weekend, (from_ms // {HOUR}) % 2 = 0 as declared from h")
def closure_gaps(spark, sf_dir):
    """Closures declared for every hole that begins at an even hour."""
    b = src.event_bars(spark, sf_dir, HOUR)
    known = calendars.holes(b, HOUR).where(F.floor(F.col("from_ms") / HOUR) % 2 == 0)
    return calendars.holes(b, HOUR, known)


@query("with d as (select cast(unnest(generate_series(date '2024-01-01', date '2024-12-31', interval 1 day)) as date) as nominal), n as (select nominal from d where day(nominal) in (5, 10, 15, 20, 25) or nominal = last_day(nominal)), b as (select nominal, cast(nominal - cast(unnest(range(0, 15)) as integer) as date) as d from n) select cast(nominal as varchar) as nominal, cast(max(d) as varchar) as settles from b where isodow(d) < 6 and cast(d as varchar) not in ('2024-05-03', '2024-12-31') group by 1")
def settlement_days(spark, sf_dir):
    out = calendars.settlement_days(spark, "2024-01-01", "2024-12-31", ["2024-05-03", "2024-12-31"])
    return out.select(F.col("nominal").cast("string").alias("nominal"), F.col("settles").cast("string").alias("settles"))


@query(f"with {PNL} select label, strftime(make_timestamp(entry_t * 1000), '%Y-%m') as month, count(*) as trades, cast(sum(case when pnl > 0 then 1 else 0 end) as bigint) as wins, round(sum(pnl), 6) as net from pn group by 1, 2")
def monthly_summary(spark, sf_dir):
    return rounded(account.monthly(priced(spark, sf_dir), ["label"]), "label", "month", "trades", "wins", "net")


DAILY = f"dn as (select label, exit_t // {DAY} as day, sum(pnl) as net from pn group by 1, 2), de as (select *, 10000.0 + sum(net) over (partition by label order by day) as equity from dn), dd as (select *, greatest(10000.0, max(equity) over (partition by label order by day)) as pk from de)"


@query(f"with {PNL}, {DAILY} select label, day, round(net, 6) as net, round(equity, 6) as equity, round(net / (equity - net), 6) + 0.0 as growth, round((pk - equity) / pk, 6) + 0.0 as drawdown from dd")
def daily_equity(spark, sf_dir):
    return rounded(account.daily(priced(spark, sf_dir), ["label"]), "label", "day", "net", "equity", "growth", "drawdown")


@query(f"with {PNL}, {DAILY}, n as (select row_number() over (order by day) - 1 as day_no, net / (equity - net) as growth from dd where label = 'realistic'), p as (select r.r as replicate, unnest(range((r.r * 7 + k.k * 3) % 5, (r.r * 7 + k.k * 3) % 5 + 4)) as day_no from range(10) r(r) cross join range(3) k(k)) select replicate, count(*) as days, round(exp(sum(ln(1 + growth))) - 1, 6) + 0.0 as total from p join n using (day_no) group by 1")
def block_bootstrap(spark, sf_dir):
    days = account.daily(priced(spark, sf_dir).where("label = 'realistic'"), ["label"])
    days = days.withColumn("day_no", F.row_number().over(Window.partitionBy("label").orderBy("day")).cast("long") - 1).select("day_no", "growth")
    starts = spark.range(30).select(F.floor(F.col("id") / 3).alias("replicate"), (F.col("id") % 3).alias("piece")).withColumn("start", (F.col("replicate") * 7 + F.col("piece") * 3) % 5)
    return rounded(account.block_bootstrap(days, starts, 4), "replicate", "days", "total")


@query(f"with {PNL}, q as (select * from pn where label = 'realistic'), x as (select m.symbol, m.i, m.t_ms, m.c, coalesce((select sum(pnl) from q where q.symbol = m.symbol and q.exit_i <= m.i), 0.0) as realized, coalesce((select max(m.c - q.entry) from q where q.symbol = m.symbol and q.entry_i <= m.i and m.i < q.exit_i), 0.0) as open_profit from m), y as (select *, 10000.0 + realized + open_profit as equity from x) select symbol, cast(i as bigint) as i, t_ms, round(realized, 6) + 0.0 as realized, round(open_profit, 6) + 0.0 as open_profit, round(equity, 6) as equity, round((greatest(10000.0, max(equity) over (partition by symbol order by i)) - equity) / greatest(10000.0, max(equity) over (partition by symbol order by i)), 6) + 0.0 as drawdown from y")
def account_marks(spark, sf_dir):
    b = ind.indexed(events(spark, sf_dir))
    return rounded(account.marked(b, priced(spark, sf_dir).where("label = 'realistic'")), "symbol", "i", "t_ms", "realized", "open_profit", "equity", "drawdown")


@query(f"with {PNL}, p as (select *, case when entry_t >= 1705276800000 then 'holdout' else 'train' end as part from pn where label = 'raw'), q as (select *, 10000.0 + sum(pnl) over (partition by part order by entry_t, symbol, entry_i rows between unbounded preceding and current row) as equity from p), x as (select *, greatest(10000.0, max(equity) over (partition by part order by entry_t, symbol, entry_i rows between unbounded preceding and current row)) as peak from q) select part, count(*) as trades, round(100.0 * sum(case when pnl > 0 then 1 else 0 end) / count(*), 6) as win_rate, round(sum(pnl), 6) as net, round(100 * max(peak - equity) / max(peak), 6) as drawdown from x group by 1")
def holdout_split(spark, sf_dir):
    return rounded(report.holdout(priced(spark, sf_dir).where("label = 'raw'"), 1705276800000), "part", "trades", "win_rate", "net", "drawdown")


@query(f"with {PNL}, n as (select label, pnl, row_number() over (partition by label order by pnl) - 1 as r, count(*) over (partition by label) as n from pn) select label, round({_rank('ceil(0.9 * n) - 1')}, 6) as ceil_90, round({_rank('floor(0.9 * (n - 1))')}, 6) as floor_90 from n group by 1")
def rank_variants(spark, sf_dir):
    p = priced(spark, sf_dir)
    up, down = (report.ranked(p, ["label"], "pnl", [0.9], how).select("label", F.col("q_90").alias(f"{how}_90")) for how in ("ceil", "floor"))
    return rounded(up.join(down, "label"), "label", "ceil_90", "floor_90")


@query(f"with b as ({H1}), {DAYS}, x as (select b.*, d.pd_h, d.pd_l from b join d on b.symbol = d.symbol and b.t_ms // {DAY} = d.day) select symbol, t_ms, case when h > pd_h and c < pd_h and o < pd_h then 'pd_h' else 'pd_l' end as level, case when h > pd_h and c < pd_h and o < pd_h then 'short' else 'long' end as side from x where (h > pd_h and c < pd_h and o < pd_h) or (l < pd_l and c > pd_l and o > pd_l)")
def named_sweep_signals(spark, sf_dir):
    s = signals.named_sweep(levels.day_context(src.event_bars(spark, sf_dir, HOUR)), ["pd_h", "pd_l"])
    return s.where("side is not null").select("symbol", "t_ms", "level", "side")


@query(f"with b as ({ORDERS}), {ATR}, x as (select *, max(h) over {frame(3, 1)} as hi, min(l) over {frame(3, 1)} as lo, max(h - l) over {frame(3, 1)} as wd, count(*) over {frame(3, 1)} as n from a), s as (select *, case when n = 3 and wd <= 1.0 * atr and c - hi >= 0.25 * atr then 'long' when n = 3 and wd <= 1.0 * atr and lo - c >= 0.25 * atr then 'short' end as side from x) select symbol, t_ms, side, round(lo, 6) as zone_low, round(hi, 6) as zone_high from s where side is not null")
def supply_demand_zones(spark, sf_dir):
    return rounded(signals.supply_demand(ind.atr(src.order_bars(spark, sf_dir)), 3, 1.0, 0.25).where("side is not null"), "symbol", "t_ms", "side", "zone_low", "zone_high")


@query(f"with b as ({H1}), r0 as (select symbol, t_ms // {DAY} as day, max(h) as rh, min(l) as rl, count(*) as n from b where t_ms % {DAY} < {8 * HOUR} group by 1, 2), r as (select * from r0 where n >= 4.0 and rh > rl), x as (select b.*, r.day, rh, rl from b join r on b.symbol = r.symbol and b.t_ms // {DAY} = r.day), y as (select *, case when t_ms % {DAY} < {8 * HOUR} then null when h > rh and l < rl then case when rh - o <= o - rl then 'long' else 'short' end when h > rh then 'long' when l < rl then 'short' end as side from x), z as (select *, count(side) over (partition by symbol, day order by t_ms rows between unbounded preceding and 1 preceding) as seen from y) select symbol, t_ms, side, round(rh, 6) as range_high, round(rl, 6) as range_low from z where side is not null and seen = 0")
def clock_breakout_signals(spark, sf_dir):
    b = src.event_bars(spark, sf_dir, HOUR)
    r = levels.clock_ranges(b, 0, 8, HOUR, 0.5)
    return rounded(signals.clock_breakout(b.withColumn("day", clock.day_utc(F.col("t_ms"))), r, 8).where("side is not null"), "symbol", "t_ms", "side", "range_high", "range_low")


@query(f"with b as ({BARS}), x as (select *, sum(case when c > o then 1 else 0 end) over {frame(2)} as u, sum(case when c < o then 1 else 0 end) over {frame(2)} as d from b), y as (select *, lag(u) over {ALL} as pu, lag(d) over {ALL} as pd from x) select symbol, t_ms, case when u = 2 and pu != 2 then 'long' else 'short' end as side from y where (u = 2 and pu != 2) or (d = 2 and pd != 2)")
def streak_canary_signals(spark, sf_dir):
    return _found(signals.streak_canary(events(spark, sf_dir)))


_family("triple_screen_signals", lambda b: signals.triple_screen(asof.completed_trend(ind.ema(b, 10), src.resample(b, DAY), HOUR, DAY)))
_family("dual_ema_signals", lambda b: signals.dual_ema_resumption(ind.ema(ind.ema(b, 5, "fast"), 20, "slow")))
_family("ema_ribbon_signals", lambda b: signals.ema_ribbon(ind.ema(ind.ema(ind.ema(b, 5, "e1"), 10, "e2"), 20, "e3"), ["e1", "e2", "e3"]))
_family("range_fake_signals", lambda b: signals.range_fake(shapes.narrow_ranges(b, 6, 40)))
_family("triple_push_signals", lambda b: signals.triple_push(shapes.swings(b, 2)))
_family("regime_cross_signals", lambda b: signals.regime_cross(ind.supertrend(ind.hma(ind.volume_stats(b), 9))))


@query()
def seed_variants(spark, sf_dir):
    """Wilder's ATR seeded with a mean (at once), the plain full-window mean, and the EMA that counts from 3 n bars on."""
    b = ind.indexed(ind.ema(ind.wilder_atr(ind.atr_full(events(spark, sf_dir))), 10))
    return rounded(b.withColumn("ema_late", F.when(F.col("i") >= 30, F.col("ema"))), "symbol", "t_ms", "wilder_atr", "atr_full", "ema_late")

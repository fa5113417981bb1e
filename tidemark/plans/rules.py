"""Registered queries over gates, clocks, zones and more families, with their SQL."""

from pyspark.sql import functions as F

from ..functions import clock, indicators as ind
from ..operators import asof, gates, levels, shapes, signals
from ..sources import bars as src
from . import report
from .more import hourly
from .queries import ALL, ATR, BARS, CANDLES, DAY, DAYS, ER, H1, HOUR, PNL, QUOTES, SQL, TR, W, _EVENTS, _found, _quotes, _reduced, _rma, _wma, events, frame, priced, query, rounded

PAST = "(partition by symbol order by t_ms rows between unbounded preceding and 1 preceding)"
UPTO = "(partition by symbol order by t_ms rows between unbounded preceding and current row)"
SIDE = "case when c > o then 'long' else 'short' end as side"
M5 = HOUR // 12


def _sided(spark, sf_dir):
    """Bars with ATR, candles and the side of their body."""
    return shapes.candles(ind.atr(events(spark, sf_dir))).withColumn("side", F.when(F.col("c") > F.col("o"), "long").otherwise("short"))


@query(f"""
with b as ({BARS}), {ATR}, {CANDLES.replace("from b)", "from a)")},
k as (select *, lower >= 0.45 * wide and lower >= 1.5 * body and upper <= 0.35 * wide and c >= o as bp,
  upper >= 0.45 * wide and upper >= 1.5 * body and lower <= 0.35 * wide and c <= o as sp,
  coalesce(c > o and pc < po and c >= po and o <= pc, false) as be, coalesce(c < o and pc > po and c <= po and o >= pc, false) as se,
  coalesce(h > ph and l < pl, false) as ou, {SIDE} from cd)
select symbol, t_ms, side, case when side = 'long' then bp or be or (ou and c > o) else sp or se or (ou and c < o) end as trigger,
  round(case when span <= 0 then 0.5 when side = 'short' then (h - c) / span else (c - l) / span end, 6) + 0.0 as close_at,
  round(case when span <= 0 then 0.0 when side = 'short' then upper / span else lower / span end, 6) + 0.0 as tail,
  coalesce(atr <> 0 and case when side = 'long' then c - l else h - c end between 0.25 * atr and 1.5 * atr, false) as stop_ok,
  case when span <= 0 then false else case when side = 'short' then h - c else c - l end / span >= 0.6 and case when side = 'short' then upper else lower end / span >= 0.2 end as quality
from k""")  # fmt: skip
def entry_gates(spark, sf_dir):
    """Trigger, close location, tail rejection, stop distance and candle quality for the side of each bar's body."""
    b, side = _sided(spark, sf_dir), F.col("side")
    stop = F.when(side == "long", F.col("l")).otherwise(F.col("h"))
    b = b.select("symbol", "t_ms", "side", gates.trigger(side).alias("trigger"), gates.close_location(side).alias("close_at"), gates.tail_rejection(side).alias("tail"),
                 gates.stop_distance(F.col("c"), stop, 0.25, 1.5).alias("stop_ok"), gates.candle_quality(side, 0.2, 0.6).alias("quality"))
    return rounded(b, *b.columns)


@query(f"""
with b as ({BARS}), q as ({H1}), h as (select symbol, t_ms + {4 * HOUR} as hc, cast(sign(c - o) as integer) as x from b),
j as (select q.*, q.t_ms + {HOUR} - h.hc as age, h.x, {SIDE.replace("c >", "q.c >").replace("> o", "> q.o")} from q asof left join h on q.symbol = h.symbol and q.t_ms + {HOUR} >= h.hc),
k as (select symbol, t_ms, side, case when side = 'long' then 1 else -1 end as way, case when age <= {4 * HOUR} then x end as x from j)
select symbol, t_ms, side, coalesce(x = 0 or x = way, false) as not_against, coalesce(x = way, false) as agrees, coalesce(x = 0 or x = -way, false) as fades from k""")
def higher_gates(spark, sf_dir):
    b = asof.completed_trend(hourly(spark, sf_dir), events(spark, sf_dir), HOUR, 4 * HOUR).withColumn("side", F.when(F.col("c") > F.col("o"), "long").otherwise("short"))
    side = F.col("side")
    return b.select("symbol", "t_ms", "side", gates.higher_not_against(side).alias("not_against"), gates.higher_agrees(side).alias("agrees"), gates.higher_fades(side).alias("fades"))


REGIME = f"{ER}, m as (select *, case when er >= 0.4 then 1 when er < 0.3 then 0 end as m from er), rg as (select *, case when coalesce(last_value(m ignore nulls) over {UPTO}, 0) = 1 then 'trending' else 'ranging' end as regime, c - lag(c, 10) over {ALL} as d from m)"


def _regime(spark, sf_dir):
    return shapes.regime(ind.efficiency(events(spark, sf_dir)), 0.4, 0.3)


@query(f"""
with b as ({BARS}), {REGIME}, {DAYS.replace(", d as (select", ", dd as (select")},
x as (select rg.*, {SIDE}, cast(coalesce(sign(rg.d), 0) as integer) as dir, dd.pd_h, dd.pd_l, case when dd.pd_h - dd.pd_l > 0 then (c - dd.pd_l) / (dd.pd_h - dd.pd_l) end as spot
  from rg left join dd on dd.symbol = rg.symbol and dd.day = rg.t_ms // {DAY}),
y as (select *, case when regime = 'trending' and dir <> 0 then 'join_momentum' when spot <= 0.38 then 'buy_lows' when spot >= 0.62 then 'sell_highs' else 'stand_aside' end as day_theme from x)
select symbol, t_ms, side, day_theme, coalesce(er, 0.0) <= 0.35 as calm, regime = 'ranging' or coalesce(er, 0.0) <= 0.45 as day_type_ok,
  case day_theme when 'join_momentum' then dir = case when side = 'long' then 1 else -1 end when 'buy_lows' then side = 'long' when 'sell_highs' then side = 'short' else false end as admitted from y""")
def day_theme(spark, sf_dir):
    """Theme of the day and what it admits; the cap on directed movement; the day type with its escape. No opening location is used here."""
    b = levels.day_context(_regime(spark, sf_dir)).withColumn("trend_dir", F.coalesce(F.signum(F.col("c") - ind.lag("c", 10)).cast("int"), F.lit(0))).withColumn("open_location", F.lit(None).cast("string"))
    b = gates.day_theme(b).withColumn("side", F.when(F.col("c") > F.col("o"), "long").otherwise("short"))
    return b.select("symbol", "t_ms", "side", "day_theme", gates.theme_admits(F.col("side")).alias("admitted"), gates.movement(0.35).alias("calm"), gates.day_types(["ranging"], 0.45).alias("day_type_ok"))


@query(f"""
with b as ({BARS}), {ATR}, m as (select *, min(atr) over {frame(20)} as lo, max(atr) over {frame(20)} as hi from a),
x as (select *, case when i >= 32 and hi > lo then 100 * (atr - lo) / (hi - lo) end as rmv, t_ms % {DAY} / {float(HOUR)} as hu, (t_ms + {10 * HOUR}) as lt, nullif(v, 1) as spread from m)
select symbol, t_ms, coalesce(rmv <= 50, false) as quiet, hu >= 20 or hu < 8 as night, hu >= 8 and hu < 16 as day_hours,
  floor(lt % {DAY} / {HOUR}) in (10, 14, 18) and (lt // {DAY} + 3) % 7 in (0, 1, 2, 3) as local_ok, spread is null or spread <= 20 as spread_ok from x""")
def time_gates(spark, sf_dir):
    """Volatility, UTC hours (over midnight too), local hours and weekdays, and a microstructure filter that skips missing values."""
    b = ind.relative_volatility(ind.atr(events(spark, sf_dir))).withColumn("spread", F.nullif(F.col("v"), F.lit(1.0)))
    return b.select("symbol", "t_ms", gates.quiet(50).alias("quiet"), gates.hours_utc(20, 8).alias("night"), gates.hours_utc(8, 16).alias("day_hours"), gates.local_time([10, 14, 18], [0, 1, 2, 3]).alias("local_ok"), gates.microstructure("spread", 20).alias("spread_ok"))


@query(f"with b as ({BARS}) select symbol, t_ms, (t_ms // {90 * 60_000}) * {90 * 60_000} as slot_ms, (t_ms % {90 * 60_000}) // 60000 as minutes, (t_ms + {10 * HOUR}) // {DAY} as day_local, cast(((t_ms + {10 * HOUR}) // {DAY} + 3) % 7 as integer) as weekday_local from b")
def utc_slots(spark, sf_dir):
    start, minutes = clock.slot_utc(F.col("t_ms"), 90)
    return events(spark, sf_dir).select("symbol", "t_ms", start.alias("slot_ms"), minutes.alias("minutes"), clock.day_local(F.col("t_ms")).alias("day_local"), clock.weekday_local(F.col("t_ms")).alias("weekday_local"))


def _minutes() -> str:
    one = lambda zone, m: f"""
select cast(d as varchar) as date, '{zone}' as zone, {m} as minute, cast(d as timestamp) + interval {m} minute as wall, timezone('{zone}', cast(d as timestamp) + interval {m} minute) as moment from ds"""  # noqa: E731
    parts = " union all ".join(one(z, m) for z in clock.ZONES for m in (60, 90, 150, 540))
    return f"""
with ds as (select distinct cast(o_orderdate as date) + interval 12 year as d from orders where month(o_orderdate) in (3, 11)), x as (select date, zone, minute, wall, moment from ({parts})),
y as (select *, timezone(zone, moment) as b0, timezone(zone, moment + interval 1 hour) as b1, timezone(zone, moment - interval 1 hour) as b2 from x),
z as (select *, case when b0 <> wall then 'nonexistent' when b1 = wall or b2 = wall then 'ambiguous' else 'ok' end as status from y)
select substr(date, 1, 10) as date, zone, minute, case when status = 'ok' then epoch_ms(moment) end as t_ms, status from z"""


@query(_minutes())
def local_minutes(spark, sf_dir):
    """Minutes of local days in March and November of later years, in each zone: some are skipped by the clock, some are there twice."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("d")).where(F.month("d").isin(3, 11))
    d = d.select(F.add_months("d", 144).alias("d")).distinct().withColumn("minute", F.explode(F.array(*[F.lit(m) for m in (60, 90, 150, 540)])))
    out = None
    for zone in clock.ZONES:
        t, status = clock.local_minute(F.col("d"), zone, F.col("minute"))
        one = d.select(F.col("d").cast("string").alias("date"), F.lit(zone).alias("zone"), "minute", t.alias("t_ms"), status.alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
with x as (select distinct o_orderpriority as mode, o_orderstatus as flag from orders),
y as (select *, case mode when '1-URGENT' then '1m' when '2-HIGH' then '5m' when '3-MEDIUM' then '15m' when '4-NOT SPECIFIED' then '1h' when '5-LOW' then ' 4H' else '1w' end as tf, case flag when 'O' then 'auto' when 'F' then 'None' else '1d' end as asked,
  case mode when '1-URGENT' then 'XAUUSD' when '2-HIGH' then 'USDJPY' when '3-MEDIUM' then 'EURUSD' when '4-NOT SPECIFIED' then 'NAS100' else 'OTHER' end as symbol from x),
z as (select *, lower(trim(tf)) as own, case lower(trim(tf)) when '1m' then '1h' when '5m' then '1h' when '15m' then '1h' when '1h' then '4h' when '4h' then '1d' end as up from y)
select mode, flag, up as higher, case when asked = 'auto' then up when lower(asked) = 'none' or lower(asked) = own then null else lower(asked) end as chosen,
  case symbol when 'XAUUSD' then 0.1::double when 'USDJPY' then 0.01::double when 'EURUSD' then 0.0001::double when 'NAS100' then 1.0::double end as pip from z""")
def route_lookups(spark, sf_dir):
    """Higher timeframes and pip sizes by name."""
    x = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("flag")).distinct()
    named = lambda c, table, other: F.coalesce(F.create_map(*[F.lit(v) for p in table.items() for v in p])[F.col(c)], F.lit(other))
    tf = named("mode", {"1-URGENT": "1m", "2-HIGH": "5m", "3-MEDIUM": "15m", "4-NOT SPECIFIED": "1h", "5-LOW": " 4H"}, "1w")
    symbol = named("mode", {"1-URGENT": "XAUUSD", "2-HIGH": "USDJPY", "3-MEDIUM": "EURUSD", "4-NOT SPECIFIED": "NAS100"}, "OTHER")
    return x.select("mode", "flag", clock.higher_timeframe(tf).alias("higher"), clock.higher_timeframe(tf, named("flag", {"O": "auto", "F": "None"}, "1d")).alias("chosen"), gates.pip_size(symbol).alias("pip"))


@query(f"""
with b as ({BARS}), {REGIME}, x as (select *, row_number() over {ALL} as k, max(h) over {frame(10)} as top, min(l) over {frame(10)} as bottom from rg)
select symbol, t_ms, round(last_value(case when regime = 'ranging' then top end ignore nulls) over {UPTO}, 6) as last_top,
  round(last_value(case when regime = 'ranging' then bottom end ignore nulls) over {UPTO}, 6) as last_bottom, cast(k - last_value(case when regime = 'ranging' then k end ignore nulls) over {UPTO} as integer) as last_age from x""")
def last_range_age(spark, sf_dir):
    """Edges of the last bar in a ranging regime and its age."""
    b = _regime(spark, sf_dir).withColumn("top", F.max("h").over(ind.last(10))).withColumn("bottom", F.min("l").over(ind.last(10)))
    return rounded(gates.carried(b, F.col("regime") == "ranging", ["top", "bottom"]), "symbol", "t_ms", "last_top", "last_bottom", "last_age")


@query(f"""
with b as ({BARS}), q as ({H1}), k as (select symbol, lead(t_ms) over {ALL} as known_ms, t_ms as src_ms, c from b)
select q.symbol, q.t_ms, k.src_ms, round(k.c, 6) as src_c from q asof left join (select * from k where known_ms is not null) k on q.symbol = k.symbol and q.t_ms >= k.known_ms""")
def native_rows_asof(spark, sf_dir):
    """The latest higher bar that is known, which is when its successor has begun."""
    known = gates.native_availability(events(spark, sf_dir)).where("available_ms is not null").withColumn("src_ms", F.col("t_ms")).withColumn("src_c", F.col("c"))
    return rounded(asof.asof(hourly(spark, sf_dir), known, ["symbol"], "t_ms", "available_ms", ["src_ms", "src_c"]), "symbol", "t_ms", "src_ms", "src_c")


SUPPLY = f"s0 as (select *, max(h) over {frame(3, 1)} as zh, min(l) over {frame(3, 1)} as zl, max(h - l) over {frame(3, 1)} as wd, count(c) over {frame(3, 1)} as n from a), s1 as (select *, case when n = 3 and wd <= 2.0 * atr and c - zh >= 0.3 * atr then 'long' when n = 3 and wd <= 2.0 * atr and zl - c >= 0.3 * atr then 'short' end as sd, row_number() over {ALL} as k from s0)"


def _zones(spark, sf_dir):
    return signals.supply_demand(ind.atr(events(spark, sf_dir)), narrow=2.0, leave=0.3)


@query(f"""
with b as ({BARS}), {ATR}, {SUPPLY}, zs as (select *, last_value(case when sd is not null then {{'sd': sd, 'zl': zl, 'zh': zh, 'k': k}} end ignore nulls) over {PAST} as z from s1)
select symbol, t_ms, z.sd as side, round(z.zl, 6) as zone_low, round(z.zh, 6) as zone_high, cast(k - z.k as integer) as zone_age, l <= z.zh and h >= z.zl as touched from zs""")
def newest_zones(spark, sf_dir):
    return rounded(gates.newest_zone(_zones(spark, sf_dir)), "symbol", "t_ms", "side", "zone_low", "zone_high", "zone_age", "touched")


FAILED = f"f0 as (select *, max(h) over {frame(20, 3)} as eh, min(l) over {frame(20, 3)} as el, max(h) over {frame(3)} as h3, min(l) over {frame(3)} as l3 from a), f1 as (select symbol, t_ms, case when h3 >= eh + 0.1 * atr and c < eh then 'short' when l3 <= el - 0.1 * atr and c > el then 'long' end as sd from f0)"


@query(f"""
with b as ({BARS}), {ATR}, {SUPPLY}, {FAILED}, u as (select symbol, t_ms, 0 as rank, sd from f1 where sd is not null union all select symbol, t_ms, 1, sd from s1 where sd is not null)
select symbol, t_ms, min(rank) as rank, arg_min(sd, rank) as side from u group by 1, 2""")
def first_orders(spark, sf_dir):
    """One order for each bar, though two families may signal on it."""
    return gates.first_of(signals.failed_breakout(ind.atr(events(spark, sf_dir))), _zones(spark, sf_dir))


@query("""
with w as (select o_custkey as id, list_sort(list_distinct(list(lower(o_orderpriority)))) as ws from orders group by 1)
select id, array_to_string(list_filter(list_concat(ws, list_filter(['5-low', 'extra'], lambda x: not list_contains(ws, x))), lambda x: x not in ('1-urgent', '2-high')), ',') as names from w""")
def level_candidates(spark, sf_dir):
    """Names by customer: those that occur, and two more, without two others, each once."""
    w = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set(F.lower("o_orderpriority"))).alias("ws"))
    return w.select("id", F.array_join(gates.level_names(F.col("ws"), ["5-low", "extra"], ["1-urgent", "2-high"]), ",").alias("names"))


@query(f"""
with b as ({H1}), g as (select *, t_ms - lag(t_ms) over {ALL} as gap from b),
n as (select *, case when gap > {HOUR} and not (gap - {HOUR} >= {7 * DAY} or floor(((t_ms - 1) // {DAY} - 2) / 7.0) > floor(((t_ms - gap + {HOUR}) // {DAY} - 3) / 7.0)) then 1 else 0 end as new from g),
e as (select *, sum(new) over {ALL} as episode from n)
select symbol, t_ms, cast(episode as bigint) as episode, cast(row_number() over (partition by symbol, episode order by t_ms) - 1 as integer) as episode_bar from e""")
def bar_episodes(spark, sf_dir):
    return gates.episodes(hourly(spark, sf_dir), HOUR).select("symbol", "t_ms", "episode", "episode_bar")


def _frozen(aligned: bool) -> str:
    grid = 6 * M5 if aligned else M5
    return f"""
with b as ({_EVENTS.format(w=M5)}), ds as (select symbol, t_ms + {M5 + 60_000} as t_ms from b), s as (select symbol, t_ms, (t_ms // {grid}) * {grid} as end_ms from ds),
j as (select s.symbol, s.t_ms, s.end_ms, count(b.c) as n, arg_min(b.o, b.t_ms) as o, max(b.h) as h, min(b.l) as l, arg_max(b.c, b.t_ms) as c
  from s left join b on b.symbol = s.symbol and b.t_ms >= s.end_ms - {6 * M5} and b.t_ms < s.end_ms group by 1, 2, 3)
select symbol, t_ms, end_ms, case when n < 6 then 'missing' else 'ok' end as status, {", ".join(f"case when n = 6 then round({c}, 6) end as {c}" for c in "ohlc")} from j"""


def _freeze(spark, sf_dir, aligned: bool):
    b = src.event_bars(spark, sf_dir, M5)
    decisions = b.select("symbol", (F.col("t_ms") + M5 + 60_000).alias("t_ms"))
    return rounded(gates.frozen_windows(decisions, b, M5, 6, aligned), "symbol", "t_ms", "end_ms", "status", *"ohlc")


@query(_frozen(False))
def frozen_rolling(spark, sf_dir):
    """The six five-minute bars before each decision, on their own grid."""
    return _freeze(spark, sf_dir, False)


@query(_frozen(True))
def frozen_clock(spark, sf_dir):
    """The half hour of the clock before each decision."""
    return _freeze(spark, sf_dir, True)


@query(f"""
with b as ({BARS}), d as (select symbol, (t_ms // {DAY}) * {DAY} + {DAY} as dc, arg_max(c, t_ms) as dclose from b group by 1, 2)
select b.symbol, b.t_ms, round(d.dclose, 6) as bucket_c from b asof left join d on b.symbol = d.symbol and b.t_ms + {4 * HOUR} >= d.dc""")
def ribbon_buckets(spark, sf_dir):
    """The close of the last whole UTC bucket that has ended by each bar's close."""
    b = events(spark, sf_dir)
    width = 6 * 4 * HOUR
    buckets = b.groupBy("symbol", (F.floor(F.col("t_ms") / width) * width + width).cast("long").alias("dc")).agg(F.max_by("c", "t_ms").alias("bucket_c"))
    got = asof.asof(b.withColumn("t_close", F.col("t_ms") + 4 * HOUR), buckets, ["symbol"], "t_close", "dc", ["bucket_c"])
    return rounded(got, "symbol", "t_ms", "bucket_c")


def _lagged(columns: str, k: int) -> str:
    return ", ".join(f"lag({c}, {k}) over {ALL} as {c}{k}" for c in columns.split())


@query(f"""
with b as ({BARS}), {ATR}, x as (select *, {_lagged("o h l c atr", 1)} from a)
select symbol, t_ms, 'long' as side, round(least(l, l1), 6) as stop from x where c1 < o1 and h1 - l1 >= 0.8 * atr1 and case when h1 > l1 then (c1 - l1) / (h1 - l1) else 1.0 end <= 0.4 and l < l1 and c > o and c > c1""")
def daily_flush_signals(spark, sf_dir):
    return rounded(gates.daily_flush_failure(ind.atr(events(spark, sf_dir)), 0.8, 0.4).where("side is not null"), "symbol", "t_ms", "side", "stop")


@query(f"""
with b as ({H1}), {ATR}, x as (select *, {_lagged("o h l c t_ms", 1)}, {_lagged("o h l c t_ms", 2)} from a),
y as (select *, t_ms % {4 * HOUR} = {3 * HOUR} and t_ms - t_ms2 = {2 * HOUR} as whole, case when h > l then (c - l) / (h - l) else 0.5 end as loc from x)
select symbol, t_ms, case when c2 > o2 then 'short' else 'long' end as side from y where whole and (
  (c2 > o2 and c1 > o1 and c1 - o2 >= 0.2 * atr and h > greatest(h2, h1) and loc <= 0.6) or (c2 < o2 and c1 < o1 and o2 - c1 >= 0.2 * atr and l < least(l2, l1) and case when h > l then (h - c) / (h - l) else 0.5 end <= 0.6))""")
def hour_run_signals(spark, sf_dir):
    return _found(gates.hour_run_exhaustion(ind.atr(hourly(spark, sf_dir)), HOUR, 4, 2, 0.2, 0.6))


# SQL of families that are registered without any: hourly bars b, with ATR a; each gives symbol, t_ms, side.


def _family(name: str, ctes: str, long: str, short: str, atr: bool = True, first: str = "long") -> None:
    """CTEs of which the last is x, and when a side holds; `first` wins where both do."""
    one, two = (f"when {long} then 'long'", f"when {short} then 'short'")
    cases = f"{one} {two}" if first == "long" else f"{two} {one}"
    SQL[name] = f"with b as ({H1}), {ATR + ', ' if atr else ''}{ctes}, s as (select symbol, t_ms, case {cases} end as side from x)\nselect symbol, t_ms, side from s where side is not null"


def _emas(*lengths: int) -> str:
    return "pre as (select *, list(c) over {all} as cs from {src}), em as (select *, {emas} from pre)".replace("{all}", ALL).replace("{emas}", ", ".join(f"{_reduced('cs', f'a + (2.0 / {n + 1}) * (x - a)')} as e{n}" for n in lengths))


def _swung(k: int) -> str:
    around = lambda f, c, a, b: f"{f}({c}) over (partition by symbol order by t_ms rows between {a} and {b})"
    side = lambda f, c: f"case when {around('count', '*', f'{k} preceding', f'{k} following')} = {2 * k + 1} and {c} {'>' if f == 'max' else '<'} {around(f, c, f'{k} preceding', '1 preceding')} and {c} {'>' if f == 'max' else '<'} {around(f, c, '1 following', f'{k} following')} then {c} end"
    return f"w1 as (select *, {side('max', 'h')} as ph, {side('min', 'l')} as pl from a), w2 as (select *, lag(ph, {k}) over {ALL} as sh, lag(pl, {k}) over {ALL} as sl, row_number() over {ALL} as k, lag(c) over {ALL} as c1 from w1)"


_day = f"{DAYS}, f as (select a.*, d.pd_h, d.pd_l from a left join d on d.symbol = a.symbol and d.day = a.t_ms // {DAY})"
_family("break_retest_signals", f"{_day}, x as (select *, max(h) over {frame(12, 1)} as mh, min(l) over {frame(12, 1)} as ml from f)",
        "mh >= pd_h + 0.3 * atr and abs(l - pd_h) <= 0.5 * atr and c > pd_h", "ml <= pd_l - 0.3 * atr and abs(h - pd_l) <= 0.5 * atr and c < pd_l")

_within = f"(partition by symbol, t_ms // {DAY} order by t_ms rows between 4 preceding and current row)"
_family("day_open_reclaim_signals", f"x as (select *, first(o) over {W} as op, max(h) over {_within} as mh, min(l) over {_within} as ml, lag(c) over (partition by symbol, t_ms // {DAY} order by t_ms) as c1 from a)",
        "op - ml >= atr and c1 <= op and c > op", "mh - op >= atr and c1 >= op and c < op")

_family("fib_signals", f"x as (select *, max(h) over {frame(12, 1)} as mh, min(l) over {frame(12, 1)} as ml, arg_max(t_ms, h) over {frame(12, 1)} as th, arg_min(t_ms, l) over {frame(12, 1)} as tl from a)",
        "mh - ml >= 2.0 * atr and th > tl and (mh - l) / (mh - ml) between 0.5 and 0.618 and c > o", "mh - ml >= 2.0 * atr and th < tl and (h - ml) / (mh - ml) between 0.5 and 0.618 and c < o")

_week = f"(t_ms // {DAY} + 3) // 7"
_family("weekend_fade_signals", f"""
y as (select *, {_week} as week, (t_ms // {DAY} + 3) % 7 as wd, row_number() over (partition by symbol, {_week} order by t_ms) as k from b),
e as (select symbol, week + 1 as week, max(h) as eh, min(l) as el, arg_max(c, t_ms) as ec from y where wd >= 5 group by 1, 2),
x as (select y.symbol, y.t_ms, (ec - el) / (eh - el) as at_ from y join e on e.symbol = y.symbol and e.week = y.week where k = 1 and wd = 0)""", "at_ <= 0.2", "at_ >= 0.8", atr=False)  # fmt: skip

_family("down_shock_signals", f"y as (select *, ln(c / lag(c) over {ALL}) as r from b), x as (select *, quantile_cont(abs(r), 0.5) over {frame(20, 1)} as m, count(r) over {frame(20, 1)} as n from y)",
        "n = 20 and r <= -2.0 * 1.4826 * m", "false", atr=False)

_loud = f"x as (select *, case when h > l then (c - l) / (h - l) else 0.5 end as loc, lag(c, 3) over {ALL} as c3, case when count(*) over {frame(20, 1)} = 20 and avg(v) over {frame(20, 1)} > 0 then v / avg(v) over {frame(20, 1)} end as vr from b)"
_family("volume_exhaustion_signals", _loud, "vr >= 1.5 and loc >= 0.7 and c < c3", "vr >= 1.5 and loc <= 0.3 and c > c3", atr=False)

_counter = f"n0 as (select *, coalesce(cast(sign(c - lag(c, 4) over {ALL}) as integer), 0) as sg from b), n1 as (select *, case when sg != coalesce(lag(sg) over {ALL}, 0) then 1 else 0 end as new from n0), n2 as (select *, sum(new) over {ALL} as run from n1), n3 as (select *, row_number() over (partition by symbol, run order by t_ms) * sg as counter from n2)"
_family("counter_nine_signals", f"{_counter}, x as (select *, least(lag(l, 2) over {ALL}, lag(l, 3) over {ALL}) as lo, greatest(lag(h, 2) over {ALL}, lag(h, 3) over {ALL}) as hi from n3)",
        "counter = -3 and l <= lo", "counter = 3 and h >= hi", atr=False)

_family("session_hold_signals", f"""
r as (select symbol, (t_ms // {DAY}) * {DAY} + {8 * HOUR} as done, max(h) as ah, min(l) as al from b where t_ms % {DAY} < {8 * HOUR} group by 1, 2),
j as (select b.*, coalesce(c > ah, false)::int as u, coalesce(c < al, false)::int as d from b asof left join r on r.symbol = b.symbol and b.t_ms >= r.done),
x as (select *, u + lag(u) over {ALL} as su, d + lag(d) over {ALL} as sd, coalesce(lag(u, 2) over {ALL}, 0) as u2, coalesce(lag(d, 2) over {ALL}, 0) as d2 from j)""", "su = 2 and u2 = 0", "sd = 2 and d2 = 0", atr=False)  # fmt: skip

_keltner = _emas(20).replace("{src}", "a") + ", kc as (select *, case when i >= 40 then e20 end as mid, {k} * atr as band from em)"
_family("keltner_reversion_signals", f"{_keltner.replace('{k}', '1.5')}, x as (select * from kc)", "l < mid - band and c > mid - band", "h > mid + band and c < mid + band")
_family("keltner_expansion_signals", f"{_keltner.replace('{k}', '0.8')}, y as (select *, c > mid + band as u, c < mid - band as d from kc), x as (select *, lag(u) over {ALL} as u1, lag(d) over {ALL} as d1 from y)", "u and u1", "d and d1")

_family("dual_ema_signals", _emas(5, 20).replace("{src}", "b") + f", x as (select *, lag(c < e5) over {ALL} as was, e5 > lag(e5) over {ALL} as rise from em)", "e5 > e20 and rise and was and c > e5", "false", atr=False)
_family("ema_ribbon_signals", _emas(5, 10, 20).replace("{src}", "b") + f", y as (select *, case when e5 > e10 and e10 > e20 then 1 when e5 < e10 and e10 < e20 then -1 else 0 end as rb from em), x as (select *, lag(rb) over {ALL} as rp from y)",
        "rb = 1 and rp != 1", "rb = -1 and rp != -1", atr=False)
_trend = f"{ER}, m as (select *, case when er >= 0.4 then 1 when er < 0.4 then 0 end as m from er), " + _emas(10).replace("{src}", "m")
_family("trend_pullback_signals", f"{_trend}, x as (select *, coalesce(last_value(m ignore nulls) over {UPTO}, 0) = 1 as trending, e10 > lag(e10, 3) over {ALL} as rise from em)",
        "trending and rise and l <= e10 and c > e10", "trending and not rise and h >= e10 and c < e10", atr=False)
_family("triple_screen_signals", _emas(10).replace("{src}", "b") + f""",
dy as (select symbol, (t_ms // {DAY}) * {DAY} + {DAY} as done, cast(sign(arg_max(c, t_ms) - arg_min(o, t_ms)) as integer) as tr from b group by 1, 2),
j as (select em.*, case when em.t_ms + {HOUR} - done <= {DAY} then tr end as ht from em asof left join dy on dy.symbol = em.symbol and em.t_ms + {HOUR} >= dy.done),
x as (select *, e10 > lag(e10) over {ALL} as up, lag(h) over {ALL} as h1, lag(l) over {ALL} as l1 from j)""", "ht > 0 and up and l <= e10 and c > h1", "ht < 0 and not up and h >= e10 and c < l1", atr=False)  # fmt: skip

_last3 = "(partition by symbol order by t_ms rows between 120 preceding and current row)"
_steps = lambda c, way: f"({way} * ({c}[-2] - {c}[-3]) > 0 and {way} * ({c}[-1] - {c}[-2]) > 0 and {way} * ({c}[-1] - {c}[-2]) < {way} * ({c}[-2] - {c}[-3]))"
_family("triple_push_signals", _swung(2) + f", y as (select *, list(sh) over {_last3} as hs0, list(sl) over {_last3} as ls0 from w2), x as (select *, list_filter(hs0, lambda v: v is not null) as hs, list_filter(ls0, lambda v: v is not null) as ls from y)",
        f"sl is not null and {_steps('ls', -1)}", f"sh is not null and {_steps('hs', 1)}", first="short")


def _pairs(side: str, swing: str, other: str, neck: str) -> str:
    return f"""
{side}1 as (select *, last_value(case when {swing} is not null then k end ignore nulls) over {PAST} as {side}pk, last_value({swing} ignore nulls) over {PAST} as {side}pp, list({other}) over (partition by symbol order by t_ms rows between 75 preceding and current row) as {side}xs from {{src}}),
{side}2 as (select *, case when {swing} is not null and {side}pk is not null then {{'k': k, 'd': abs({swing} - {side}pp), 'neck': case when k - {side}pk <= 72 then {neck}({side}xs[len({side}xs) - 3 - (k - {side}pk) : len({side}xs) - 3]) end}} end as {side}n from {side}1),
{side}3 as (select *, last_value({side}n ignore nulls) over {UPTO} as {side}p from {side}2)"""


_family("double_extreme_signals", _swung(3) + "," + _pairs("top", "sh", "l", "list_min").replace("{src}", "w2") + "," + _pairs("low", "sl", "h", "list_max").replace("{src}", "top3") + ", x as (select * from low3)",
        "lowp.d <= 0.3 * atr and k - lowp.k <= 12 and c > lowp.neck and c1 <= lowp.neck", "topp.d <= 0.3 * atr and k - topp.k <= 12 and c < topp.neck and c1 >= topp.neck")


_fl = []
for _n in range(3, 11):
    _top, _low, _sh, _sl = f"max(h) over {frame(_n, 1)}", f"min(l) over {frame(_n, 1)}", f"max(h) over {frame(12, _n + 1)}", f"min(l) over {frame(12, _n + 1)}"
    _fl.append(f"{_top} as t{_n}, {_low} as b{_n}, {_sh} as g{_n}, {_sl} as f{_n}, count(c) over {frame(12, _n + 1)} = 12 as w{_n}, lag(c, {_n + 1}) over {ALL} as q{_n}")
_pole = lambda n: f"w{n} and g{n} - f{n} >= 1.5 * atr"
_up = lambda n: f"({_pole(n)} and g{n} - b{n} <= 0.34 * (g{n} - f{n}) and q{n} >= g{n} - 0.25 * (g{n} - f{n}) and c > t{n})"
_down = lambda n: f"({_pole(n)} and t{n} - f{n} <= 0.34 * (g{n} - f{n}) and q{n} <= f{n} + 0.25 * (g{n} - f{n}) and c < b{n})"
SQL["flag_signals"] = f"""
with b as ({H1}), {ATR}, x as (select *, {", ".join(_fl)} from a),
s as (select symbol, t_ms, case {" ".join(f"when {_up(n)} then 'long' when {_down(n)} then 'short'" for n in range(3, 11))} end as side from x)
select symbol, t_ms, side from s where side is not null"""

SQL["psar"] = f"""
with recursive b as ({BARS}), n as (select *, row_number() over {ALL} - 1 as i, lag(h) over {ALL} as h1, lag(l) over {ALL} as l1, lag(h, 2) over {ALL} as h2, lag(l, 2) over {ALL} as l2, lag(c) over {ALL} as c1 from b),
r as (
  select symbol, t_ms, i, case when c >= c1 then 1 else -1 end as way, case when c >= c1 then l1 else h1 end as sar, case when c >= c1 then h else l end as far, 0.02::double as fac, 0 as flip from n where i = 1
  union all
  select symbol, t_ms, i, case when turn then -way else way end, case when turn then far else v end, case when turn then case when way > 0 then l else h end when way > 0 then greatest(far, h) else least(far, l) end,
    case when turn then 0.02::double when (way > 0 and h > far) or (way < 0 and l < far) then least(0.2::double, fac + 0.02::double) else fac end, turn::int
  from (select *, case when way > 0 then l < v else h > v end as turn from (select n.symbol, n.t_ms, n.i, n.h, n.l, r.way, r.far, r.fac,
    case when r.way > 0 then least(r.sar + r.fac * (r.far - r.sar), l1, l2) else greatest(r.sar + r.fac * (r.far - r.sar), h1, h2) end as v from r join n on n.symbol = r.symbol and n.i = r.i + 1) u) w)
select n.symbol, n.t_ms, round(sar, 6) as sar, cast(way as double) as sar_trend, cast(flip as double) as sar_flip from n left join r using (symbol, i)"""

SQL["supertrend"] = f"""
with recursive b as ({BARS}), {TR}, pre as (select *, list(tr) over {ALL} as ts, lag(c) over {ALL} as c1, (h + l) / 2 as mid from tr), n as (select *, {_rma("ts", 10)} as a from pre),
r as (
  select symbol, i, mid + 3.0 * a as up, mid - 3.0 * a as dn, 1.0::double as way from n where i = 9
  union all
  select symbol, i, case when high < up or c1 > up then high else up end, case when low > dn or c1 < dn then low else dn end, case when c > up and way < 0 then 1.0 when c < dn and way > 0 then -1.0 else way end
  from (select n.symbol, n.i, n.c, n.c1, mid + 3.0 * a as high, mid - 3.0 * a as low, r.up, r.dn, r.way from r join n on n.symbol = r.symbol and n.i = r.i + 1) u)
select n.symbol, n.t_ms, round(case when way > 0 then dn else up end, 6) as supertrend, way as st_trend from n left join r using (symbol, i)"""

_KNOWN = f"q as (select *, q_ms + 500 + (q_ms // 1000) % 3 * {HOUR} as av from ({QUOTES}))"


def _late_quotes(spark, sf_dir):
    """Quotes that become known half a second, or one or two hours, after their time."""
    return _quotes(spark, sf_dir).withColumn("available_ms", F.col("t_ms") + 500 + F.floor(F.col("t_ms") / 1000) % 3 * HOUR)


_OF_ONE = "(select symbol, av, max((q_ms, mid)) as x from q group by 1, 2)"


@query(f"with b as ({BARS}), {_KNOWN} select b.symbol, b.t_ms, case when b.t_ms - x[1] <= {2 * HOUR} then x[1] end as quote_ms, case when b.t_ms - x[1] <= {2 * HOUR} then round(x[2], 6) end as mid from b asof left join {_OF_ONE} k on b.symbol = k.symbol and b.t_ms > k.av")
def quotes_known_before(spark, sf_dir):
    return rounded(asof.known_before(events(spark, sf_dir).select("symbol", "t_ms"), _late_quotes(spark, sf_dir), 2 * HOUR), "symbol", "t_ms", "quote_ms", "mid")


@query(f"""
with recursive {PNL.replace("b as", "b as", 1)}, t as (select pnl, row_number() over (order by entry_t, symbol, entry_i) - 1 as number from pn where label = 'realistic'), n as (select count(*) as n from t),
d as (select i, k, cast(floor(cast('0x' || substr(md5('7|' || i || '|' || k), 1, 8) as bigint) * n / 4294967296.0) as bigint) as number from n, range(2000) r(i), range(n) s(k)),
z as (select i, sum(pnl) as net from d join t using (number) group by 1), o as (select net, row_number() over (order by net) - 1 as r, count(*) over () as m from z)
select 'realistic' as run, round(max(case when r = floor(0.05 * (m - 1) + 0.5) then net end), 6) as q_5, round(max(case when r = floor(0.5 * (m - 1) + 0.5) then net end), 6) as q_50, round(max(case when r = floor(0.95 * (m - 1) + 0.5) then net end), 6) as q_95 from o""")
def monte_carlo(spark, sf_dir):
    rows = report.resample_trades(priced(spark, sf_dir).where("label = 'realistic'"), 2000, 7)
    return rounded(report.ranked(rows.withColumn("run", F.lit("realistic")), ["run"], "bootstrap_net", [0.05, 0.5, 0.95]), "run", "q_5", "q_50", "q_95")


SQL["adx"] = f"""
with b as ({BARS}), d as (select *, h - lag(h) over {ALL} as up, lag(l) over {ALL} - l as dn from b),
e as (select symbol, t_ms, case when up > dn and up > 0 then up else 0.0 end as plus, case when dn > up and dn > 0 then dn else 0.0 end as minus from d where up is not null),
f as (select symbol, t_ms, list(plus) over {ALL} as ps, list(minus) over {ALL} as ms from e), g as (select symbol, t_ms, {_rma("ps", 14)} as p, {_rma("ms", 14)} as m from f),
x as (select symbol, t_ms, case when p + m > 0 then 100 * abs(p - m) / (p + m) else 0.0 end as dx from g where p is not null),
y as (select symbol, t_ms, dx, list(dx) over {ALL} as xs from x)
select b.symbol, b.t_ms, round(dx, 6) as dx, round({_rma("xs", 14)}, 6) as adx from b left join y using (symbol, t_ms)"""

SQL["seed_variants"] = f"""
with b as ({BARS}), {ATR}, x as (select *, list(tr) over {ALL} as ts, list(c) over {ALL} as cs, count(*) over {frame(14)} as n from a)
select symbol, t_ms, round({_rma("ts", 14)}, 6) as wilder_atr, round(case when n = 14 then atr end, 6) as atr_full, round(case when i >= 30 then {_reduced("cs", "a + (2.0 / 11) * (x - a)")} end, 6) as ema_late from x"""

_RAILS = f"""k as (select *, row_number() over {ALL} - 1 as j from b),
m as (select *, regr_slope(c, j) over {frame(60)} as slope, regr_intercept(c, j) over {frame(60)} as mid, list({{'x': j, 'h': h, 'l': l}}) over {frame(60)} as pts from k),
rl as (select *, case when len(pts) = 60 then mid + slope * j + list_max(list_transform(pts, lambda p: p.h - (mid + slope * p.x))) end as rail_high,
  case when len(pts) = 60 then mid + slope * j + list_min(list_transform(pts, lambda p: p.l - (mid + slope * p.x))) end as rail_low from m)"""
SQL["channel_rails"] = f"with b as ({BARS}), {_RAILS} select symbol, t_ms, round(rail_high, 6) as rail_high, round(rail_low, 6) as rail_low from rl"
_family("channel_hold_signals", f"""{_RAILS}, v as (select *, coalesce(c > lag(rail_high) over {ALL}, false) as u, coalesce(c < lag(rail_low) over {ALL}, false) as d from rl),
x as (select *, coalesce(lag(u) over {ALL}, false) as u1, coalesce(lag(d) over {ALL}, false) as d1 from v)""", "u and not u1", "d and not d1", atr=False)  # fmt: skip

SQL["regime_cross_signals"] = f"""
with recursive b as ({H1}), {TR}, pre as (select *, list(tr) over {ALL} as ts, lag(c) over {ALL} as c1, (h + l) / 2 as mid, 2 * {_wma("c", 4)} - {_wma("c", 9)} as raw,
  case when count(*) over {frame(20, 1)} = 20 and avg(v) over {frame(20, 1)} > 0 then v / avg(v) over {frame(20, 1)} end as vr from tr),
n as (select *, {_rma("ts", 10)} as a, {_wma("raw", 3)} as hm from pre),
r as (
  select symbol, i, mid + 3.0 * a as up, mid - 3.0 * a as dn, 1.0::double as way from n where i = 9
  union all
  select symbol, i, case when high < up or c1 > up then high else up end, case when low > dn or c1 < dn then low else dn end, case when c > up and way < 0 then 1.0 when c < dn and way > 0 then -1.0 else way end
  from (select n.symbol, n.i, n.c, n.c1, mid + 3.0 * a as high, mid - 3.0 * a as low, r.up, r.dn, r.way from r join n on n.symbol = r.symbol and n.i = r.i + 1) u),
x as (select n.symbol, n.t_ms, vr, way, c - hm as d, lag(c - hm) over (partition by n.symbol order by n.t_ms) as p from n left join r using (symbol, i)),
s as (select symbol, t_ms, case when vr > 1 and d > 0 and p <= 0 and way > 0 then 'long' when vr > 1 and d < 0 and p >= 0 and way < 0 then 'short' end as side from x)
select symbol, t_ms, side from s where side is not null"""

"""Streams of ticks and bars: tumbling bars under a watermark, and rules whose state lives in Spark's state store.

The rules' step functions are the batch definitions, one bar at a time; a replayed stream gives the batch result, except
that what is still open stays open. The rows of one micro-batch have no order of their own and are put in order of time; a bar
that is not later than the last one of an earlier micro-batch, or comes twice, is returned as an error and changes nothing.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bar_stream(ticks: DataFrame, symbol: str, ts: str, price: str, order: list[str], width: str, late: str) -> DataFrame:
    """Bars of a stream of ticks (ts a timestamp), each once its window is older than the watermark."""
    when = F.struct("_ts", *[f"_{c}" for c in order])
    rows = ticks.select(F.col(symbol).alias("symbol"), F.col(ts).alias("_ts"), F.col(price).alias("p"), *[F.col(c).alias(f"_{c}") for c in order]).withWatermark("_ts", late)
    out = rows.groupBy("symbol", F.window("_ts", width)).agg(F.min_by("p", when).alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", when).alias("c"), F.count("*").cast("double").alias("v"))
    return out.select("symbol", F.unix_millis("window.start").alias("t_ms"), *"ohlcv")


def hold_step(state: dict, bar: dict, n: int) -> list[dict]:
    """Long while the close is above the mean of the last n: events fill at the bar after the one that decided."""
    events = []
    if state["want"] != state["held"]:
        events.append({"t_ms": bar["t_ms"], "event": "entry" if state["want"] else "exit", "price": bar["o"]})
        state["held"] = state["want"]
    state["closes"] = (state["closes"] + [bar["c"]])[-n:]
    state["want"] = len(state["closes"]) == n and bar["c"] > sum(state["closes"]) / n
    return events


def count_step(state: dict, bar: dict, back: int) -> list[dict]:
    """Run length of closes above or below the close `back` bars before."""
    closes = state["closes"]
    sign = 0 if len(closes) < back else (bar["c"] > closes[-back]) - (bar["c"] < closes[-back])
    run = state["run"]
    state["run"] = 0 if sign == 0 else run + sign if run * sign > 0 else sign
    state["closes"] = (closes + [bar["c"]])[-back:]
    return [{"t_ms": bar["t_ms"], "event": "count", "price": float((state["run"] + 128) % 256 - 128)}]


def _stateful(bars: DataFrame, start: dict, step) -> DataFrame:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        own = json.loads(state.get[1]) if state.exists else dict(start)
        last = state.get[0] if state.exists else None
        out = []
        # Within one micro-batch Spark gives no order, so the batch is put in order; between batches order must hold.
        for bar in pd.concat(list(frames)).sort_values("t_ms").to_dict("records"):
            if last is not None and bar["t_ms"] <= last:
                out.append({"t_ms": bar["t_ms"], "event": "error: out of order", "price": bar["c"]})
                continue
            last = bar["t_ms"]
            out += step(own, bar)
        state.update((last, json.dumps(own)))
        yield pd.DataFrame([{"symbol": key[0], **e} for e in out], columns=["symbol", "t_ms", "event", "price"])

    return bars.groupBy("symbol").applyInPandasWithState(run, "symbol string, t_ms long, event string, price double", "last long, own string", "append", GroupStateTimeout.NoTimeout)


def hold_events(bars: DataFrame, n: int) -> DataFrame:
    """Entries and exits of the hold rule on a stream of bars; an open position stays open at its end."""
    return _stateful(bars, {"want": False, "held": False, "closes": []}, lambda s, b: hold_step(s, b, n))


def counter_events(bars: DataFrame, back: int = 4) -> DataFrame:
    return _stateful(bars, {"run": 0, "closes": []}, lambda s, b: count_step(s, b, back))

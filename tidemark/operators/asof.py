"""As-of joins. Spark has none, so both sides are stacked by time and the last known row is carried along."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock

#: Milliseconds of a block in which rows of one key are put in order.
BLOCK = 7 * clock.DAY


def asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], prefix: str = "", strict: bool = False, max_age: int | None = None, forward: bool = False) -> DataFrame:
    """left with columns of the latest right row at or before left_time (forward: the first at or after).

    Both sides are put in order inside blocks of time (BLOCK), so that one hot key's rows are spread over tasks; each
    block's last right row is carried to later blocks, a row for each block. No range join: work is linear however many
    rows match. With strict an equal time does not count. Rows older than max_age are not taken. Among right rows of one
    time the greatest columns win.
    """
    got = F.struct(F.col(right_time).alias("_at"), *[F.col(c) for c in columns])
    r = right.select(*on, F.col(right_time).alias("_t"), got.alias("_right"), F.lit(None).cast(left.schema.simpleString()).alias("_left"))
    l_ = left.select(*on, F.col(left_time).alias("_t"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"))
    first_right = not strict if not forward else strict
    side = F.when(F.col("_left").isNull(), 0 if first_right else 2).otherwise(1)
    both = l_.unionByName(r).withColumn("_side", side).withColumn("_block", F.floor(F.col("_t") / BLOCK))
    way, sign = (F.desc, -1) if forward else (F.asc, 1)
    w = Window.partitionBy(*on, "_block").orderBy(way("_t"), way("_side"), F.col("_right").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("_got", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    last = F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct(F.col("_t") * sign, F.col("_right"))))
    before = Window.partitionBy(*on).orderBy(way("_block")).rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*on, "_block").agg(last.alias("_end")).withColumn("_carried", F.last("_end", ignorenulls=True).over(before))
    keys = (*on, "_block")
    ends = ends.where("_carried is not null").select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_carried")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    out = rows.join(ends, same, "left").withColumn("_got", F.coalesce("_got", "_carried"))
    fresh = F.lit(True) if max_age is None else F.abs(F.col("_t") - F.col("_got._at")) <= max_age
    return out.select("_left.*", *[F.when(fresh, F.col(f"_got.{c}")).alias(f"{prefix}{c}") for c in columns])


def completed_trend(bars: DataFrame, higher: DataFrame, width: int, higher_width: int, exempt: Column | None = None) -> DataFrame:
    """htf_trend of each bar: sign of close less open of the latest higher bar that has closed by the bar's close.

    Null if that one closed more than higher_width before (unless exempt, e.g. over a weekend; columns t_close, htf_close).
    """
    h = higher.select("symbol", (F.col("t_ms") + higher_width).alias("htf_close"), F.signum(F.col("c") - F.col("o")).cast("int").alias("htf_trend"))
    out = asof(bars.withColumn("t_close", F.col("t_ms") + width), h, ["symbol"], "t_close", "htf_close", ["htf_close", "htf_trend"])
    fresh = F.col("t_close") - F.col("htf_close") <= higher_width
    fresh = fresh if exempt is None else fresh | exempt
    return out.withColumn("htf_trend", F.when(fresh, F.col("htf_trend")))


def quote_before(decisions: DataFrame, quotes: DataFrame, max_age: int) -> DataFrame:
    """decisions (symbol, t_ms) with mid and quote_ms of the newest quote strictly before, unless older than max_age."""
    return asof(decisions, quotes.withColumn("quote_ms", F.col("t_ms")), ["symbol"], "t_ms", "t_ms", ["quote_ms", "mid"], strict=True, max_age=max_age)


def quote_after(submits: DataFrame, quotes: DataFrame, deadline: int) -> DataFrame:
    """submits with the first quote at or after, within deadline."""
    return asof(submits, quotes.withColumn("quote_ms", F.col("t_ms")), ["symbol"], "t_ms", "t_ms", ["quote_ms", "mid"], max_age=deadline, forward=True)


def known_before(decisions: DataFrame, quotes: DataFrame, max_age: int) -> DataFrame:
    """quote_before where a quote is known only from its available_ms on: the newest known strictly before; its age counts from its own time (t_ms)."""
    q = quotes.select("symbol", "available_ms", F.col("t_ms").alias("quote_ms"), "mid")
    out = asof(decisions, q, ["symbol"], "t_ms", "available_ms", ["quote_ms", "mid"], strict=True)
    fresh = F.col("t_ms") - F.col("quote_ms") <= max_age
    return out.withColumn("mid", F.when(fresh, F.col("mid"))).withColumn("quote_ms", F.when(fresh, F.col("quote_ms")))


def known_after(submits: DataFrame, quotes: DataFrame, deadline: int, freshness: int) -> DataFrame:
    """The first quote that becomes known at or after, within deadline; null if it was older than freshness by then."""
    q = quotes.select("symbol", "available_ms", F.col("t_ms").alias("quote_ms"), "mid", (F.col("available_ms") - F.col("t_ms")).alias("_late"))
    out = asof(submits, q, ["symbol"], "t_ms", "available_ms", ["quote_ms", "mid", "_late"], max_age=deadline, forward=True)
    fresh = F.col("_late") <= freshness
    return out.withColumn("mid", F.when(fresh, F.col("mid"))).withColumn("quote_ms", F.when(fresh, F.col("quote_ms"))).drop("_late")


def project(chart: DataFrame, source: DataFrame, width: int, source_width: int, columns: list[str]) -> DataFrame:
    """Context of the latest closed source bar on each chart bar; null if that bar does not end where its successor should begin (a hole fails closed)."""
    s = source.withColumn("src_close", F.col("t_ms") + source_width)
    out = asof(chart.withColumn("t_close", F.col("t_ms") + width), s, ["symbol"], "t_close", "src_close", ["src_close", *columns], prefix="src_")
    fresh = F.col("t_close") - F.col("src_src_close") < source_width
    return out.select(*chart.columns, *[F.when(fresh, F.col(f"src_{c}")).alias(f"src_{c}") for c in columns])

"""What the times of a series say: its timeframe, its holes, declared closures, settlement days."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import clock
from ..functions.indicators import lag


def steps(bars: DataFrame) -> DataFrame:
    """Bars with prev_t and gap_ms, the time since the bar before."""
    return bars.withColumn("prev_t", lag("t_ms")).withColumn("gap_ms", F.col("t_ms") - F.col("prev_t"))


def timeframe(bars: DataFrame, first: int = 200, most: int = 4 * clock.HOUR) -> DataFrame:
    """The commonest step among each series' first bars, no longer than most; ties go to the shorter."""
    rows = steps(bars).withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy("t_ms"))).where((F.col("_k") <= first) & (F.col("gap_ms") > 0) & (F.col("gap_ms") <= most))
    counts = rows.groupBy("symbol", "gap_ms").agg(F.count("*").alias("n"))
    return counts.groupBy("symbol").agg(F.max_by("gap_ms", F.struct("n", (-F.col("gap_ms")).alias("m"))).alias("step_ms"), F.max("n").alias("n"))


def holes(bars: DataFrame, step: int, closures: DataFrame | None = None) -> DataFrame:
    """Stretches [from_ms, to_ms) without a bar: symbol, from_ms, to_ms, weekend, and whether a closure (symbol, from_ms, to_ms) is exactly that stretch."""
    out = steps(bars).where(F.col("gap_ms") > step).select("symbol", (F.col("prev_t") + step).alias("from_ms"), F.col("t_ms").alias("to_ms"))
    out = out.withColumn("weekend", clock.spans_weekend(F.col("from_ms"), F.col("to_ms")))
    if closures is None:
        return out
    known = closures.select("symbol", "from_ms", "to_ms").distinct().withColumn("declared", F.lit(True))
    return out.join(known, ["symbol", "from_ms", "to_ms"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


def settlement_days(spark, first: str, last: str, holidays: list[str], days: tuple[int, ...] = (5, 10, 15, 20, 25)) -> DataFrame:
    """The given days of each month and its last day, each rolled back to a weekday that is no holiday: nominal, settles."""
    dates = spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as nominal").where(F.dayofmonth("nominal").isin(*days) | (F.col("nominal") == F.last_day("nominal")))
    back = dates.withColumn("d", F.explode(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.date_sub("nominal", k))))
    open_ = (F.weekday("d") < 5) & ~F.col("d").cast("string").isin(*holidays) if holidays else F.weekday("d") < 5
    return back.where(open_).groupBy("nominal").agg(F.max("d").alias("settles"))

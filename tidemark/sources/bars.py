"""Bars (symbol, t_ms, o, h, l, c, v): from ticks, tables, JSON fixtures, quote files and binary bar files."""

import struct

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HOUR = 3_600_000
DAY = 24 * HOUR
SCHEMA = "symbol string, tf string, t_ms bigint, o double, h double, l double, c double, v double"
SYMBOL, TIMEFRAME = "^[A-Z][A-Z0-9]{1,31}$", r"^[1-9]\d*[mhdwt]$"


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def bars_from_ticks(ticks: DataFrame, symbol: str, t_ms: Column, price: str, order: list[str], width_ms: int, volume: Column | None = None) -> DataFrame:
    """Tumbling bars: first, highest, lowest and last price, by t_ms and order; volume counts ticks unless given.

    One aggregation with partial sums before its only shuffle; buckets without a tick have no bar.
    """
    keys = [f"_{k}" for k in range(len(order))]
    rows = ticks.select(F.col(symbol).alias("symbol"), t_ms.alias("at"), F.col(price).alias("p"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], (volume if volume is not None else F.lit(1)).alias("q"))
    when = F.struct("at", *keys)
    return rows.groupBy("symbol", (F.floor(F.col("at") / width_ms) * width_ms).cast("long").alias("t_ms")).agg(
        F.min_by("p", when).alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", when).alias("c"), F.sum("q").cast("double").alias("v")
    )


def resample(bars: DataFrame, width_ms: int, step_ms: int | None = None) -> DataFrame:
    """Coarser bars; n_source counts the bars of each, complete says whether all of them, step_ms apart, are there."""
    bucket = (F.floor(F.col("t_ms") / width_ms) * width_ms).cast("long").alias("t_ms")
    out = bars.withColumn("at", F.col("t_ms")).groupBy("symbol", bucket).agg(
        F.min_by("o", "at").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "at").alias("c"), F.sum("v").alias("v"), F.count("*").alias("n_source")
    )
    return out.withColumn("complete", F.col("n_source") == width_ms // step_ms) if step_ms else out


def event_bars(spark: SparkSession, sf_dir: str, width_ms: int = 4 * HOUR) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars_from_ticks(events, "event_type", epoch_ms("ts"), "value", ["event_id"], width_ms)


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of extended price by return flag and line status, with quantity as volume."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("symbol", F.concat("l_returnflag", "l_linestatus"))
    return bars_from_ticks(items, "symbol", epoch_ms("l_shipdate"), "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], DAY, F.col("l_quantity"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of total price by order priority."""
    return bars_from_ticks(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", epoch_ms("o_orderdate"), "o_totalprice", ["o_orderkey"], DAY)


def valid_routes(bars: DataFrame) -> DataFrame:
    """Bars whose symbol and timeframe are well formed."""
    return bars.where(F.col("symbol").rlike(SYMBOL) & F.col("tf").rlike(TIMEFRAME))


def defects(bars: DataFrame) -> DataFrame:
    """Per symbol: bars with a missing or infinite price, with h under l, and repeated times."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    broken = bad("o") | bad("h") | bad("l") | bad("c")
    times = bars.groupBy("symbol", "t_ms").agg(F.count("*").alias("n"), F.sum(broken.cast("long")).alias("broken"), F.sum((F.col("h") < F.col("l")).cast("long")).alias("crossed"))
    return times.groupBy("symbol").agg(F.sum("n").alias("n_bars"), F.sum("broken").alias("n_broken"), F.coalesce(F.sum("crossed"), F.lit(0)).alias("n_crossed"), F.sum((F.col("n") > 1).cast("long")).alias("n_repeated"))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Bars of JSON run fixtures: field bars holds [t, o, h, l, c, v] rows; rows with fewer than six cells are dropped."""
    docs = spark.read.schema("symbol string, timeframe string, bars array<array<double>>").json(path, multiLine=True)
    row = docs.select("symbol", F.col("timeframe").alias("tf"), F.explode("bars").alias("b")).where(F.size("b") >= 6)
    return row.select("symbol", "tf", F.col("b")[0].cast("long").alias("t_ms"), *[F.col("b")[k + 1].alias(n) for k, n in enumerate("ohlcv")])


def quote_defects(spark: SparkSession, path: str) -> DataFrame:
    """How many rows read_quotes takes and drops: n_rows, n_unparsed (a value that is no number), n_crossed (no bid, or ask under bid)."""
    text = spark.read.schema("eventMS string, bid string, ask string").csv(path, header=True)
    t, bid, ask = F.col("eventMS").try_cast("bigint"), F.col("bid").try_cast("double"), F.col("ask").try_cast("double")
    bad = t.isNull() | bid.isNull() | ask.isNull()
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    return text.agg(F.count("*").alias("n_rows"), count(bad).alias("n_unparsed"), count(~bad & ((bid <= 0) | (ask < bid))).alias("n_crossed"))


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quotes of CSV files with header eventMS,bid,ask: t_ms, bid, ask, mid; rows that don't parse, or cross, are dropped; quote_defects counts them."""
    rows = spark.read.schema("eventMS bigint, bid double, ask double").csv(path, header=True, mode="DROPMALFORMED")
    return rows.where("eventMS is not null and bid > 0 and ask >= bid").select(F.col("eventMS").alias("t_ms"), "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"))


def read_pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """Files of a folder with their content; a file whose SHA-256 is not the pinned one is an error when it is read."""
    files = spark.read.format("binaryFile").load(path)
    wrong = F.raise_error(F.concat(F.lit("SHA-256 differs from the pinned one: "), F.col("path")))
    return files.withColumn("content", F.when(F.sha2("content", 256) == sha256.lower(), F.col("content")).otherwise(wrong.cast("binary")))


#: Fixed values of the binary bar format: magic, version, bytes of the header; columns are little-endian doubles.
MAGIC, VERSION, HEADER = 0x31425442, 1, 16


def decode_columns(data: bytes):
    """Columns t, o, h, l, c, v of a binary bar file; v may be missing. Raises ValueError for another or a short file."""
    import numpy as np

    if len(data) < HEADER or struct.unpack_from("<I", data)[0] != MAGIC:
        raise ValueError("not a binary bar file")
    _, version, n, k = struct.unpack_from("<4I", data)
    if version != VERSION or k < 5 or len(data) < HEADER + 8 * n * k:
        raise ValueError("a binary bar file of another version, or cut short")
    return np.frombuffer(data, "<f8", n * k, HEADER).reshape(k, n)[:6]


def read_binary_bars(spark: SparkSession, root: str) -> DataFrame:
    """Bars of <root>/<SYMBOL>/<tf>.bin, each file in a task of its own; files come through Spark's readers."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for symbol, tf, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x = decode_columns(content)
                v = pa.array(x[5], from_pandas=True) if len(x) > 5 else pa.nulls(x.shape[1], pa.float64())
                n = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * n), pa.array([tf] * n), pa.array(x[0].astype(np.int64)), *map(pa.array, x[1:5]), v], names=["symbol", "tf", "t_ms", *"ohlcv"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(root)
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)\.bin$", k)
    return files.select(part(1).alias("symbol"), part(2).alias("tf"), "content").mapInArrow(run, SCHEMA)


class BarFiles(DataSource):
    """`spark.read.format("tidemark_bars")` over one binary bar file a row of option paths (comma-separated); also a sink."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_bars"

    def schema(self) -> str:
        return "t_ms bigint, o double, h double, l double, c double, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            x = decode_columns(f.read())
        for row in zip(*x.tolist(), strict=True):
            v = row[5] if len(row) > 5 and row[5] == row[5] else None
            yield (int(row[0]), *row[1:5], v)


class _Writer(DataSourceWriter):
    """One file for each task, under a folder that all executors share."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, rows):
        import os
        import uuid

        import numpy as np

        x = np.array([[r["t_ms"], r["o"], r["h"], r["l"], r["c"], float("nan") if r["v"] is None else r["v"]] for r in rows], "<f8").reshape(-1, 6)
        if len(x):
            os.makedirs(self.path, exist_ok=True)
            with open(f"{self.path}/{uuid.uuid4().hex}.bin", "wb") as f:
                f.write(struct.pack("<4I", MAGIC, VERSION, len(x), 6) + np.ascontiguousarray(x.T).tobytes())
        return WriterCommitMessage()

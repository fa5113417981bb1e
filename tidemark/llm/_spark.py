"""Small Spark helpers that the corpus operators share."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

#: Tables of more rows or more bytes than this are joined by a shuffle instead of a broadcast.
BROADCAST_IDS = 1_000_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a local one only where none is set and all run on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        shared_dir.own = at
    return at


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def done(*written: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._cut)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def kept(docs: DataFrame, keep: list[str], outputs: str) -> StructType:
    """The schema of the columns keep, then outputs (DDL). A kept column must not be named like an output."""
    new = StructType.fromDDL(outputs)
    if clash := sorted({c.lower() for c in keep} & {c.lower() for c in new.names}):
        raise ValueError(f"kept columns have names of outputs: {', '.join(clash)}; rename them, or keep them in a struct")
    return StructType([docs.schema[c] for c in keep] + new.fields)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _width(field: StructField) -> Column:
    """Bytes of a value, at about: strings and binaries by their length, arrays by 16 for each element, all else 16."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, ArrayType):
        size = F.cardinality(c) * 16
    else:
        return F.lit(16)
    return F.coalesce(size, F.lit(0)) + 16


def small(df: DataFrame, limit: int = BROADCAST_IDS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows and most_bytes bytes; else as it is, for a shuffled join.

    df should be cut: it is counted first.
    """
    width = sum((_width(f).cast("long") for f in df.schema.fields), F.lit(0))
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= most_bytes else df


def join_split(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """rows left joined with facts (one row for each key, cut; size: how many of the rows have the key).

    A key that alone fills a task has the rows' number / partitions or more; of these there can be no more than there are
    partitions, so they are broadcast, and only the other keys' rows meet by a shuffle.
    """
    total = facts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    full = F.col(size) * partitions(rows.sparkSession) >= total
    hot = F.broadcast(facts.where(full))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(~full), key, "left")
    return rows.join(hot, key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node that is reached.

    Each round hooks every node's neighbourhood to its least member (large star, then small star), so chains
    halve and stars finish at once. Each round's edges are a written table; only a count reaches the driver.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join reads it as a shuffle of its own and a hub's many edges can be split.
        written = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(small(written), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        rest = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        new = cut(least.select("a", F.col("m").alias("b")).union(rest).distinct(), "edges")
        done(e, written)
        # A forest of stars is the fixed point: no node is both a child and a root, no child has two roots.
        mixed = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        e = new
        if not mixed and not new.groupBy("a").count().where("count > 1").limit(1).count():
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

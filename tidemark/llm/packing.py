"""Conflict-constrained best-fit packing of documents into bins of `capacity` words.

A document longer than a bin is cut into pieces, none is lost. Pieces are dealt by a hash into shards of about
`shard` pieces, and each shard is packed apart, so that no task holds more than that, however large a source or a
group of copies is. Within a shard, pieces come largest first. Open bins are ordered by what is left in them and carry
bitmaps of their sources and duplicate clusters; from the successor of the piece's size on, bins are tried in that order
until the tightest compatible one is found, else a bin is opened.

A bin never holds two pieces of one duplicate cluster (so neither two of one document), nor, with distinct_sources, of
one source. Defined results: a document without words has one row with a null bin; a null source or cluster conflicts
with nothing but the own document's pieces; ties go to the lower doc_id; repeated rows are packed each; an empty table
gives no rows.
"""

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _spark, _text

CAPACITY, SHARD = 2048, 2048


def best_fit(sizes, sources, clusters, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and start in it of each piece, in the given order. Sources and clusters are small numbers, -1: no conflict."""
    left: list[tuple[int, int]] = []  # (residual, bin), ordered
    held: list[tuple[int, int]] = []  # bitmaps of sources and clusters
    bins, starts = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        i = bisect_left(left, (size, -1))
        while i < len(left) and (held[left[i][1]][0] & s or held[left[i][1]][1] & c):
            i += 1
        if i < len(left):
            room, b = left.pop(i)
        else:
            room, b = capacity, len(held)
            held.append((0, 0))
        held[b] = (held[b][0] | s, held[b][1] | c)
        insort(left, (room - size, b))
        bins.append(b)
        starts.append(capacity - room)
    return bins, starts


def _codes(column: pa.ChunkedArray) -> list[int]:
    """A small number for each value, -1 for null."""
    return np.asarray(column.combine_chunks().dictionary_encode().indices.fill_null(-1)).tolist()


def _shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        bins, starts = best_fit(table.column("n_words").to_pylist(), _codes(table.column("source")), _codes(table.column("cluster")), capacity)
        ids = [(s << 24) + b for s, b in zip(table.column("shard").to_pylist(), bins, strict=True)]
        return table.select(["doc_id", "piece", "start_word", "n_words"]).append_column("bin_id", pa.array(ids, pa.int64())).append_column("bin_start", pa.array(starts, pa.int64()))

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, distinct_sources: bool = True) -> DataFrame:
    """items: doc_id, n_words, source, cluster. Per piece: doc_id, piece, start_word, n_words, bin_id, bin_start (its first word's place in the bin)."""
    source = F.col("source").cast("string") if distinct_sources else F.lit(None).cast("string")
    items = items.select("doc_id", F.col("n_words").cast("long").alias("all"), source.alias("source"), F.coalesce(F.col("cluster").cast("string"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("cluster"))
    items = _spark.cut(items, "items")  # texts are read once, though items are counted first
    pieces = items.where("all > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / capacity))))
    pieces = pieces.withColumn("start_word", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("start_word")))
    total = items.where("all > 0").agg(F.sum(F.ceil(F.col("all") / capacity))).first()[0] or 0
    shards = max(1, -(-int(total) // shard))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards))).drop("all")
    kind = items.schema["doc_id"].dataType.simpleString()
    packed = pieces.groupBy("shard").applyInArrow(_shard(capacity), f"doc_id {kind}, piece long, start_word long, n_words long, bin_id long, bin_start long")
    zero = F.lit(0).cast("long")
    none = items.where("all = 0 or all is null").select("doc_id", zero.alias("piece"), zero.alias("start_word"), zero.alias("n_words"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_start"))
    return packed.union(none)


def _items(batches):
    for batch in batches:
        for part in _text.slices(batch, "_text"):
            words = _text.Words(*_text.buffer(part.column("_text")))
            h, first = words.hashes(_text.LOWER), words.first
            same = b"".join(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest() for a, b in zip(first, first[1:], strict=False))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(words.count), pa.array(np.frombuffer(same, np.int64))], names=["doc_id", "source", "n_words", "cluster"])


def items_of(docs: DataFrame) -> DataFrame:
    """What pack() needs of documents; texts with the same words, whatever the case of A-Z, are one cluster."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "source"))
    return docs.select(F.col("text").cast("string").alias("_text"), "doc_id", "source").mapInArrow(_items, f"{kinds}, n_words long, cluster long")

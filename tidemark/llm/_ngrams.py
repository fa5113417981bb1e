"""Hashed byte n-gram counts of whole texts, many texts at once, and a bounded labelled sample of them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _text


def byte_classes(letters_only: bool) -> np.ndarray:
    """What each byte counts as: digits alike, white space alike; with letters_only, case and all other ASCII too."""
    table = np.arange(256, dtype=np.uint32)
    table[48:58], table[_text.SPACE] = 48, 32
    if letters_only:
        table[65:91] += 32
        table[[b for b in range(128) if not 97 <= b < 123 and not 65 <= b < 91]] = 32
    return table


def counts(texts: pa.Array, size: int, letters_only: bool, n: int = 3) -> np.ndarray:
    """A row for each text: how often each of size hashed n-grams of bytes occurs in it. None spans two texts."""
    data, off = _text.buffer(texts)
    rows = len(off) - 1
    b = byte_classes(letters_only)[data]
    if len(b) < n:
        return np.zeros((rows, size), np.float32)
    m = len(b) - n + 1
    gram = b[:m].copy()
    for k in range(1, n):
        gram = gram * np.uint32(257) + b[k : k + m]
    gram = (gram * np.uint32(2654435761)) >> np.uint32(32 - int(size).bit_length() + 1)
    row = np.repeat(np.arange(rows), np.diff(off))
    whole = row[:m] == row[n - 1 :]
    if letters_only:
        whole &= ~((b[:m] == 32) & (b[1 : m + 1] == 32))
    key = row[:m][whole] * size + gram[whole]
    return np.bincount(key, minlength=rows * size).reshape(rows, size).astype(np.float32)


def even(labels: DataFrame, rows: int) -> DataFrame:
    """At most rows of labels (doc_id, label), by a hash of doc_id: no label has a next row before each other one has as many or all of its own.

    Of a large label only the rows with the least hashes, about twice as many as may be taken, are numbered.
    """
    own = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("_h", F.xxhash64("doc_id"))
    held = own.groupBy("label").agg(F.count("*").alias("_n"))
    most = F.least(F.lit(1.0), (2.0 * rows + 64) / F.col("_n")) * 2.0**64 - 2.0**63
    few = own.join(held, "label").where(F.col("_h").cast("double") <= most)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("_h", "doc_id"))).where(F.col("_r") <= rows)
    return few.orderBy("_r", "_h", "doc_id").limit(rows).select("doc_id", "label")


def labelled(docs: DataFrame, labels: DataFrame, rows: int, size: int, features) -> tuple[list, np.ndarray]:
    """At most rows of labels (doc_id, label), by a hash of doc_id, and what features(texts) makes of their texts. Bounded: rows x size numbers reach the driver.

    Of several texts with one doc_id the least counts.
    """
    few = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    few = F.broadcast(few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                x = features(part.column("text"))
                packed = [np.concatenate([[len(i := np.flatnonzero(r))], i, r[i]]).astype(np.float32).tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(packed, pa.binary())], names=["label", "x"])

    kind = labels.schema["label"].dataType.simpleString()
    found = docs.select("doc_id", "text").where("text is not null").join(few, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")
    found = found.mapInArrow(run, f"label {kind}, x binary").orderBy("label", F.xxhash64("x")).limit(rows).collect()
    out = np.zeros((len(found), size), np.float32)
    for r, row in zip(out, found, strict=True):
        x = np.frombuffer(row["x"], np.float32)
        k = int(x[0])
        r[x[1 : k + 1].astype(np.int64)] = x[k + 1 :]
    return [row["label"] for row in found], out

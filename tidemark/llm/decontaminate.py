"""Benchmark decontamination with a positional inverted index of the corpus.

1. Terms of the benchmark are counted over the whole corpus.
2. Each item's windows (`window` consecutive words; all words of a shorter item) name their two rarest terms. Only
   these terms' postings (term, document, position) are stored.
3. Postings meet the items on their term. Less the term's offset in the item, positions of one occurrence agree: lists
   intersect on (document, item, that difference), and where both rare terms of some window meet, a candidate stands.
4. Candidates are compared with the document's words along that difference; runs of a window's length are hits.

A window of which a term is absent from the corpus is dropped at once. `proximity` finds terms near each other.

Defined results: null or wordless texts have no words and no hits; a null item_id can hit but is not listed; repeated
items count once; repeated documents get equal results; other columns are not read; empty tables give no hits. Words
count as equal if their 64-bit hashes are.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _spark, _text

#: More terms than this are not filtered by a broadcast list (8 bytes each) but by a join; so with anchors.
BROADCAST_TERMS = 1_000_000
U = np.uint64


def _hashed(part: pa.RecordBatch) -> tuple[_text.Words, np.ndarray]:
    words = _text.Words(*_text.buffer(part.column("text")), _text.NOT_WORD)
    return words, words.hashes(_text.LOWER)


def items_of(benchmark: DataFrame) -> DataFrame:
    """ikey, item_id and terms (hashes, in order) of each distinct item that has a word."""

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                words, h = _hashed(part)
                at = pa.array(words.first.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("ikey"), part.column("item_id"), pa.ListArray.from_arrays(at, pa.array(_text.signed(h)))], names=["ikey", "item_id", "terms"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = rows.withColumn("ikey", F.xxhash64("item_id", "text"))
    return rows.mapInArrow(run, "ikey long, item_id string, terms array<long>").where(F.size("terms") > 0)


def _listed(terms: DataFrame):
    """The terms as a broadcast sorted array, or None if they are too many."""
    if terms.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        return None
    return terms.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in terms.collect()], np.int64).view(U)))


def _in(h: np.ndarray, listed) -> np.ndarray:
    if listed is None:
        return np.ones(len(h), bool)
    if not len(listed.value):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(listed.value, h), len(listed.value) - 1)
    return listed.value[at] == h


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms occurs in the corpus: term, occurs."""
    listed = _listed(terms)

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                h = _hashed(part)[1]
                term, n = np.unique(h[_in(h, listed)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_text.signed(term)), pa.array(n)], names=["term", "n"])

    counts = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("occurs"))
    return counts if listed else counts.join(terms, "term", "left_semi")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the terms: term, rid (of the document), pos."""
    listed = _listed(terms)

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                words, h = _hashed(part)
                on = np.flatnonzero(_in(h, listed))
                doc = words.doc[on]
                rid = np.asarray(part.column("rid"))[doc]
                yield pa.RecordBatch.from_arrays([pa.array(_text.signed(h[on])), pa.array(rid), pa.array((on - words.first[doc]).astype(np.int32))], names=["term", "rid", "pos"])

    rows = docs.select("rid", "text").mapInArrow(run, "term long, rid long, pos int")
    return rows if listed else rows.join(terms, "term", "left_semi")


def _rarest(window: int):
    """For each item, the offsets of the two rarest terms of each of its windows that can occur."""

    def run(batches):
        for batch in batches:
            pairs = []
            for counts in batch.column("occurs").to_pylist():
                w, found = min(window, len(counts)), set()
                for a in range(len(counts) - w + 1):
                    rare = sorted(range(a, a + w), key=lambda i: (counts[i], i))[:2]
                    if counts[rare[0]] > 0:
                        found.add((min(rare), max(rare)))
                pairs.append([{"a": a, "b": b} for a, b in sorted(found)])
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("ikey"), batch.column("item_id"), batch.column("terms"), pa.array(pairs, kind)], names=["ikey", "item_id", "terms", "pairs"])

    return run


def anchored(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """items with pairs: the offsets of which two terms to look up for their windows."""
    terms = items.select("ikey", F.posexplode("terms").alias("o", "term")).join(counts, "term", "left")
    lists = terms.groupBy("ikey").agg(F.sort_array(F.collect_list(F.struct("o", F.coalesce("occurs", F.lit(0)).alias("n")))).alias("l"))
    rows = items.join(lists.select("ikey", F.col("l.n").alias("occurs")), "ikey")
    return rows.select("ikey", "item_id", "terms", "occurs").mapInArrow(_rarest(window), "ikey long, item_id string, terms array<long>, pairs array<struct<a:int,b:int>>")


def candidates(index: DataFrame, items: DataFrame) -> DataFrame:
    """Where both rare terms of some window of an item agree: rid, ikey, shift (position less offset)."""
    offsets = F.array_distinct(F.concat("pairs.a", "pairs.b"))
    anchors = items.select("ikey", "terms", F.explode(offsets).alias("o")).select("ikey", "o", F.element_at("terms", F.col("o") + 1).alias("term"))
    met = index.join(_spark.small(_spark.cut(anchors, "anchors"), BROADCAST_TERMS), "term").groupBy("rid", "ikey", (F.col("pos") - F.col("o")).alias("shift"))
    met = met.agg(F.collect_set("o").alias("met")).join(_spark.small(items.select("ikey", "pairs"), 10_000), "ikey")
    return met.where(F.exists("pairs", lambda p: F.array_contains("met", p["a"]) & F.array_contains("met", p["b"]))).select("rid", "ikey", "shift")


def _verify(window: int):
    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                words, h = _hashed(part)
                n_hit, n_items, digests = [], [], []
                for i, found in enumerate(part.column("found").to_pylist()):
                    own = h[words.first[i] : words.first[i + 1]]
                    hit, ids, any_item = np.zeros(len(own), bool), set(), 0
                    for c in found or ():
                        terms = np.frombuffer(c["terms"], ">i8").astype(np.int64).view(U)
                        a, b = max(0, -c["shift"]), min(len(terms), len(own) - c["shift"])
                        same = np.concatenate([[False], own[a + c["shift"] : b + c["shift"]] == terms[a:b], [False]]) if b > a else np.zeros(2, bool)
                        edges = np.flatnonzero(same[1:] != same[:-1])
                        for s, e in edges.reshape(-1, 2):
                            if e - s >= min(window, len(terms)):
                                hit[a + c["shift"] + s : a + c["shift"] + e] = True
                                if c["item_id"] is not None:
                                    ids.add(c["item_id"])
                    n_hit.append(int(hit.sum()))
                    n_items.append(len(ids))
                    digests.append(hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("rid"), pa.array(words.count), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string())],
                    names=["doc_id", "rid", "n_words", "n_hit", "n_items", "items_sha256"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Per row: doc_id, rid (hash of doc_id and text), n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    items = _spark.cut(items_of(benchmark), "items")
    counts = _spark.cut(term_counts(docs, _spark.cut(items.select(F.explode("terms").alias("term")).distinct(), "terms")), "counts")
    items = _spark.cut(anchored(items, counts, window), "anchored")
    wanted = items.select(F.explode(F.transform(F.array_distinct(F.concat("pairs.a", "pairs.b")), lambda o: F.element_at("terms", o + 1))).alias("term")).distinct()
    index = _spark.cut(postings(docs, _spark.cut(wanted, "wanted")), "postings")
    found = candidates(index, items).join(items.select("ikey", "item_id", "terms"), "ikey")
    packed = F.aggregate("terms", F.lit(b""), lambda x, t: F.concat(x, F.unhex(F.lpad(F.hex(t), 16, "0"))))
    found = found.groupBy("rid").agg(F.collect_list(F.struct("item_id", "shift", packed.alias("terms"))).alias("found"))
    found = _spark.cut(found, "found")
    few = _spark.small(_spark.cut(found.select("rid"), "rids"))
    none = docs.join(few, "rid", "left_anti").select("doc_id", "rid", "text", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    some = docs.join(few, "rid", "left_semi").join(found, "rid").select("doc_id", "rid", "text", "found")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = none.union(some).mapInArrow(_verify(window), f"doc_id {kind}, rid long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def proximity(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """Where all terms of a phrase lie within slop words, in any order: rid, ikey, from_pos, to_pos (least stretch from each start).

    index: term, rid, pos; phrases: ikey, terms. A stretch is found in the block of 2 * slop words that holds it, so a
    group never holds more than those positions.
    """
    terms = phrases.select("ikey", F.size(F.array_distinct("terms")).alias("n"), F.explode(F.array_distinct("terms")).alias("term"))
    met = index.join(terms, "term").withColumn("block", F.explode(F.array(F.floor(F.col("pos") / slop), F.floor(F.col("pos") / slop) - 1)))
    block = met.groupBy("rid", "ikey", "n", "block").agg(F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("l")).where(F.size("l") >= F.col("n"))

    def reach(start: Column) -> Column:
        """Least position by which all terms have come, from start on."""
        after = F.filter("l", lambda x: (x["pos"] >= start["pos"]) & (x["pos"] < start["pos"] + slop))
        ends = F.transform(F.array_distinct(F.transform(after, lambda x: x["term"])), lambda t: F.array_min(F.transform(F.filter(after, lambda x: x["term"] == t), lambda x: x["pos"])))
        return F.when(F.size(ends) == F.col("n"), F.array_max(ends))

    starts = F.filter("l", lambda x: F.floor(x["pos"] / slop) == F.col("block"))
    rows = block.select("rid", "ikey", F.explode(F.transform(starts, lambda x: F.struct(x["pos"].alias("from_pos"), reach(x).alias("to_pos")))).alias("s"))
    return rows.select("rid", "ikey", "s.from_pos", "s.to_pos").where("to_pos is not null").distinct()

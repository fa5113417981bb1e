"""Substring dedup by recompression: long word sequences that occur more than once are removed everywhere.

Rounds name, everywhere alike, runs of one word and then pairs of neighbouring symbols, of which the first is of the
round's left half of all symbols and the second of its right half. Names are 64-bit hashes of what they stand for, so
equal substrings get equal symbols inside, whatever stands around them, without a dictionary that all tasks share.
Each symbol keeps its extent: the words on which its name and its ends depend. A window that holds a symbol's extent
can repeat only where that symbol does.

1. Each window picks, of the symbols of the last round whose extents it holds, the one with the least name; so equal
   windows pick equal symbols. The picked symbols are counted over the whole corpus, summed in tasks first.
2. A window whose symbol occurs once cannot repeat. The shared symbols go into a bitmap, which every task gets; what it
   lets through by chance costs time only. Where there are too many for the largest bitmap, occurrences meet by their
   symbols in fragments of the symbols' range instead, and those of shared ones go back to their documents by a join.
   Windows inside long runs of one word, which hold no extent, are always let through.
3. The windows let through meet by their symbols, in fragments of bounded size, and are counted by 64-bit hashes of
   their words; of windows that repeat within a task one is sent on. The single ones go back to their documents.

Only windows of one fragment or one task are compared, HELD at most: among n windows of the whole corpus that makes
n * HELD / 2 comparisons of 64-bit hashes, so less than one false equality is expected at 10^13 windows (100 TB).

Defined results: null and blank texts have no words; windows never span documents; a text of fewer words than a window
keeps all; repeated rows are occurrences of their own, so long ones lose all; other columns are not read.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _deal, _spark, _text

WINDOW, ROUNDS = 35, 4
#: Symbols' occurrences in a fragment at about, and windows in a task before it sends them on.
FRAGMENT, HELD = 50_000, 1_500_000
#: Bits of the bitmap at most (16 MB), for each shared symbol where that suffices, and at least; with less there is none.
MOST_BITS, BITS_EACH, LEAST_BITS_EACH = 1 << 27, 16, 4
#: A list of single windows of more bytes than this is joined by a shuffle, not a broadcast.
BROADCAST_BYTES = 64 << 20
U = np.uint64


def symbols(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name and extent (first word, word after the last) of each symbol of the last round.

    An extent that reaches over an end of its text, which no window can hold, is cut one word beyond it.
    """
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    end = np.append(at[1:], n)
    size = end - at
    name = np.where(size > 1, _text.mix(h[at] * _text.STEP + size.astype(U)), h[at])
    doc = doc[at]
    low, high = at - 1, end + 1  # that a run ends here, the next words say
    for r in range(rounds):
        right = (_text.mix(name + U(2 * r + 1)) >> U(63)).astype(bool)
        joint = np.zeros(len(name), bool)
        same = doc[1:] == doc[:-1]
        joint[:-1] = ~right[:-1] & right[1:] & same
        second = np.zeros(len(name), bool)
        second[1:] = joint[:-1]
        new_low, new_high, new_name = low.copy(), high.copy(), name.copy()
        a = np.flatnonzero(joint)
        new_low[a] = np.minimum(low[a], low[a + 1])
        new_high[a] = np.maximum(high[a], high[a + 1])
        new_name[a] = _text.mix(name[a] * _text.STEP + _text.mix(name[a + 1] + U(r)))
        alone = ~joint & ~second
        b = np.flatnonzero(alone[:-1] & ~right[:-1] & same)  # the next symbol is no right one
        new_high[b] = np.maximum(high[b], high[b + 1])
        c = np.flatnonzero(alone[1:] & right[1:] & same) + 1  # nor is the one before a left one
        new_low[c] = np.minimum(low[c], low[c - 1])
        keep = ~second
        name, low, high, doc = new_name[keep], new_low[keep], new_high[keep], doc[keep]
    return name, low, high


def picked(h: np.ndarray, doc: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols' names, the first words of all windows within one text, and which symbol each picks (-1: none)."""
    name, low, high = symbols(h, doc, rounds)
    m = max(len(h) - window + 1, 0)
    first = np.flatnonzero(doc[:m] == doc[window - 1 :]) if m else np.zeros(0, np.int64)
    a = np.searchsorted(low, first)
    size = np.searchsorted(high, first + window, side="right") - a
    pick = np.full(len(first), -1)
    level = np.arange(len(name))
    width = 1
    while True:
        on = (size >= width) & (size < 2 * width)
        p, q = level[a[on]], level[a[on] + size[on] - width]
        pick[on] = np.where(name[p] <= name[q], p, q)
        if not (size >= 2 * width).any():
            return name, first, pick
        p, q = level[: len(level) - width], level[width:]
        level = np.where(name[p] <= name[q], p, q)
        width *= 2


class Picks:
    """The occurrences of picked symbols in the texts of a slice, by text and place, and the windows that picked them.

    A window that picks none is an occurrence of its own; its number in its text is below 0 and tells its first word.
    """

    def __init__(self, texts: pa.Array, window: int, rounds: int):
        self.words = words = _text.Words(*_text.buffer(texts))
        h = words.hashes(_text.AS_IS)
        name, self.first, pick = picked(h, words.doc, window, rounds)
        self.hash = _text.windows(h, window)[self.first]
        new = np.ones(len(pick), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (pick[1:] < 0)
        begin = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1  # the occurrence of each window
        self.bit = np.arange(len(pick)) - begin[self.of]
        self.bare = pick[begin] < 0
        self.doc = words.doc[self.first[begin]]
        self.symbol = np.where(self.bare, self.hash[begin], name[pick[begin]])
        number = np.arange(len(begin)) - np.searchsorted(self.doc, self.doc)
        self.number = np.where(self.bare, words.first[self.doc] - self.first[begin] - 1, number).astype(np.int32)

    def passed(self, shared, part: pa.RecordBatch) -> np.ndarray:
        """Whether each occurrence is let through: by the bitmap, or as one that the column shared lists."""
        if shared is None:
            listed = [np.frombuffer(x.as_buffer(), np.int32) if x.is_valid else np.zeros(0, np.int32) for x in part.column("shared")]
            at = np.concatenate([x + (np.int64(i) << 32) for i, x in enumerate(listed)]) if listed else np.zeros(0, np.int64)
            return self.bare | np.isin(self.number + (self.doc.astype(np.int64) << 32), at)
        bitmap, bits = shared.value
        at = (self.symbol >> U(64 - bits)).astype(np.int64)
        return self.bare | (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _counts(window: int, rounds: int):
    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                p = Picks(part.column("text"), window, rounds)
                sym, n = np.unique(p.symbol[~p.bare], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_text.signed(sym)), pa.array(n), pa.array(np.zeros(len(n), np.int64))], names=["sym", "n", "bare"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0]), pa.array([int(p.bare.sum())])], names=["sym", "n", "bare"])

    return run


def _segment(bits: int):
    """A 256th of the bitmap."""

    def run(key, table):
        at = table.column("bit").to_numpy() - (key[0].as_py() << (bits - 8))
        held = np.zeros(1 << (bits - 8), np.uint8)
        held[at] = 1
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    return run


def _asked(window: int, rounds: int, buckets: int):
    """The occurrences of symbols, dealt by ranges of the symbols."""

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                p = Picks(part.column("text"), window, rounds)
                on = ~p.bare
                symbol = p.symbol[on]
                yield _deal.deal(((symbol >> U(32)) * U(buckets) >> U(32)).astype(np.int32), symbol=symbol, rid=np.asarray(part.column("rid"))[p.doc[on]], number=p.number[on])

    return run


def _answered(table: pa.Table) -> pa.Table:
    """The occurrences whose symbol is there more than once, by document."""
    symbol, rid, number = _deal.gathered(table, symbol=U, rid=np.int64, number=np.int32)
    _, at, count = np.unique(symbol, return_inverse=True, return_counts=True)
    on = count[at] > 1
    rid, number = rid[on], number[on]
    order = np.argsort(rid, kind="stable")
    rid, number = rid[order], np.ascontiguousarray(number[order])
    first = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]])) if len(rid) else np.zeros(0, np.int64)
    ends = pa.py_buffer((np.concatenate([first, [len(rid)]]) * 4).astype(np.int32))
    return pa.table({"rid": rid[first], "entry": pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(number)])})


def _windows(window: int, rounds: int, shared, buckets: int):
    """Windows that are let through, by occurrence; of those that repeat within the task only the hash, once."""

    def bucket(x: np.ndarray) -> np.ndarray:
        return ((_text.mix(x) >> U(32)) * U(buckets) >> U(32)).astype(np.int32)

    def send(parts: list):
        sizes = np.cumsum([0, *(len(p[0]) for p in parts)])
        symbol, rid, number = (np.concatenate([p[k] for p in parts]) for k in range(3))
        value, bit = (np.concatenate([p[k] for p in parts]) for k in (3, 5))
        of = np.concatenate([p[4] + a for p, a in zip(parts, sizes, strict=False)])
        kinds, at, inverse, count = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
        once = count[inverse] == 1
        of, bit, value = of[once], bit[once], value[once]
        own, place = np.unique(of, return_inverse=True)
        mask = np.zeros(len(own), U)
        np.bitwise_or.at(mask, place, U(1) << bit.astype(U))
        deal = bucket(symbol[own])
        sent = _deal.deal(deal, rid=rid[own], number=number[own], mask=mask)
        flat = _deal.deal(deal[place], window=value)
        empty = pa.nulls(sent.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([*sent.columns, flat.column("window"), empty], names=names)
        all_of = np.concatenate([p[4] + a for p, a in zip(parts, sizes, strict=False)])
        again = _deal.deal(bucket(symbol[all_of[at[count > 1]]]), again=kinds[count > 1])
        empty = pa.nulls(again.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([again.column("bucket"), empty, empty, empty, empty, again.column("again")], names=names)

    names = ["bucket", "rid", "number", "mask", "window", "again"]

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            for part in _text.slices(batch):
                p = Picks(part.column("text"), window, rounds)
                on = p.passed(shared, part)
                where = np.cumsum(on) - 1
                w = on[p.of]
                if not w.any():
                    continue
                rid = np.asarray(part.column("rid"))[p.doc[on]]
                parts.append((p.symbol[on], rid, p.number[on], p.hash[w], where[p.of[w]], p.bit[w]))
                n += int(w.sum())
                if n > HELD:
                    yield from send(parts)
                    parts, n = [], 0
        if n:
            yield from send(parts)

    return run


def _single(table: pa.Table) -> pa.Table:
    """Of each occurrence, the windows that occur once."""
    rid, number, mask, window, again = _deal.gathered(table, rid=np.int64, number=np.int32, mask=U, window=U, again=U)
    _, inverse, count = np.unique(np.concatenate([window, again, again]), return_inverse=True, return_counts=True)
    once = count[inverse[: len(window)]] == 1
    bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    bits[bits] = once
    left = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(U) if len(mask) else mask
    on = left > 0
    entry = np.zeros(int(on.sum()), [("number", "<i4"), ("mask", "<u8")])
    entry["number"], entry["mask"] = number[on], left[on]
    at = pa.py_buffer((np.arange(len(entry) + 1) * 12).astype(np.int32))
    return pa.table({"rid": rid[on], "entry": pa.Array.from_buffers(pa.binary(), len(entry), [None, at, pa.py_buffer(entry.tobytes())])})


def _kept(window: int, rounds: int, shared):
    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                p = Picks(part.column("text"), window, rounds)
                words, on = p.words, p.passed(shared, part)
                begins = on[p.of]
                edge = np.searchsorted(p.doc, np.arange(part.num_rows + 1))
                start = np.searchsorted(p.of, np.arange(len(on) + 1))
                for i, x in enumerate(part.column("single")):
                    if not x.is_valid:
                        continue
                    entry = np.frombuffer(x.as_buffer(), [("number", "<i4"), ("mask", "<u8")])
                    own = p.number[edge[i] : edge[i + 1]]
                    order = np.argsort(own, kind="stable")
                    at = edge[i] + order[np.searchsorted(own, entry["number"], sorter=order)]
                    rows, bit = np.nonzero(np.unpackbits(entry["mask"].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    begins[start[at[rows]] + bit] = False
                depth = np.zeros(len(words) + window + 1, np.int64)
                at = p.first[begins]
                depth[at] += 1
                np.subtract.at(depth, at + window, 1)
                gone = np.cumsum(depth)[: len(words)] > 0
                lost = np.bincount(words.doc[gone], minlength=part.num_rows).astype(np.int64)
                digests = [hashlib.sha256(x).hexdigest() for x in _text.joined(words, ~gone)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.count), pa.array(lost), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed (words in windows that occur elsewhere too), kept_sha256 (of the others, joined by one space)."""
    if not 2 <= window <= 64:
        raise ValueError("window must be 2 to 64 words: an occurrence's windows are marked in 64 bits")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    counts = docs.select("text").mapInArrow(_counts(window, rounds), "sym long, n long, bare long").groupBy("sym").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare"))
    counts = _spark.cut(counts.where("sym is null or n > 1"), "shared")
    kinds, occurrences, bare = counts.agg(F.count("sym"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bare"), F.lit(0))).first()
    buckets = max(_spark.partitions(docs.sparkSession), math.ceil((occurrences + bare) / FRAGMENT))
    if kinds * LEAST_BITS_EACH <= MOST_BITS:
        shared = _bitmap(counts, kinds)
        docs = docs.withColumn("shared", F.lit(None).cast("binary"))
    else:
        shared = None
        asked = docs.select("rid", "text").mapInArrow(_asked(window, rounds, buckets), _deal.schema("symbol", "rid", "number"))
        listed = _by_document(asked.groupBy("bucket").applyInArrow(_answered, "rid long, entry binary"), "shared")
        docs = docs.join(listed, "rid", "left")

    sent = docs.select("rid", "text", "shared").mapInArrow(_windows(window, rounds, shared, buckets), _deal.schema("rid", "number", "mask", "window", "again"))
    single = _by_document(sent.groupBy("bucket").applyInArrow(_single, "rid long, entry binary"), "single")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = docs.join(single, "rid", "left").select("doc_id", "text", "shared", "single")
    return rest.mapInArrow(_kept(window, rounds, shared), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def _bitmap(counts: DataFrame, kinds: int):
    """The shared symbols as a broadcast (bitmap, bits)."""
    bits = max(16, min(MOST_BITS, kinds * BITS_EACH).bit_length() - 1)
    marks = counts.where("sym is not null").select(F.shiftrightunsigned("sym", 64 - bits).alias("bit")).distinct()
    segments = marks.groupBy(F.shiftright("bit", bits - 8).cast("int").alias("segment")).applyInArrow(_segment(bits), "segment int, held binary")
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for segment, held in segments.collect():  # 256 rows, MOST_BITS in all at the most
        bitmap[segment << (bits - 11) : (segment + 1) << (bits - 11)] = np.frombuffer(held, np.uint8)
    return counts.sparkSession.sparkContext.broadcast((bitmap, bits))


def _by_document(entries: DataFrame, name: str) -> DataFrame:
    """The entries of each document (rid) as one binary column; to be broadcast if they are few and small."""
    packed = F.unhex(F.array_join(F.transform(F.collect_list("entry"), F.hex), ""))
    out = _spark.cut(entries.groupBy("rid").agg(packed.alias(name)), name)
    rows, size = out.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    return F.broadcast(out) if rows <= _spark.BROADCAST_IDS and size <= BROADCAST_BYTES else out

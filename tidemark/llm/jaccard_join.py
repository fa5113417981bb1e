"""N-gram Jaccard join with vertical partitioning of the global n-gram order.

The global order of shingles is that of their 64-bit hashes; ranges of it are fragments. Fragments are worked on
apart: each counts how many texts hold each of its shingles, and each adds its part of a pair's overlap.

1. `shingle_sets`: one row per document, its set's size and 128-bit fingerprint. Equal sets are one class from here on.
2. Fragments of the first part of the order count shingles that no second text holds. A set of n shingles with more
   than n - ceil(t n) of them has no link, however the rest looks; most texts end here. No link is lost.
3. For the others, fragments count again among classes, and a prefix filter (rarest first) leaves shingles of which
   any link shares at least one. Classes that share one are candidates; their components are taken by stars, so a
   common shingle costs as many edges as it has classes, not pairs.
4. The classes of a candidate component are dealt by size (links join neighbouring size classes only) into chunks. For
   each two chunks and each fragment of the order a group of bounded size counts the partial overlaps of its pairs,
   as one small matrix; a fragment after which no pair can reach the threshold sends nothing.
5. The matrices of two chunks are summed over the fragments, and pairs that reach the threshold are links. Only a
   spanning forest of them and their number per class go on, never the pairs.

Defined results: null, empty or blank text has no shingles, no links and is its own component; repeated rows and
equal sets are linked; a null doc_id stays null and never names a component unless all of its documents are null;
other columns are not read; an empty table gives an empty result. Shingles count as equal if their 64-bit hashes are,
sets if their 128-bit fingerprints are.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _deal, _spark, _text

#: Shingles in a fragment, and in one of the groups that count partial overlaps, at most about.
FRAGMENT, SEGMENT = 500_000, 250_000
#: Fragments (as a power of 2, at least) in which overlaps are counted.
CUTS = 2
#: Sets that may share a 64-bit name with a different one, at most; more are an error.
CLASHES = 100_000
#: Classes in a chunk: at least and at most, and chunks that a component is dealt into before they grow.
CHUNK, LARGEST_CHUNK, CHUNKS = 64, 512, 32
#: Sets smaller than SHORT count all of the first half of the order, larger ones 3/8 of it: enough, with fewer numbers.
SHORT = 96
U = np.uint64
HALF, THREE_EIGHTHS = U(1 << 63), U(3 << 61)


def _distinct(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the text, hash) of each text's distinct shingles, by text and hash; and the number of texts."""
    words = _text.Words(*_text.buffer(part.column("text")))
    h = words.hashes(_text.LOWER)
    g = _text.windows(h, k)
    whole = words.doc[: len(g)] == words.doc[k - 1 :] if len(g) else np.zeros(0, bool)
    docs, values = [words.doc[: len(g)][whole]], [g[whole]]
    for c in range(1, k):
        few = np.flatnonzero(words.count == c)
        if len(few):
            docs.append(few)
            values.append(_text.mix(_text.windows(h, c)[words.first[few]] + U(c)))
    d, v = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((v, d))
    d, v = d[order], v[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[new], v[new], part.num_rows


def _set_ids(d: np.ndarray, v: np.ndarray, n: int, clash: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, name and second hash of each text's set; both are 0 for the empty set only. Sets in clash have another name."""
    size = np.bincount(d, minlength=n)
    first, second = np.zeros(n, U), np.zeros(n, U)
    np.add.at(first, d, _text.mix(v ^ U(0xA5A5A5A5A5A5A5A5)))
    np.add.at(second, d, _text.mix(v * _text.BASE + U(1)))
    node, twin = (np.where(size > 0, _text.mix(x + size.astype(U)) | U(1), U(0)) for x in (first, second))
    for i in np.flatnonzero(np.isin(node, np.fromiter((a for a, _ in clash), U, len(clash)))) if clash else ():
        node[i] = clash[int(node[i]), int(twin[i])]
    return size, node, twin


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                size, node, twin = _set_ids(*_distinct(part, k))
                columns = [part.column("doc_id"), part.column("rid"), pa.array(size), pa.array(_text.signed(node)), pa.array(_text.signed(twin))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "n", "node", "twin"])

    return run


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, rid (a hash of doc_id and text), n (size of the set of k-word shingles), node and twin (its fingerprint)."""
    return docs.mapInArrow(_sets(k), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rid long, n long, node long, twin long")


def _part(k: int, fragments: int, short: tuple[int, float], clash: dict):
    """The first part of each set: half of the order for small sets, less for others.

    A set counts its lone shingles in half (size under short) or 3/8 of the order. All that it may link to has at
    most 4/3 of its size, so sets send half up to that size: whatever one of them counts, the others have sent.
    """

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                d, v, n = _distinct(part, k)
                size, node, _ = _set_ids(d, v, n, clash)
                on = v < np.where(size < short[0] * short[1], HALF, THREE_EIGHTHS)[d]
                v, d = v[on], d[on]
                counts = (v < THREE_EIGHTHS) | (size[d] < short[0])
                bucket = ((v >> U(31)) * U(fragments) >> U(32)).astype(np.int32)
                # 31 low bits tell shingles of one fragment apart; two that agree by chance are only not called lone.
                token = (v.astype(np.uint32) << np.uint32(1)) | counts.astype(np.uint32)
                yield _deal.deal(bucket, node=node[d], token=token)

    return run


def _lone(buckets: int):
    """Of each class, how many of the fragment's shingles no other text holds."""

    def run(table: pa.Table) -> pa.Table:
        node, token = _deal.gathered(table, node=U, token=np.uint32)
        _, at, count = np.unique(token >> np.uint32(1), return_inverse=True, return_counts=True)
        nodes, lone = np.unique(node[(count[at] == 1) & (token & np.uint32(1)).astype(bool)], return_counts=True)
        return pa.Table.from_batches([_deal.deal((nodes % U(buckets)).astype(np.int32), node=nodes, lone=lone.astype(np.int32))])

    return run


def _lone_sums(table: pa.Table) -> pa.Table:
    node, lone = _deal.gathered(table, node=U, lone=np.int32)
    nodes, at = np.unique(node, return_inverse=True)
    return pa.table({"node": _text.signed(nodes), "lone": np.bincount(at, weights=lone, minlength=len(nodes)).astype(np.int64)})


def _tokens(k: int, clash: dict):
    def run(batches):
        for batch in batches:
            for part in _text.slices(batch):
                d, v, n = _distinct(part, k)
                size, node, _ = _set_ids(d, v, n, clash)
                at = np.concatenate([[0], np.cumsum(size)]) * 8
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))])
                yield pa.RecordBatch.from_arrays([pa.array(_text.signed(node)), pa.array(size), data], names=["node", "n", "tokens"])

    return run


def _fragments(fragments: int):
    def run(batches):
        for batch in batches:
            token, size = _deal.gathered(batch, tokens=U)[0], np.asarray(batch.column("n"))
            node = np.repeat(np.asarray(batch.column("node")), size)
            yield _deal.deal(((token >> U(32)) * U(fragments) >> U(32)).astype(np.int32), node=node, n=np.repeat(size, size), token=token)

    return run


def _shared(buckets: int):
    """The shingles that several classes hold, with their number, dealt out by class."""

    def run(table: pa.Table) -> pa.Table:
        node, n, token = _deal.gathered(table, node=np.int64, n=np.int64, token=U)
        _, at, count = np.unique(token, return_inverse=True, return_counts=True)
        df = count[at]
        on = df > 1
        node = node[on]
        return pa.Table.from_batches([_deal.deal((node.view(U) % U(buckets)).astype(np.int32), node=node, n=n[on], token=token[on], df=df[on])])

    return run


def _prefix(threshold: tuple[int, int]):
    """Of each class's shingles, rarest first, those of which any link shares at least one."""

    def run(table: pa.Table) -> pa.Table:
        node, n, token, df = _deal.gathered(table, node=np.int64, n=np.int64, token=U, df=np.int64)
        order = np.lexsort((token, df, node))
        node, n, token = node[order], n[order], token[order]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        held = np.diff(np.concatenate([first, [len(node)]]))
        rank = np.arange(len(node)) - np.repeat(first, held)
        lone = n - np.repeat(held, held)  # these come before all shared ones
        on = rank < n - _least(n, threshold) + 1 - lone
        return pa.table({"token": _text.signed(token[on]), "node": node[on]})

    return run


def _least(n, threshold: tuple[int, int]):
    """The smallest overlap that a set of n may have with a linked one: ceil(t n)."""
    return -(-n * threshold[0] // threshold[1])


def _need(n, m, threshold: tuple[int, int]):
    """The smallest overlap with which sets of n and m link."""
    return -(-threshold[0] * (n + m) // (threshold[0] + threshold[1]))


_SEGMENTS = "deal int, root long, a long, b long, side int, cut int, node long, n long, weight long, tokens binary"
_PARTIAL = "deal int, root long, a long, b long, nodes binary, size binary, weight binary, side binary, overlap binary"


def _segments(deals: int):
    """Each class once for every two chunks (a, b) that it is in one of, and every fragment; with that fragment's shingles."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in _SEGMENTS.split(", ")}
            size = 0
            for r in batch.to_pylist():
                token = np.frombuffer(r["tokens"], U)  # in the global order
                bounds = np.searchsorted(token, (np.arange(1, 1 << r["bits"], dtype=U)) << U(64 - r["bits"]))
                parts = [p.tobytes() for p in np.split(token, bounds)]
                own = r["level"] << 32 | r["chunk"]
                two = [(min(own, x), max(own, x)) for j in range(r["chunks"]) if (x := r["level"] << 32 | j) != own or r["several"]]
                two += [(own, r["level"] + 1 << 32 | j) for j in range(r["above"])] + [(r["level"] - 1 << 32 | j, own) for j in range(r["below"])]
                for a, b in two:
                    for cut, part in enumerate(parts):
                        if part:
                            values = (hash((r["root"], a, b, cut)) % deals, r["root"], a, b, int(own != a), cut, r["node"], r["n"], r["weight"], part)
                            for column, x in zip(out.values(), values, strict=True):
                                column.append(x)
                            size += len(part)
                if size > 8 << 20:
                    yield _batch(out, _SEGMENTS)
                    out, size = {c: [] for c in out}, 0
            yield _batch(out, _SEGMENTS)

    return run


def _batch(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) for c, k in (x.split() for x in schema.split(", "))], names=list(columns))


def _runs(table: pa.Table, keys: list[str]):
    """The rows of each key, one slice after another."""
    table = table.sort_by([(k, "ascending") for k in keys]).combine_chunks()
    n = table.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        x = np.asarray(table.column(k))
        new[1:] |= x[1:] != x[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), n]
    for p, q in zip(edges, edges[1:], strict=False):
        if q > p:
            yield table.slice(p, q - p)


def _overlaps(token: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many tokens each two of n rows have in common: a 0/1 matrix product, some columns at a time."""
    _, at, count = np.unique(token, return_inverse=True, return_counts=True)
    on = count[at] > 1
    row, column = row[on], (np.cumsum(count > 1) - 1)[at[on]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap, width = np.zeros((n, n), np.float32), 2048
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        p, q = np.searchsorted(column, [a, a + width])
        rows = np.unique(row[p:q])
        held = np.zeros((len(rows), width), np.float32)
        held[np.searchsorted(rows, row[p:q]), column[p:q] - a] = 1
        overlap[np.ix_(rows, rows)] += held @ held.T
    return overlap.astype(np.int64)


def _partial(threshold: tuple[int, int]):
    """For every two chunks and a fragment: the fragment's part of each pair's overlap, unless no pair can link any more."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _PARTIAL.split(", ")}
        for own in _runs(table, ["root", "a", "b", "cut"]):
            node, n, weight, side = (np.asarray(own.column(c)) for c in ("node", "n", "weight", "side"))
            held = np.asarray(pa.compute.binary_length(own.column("tokens"))).astype(np.int64) // 8
            overlap = _overlaps(_deal.gathered(own, tokens=U)[0], np.repeat(np.arange(len(node)), held), len(node))
            rest = n - held
            can = overlap + np.minimum(rest[:, None], rest[None, :]) >= _need(n[:, None], n[None, :], threshold)
            np.fill_diagonal(can, False)
            if not can.any():
                continue
            kind = np.uint16 if held.max() < 1 << 16 else np.uint32
            values = (own.column("deal")[0].as_py(), own.column("root")[0].as_py(), own.column("a")[0].as_py(), own.column("b")[0].as_py())
            packed = (node, n, weight, side.astype(np.uint8), overlap.astype(kind)[np.triu_indices(len(node), 1)])
            for column, x in zip(out.values(), (*values, *(p.tobytes() for p in packed)), strict=True):
                column.append(x)
        return pa.Table.from_batches([_batch(out, _PARTIAL)])

    return run


def _sums(threshold: tuple[int, int]):
    """For every two chunks: partial overlaps summed per pair; of the links a spanning forest, and their number per class."""

    def run(table: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        for own in _runs(table, ["root", "a", "b"]):
            nodes, size, weight = _deal.gathered(own, nodes=np.int64, size=np.int64, weight=np.int64)
            side = _deal.gathered(own, side=np.uint8)[0]
            node, first, place = np.unique(nodes, return_index=True, return_inverse=True)
            size, weight, side = size[first], weight[first], side[first]
            overlap, at = np.zeros((len(node), len(node)), np.int64), 0
            for x, y in zip(own.column("nodes"), own.column("overlap"), strict=True):
                n = len(x.as_buffer()) // 8
                i, j = np.triu_indices(n, 1)
                part = np.frombuffer(y.as_buffer(), np.uint16 if len(y.as_buffer()) == 2 * len(i) else np.uint32)
                i, j, at = place[at + i], place[at + j], at + n
                overlap[np.minimum(i, j), np.maximum(i, j)] += part
            overlap += overlap.T
            linked = threshold[1] * overlap >= threshold[0] * (size[:, None] + size[None, :] - overlap)
            np.fill_diagonal(linked, False)
            if side.max():  # two chunks: the pairs between them
                linked &= side[:, None] != side[None, :]
            root = np.arange(len(node))
            while True:
                new = np.minimum(root, np.where(linked, root[None, :], len(node)).min(1, initial=len(node)))
                new = new[new]
                if (new == root).all():
                    break
                root = new
            for column, x in zip(found, (node, node[root], linked @ weight), strict=True):
                column.append(x)
        node, root, links = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        return pa.table({"node": node, "root": root, "links": links.astype(np.int64)})

    return run


def _levels(threshold: tuple[int, int]):
    """Size class of a set: sets that link are of the same class or of neighbouring ones."""
    return F.floor(F.log("n") / math.log(threshold[1] / threshold[0]) - 1e-9).cast("long")


def _linked(near: DataFrame, held: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links among the classes (node, n, weight) of each candidate component: forest edges and numbers of links (node, root, links)."""
    level = _levels(threshold)
    near = _spark.cut(near.withColumn("level", level), "levels")
    grown = F.least(F.lit(LARGEST_CHUNK), F.greatest(F.lit(CHUNK), F.ceil(F.col("classes") / CHUNKS)))
    levels = near.groupBy("root", "level").agg(F.count("*").alias("classes"), F.sum("n").alias("all"), F.max("n").alias("most"))
    levels = _spark.cut(levels.withColumn("chunks", F.ceil(F.col("classes") / grown).cast("int")), "chunks")
    shingles = F.greatest(2 * F.col("all") / F.col("chunks"), 2 * F.col("most"))
    bits = levels.groupBy("root").agg(F.max(F.greatest(F.lit(CUTS), F.ceil(F.log2(shingles / SEGMENT)))).cast("int").alias("bits"))
    beside = lambda step, name: levels.select("root", (F.col("level") + step).alias("level"), F.col("chunks").alias(name))
    levels = levels.join(beside(-1, "above"), ["root", "level"], "left").join(beside(1, "below"), ["root", "level"], "left").join(bits, "root")
    none = F.lit(0)
    levels = levels.select("root", "level", "chunks", "bits", "all", (F.col("classes") > 1).alias("several"), F.coalesce("above", none).alias("above"), F.coalesce("below", none).alias("below"))
    levels = _spark.cut(levels.where("several or above > 0 or below > 0"), "levels")
    sent = levels.agg(F.coalesce(F.sum(F.col("all") * (F.col("chunks") + F.col("above") + F.col("below"))), none)).first()[0]
    deals = max(_spark.partitions(near.sparkSession), math.ceil(sent / SEGMENT))
    placed = near.join(levels.drop("all"), ["root", "level"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).drop("n")
    segments = placed.join(held, "node").mapInArrow(_segments(deals), _SEGMENTS)
    partial = segments.groupBy("deal").applyInArrow(_partial(threshold), _PARTIAL)
    both = F.pmod(F.xxhash64("root", "a", "b"), F.lit(deals)).cast("int")
    return partial.withColumn("deal", both).groupBy("deal").applyInArrow(_sums(threshold), "node long, root long, links long")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reached by links), n_links (documents that it links to).

    Two documents link if threshold[1] * |intersection| >= threshold[0] * |union| of their sets of k-word shingles.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    return grouped(docs, k, threshold).drop("rid", "group_id")


def grouped(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """near_duplicates of docs (doc_id, rid, text), where rid tells rows apart that have different texts; with rid and
    group_id, a name of the component of its own, also where rows of several components have one doc_id (null: no shingles)."""
    spark = docs.sparkSession
    sets = _spark.cut(shingle_sets(docs, k), "sets")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = _spark.partitions(spark)
    fragments = max(parts, math.ceil(total / 2 / FRAGMENT))
    own = sets.where("n > 0").groupBy("node").agg(F.min("twin").alias("twin"), F.max("twin").alias("other"), F.min("doc_id").alias("least"), F.min("rid").alias("rid"), F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = _spark.cut(own, "classes")
    clash = clashes(sets, classes)
    if clash:  # different sets with one 64-bit name: some other name for each
        new = spark.createDataFrame([(*(int(np.uint64(x).view(np.int64)) for x in key), int(np.uint64(x).view(np.int64))) for key, x in clash.items()], "node long, twin long, new long")
        sets = _spark.cut(sets.join(F.broadcast(new), ["node", "twin"], "left").withColumn("node", F.coalesce("new", "node")).drop("new"), "sets")
        own = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"), F.first("n").alias("n"), F.count("*").alias("copies"))
        classes = _spark.cut(own, "classes")

    short = (SHORT, threshold[1] / threshold[0])
    lone = docs.mapInArrow(_part(k, fragments, short, clash), _deal.schema("node", "token")).groupBy("bucket").applyInArrow(_lone(fragments), _deal.schema("node", "lone"))
    lone = lone.groupBy("bucket").applyInArrow(_lone_sums, "node long, lone long")
    spare = F.col("n") - F.ceil(F.col("n") * threshold[0] / threshold[1])
    open_ = _spark.cut(classes.join(lone, "node", "left").where(F.coalesce("lone", F.lit(0)) <= spare).select("node", "rid", "n", "copies"), "open")

    held = docs.join(_spark.small(open_.select("rid")), "rid", "left_semi").mapInArrow(_tokens(k, clash), "node long, n long, tokens binary")
    held = _spark.cut(held.dropDuplicates(["node"]), "held")
    buckets = max(parts, math.ceil(held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / FRAGMENT))
    shared = held.mapInArrow(_fragments(buckets), _deal.schema("node", "n", "token")).groupBy("bucket").applyInArrow(_shared(buckets), _deal.schema("node", "n", "token", "df"))
    prefix = _spark.cut(shared.groupBy("bucket").applyInArrow(_prefix(threshold), "token long, node long"), "prefix")

    stars = prefix.groupBy("token").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1")
    near = _spark.components(prefix.join(stars, "token").select("a", F.col("node").alias("b")).where("a <> b").distinct())
    near = near.join(open_.select("node", "n", F.col("copies").alias("weight")), "node")
    pairs = _spark.cut(_linked(near, held, threshold), "links")
    _spark.done(prefix, held)

    joined = _spark.components(pairs.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = _spark.cut(joined.join(classes.select("node", "least"), "node"), "joined")
    least = _spark.cut(joined.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("members")), "least")
    found = _spark.join_split(joined.select("node", "root"), least, "root", "members").drop("members")
    degree = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    many = classes.join(found, "node", "left").join(degree, "node", "left").where("copies > 1 or component is not null")
    many = many.select("node", "root", F.coalesce("component", "least").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "copies")
    out = _spark.join_split(sets.where("n > 0"), _spark.cut(many, "many"), "node", "copies")
    out = out.unionByName(sets.where("n = 0"), allowMissingColumns=True)
    links = F.coalesce("links", F.lit(0).cast("long")).alias("n_links")
    group = F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("group_id")
    return out.select("doc_id", "rid", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), links, group)


def clashes(sets: DataFrame, classes: DataFrame) -> dict[tuple[int, int], int]:
    """(node, twin) of different sets that have one node, and a name for each: by the birthday bound a few at 10^11 texts."""
    both = classes.where("twin <> other").select("node")
    if not both.limit(1).count():
        return {}
    rows = sets.join(F.broadcast(both), "node", "left_semi").select("node", "twin").distinct().limit(CLASHES + 1).collect()
    if len(rows) > CLASHES:
        raise ValueError(f"more than {CLASHES} sets share a 64-bit name with another one")
    keys = [(r["node"] & (1 << 64) - 1, r["twin"] & (1 << 64) - 1) for r in rows]
    return {key: int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little") | 1 for key in keys}

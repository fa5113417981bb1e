"""The registered queries without SQL, on their contract's columns, against plain Python over a small fixture."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_ops import brute_patterns, texts
from tidemark.llm import gif, language_id, packing, pii, quality_knn, queries

DIR = "/root/testdata/sf0.001"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def rows():
    own = [*texts()[:40], "call +1 (509) 555-6973 190.137.223.20 now, a.b@c.example.com 4952935900253052", "1.2.3.4.5.6.7.8 4111-1111-1111-1111", "x" * 70_000]
    return [(k, t, ("en", "de", "fr", None)[k % 4], f"s{k % 3}") for k, t in enumerate(own)]


@pytest.fixture(scope="module")
def at(spark, rows, tmp_path_factory):
    """A folder with the fixture's documents, given ones that tell languages and quality apart, and labels."""
    given = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select((F.col("doc_id") + 1000).alias("d"), "text", "lang", "source").collect()]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([*rows, *given], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(f"{folder}/labels.parquet")
    return folder, [*rows, *given]


def test_op1(spark, at):
    got = {r.doc_id: r for r in queries.op1_gif(spark, at[0]).collect()}
    assert len(got) == len(at[1])
    for d, t, *_ in at[1]:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or 64 * (not data))
        media = gif.encode(payload)
        assert tuple(got[d])[1:7] == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media)), d
    same: dict = {}
    for d, t, *_ in at[1]:
        assert same.setdefault(t or "", got[d].feature) == got[d].feature


def test_op2(spark, at):
    got = sorted((r.doc_id, r.start_word, r.n_words, r.bin_id & 0xFFFFFF, r.bin_start) for r in queries.op2_packing(spark, at[0]).collect() if r.n_words)
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "").encode().split()
    pieces = [(d, a, min(packing.CAPACITY, n - a), s, tuple(w)) for d, t, _, s in at[1] for w in [low(t)] for n in [len(w)] for a in range(0, n, packing.CAPACITY)]
    bins, want = [], []
    for d, a, n, s, text in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        fits = [(left, k) for k, (left, sources, held) in enumerate(bins) if left >= n and s not in sources and text not in held]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([packing.CAPACITY, set(), set()])
        want.append((d, a, n, k, packing.CAPACITY - bins[k][0]))
        bins[k] = [bins[k][0] - n, bins[k][1] | {s} - {None}, bins[k][2] | {text}]
    assert got == sorted(want)


def grams(text, size, kinds):
    """Hashed trigrams of bytes, counted one by one."""
    b, out = [int(kinds[x]) for x in (text or "").encode()], np.zeros(size, np.float32)
    for i in range(len(b) - 2):
        if not (kinds is LETTERS and b[i] == 32 and b[i + 1] == 32):
            h = ((b[i] * 257 + b[i + 1]) * 257 + b[i + 2]) * 2654435761 % 2**32
            out[h >> (33 - size.bit_length())] += 1
    return out


LETTERS, ALL = language_id._ngrams.byte_classes(True), language_id._ngrams.byte_classes(False)


def test_op4(spark, at):
    docs = spark.read.parquet(f"{at[0]}/documents.parquet")
    learn = [(d, lang) for d, _, lang, _ in at[1] if lang is not None and crc(d) % 3 != 1]
    model = language_id.fit(docs, spark.createDataFrame(learn, "doc_id long, label string"))
    got = {r.doc_id: r for r in queries.op4_language_id(spark, at[0]).collect()}
    assert len(got) == len(at[1])
    right = []
    for d, t, lang, _ in at[1]:
        assert got[d].held_out == (crc(d) % 3 == 1) and 0 <= got[d].score <= 1
        if not re.search(r"[^\W\d_]", t or ""):
            assert got[d].lang_pred == "und" and got[d].score == 0
            continue
        x = np.log1p(grams(t, language_id.SIZE, LETTERS))
        x = np.append(x / max(np.sqrt((x * x).sum()), 1e-9), 1)
        chance = language_id.softmax((x @ model.family_weights)[None])[0]
        langs = model.families[int(chance.argmax())]
        wins = {a: 0.0 for a in langs}
        for i, a in enumerate(langs):
            for b in langs[i + 1 :]:
                p = 1 / (1 + np.exp(-4.0 * float(x @ model.pair_weights[a, b])))
                wins[a] += (p >= 0.5) + p / 1000
                wins[b] += (p < 0.5) + (1 - p) / 1000
        assert got[d].lang_pred == max(wins, key=wins.get), d
        if got[d].held_out and d >= 1000 and lang and len(t) > 100:
            right.append(got[d].lang_pred == lang)
    assert np.mean(right) > 0.9 and len(right) > 20


def test_op7(spark, at):
    docs = spark.read.parquet(f"{at[0]}/documents.parquet")
    model = quality_knn.fit(docs, queries.labelled_quality(spark, at[0]))
    assert len(model.labels) == spark.read.parquet(f"{at[0]}/labels.parquet").where("doc_id % 1 = 0").toPandas().query("quality == quality").doc_id.drop_duplicates().map(lambda d: crc(d) % 5 != 0).sum()
    got = {r.doc_id: r for r in queries.op7_quality(spark, at[0]).collect()}
    assert len(got) == len(at[1])
    for d, t, *_ in at[1]:
        w = (t or "").encode().split()
        x = np.append(grams(t, quality_knn.SIZE, ALL), sum(a == b for a, b in zip(w, w[1:], strict=False)))
        v = np.log1p(x).astype(np.float32) @ model.weights
        norm = float(np.sqrt((v * v).sum()))
        cos = [float(u @ v) / norm for u in model.vectors] if norm > 0 else [0.0] * len(model.labels)
        near = sorted(cos, reverse=True)[quality_knn.NEIGHBOURS - 1]
        votes = [(max(c, 0) ** quality_knn.POWER, y) for c, y in zip(cos, model.labels, strict=True) if c >= near - 1e-6]
        want = sum(a * y for a, y in votes) / sum(a for a, _ in votes) if sum(a for a, _ in votes) > 0 else model.prior
        assert got[d].held_out == (crc(d) % 5 == 0) and got[d].predicted == int(got[d].score >= 0.3)
        assert abs(got[d].score - want) < 2e-2, (d, got[d].score, want)


def test_op9(spark, at):
    got = {r.doc_id: r for r in queries.op9_pii(spark, at[0]).collect()}
    assert len(got) == len(at[1])
    for d, t, *_ in at[1]:
        base = brute_patterns(t or "")
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base)]
        spans = [x for x in got[d].spans.split(",") if x]
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
        assert got[d].base_sha256 == sha(",".join(listed)) and set(listed) <= set(spans)
        key = [(pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in spans]
        assert key == sorted(key)

"""The pipeline's stages against brute force, on the smallest tables."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import pii, quality_knn
from tidemark.llm.queries import labelled_quality

DIR = "/root/testdata/sf0.001"


def shingles(t):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, DIR)
        rows = out.collect()
        if name == "n-gram Jaccard join":
            ids, sets = sorted(before), {i: shingles(r.text) for i, r in before.items()}
            left = {r.doc_id for r in rows}
            for i in ids:
                linked = [j for j in ids if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
                assert (i in left) or any(j < i for j in linked) or linked
                if not linked:
                    assert i in left
            for i in left:
                assert not any(j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in left)
        if name == "PII":
            assert all(r.n_chars == len(r.text) and not pii.patterns(r.text) for r in rows if r.text) and len(rows) == len(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns and {r.doc_id for r in rows} <= set(before)
            kept[name] = len(rows)
            docs = spark.createDataFrame(rows, docs.schema)
        else:
            assert {r.doc_id for r in rows} == set(before)
            assert sum(r.n_words for r in rows) == sum(len((r.text or "").encode().split()) for r in before.values())
    assert all(kept[n] for n in list(kept)[:-1])
    labels = spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1")
    good = spark.read.parquet(f"{DIR}/documents.parquet").join(labels, "doc_id")
    passed = corpus_pipeline.quality(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR)
    assert passed.join(good.select("doc_id"), "doc_id").count() >= 0.95 * good.count()
    assert corpus_pipeline.run(spark, DIR).agg(F.count("*")).first()[0] > 0


def words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def contaminated(text, items):
    w, hit = words(text, DECON), set()
    for t in items:
        x = words(t, DECON)
        n = min(13, len(x))
        for a in range(len(x) - n + 1 if n else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == x[a : a + n]:
                    hit |= set(range(k, k + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


DECON = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rid long, text2 string, `row` string, id int"


def fixture(spark):
    """Copies, null and repeated ids, repeated rows, empties; columns named like the operators' own."""
    given = spark.read.parquet(f"{DIR}/documents.parquet").where("length(text) between 200 and 3000").orderBy("doc_id").limit(12).collect()
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").first()["text"]
    t = [r.text for r in given]
    near = " ".join([*t[0].split()[:-1], "other"])
    rows = [(k, x) for k, x in enumerate(t)]
    rows += [(None, t[0]), (20, near), (20, t[1] + " and a long new tail " + " ".join(reversed(t[2].split()))), (21, t[3]), (21, t[3]), (3, t[3]), (3, t[3]), (None, None), (None, None), (22, ""), (23, item), (24, "x " * 500 + item)]
    return [(d, x, "en", f"s{k % 3}", len(x or ""), 0.5, 7, "t2", "r", k) for k, (d, x) in enumerate(rows)], item


def test_stages_by_brute_force(spark):
    rows, item = fixture(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {name: [tuple(r) for r in stage(spark, docs, DIR).collect()] for name, stage in corpus_pipeline.STAGES[:-1]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DIR).columns == docs.columns and stage(spark, docs.limit(0), DIR).count() == 0, name
    # quality: what the model says of each text alone
    model = quality_knn.fit(docs, labelled_quality(spark, DIR))
    keep = [r for r in rows if model.score(quality_knn.terms(pa.array([r[1]], pa.string())))[0] >= 0.3]
    assert sorted(out["quality classifier"], key=str) == sorted(keep, key=str)
    # near duplicates: of each group the least (null last), of its repeated rows one
    sets = [shingles(r[1]) for r in rows]
    linked = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in range(len(rows)) if j != i and linked(i, j))]) for i in range(len(rows))]
    want = []
    for g in sorted(set(group)):
        own = [r for r, h in zip(rows, group, strict=True) if h == g]
        want.append(min(own, key=lambda r: (r[0] is None, r[0] or 0))[:2])
    assert sorted((r[:2] for r in out["n-gram Jaccard join"]), key=str) == sorted(want, key=str) and len(want) < len(rows) - 6
    assert set(out["n-gram Jaccard join"]) <= set(rows)
    # decontamination
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    keep = [r for r in rows if not contaminated(r[1], items)]
    assert sorted(out["benchmark decontamination"], key=str) == sorted(keep, key=str) and len(keep) < len(rows)
    # personal data: patterns' spans give way, all else stays
    field = pii.fit(pii.labelled_table(spark))
    for r, x in zip(sorted(rows, key=lambda r: r[-1]), sorted(out["PII"], key=lambda r: r[-1]), strict=True):
        text, at, parts = r[1], 0, []
        for _, a, b, *_ in sorted(pii.spans_of([text or ""], field)[0], key=lambda s: (s[1], -s[2])):
            parts += [text[at:a], "<>"] if a >= at else []
            at = max(at, b)
        want = None if text is None else "".join([*parts, text[at:]])
        assert (x[1] if x[1] is None else re.sub("<(EMAIL|IP|CARD|PHONE)>", "<>", x[1])) == want and x[5:] == r[5:]
        assert x[4] == len(x[1] or "")


def test_packing_stage_by_brute_force(spark):
    """One shard: the stage's bins and places are those of a plain best fit over pieces, largest first."""
    rows = [(k, *r[1:]) for k, r in enumerate(fixture(spark)[0])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.start_word, r.n_words, r.bin_id, r.bin_start) for r in corpus_pipeline.packed(spark, docs, DIR).collect() if r.n_words)
    capacity = corpus_pipeline.packing.CAPACITY
    pieces = [(d, a, min(capacity, n - a), s, tuple(words(x))) for d, x, _, s, *_ in rows for n in [len(words(x))] for a in range(0, n, capacity)]
    bins, want = [], []
    for d, a, n, s, text in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        fits = [(left, k) for k, (left, sources, texts) in enumerate(bins) if left >= n and s not in sources and text not in texts]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        want.append((d, a, n, k, capacity - bins[k][0]))
        bins[k] = [bins[k][0] - n, bins[k][1] | {s}, bins[k][2] | {text}]
    assert got == sorted(want) and len(bins) < len(pieces)

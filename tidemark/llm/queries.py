"""The queries of this folder's operators, over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, decontaminate, gif, language_id, oracles, packing, pii, quality_knn, substring_dedup, url_filter
from .jaccard_join import near_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where((remainder(3) != 1) & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("label"))
    model = language_id.fit(docs, learn)
    out = language_id.predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


def labelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of labels from which quality may be learned: doc_id, label."""
    return table(spark, sf_dir, "labels").where(remainder(5) != 0).select("doc_id", F.col("quality").alias("label"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_knn.score(docs.select("doc_id", "text"), quality_knn.fit(docs, labelled_quality(spark, sf_dir)), ["doc_id"])
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.fit(pii.labelled_table(spark)), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.items_of(table(spark, sf_dir, "documents")))


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = gif.store(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    read = gif.read_frames(stored, ["doc_id", "n_bytes", "media"], grey=True)
    parts = F.transform("frames", lambda f: F.substring(f["pixels"], F.lit(1), f["width"] * f["height"]))
    payload = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    colours = F.aggregate("frames.histogram", F.array_repeat(F.lit(0), gif.BINS**3), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    read = read.select("doc_id", "n_bytes", "media", "frames", payload.alias("payload"), colours.alias("colours"))
    last = F.element_at("frames", -1)
    size = F.octet_length("payload").cast("long")
    feature = F.concat_ws(":", F.size("frames"), last["canvas_width"], F.element_at("frames", 1)["canvas_height"], last["start_ms"] + last["delay_ms"], F.array_join(F.transform(F.filter("colours", lambda x: x > 0), lambda x: x.cast("string")), ","))
    return read.select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", size.cast("int") - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = turns.unionByName(spark.sql(f"select -1L as conv_id, 0L as turn, 'user' as role, '{tricky}' as text union all select -1L, 1L, 'assistant', '{tricky}'"))
    chats = chat_format.format_chats(turns).select("conv_id", "valid", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.learned(F.col("segments")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.select("conv_id", "valid", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), "learned")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    size = lambda c: F.length(c).cast("long")
    return chats.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), size("learned").alias("loss_chars"), digest("learned").alias("loss_sha256"), size("formatted").alias("formatted_chars"), "valid")


#: Verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page shows the document whose number its path (language, number, then / or .html or nothing) ends in; it is bad if that one is labelled low or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select(url_filter.split(F.col("url"))[0].alias("host"), F.regexp_extract(url_filter.split(F.col("url"))[1], r"^/[a-z]+/([0-9]{1,18})(?:/|\.html)?$", 1).try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    return url_filter.judge(pages, shown.join(labels, "doc_id").select("host", "bad"), RULES).drop("bad_rate")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_gif": op1_gif, "op2_packing": op2_packing, "op3_jaccard": op3_jaccard, "op4_language_id": op4_language_id, "op5_substring_dedup": op5_substring_dedup, "op6_decontaminate": op6_decontaminate, "op7_quality": op7_quality, "op8_chat": op8_chat, "op9_pii": op9_pii, "op10_url_filter": op10_url_filter}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql(RULES)

"""A corpus, from raw documents to packed bins: STAGES one after another, each over all that its predecessor kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import _spark, decontaminate, jaccard_join, packing, pii, quality_knn
from tidemark.llm.queries import labelled_quality, table


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as one column, so that no name clashes with the operators', and what tells rows of different texts apart."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("rid"))


def _in(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of _keyed whose (doc_id, rid) is in keys (left_semi) or not (left_anti); null is equal to null."""
    return rows.join(_spark.small(keys), (rows["rid"] == keys["rid"]) & rows["id"].eqNullSafe(keys["doc_id"]), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote rejects (score under 0.3) go."""
    model = quality_knn.fit(docs, labelled_quality(spark, sf_dir))
    return quality_knn.score(docs.select("text", F.struct("*").alias("row")), model, ["row"]).where("score >= 0.3").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least (doc_id, hash of the row) stays, a null doc_id last.

    Of rows that repeat it (one doc_id, one text) one stays. Documents without words are linked with nothing and stay.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    found = _spark.cut(jaccard_join.grouped(keyed).where("n_links > 0").select("doc_id", "rid", "group_id"), "groups")
    first = found.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"), F.count("*").alias("size"))
    marked = _spark.join_split(found, _spark.cut(first, "first"), "group_id", "size")
    stays = (F.col("rid") == F.col("first.rid")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    marked = _spark.cut(marked.groupBy("doc_id", "rid").agg(F.first(stays).alias("stays"), F.count("*").alias("rows")), "marked")
    kept = _in(_keyed(docs), marked.where("not stays").select("doc_id", "rid"), "left_anti")
    again = _spark.cut(marked.where("stays and rows > 1").select("doc_id", "rid"), "again")
    once = _in(kept, again, "left_semi").groupBy("id", "rid").agg(F.first("row").alias("row"))
    return _in(kept, again, "left_anti").select("row").union(once.select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = _spark.cut(found.where("contaminated").select("doc_id", "rid").distinct(), "gone")
    return _in(_keyed(docs), gone, "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to <KIND>; n_chars is that of the new text."""
    out = pii.redact(docs, pii.fit(pii.labelled_table(spark)))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands: doc_id, piece, start_word, n_words, bin_id, bin_start."""
    return packing.pack(packing.items_of(docs))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: Trained models and a join over components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = _spark.cut(docs, f"stage{k}")
            if k:
                _spark.done(before)
    return docs

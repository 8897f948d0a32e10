"""From raw documents to token digests: five stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from tidewheel.llm._util import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go; the model learns from labels of rows whose crc32(doc_id) mod 3 is not 1.

    Null and empty texts have the score of a text without terms; rows with a null
    doc_id and repeated rows are scored each; without labels of both kinds every
    text has the share of toxic ones; an empty table gives none.  All columns
    stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("crc32(cast(doc_id as string)) % 3 <> 1")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, 0.7).where("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word n-grams at 0.8 one row of the smallest id stays; rows without id or words stay.

    Null, empty and blank texts are linked with nothing.  Of rows that repeat an
    id and a text one stays; differing texts under one id are told apart.  An
    empty table gives none; other columns stay as they are.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", F.col("text").cast("string").alias("text"))
    joined = ngram_join.jaccard_join(docs, n=5, percent=80, by_text=True, count=False)
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("doc_id").alias("again_id")))
    if again.isEmpty():
        gone = joined.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
        return whole(own.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti"), docs)
    # ids repeat: rows are told apart by id and digest
    best = joined.where("doc_id is not null and digest is not null").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("best_id"), F.col("best.digest").alias("best_digest"))
    marked = ngram_join.with_digests(own, n=5).withColumn("text", F.xxhash64("text"))
    words = F.col("doc_id").isNotNull() & F.col("set_digest").isNotNull()
    one = marked.where(words).join(best, (F.col("doc_id") == F.col("best_id")) & (F.col("set_digest") == F.col("best_digest")), "left_semi")
    one = one.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "set_digest").orderBy("text"))).where("k = 1")
    return whole(marked.where(~words).select("whole").union(one.select("whole")), docs)


def whole(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of the struct they are kept in, so that no name of theirs clashes on the way."""
    return rows.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a repeated string of 200 bytes covers go; documents stay, emptied ones too.

    Null texts become empty; texts of under 200 bytes stay whole; repeated rows
    repeat each other, so both are emptied where they are long enough; n_chars
    follows the text; other columns, and null ids, stay as they are.
    """
    done = suffix_dedup.remove_repeats(docs, keep_text=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*[new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of sources draws them.

    Null and empty texts have no words and are never drawn; null sources are a
    source of their own; a null id is kept; repeated rows share what is drawn for
    any of them; an empty table gives none.  Columns stay as they are.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null texts are empty, null ids and repeated rows stay."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]
#: SQL cannot express the learned scores; tests run all five stages against plain loops and compare whole rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs

"""The cleaning pipeline over ``documents``: language, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
``documents``; the last returns the packed pieces. Stages keep whole texts, and rows that they have nothing against.

In every stage: repeated rows are judged alike; a null in any other column than text does no harm and is kept; columns besides doc_id and text
are returned as they are, whatever their names; very long texts are judged whole; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm import language, minhash, packing, spans, toxicity
from meshlake.llm.columns import known
from meshlake.llm.scratch import keep, small_batches

#: A text goes if the language that contains most of its n-grams contains less than this share.
LEAST_MATCH = 0.2
#: A hash of a text before passages are cut out of it.
SEEN = "_text_before"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those with a null text or without a letter, or mostly of n-grams that no language has, go.

    Of languages that tie, that with more training documents counts. A null doc_id is no ground to go. Without any lang to learn from all go.
    """
    small_batches(spark)  # holds for the later stages too
    model = language.train(docs)
    rows = known(docs, "text")
    found = language.predict(rows, model)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("match") >= LEAST_MATCH)).select(rows.columns).toDF(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't reject (a score of 0.5 goes). Without labels to learn from none go; null doc_ids and texts are judged like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = known(docs, "text")
    return toxicity.score(rows, toxicity.train(docs, labels)).where("predicted = 0").select(rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; an id's further texts stay if they are no near-duplicates.

    Rows that repeat doc_id and text become one. Rows with a null doc_id and texts without words stay.
    """
    return minhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has (n_chars, if there, counted anew for these); those of which nothing is left go.

    Runs of 50 words go first, wherever in a sentence they begin, then runs of three sentences.

    "Earlier" is by doc_id, then by a hash of the text. Rows with null doc_id or text stay as they are.
    """
    counted = "n_chars" in docs.columns
    rows = known(docs, "doc_id", "text", *["n_chars"] * counted)
    before = F.xxhash64("text")
    marked = spans.remove_passages(rows.withColumn(SEEN, before))
    cleaned = spans.remove_repeats(keep(marked)).where("n_removed = 0 OR n_removed < n_sentences")
    if counted:
        length = F.char_length("text").cast(rows.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(before != F.col(SEEN), length).otherwise(F.col("n_chars")))
    return cleaned.select(rows.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the remaining documents in sequences of 2048; null texts count as empty, and pieces of one length take their slots in any order."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", pack),
]
#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs

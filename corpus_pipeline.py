"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; its result is written as Parquet to the shared
folder and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontaminate, language, near_dedup, packing, queries, substring_dedup
from attestry.llm.carry import carry, restore
from attestry.session import prepare, settle

LEAST_LANGUAGE_SCORE = 0.35  # below it no language explains the words of a document


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Rejected are texts that are null or have no letter, and those whose best language
    scores below LEAST_LANGUAGE_SCORE. If no document has a language to learn from, nothing can be judged and all stay."""
    prepare(spark)
    model = language.learn(docs.filter(~language.held_out()))
    if not model.languages:
        return docs
    judged = language.predict(carry(docs, "doc_id", "text"), model)
    known = judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return restore(known, docs, "doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more. The smallest doc_id stays; of
    repeated rows with one doc_id, one stays. Rows without doc_id stay."""
    prepare(spark)
    kept = near_dedup.near_duplicates(docs, shingle=5, percent=80).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    own = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return own.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 or more words that a document with a smaller doc_id has too; n_chars follows. A
    document of which nothing is left goes; one that had no words stays as it is."""
    prepare(spark)
    cleaned = substring_dedup.remove_repeats(carry(docs, "doc_id", "text"), window=50)
    left = cleaned.filter("n_removed = 0 OR n_removed < n_words")
    changed = {}
    if "n_chars" in docs.columns:
        count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, count).otherwise(F.col("carried.n_chars"))
    return restore(left, docs, "doc_id", "text", changed=changed)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item."""
    prepare(spark)
    return decontaminate.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, **queries.vocabulary()).drop("row")


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontaminate", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned model of the first stage nor the tokenizer of the last: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

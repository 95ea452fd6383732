"""From raw documents to packed training sequences, as five stages over Spark tables.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of ``docs``; ``n_chars``, where the table has it, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rentlens.llm import language, line_dedup, minhash, packing, pii
from rentlens.llm.queries import vocabulary
from rentlens.operators.batches import number_rows
from rentlens.session import cut_lineage

# Models, tokenizers and union-find are not expressible in SQL.
ORACLE_SQL = None


def _like(docs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` of the text as it now is."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(kind))
    return cleaned.select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or a clear language go."""
    model = language.fit(docs, vocabulary("piece_bpe_32k.model"))
    return language.keep_identified(docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across documents; one that had no others goes."""
    return _like(docs, line_dedup.drop_recurring_lines(docs, drop_emptied=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; rows without an id stay.

    A document is an id with a text: rows that share an id but not the text are told apart, and of a
    group the least id stays, then the least digest of the text. Of equal rows one stays.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(digest).alias("least"), F.max(digest).alias("most"))
    if several.where("least <> most").isEmpty():
        found = minhash.near_duplicates(docs, minhash.FIVE_WORDS)
        kept = found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
        one_each = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    else:
        free = "_"
        while any(column.startswith(free) for column in docs.columns):
            free += "_"
        key, number = f"{free}key", f"{free}number"
        keyed = docs.where("doc_id IS NOT NULL").withColumn(key, F.struct("doc_id", digest.alias("digest")))
        numbers = cut_lineage(number_rows(cut_lineage(keyed.select(key).distinct()), key, number))
        numbered = cut_lineage(keyed.join(numbers, key).dropDuplicates([number]).drop(key))
        found = minhash.near_duplicates(numbered, minhash.FIVE_WORDS, id_col=number)
        kept = found.where("kept").select(F.col("doc_id").alias(number))
        one_each = numbered.join(kept, number, "left_semi").select(docs.columns)
    return one_each.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _like(docs, pii.mask_personal_data(docs, pii.fit(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in training sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_recurring_lines),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)

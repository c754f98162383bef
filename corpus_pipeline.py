"""The corpus pipeline: five stages from raw documents to tokens, each written as Parquet before the next.

Every stage takes all rows that its predecessor kept, with whatever columns they have, and a stage's decision depends on
the text alone (near duplicates also on doc_id). The stages lower the session's Arrow batches to 1,000 rows, since a batch
of long texts takes the memory of an executor twice. Rows with NULLs in any column pass through every stage that their text
passes; a NULL text has no letter and leaves at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm import bpe, decontaminate, language_id, secrets
from cohortry.llm.common import is_present, presence_bits, small_batches, stored, table, work_folder
from cohortry.llm.jaccard_join import near_duplicates
from cohortry.llm.queries import tokenizer_file

#: A text of which the filters explain a smaller share in every language is in none of them.
LEAST_LANGUAGE_SCORE = 0.2


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or in none of the learned languages, go."""
    small_batches(spark)
    held = language_id.held_out(5, 0)
    model = language_id.fit(docs.where(~held).select("text", "lang"))
    guess = language_id.predicted(docs, model)
    known = (guess["language"] != language_id.UNKNOWN) & (guess["score"] >= LEAST_LANGUAGE_SCORE)
    return docs.where(known if model.languages else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each near-duplicate group the row with the smallest doc_id stays, once.

    Rows are judged by their texts, so a doc_id that occurs with different texts keeps those that no other row has. NULL ids
    come last. Documents without words are no duplicates of each other; rows equal in id and text stay once.
    """
    small_batches(spark)
    key = F.xxhash64("doc_id", "text")
    named = docs.select(key.alias("doc_id"), "text")
    groups = near_duplicates(named).where("n_shingles > 0").select(F.col("doc_id").alias("h"), "component_id").distinct()
    rows = groups.join(docs.select(key.alias("h"), "doc_id").distinct(), "h")
    rows = stored(rows, f"{work_folder(spark)}/groups")
    stays = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("first")).select("first.h")
    dropped = rows.select("h").join(stays, "h", "left_anti")
    repeated = docs.select(key.alias("h")).groupBy("h").count().where("count > 1").select("h")
    # a bitmap of fixed size finds the rows that need a look, so that the others are not shuffled
    special = is_present(docs, key, presence_bits(dropped.union(repeated)))
    plain = [F.col(f"`{c}`") for c in docs.columns]
    rest = docs.where(special).select(F.struct(*plain).alias("row"), key.alias("h")).join(dropped, "h", "left_anti")
    order = Window.partitionBy("h").orderBy(F.xxhash64(*[F.col(f"row.`{c}`").cast("string") for c in docs.columns]))
    one = rest.withColumn("turn", F.row_number().over(order)).where("turn = 1").select("row.*")
    return docs.where(~special).union(one)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that leak a benchmark item go."""
    small_batches(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret is replaced by a mark; ``n_chars`` follows the text. No document goes."""
    small_batches(spark)
    texts = docs.select("text")
    out = docs.withColumn("text", secrets.redacted(docs, secrets.identifier_dictionary(texts)))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: the tokens of every document that is left."""
    small_batches(spark)
    coded = bpe.encode(docs, tokenizer_file("word_bpe_49k.json"), ["doc_id"])
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_languages),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("bpe_encoding", tokenize),
]

#: SQL can express neither the learned filters nor the latent search nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    folder = work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents, in stages whose outputs are written and read again.

Language identification rejects texts without a clear language, line dedup drops repeated lines, MinHash near-dedup keeps
one document of each group, mixing repeats or skips documents until each source is near its target, and packing lays out
what is left in token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import language_id, line_dedup, minhash, mixing, packing
from logsift.llm.common import broadcast_if_small, materialize
from logsift.llm.queries import tokenizer_file

#: Columns that stages read or write by name. All others are carried through under names that no operator uses.
OWN = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL for the rows of run(): no SQL expresses the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def _inner(docs: DataFrame) -> list[str]:
    return [c if c in OWN else f"_doc_{k}" for k, c in enumerate(docs.columns)]


def _aside(docs: DataFrame) -> DataFrame:
    """docs with the columns outside OWN renamed, so that none can clash with what an operator adds or replaces."""
    return docs.toDF(*_inner(docs))


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from a result over _aside(docs)."""
    return found.select(*_inner(docs)).toDF(*docs.columns)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is clearly in one of the languages that the rows with a language teach; null or letterless
    texts go."""
    model = language_id.learn(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    found = language_id.identify(_aside(docs), model)
    return _back(found.where((F.col("lang_pred") != language_id.UNDETERMINED) & ~F.col("ambiguous")), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are equal or near to a line which stays; n_chars, where there is one, follows
    the text."""
    out = line_dedup.dedup_lines(_aside(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _back(out, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    found = minhash.near_duplicates(docs, minhash.Near(shingle=5, percent=80))
    gone = materialize(found.where("NOT kept").select("doc_id").distinct())
    return _back(_aside(docs).join(broadcast_if_small(gone), "doc_id", "left_anti"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for each repetition."""
    mixed = mixing.mix_sources(_aside(docs)).where("mix_copies > 0")
    return _back(mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_file(), capacity=4096, end_id=1)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialize(docs), sf_dir)
    return docs

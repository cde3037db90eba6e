"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing to target weights, SentencePiece encoding.

``run`` applies ``STAGES`` to the documents table; each stage's rows are
written as Parquet into the shared folder that ``spark.checkpoint.dir`` names and
read back as the next one's input, so a lost executor costs the tasks it ran
and no stage is computed twice.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulant.llm import line_dedup, mixing, pieces, queries, simhash, toxicity
from tabulant.llm.common import owner, release, save, stage
from tabulant.sources.tables import table_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the scorer learns from labels of these documents that are not held out.

    Rows stay as they are; NULL and empty texts have no toxic word and stay.
    """
    labels = spark.read.parquet(table_path(sf_dir, "labels"))
    return toxicity.keep_clean(docs, queries.toxicity_model(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long lines that repeat an earlier one within 2 edits; a document of nothing but repeats goes.

    Lines under 24 characters stay where a document stays.  ``n_chars`` is counted anew where the text changes.  NULL ids take no part and stay.
    """
    return line_dedup.drop_lines(docs, line_dedup.duplicate_lines(docs, max_edits=2))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (4-word shingles, 4 bits) the document with the smallest id.

    Rows that agree in id and text are one document; rows without an id cannot
    be named as a copy and stay.
    """
    groups = simhash.near_duplicates(docs, shingle=4, max_bits=4)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.filter(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi")
    kept = kept.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken so that 80 % of the tokens follow the target weights; one row for each time one is taken."""
    return mixing.mix(docs, queries.mix_levels(), mixing.node_weights(spark, queries.MIX_WEIGHTS),
                      budget_percent=queries.MIX_PERCENT, max_epochs=queries.MIX_EPOCHS,
                      seed=queries.MIX_SEED).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document: whole texts as SentencePiece ids; NULL and empty texts have none."""
    vocabulary = pieces.Vocabulary.load(pieces.default_model())
    return pieces.encode(docs, vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

# Scores of a learned model, edit distances and piece ids are beyond SQL; tests/llm/test_pipeline.py uses brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.

    What a stage staged on its way is removed once its result is written, and
    that once the next stage's is; the result reads the last one.
    """
    docs, before = spark.read.parquet(table_path(sf_dir, "documents")), []
    for name, apply in STAGES[:-1]:
        with owner(spark) as folders:
            docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
            release(spark, before + folders[:-1])   # the last folder is the stage's own
            before = folders[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The pipeline's rows as Parquet at ``path``; nothing that was staged for them is left."""
    save(spark, lambda: run(spark, sf_dir), path)

"""The corpus pipeline: documents through quality, near-dedup, secrets, mixing and packing.

Each stage takes (spark, docs, sf_dir), docs being all rows the stage before kept, and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm import bagminhash, mixing, packing, quality, secrets, shared

#: Documents that the classifier gives a lower probability of good quality are rejected.
REJECT_BELOW = 0.5


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator reads by their names, the others by numbers, so that none can clash with what the
    operator adds."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in needed else f"__{i}") for i, c in enumerate(docs.columns)])


def restored(rows: DataFrame, docs: DataFrame, *needed: str, **changed: Column) -> DataFrame:
    """The columns of docs again, but for those that have changed."""
    return rows.select(*[changed.get(c, F.col(c if c in needed else f"__{i}")).alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from labels that are not held out, reject documents scored low."""
    net = quality.fit(docs, shared.table(spark, sf_dir, "labels"))
    return restored(quality.score(carried(docs, "text"), net).where(F.col("score") >= REJECT_BELOW), docs, "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the smallest doc_id."""
    return bagminhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; n_chars follows where there is one."""
    needed, changed = ("doc_id", "text", "lang", "source"), {}
    clean = secrets.redact(secrets.find_secrets(carried(docs, *needed)))
    if "n_chars" in docs.columns:
        before = F.col(f"__{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.size("secrets") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(before)
    return restored(clean, docs, *needed, **changed)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    needed = ("doc_id", "text", "source")
    mixed = mixing.mix(carried(docs, *needed)).where("copies > 0")
    return restored(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, *needed)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: where each document's pieces lie."""
    pieces = packing.tokenize_pieces(docs, shared.tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))).rows


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned scores, signatures and tokens are beyond SQL; tests/llm holds the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again as the next one's input."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

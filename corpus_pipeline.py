"""A training corpus made from ``documents``: toxic texts out, near-duplicates out, secrets masked, sources mixed, encoded.

Each stage works on all rows that the one before it kept and returns the columns
of documents; the last returns each text's token ids. Texts are read whole at
any length, empty tables give empty ones, and columns that documents has beside
its own pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmerge.llm import bpe, mixing, secrets, simhash, toxicity
from kinmerge.llm.common import save, table
from kinmerge.session import ship


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars brought up to date after texts have changed."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*(f"`{c}`" for c in docs.columns))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts bear no evidence and stay; repeated rows stay or go together; a null doc_id is judged by its text."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, a null id last; of repeated rows one. Null and wordless texts are copies of each other."""
    ship(spark)
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, repeated ones too; secrets in it are masked. A null text stays null."""
    ship(spark)
    return _counted(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: words not drawn go, words drawn twice come twice. Null and empty texts have no words to draw and go; a null source is a source."""
    ship(spark)
    return _counted(mixing.Mix(docs).texts())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text: (doc_id, source, n_tokens, ids); a null text has none."""
    ship(spark)
    return bpe.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Hash fingerprints, a trained classifier, pseudorandom draws and BPE: no stage but the third is within SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

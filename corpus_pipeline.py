"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
documents. All stages but the last return the columns of ``documents``. Every decision of a stage is taken on what
its predecessor kept: rejected documents go, one document of each near-duplicate group stays, finds are masked in the
texts, documents are dropped or repeated as the mix says, and what is left is packed.

Nulls, ties, repeated rows, empty tables and further columns are treated as the docstrings of the operators say; further columns stay
up to the mix. Documents without id stay: nothing can be decided about a row by an id that it does not have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmerge.llm import mixing, packing, pii, quality, simhash
from docmerge.session import ensure_checkpoint_dir

#: SQL has no SimHash trees, tilted rates or packing plans; tests hold the stages against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    rows = docs.select("text", F.struct("*").alias("row"))  # whole rows in one column: no name can clash
    return quality.keep(quality.ledger(rows), "v1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group whose fingerprints link at 3 or fewer differing bits."""
    return simhash.keep_first(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with finds masked in ``text``; ``n_chars`` follows."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 1024 tokens."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_dedup", drop_near_duplicates),
    ("pii", mask_pii),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; their tables go to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

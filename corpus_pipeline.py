"""From raw documents to token ids: five stages over whole tables.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; each
result is written as Parquet and read again as the next stage's documents,
so every stage works on all that its predecessor kept and a lost executor
costs at most one stage's tasks.  All but the last return the columns of
their input.

Defined results: NULL, empty and rejected texts go in the first stage; of
each group of near copies (five-word shingles, similarity 0.8 or more, and
exact copies) the row with the smallest doc_id stays; mixing repeats or
leaves out documents to reach the sources' targets and cuts at most one
document per source; ``n_chars`` follows the text where a stage changes it.
Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm import minhash, mixing, pii, quality, spm
from shiftscope.llm.common import read_table, shared_folder, ship_package
from shiftscope.plans.catalog import Query


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; ``n_chars``, where there, counts the text."""
    return df.select(*[F.length("text").cast(like.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
                       for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, shingle=5)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(pii.with_pseudonyms(docs, pii.session_key(spark), hits="__pii_hits"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(mixing.mix(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # in a long-running application the encoder shares its executor with what the other stages left
    d = spm.encode_checked(docs.select("doc_id", "source", "lang", "text"), chunk_chars=spm.FRUGAL_CHARS)
    return d.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("pii", pseudonyms),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    base = shared_folder(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)


# The circulant signatures, keyed permutations and the subword lattice have no
# form in SQL; tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": Query("pipeline", run, ORACLE_SQL)}

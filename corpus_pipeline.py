"""A corpus pipeline of five stages over ``documents``; each calls one operator of wattloom.llm.

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import bpe, jaccard, mixing, pii, toxicity
from wattloom.llm._tasks import settled, shared_dir
from wattloom.llm.queries import VOCABULARY, pii_key

#: Bytes of rows that go to a Python worker at once, where the session doesn't say: all workers of an executor and its buffers hold a batch, whatever the texts' length.
BATCH = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def packed(docs: DataFrame, used: list[str]) -> DataFrame:
    """The used columns and, in one column, the others, so that an operator's own columns can't clash with them."""
    return docs.select(*used, F.struct(*[c for c in docs.columns if c not in used]).alias("others"))


def unpacked(out: DataFrame, docs: DataFrame, used: list[str]) -> DataFrame:
    return out.select(*[F.col(c) if c in used else F.col("others")[c].alias(c) for c in docs.columns])


def by_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with batches of BATCH bytes in the session from then on, as its rows are made when they are written; a setting of the session's own stays."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH_KEY, None) is None:
            spark.conf.set(_BATCH_KEY, BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain doesn't reject; a null text is scored as empty, repeated rows and null ids as they come."""
    used = ["doc_id", "text"]
    scored = toxicity.score(packed(docs, used), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(scored.where("not rejected"), docs, used)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id; documents without words or id all stay, rows that repeat an id stay or go together."""
    classes = jaccard.near_classes(docs)
    first = classes.where("n_shingles = 0 or doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    return docs.join(first, docs.doc_id.eqNullSafe(first["first"]), "left_semi")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text, and is null where that is."""
    used = ["text", "n_chars"]
    out = pii.pseudonymise(packed(docs, used), pii_key(spark))
    return unpacked(out.withColumn("n_chars", F.length("text").cast("long")), docs, used)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows are told apart by a hash of all their columns, so repeated or null ids draw for themselves; of rows
    equal in every column only the sum of their copies is defined. An empty table gives no rows.
    """
    row = next(c for c in ("row_hash", *(f"row_hash_{i}" for i in range(len(docs.columns)))) if c not in docs.columns)
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    taken = mixing.mix_sources(keyed, id_col=row).groupBy(F.col("doc_id").alias("taken_row")).agg(F.sum("copies").alias("all_copies"), F.count("*").alias("rows"))
    taken = settled(taken.where("all_copies > 0"))
    each = F.floor(F.col("all_copies") / F.col("rows")).cast("int")
    most = keyed.join(taken.where("all_copies >= rows"), F.col(row) == F.col("taken_row")).withColumn("copy", F.explode(F.array_repeat(F.lit(0), each)))
    # what does not divide among equal rows goes to one of them
    rest = taken.where("all_copies % rows > 0")
    more = keyed.join(rest, F.col(row) == F.col("taken_row")).dropDuplicates([row]).withColumn("copy", F.explode(F.array_repeat(F.lit(0), (F.col("all_copies") % F.col("rows")).cast("int"))))
    return most.select(*docs.columns).unionByName(more.select(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy, with digests of the ids and of the decoded text; a null text gives no tokens, null ids and repeated rows come as they are."""
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), with_ids=True, with_text=False)


STAGES = [(name, by_batches(f)) for name, f in (("toxicity", drop_toxic), ("near_duplicates", one_of_each_group), ("pii", hide_personal_data), ("mixing", mix), ("bpe", encode))]
#: Models and keyed surrogates can't be told in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Small helpers that the operators share: cutting lineage, partition counts, Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Only where the session names no folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of this machine only where Spark runs on this machine alone."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return own or FALLBACK_DIR


def settled(df: DataFrame) -> DataFrame:
    """Runs ``df`` once and keeps its rows in the shared checkpoint folder, so that a lost executor costs no rerun of what lies before."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; what else ``df`` has can't clash."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """Each text in UTF-8; null: empty. No Python string is built."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py() or b""

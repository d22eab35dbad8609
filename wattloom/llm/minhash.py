"""Document fingerprints by MinHash over five-word shingles.

Each of PERMUTATIONS universal hashes (odd multiplier and offset modulo 2^64, upper half kept) gives the
smallest value over a text's shingles, in vectorised numpy. The share of equal values estimates the
Jaccard similarity. ``near_duplicates`` joins bands of the signature in Spark and verifies the exact Jaccard.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tasks import byte_texts, id_and_text, partitions, settled
from .jaccard import linked, shingle_arrays
from .shingles import SIZE, mix, set_keys, shingle_set

PERMUTATIONS, BANDS = 64, 16
#: Bytes of text in a partition of consecutive documents, about, and how many there are at least.
RUN_BYTES, LEAST_RUNS = 32 << 20, 64
_SEEDS = mix(np.arange(2 * PERMUTATIONS, dtype=np.uint64), 50)
_A, _B = (_SEEDS[:PERMUTATIONS] | np.uint64(1))[:, None], _SEEDS[PERMUTATIONS:][:, None]
_STEP = 4096


def signature(shingles: np.ndarray) -> np.ndarray:
    """PERMUTATIONS values of 32 bits; all ones for a text without words."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), _STEP):
        low = ((_A * shingles[at : at + _STEP] + _B) >> np.uint64(32)).min(axis=1)
        np.minimum(out, low.astype(np.uint32), out=out)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / PERMUTATIONS


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by the first as many code points of ``following``, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


FINGERPRINTS = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _finished(doc: int | None, text: str, sig: np.ndarray, following: str, sig_next: np.ndarray, size: int) -> tuple:
    new = edited(text, following)
    raw = new.encode()
    sig2 = sig if new == text else signature(shingle_set(raw, size))
    return doc, len(text), hashlib.sha256(raw).hexdigest(), sig.tobytes().hex(), sig2.tobytes().hex(), likeness(sig, sig2), likeness(sig, sig_next)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[t]) for k, t in enumerate(FINGERPRINTS.values())], list(FINGERPRINTS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text replaces the last third of a text by the beginning of the next document's, in
    descending doc_id; the one after the last is the first. near_edited and near_next are the likeness
    of the fingerprint to those of the edited text and of the next document. Equal texts have equal
    fingerprints. A null text counts as empty. Rows that repeat an id follow each other in the order of
    their texts' hashes; null ids come last. A single row is its own next. An empty table gives no rows.

    Texts are moved once, sorted across partitions by range of id and of the text's hash, so that rows that repeat an id, or have none, spread too. The last row of
    each partition waits for the first of the next one that has rows: two rows of each partition are joined for that.
    """
    docs = id_and_text(docs, id_col, text_col)
    runs = max(LEAST_RUNS, partitions(docs.sparkSession), math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / RUN_BYTES))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(runs, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its next
        for b in batches:
            out = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), byte_texts(b.column("text")), strict=True):
                row = doc, raw.decode(), signature(shingle_set(raw, size))
                if held:
                    out.append(_finished(*held, *row[1:], size))
                held = row
            if out:
                yield _batch(out)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's first text, and its last row."""
        first = last = None
        for b in batches:
            if len(b):
                first = b.slice(0, 1) if first is None else first
                last = b.slice(len(b) - 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays([last.column("part").cast(pa.int64()), pa.array(first.column("text").to_pylist(), pa.string()), last.column("doc_id").cast(pa.int64()), pa.array(last.column("text").to_pylist(), pa.string())], ["part", "first", "doc_id", "text"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("doc_id").to_pylist(), byte_texts(b.column("text")), byte_texts(b.column("following")), strict=True)
            yield _batch([_finished(doc, t.decode(), signature(shingle_set(t, size)), f.decode(), signature(shingle_set(f, size)), size) for doc, t, f in rows])

    kept = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(ends, "part long, first string, doc_id long, text string")
    numbers = kept.select("part")  # one for each partition
    after = numbers.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("then"))
    firsts = kept.select(F.col("part").alias("then"), F.col("first").alias("following"))
    closing = kept.join(after, "part").join(firsts, "then").select("doc_id", "text", "following")
    schema = ", ".join(f"{c} {t}" for c, t in FINGERPRINTS.items())
    return dealt.mapInArrow(run, schema).union(closing.mapInArrow(close, schema))


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, key, key2, bands array<long>); equal sets have equal keys and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, bands = [], [], []
            for t in byte_texts(b.column("text")):
                s = shingle_set(t, size)
                sig = signature(s).reshape(BANDS, -1).astype(np.uint64)
                code = np.zeros(BANDS, np.uint64)
                for k in range(sig.shape[1]):
                    code = mix(code + sig[:, k], k)
                n.append(len(s))
                keys.append(set_keys(s))
                bands.append(mix(code + np.arange(BANDS, dtype=np.uint64), 60).view(np.int64))
            columns = [pa.array(n, pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_shingles", "key", "key2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key long, key2 long, bands array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row for each document with shingles: (doc_id, class_id), the smallest id that verified links reach.

    Equal sets are one node, so copies make no pairs. Each band bucket compares its nodes with its smallest; nodes of a
    candidate cluster that this leaves apart are then compared in blocks, so no link between texts that share a band
    is lost. A link counts when the exact Jaccard similarity is at least 0.75. Texts that are null or blank are left
    out; null ids too; a repeated id is one document. An empty table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    table = settled(signatures(docs, size).where("n_shingles > 0"))
    return classes(docs, table, size)


def classes(docs: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """``near_duplicates`` of texts whose ``signatures`` are known."""
    same = ["key", "key2", "n_shingles"]
    nodes = settled(table.groupBy(*same).agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")))
    listed = table.select("doc_id", *same).join(nodes.select("first", *same), same)
    members = nodes.select(F.explode("bands").alias("bucket"), F.col("key").alias("node"), F.col("n_shingles").cast("int").alias("n"), (-F.col("first")).alias("rank"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        firsts = nodes.select("key", "first").join(wanted, F.col("key") == wanted.node).select("first", "node")
        texts = docs.join(firsts, docs.doc_id == firsts["first"]).select("node", "text")
        return shingle_arrays(texts, size).where("node = key").groupBy("node").agg(F.first("shingles").alias("shingles"))

    comp = linked(members, sets_of)
    if comp is None:
        return listed.groupBy("doc_id").agg(F.min("first").alias("class_id"))
    least = comp.join(nodes.select(F.col("key").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    reached = comp.join(least, "component").select(F.col("node").alias("key"), "least")
    return listed.join(reached, "key", "left").groupBy("doc_id").agg(F.min(F.coalesce("least", "first")).alias("class_id"))

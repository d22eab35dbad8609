"""The prefix trie of conversations, by count-min screening of prefix digests.

A conversation's prefix of depth d gets a 128-bit digest: the exclusive or of hashes of each turn's content
and place. A count-min sketch counts all digests; where its estimate for a prefix is one, the prefix is
proven to belong to that conversation alone, and so is all below it: these tails become nodes where they
are, without a shuffle for grouping. Only prefixes that may be shared are grouped by their digest, exactly.

Rows carry hashes and counts of words, no texts, after the first step. A node is owned by its smallest
member, so the nodes an owner has are one stretch of its conversation; sums over a subtree are sums over the
members' own stretches, and are grouped by digest like the members themselves. Conversations of any length
are numbered across partitions and summed up in segments, so none has to pass through one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tasks import partitions, settled
from .mixing import word_count
from .shingles import mix

BRANCHES, HEAD = 20, 4
#: Turns of a conversation that one window holds; ids that travel as one row to be hashed.
SEGMENT, PACK = 4096, 1 << 14
#: The sketch: rows, and cells of a row for each prefix; cells of a row at most, so that all of it has 4 MB in bits.
ROWS, SPACE, MOST_CELLS = 2, 8, 1 << 24
BLOCK = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
#: What a node with one member has, given its depth and the conversation's length.
LONE = {"n_convs": "1L", "n_children": "if(depth < length, 1L, 0L)", "n_leaves": "1L", "saved_tokens": "0L", "ends_sha256": f"if(depth = length, sha2(string(conv_id), 256), '{EMPTY}')"}


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with their place in the conversation, from 1, in the order (turn, k1, k2), null turns first.

    Rows are sorted across partitions by range; a conversation that lies in several continues its count by
    what the earlier ones hold of it. Each border cuts one conversation at most, so the counts that are sent to all are no more
    than the partitions.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")]
    dealt = settled(turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)).withColumns({"at": F.monotonically_increasing_id(), "pid": F.spark_partition_id()})
    held = dealt.groupBy("conv_id", "pid").agg(F.count("*").alias("here"))
    earlier = W.partitionBy("conv_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    later = held.withColumn("earlier", F.sum("here").over(earlier)).where("earlier is not null").select("conv_id", "pid", "earlier")
    local = F.row_number().over(W.partitionBy("conv_id", "pid").orderBy("at"))
    return dealt.withColumn("local", local).join(F.broadcast(later), ["conv_id", "pid"], "left").select("conv_id", (F.col("local") + F.coalesce("earlier", F.lit(0))).alias("place"), "k1", "k2", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, k1, k2, words) of all rebuilt turns, depth from 1; and the conversations (conv_id).

    Conversation c starts with the first h turns of conversation c - c % 20 (all if it has fewer, none if it
    is absent), h = crc32(c) % 4, then its own turns after its first h. Turns with equal numbers are ordered
    by their content's hash; rows with a null conv_id take no part; null roles and texts are empty.
    """
    said = [F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text")]
    slim = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), F.xxhash64(*said).alias("k1"), F.xxhash64(F.lit(1), *said).alias("k2"), word_count(said[1]).alias("words"))
    turns = settled(_numbered(slim))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    heads = turns.where((F.col("conv_id") % BRANCHES == 0) & (F.col("place") < HEAD)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "k1", "k2", "words"))).alias("head"))
    convs = turns.where("place = 1").select("conv_id", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % BRANCHES).alias("base"))
    convs = settled(convs.join(heads, "base", "left").select("conv_id", "h", F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(array(named_struct('place', 0L, 'k1', 0L, 'k2', 0L, 'words', 0L)), 1, 0)")).alias("head")))
    taken = convs.select("conv_id", F.posexplode("head").alias("i", "t")).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "t.k1", "t.k2", "t.words")
    shift = convs.select("conv_id", "h", F.size("head").alias("n"))
    own = turns.join(shift, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("n")).cast("long").alias("depth"), "k1", "k2", "words")
    return taken.unionByName(own), convs.select("conv_id")


def _running(df: DataFrame, what: dict[str, str], down: bool, combine=F.sum) -> DataFrame:
    """Adds for each column of ``what`` (new name: column) its running total in a conversation along the depth, from below where ``down``."""
    way = (lambda c: F.col(c).desc()) if down else F.col
    df = df.withColumn("segment", F.floor(F.col("depth") / SEGMENT))
    inside = W.partitionBy("conv_id", "segment").orderBy(way("depth")).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy(way("segment")).rowsBetween(W.unboundedPreceding, -1)
    whole = df.groupBy("conv_id", "segment").agg(*(combine(c).alias(f"{n}_whole") for n, c in what.items()))
    whole = whole.withColumns({f"{n}_before": combine(f"{n}_whole").over(before) for n in what}).where(" or ".join(f"{n}_before is not null" for n in what)).select("conv_id", "segment", *(f"{n}_before" for n in what))
    df = df.withColumns({n: combine(c).over(inside) for n, c in what.items()}).join(whole, ["conv_id", "segment"], "left")

    def met(n: str) -> Column:
        before = F.coalesce(f"{n}_before", F.lit(0))
        return F.col(n).bitwiseXOR(before) if combine is F.bit_xor else F.col(n) + before

    return df.withColumns({n: met(n) for n in what}).drop("segment", *(f"{n}_before" for n in what))


def _cells(keys: np.ndarray, width: int) -> np.ndarray:
    """The cells of each key, one for each row of the sketch, a row after the other."""
    return np.stack([(mix(keys, 21 + r) % np.uint64(width)).astype(np.int64) + r * width for r in range(ROWS)])


def sketch(digests: DataFrame, n: int, key: str = "p1", space: int = SPACE, most: int = MOST_CELLS) -> tuple[np.ndarray, int]:
    """(bits of the cells that more than one of ``digests`` fell into, cells of a row).

    Counters stop at two, all that is asked of them. Tasks send the blocks of cells they touched, compressed,
    and each block is added up by itself. With more than ``most`` / ``space`` prefixes cells get crowded: then more
    prefixes are grouped that needn't be, and the result stays the same.
    """
    width = BLOCK
    while width < min(space * n, most):
        width *= 2

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(ROWS * width, np.uint8)
        for b in batches:
            at, count = np.unique(_cells(b.column(0).to_numpy().view(np.uint64), width), return_counts=True)
            cells[at] = np.minimum(cells[at] + np.minimum(count, 2), 2)
        for k, block in enumerate(cells.reshape(-1, BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())], ["block", "cells"])

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.uint8)
        for b in batches:
            for x in b.column("cells"):
                total = np.minimum(total + np.frombuffer(zlib.decompress(x.as_py()), np.uint8), 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total > 1).tobytes()], pa.binary())], ["block", "bits"])

    blocks = digests.select(key).mapInArrow(own, "block int, cells binary").groupBy("block").applyInArrow(added, "block int, bits binary")
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for r in blocks.toLocalIterator():  # ROWS * MOST_CELLS bits at most
        bits[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bits, width


def _ends(rows: DataFrame) -> DataFrame:
    """(p1, p2, conv_id) to (p1, p2, ends_sha256): the hash of the ids in ascending order, comma-joined.

    A hash goes through its text from the first byte to the last, so one task has to see all ids of a node;
    ids are sorted across partitions by range and packed, 8 bytes each and many to a row, before they meet
    there, and are told to the hash row by row.
    """
    order = ["p1", "p2", "conv_id"]

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["p1", "p2", "first", "ids"]
        for b in batches:
            p1, p2, ids = (c.to_numpy() for c in b.columns)
            cut = np.flatnonzero(np.concatenate(([True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]))))
            cut = np.unique(np.concatenate((cut, np.arange(0, len(ids), PACK))))
            yield pa.RecordBatch.from_arrays([pa.array(p1[cut]), pa.array(p2[cut]), pa.array(ids[cut]), pa.array([x.tobytes() for x in np.split(ids, cut[1:])], pa.binary())], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for b in batches:
            done = []
            for p1, p2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if (p1, p2) != last:
                    if last:
                        done.append((*last, h.hexdigest()))
                    last, h, comma = (p1, p2), hashlib.sha256(), ""
                h.update((comma + ",".join(map(str, np.frombuffer(ids.as_py(), np.int64).tolist()))).encode())
                comma = ","
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, h.hexdigest())], names)

    names = ["p1", "p2", "ends_sha256"]
    n = partitions(rows.sparkSession)
    packed = rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(packs, "p1 long, p2 long, first long, ids binary")
    return packed.repartition(n, "p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string")


def trie(conversations: DataFrame, space: int = SPACE) -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    See ``rebuilt`` for the conversations. conv_id is the smallest member, the root's parent is null. An empty
    table has no conversation and gives no rows; one whose conversations are all without turns gives the root.
    """
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations)
    places = {f"m{i}": F.xxhash64(F.lit(i), F.col("depth"), "k1", "k2") for i in (1, 2)}
    chained = _running(turns.withColumns(places), {"x1": "m1", "x2": "m2"}, down=False, combine=F.bit_xor)
    rows = settled(chained.select("conv_id", "depth", F.xxhash64(F.lit(3), "x1", "x2", "depth").alias("p1"), F.xxhash64(F.lit(4), "depth", "x2", "x1").alias("p2"), "words"))
    bits, width = sketch(rows, rows.count(), space=space)
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def alone(keys: pd.Series) -> pd.Series:
        cells = _cells(keys.to_numpy().view(np.uint64), width)
        seen = sent.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1
        return pd.Series((seen == 0).any(axis=0))

    screened = settled(rows.withColumn("alone", alone("p1")))
    # of each conversation: its turns, and where its tail begins, after its end if it has none
    about = screened.groupBy("conv_id").agg(F.max("depth").alias("length"), F.min(F.when(F.col("alone"), F.col("depth"))).alias("tail"))
    about = convs.join(about, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce(F.col("tail"), F.col("length") + 1, F.lit(1)).alias("tail"))
    placed = screened.drop("alone").join(about, "conv_id")
    tails = placed.where("depth > tail").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *(F.expr(x).alias(c) for c, x in LONE.items()))

    # what may be shared, the root of all included, and the first of each tail, which needs its parent
    zero = F.lit(0).cast("long")
    root = about.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"), "length", "tail")
    few = settled(placed.where("depth <= tail").select(*root.columns).unionByName(root))
    counted = few.where("depth < tail").groupBy("p1", "p2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("length").alias("longest"), F.max("depth").alias("depth"), F.max("words").alias("words"))
    counted = settled(counted)
    owned = counted.select(F.col("owner").alias("conv_id"), "depth", F.lit(True).alias("owns"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("longest") == F.col("depth")).alias("childless"))
    members = few.join(owned, ["conv_id", "depth"], "left")
    first = F.col("depth") == F.col("tail")
    members = members.select("conv_id", "depth", "p1", "p2", "length", "tail", (first | F.coalesce("owns", F.lit(False))).cast("long").alias("owns"), F.coalesce("saved", zero).alias("saved"), F.when(first, 1).otherwise(F.coalesce(F.col("childless"), F.lit(False)).cast("long")).alias("leaf"))
    members = settled(_running(members, {"below_saved": "saved", "below_leaves": "leaf", "below_owned": "owns"}, down=True))
    # a member's owned nodes are the last of its own: it owns the next one if it owns all below
    below = F.least("tail", "length") - F.col("depth")
    child = ((below > 0) & (F.col("below_owned") - F.col("owns") == below)).cast("long")
    summed = members.where("depth < tail").groupBy("p1", "p2").agg(F.sum(child).alias("n_children"), F.sum("below_leaves").alias("n_leaves"), F.sum("below_saved").alias("saved_tokens"))
    # the first node of a stretch hangs on a prefix that a smaller conversation owns; the others on their own
    hung = members.where(F.col("depth") < F.col("tail")).where((F.col("owns") == 0) & (child == 1)).select(F.col("conv_id").alias("hung"), (F.col("depth") + 1).alias("at"), "p1", "p2")
    parents = hung.join(counted.select("p1", "p2", "owner"), ["p1", "p2"]).select("hung", "at", F.col("owner").alias("above"))
    ends = _ends(few.where("depth = length and depth < tail"))
    shared = counted.join(summed, ["p1", "p2"]).join(ends, ["p1", "p2"], "left").select(F.col("owner").alias("conv_id"), "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    begun = few.where("depth = tail").select("conv_id", "depth", *(F.expr(x).alias(c) for c, x in LONE.items()))
    nodes = shared.unionByName(begun)
    nodes = nodes.join(parents, (nodes["conv_id"] == parents["hung"]) & (nodes["depth"] == parents["at"]), "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")))
    return nodes.select(*NODE).unionByName(tails.select(*NODE))

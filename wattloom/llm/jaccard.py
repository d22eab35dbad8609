"""N-gram Jaccard join with PartEnum signatures: exact, without listing the pairs of a group.

A set of n shingles belongs to the size band [4^j, 4^(j+1)). For each band the shingle domain is
partitioned into m cells, about a third of the band's largest size; the content of one cell is one
signature. Sets with Jaccard similarity of at least 3/4 differ in at most k = (n + n') / 7 elements,
thus in at most k cells, and share every other cell. So of any k+1 signatures of a set at least one is
shared with each set that is similar to it: every set keeps only its k+1 signatures that the fewest
sets have, which leaves frequent passages out without losing a link. Signatures that very many sets have all count as equally frequent,
so their holders needn't meet to be counted. A set that reaches to the next
band gives that band's signatures too. (A set that fills k cells or fewer also names its empty cells
and keeps all signatures; then the argument holds for it too.)

Equal sets are one node. In each bucket of kept signatures every node is compared with the bucket's
most typical node, as far as their sizes allow a link. Buckets whose other nodes then still belong to several
components are open; components that open buckets name together form a cluster, and its nodes outside the
largest component are compared with all of it, in blocks. A set reaches each block once, so nothing of the size
of all pairs is written, and components are searched over verified links only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tasks import byte_texts, id_and_text, partitions, settled
from .components import components
from .shingles import SIZE, mix, set_keys, shingle_set

#: 100 * intersection >= PERCENT * union. The bounds below are for this value.
PERCENT = 75
CELLS = 0.35
#: Signatures that a task packs at once, at some 100 bytes for each; what is sent is as long with fewer.
FLUSH = 250_000
#: Shingles in a block of nodes to compare, and in a block of what they are compared with, at most; smaller clusters go in
#: up to SPREAD blocks of LEAST shingles or more.
OUTER, INNER, LEAST, SPREAD = 200_000, 800_000, 25_000, 16
ALL = 1 << 30
#: Shingles whose signatures one task holds, on average; beyond, there are more partitions than the session names.
HELD = 16_000_000
#: A signature that so many sets of one flush have at least is common: its holders are dealt over all tasks. With more flushes fewer will do,
#: so that what meets in one task stays about HELD.
COMMON = 64
#: What counts as the number of a common signature's holders: more than any other has.
MANY = (1 << 32) - 1
#: What a signature of a set is sent for: to be counted (0), as one of a common signature's holders, or as the mark of one.
HELD_HERE, MARK = 1, 2
_HEAD = np.dtype([("key", "<u8"), ("slack", "<i4"), ("n", "<i4"), ("size", "<i4")])


def set_table(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, key, key2), one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys = [], []
            for t in byte_texts(b.column("text")):
                s = shingle_set(t, size)
                n.append(len(s))
                keys.append(set_keys(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64())], ["doc_id", "n_shingles", "key", "key2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key long, key2 long")


def signatures(s: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """The PartEnum signatures of a set: (0 for the set's own band or 1 for the next, k + 1 - how many, signatures)."""
    n = len(s)
    band = (n.bit_length() - 1) // 2
    end, reach = 4 ** (band + 1), n * 100 // PERCENT
    schemes = [(0, band, min(reach, end - 1))] + [(1, band + 1, reach)] * (reach >= end)
    for nxt, j, partner in schemes:
        k, m = (n + partner) // 7, int(np.ceil(CELLS * 4 ** (j + 1)))
        cell = ((mix(s, 20) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        full = cell[first]
        sig = mix(np.add.reduceat(mix(s[order], 21), first) + full * np.uint64(0xD1342543DE82EF95), 30 + j)
        if len(sig) > k:
            yield nxt, k + 1 - len(sig), sig
        else:
            none = np.setdiff1d(np.arange(m, dtype=np.uint64), full)
            yield nxt, ALL, np.concatenate([sig, mix(none * np.uint64(0xD1342543DE82EF95), 1030 + j)])


def _pack(keys: np.ndarray, slack: np.ndarray, n: np.ndarray, size: np.ndarray, at: np.ndarray, columns: list[np.ndarray], to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows (at: index of the key, columns) dealt by ``to`` into byte strings."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        own, local = np.unique(at[part], return_inverse=True)
        head = np.empty(len(own), _HEAD)
        head["key"], head["slack"], head["n"], head["size"] = keys[own], slack[own], n[own], size[own]
        sizes = np.array([len(own), len(part)], "<u4")
        yield int(to[part[0]]), b"".join([sizes.tobytes(), head.tobytes(), local.astype("<u4").tobytes(), *(c[part].tobytes() for c in columns)])


def _unpack(batches: Iterator[pa.RecordBatch], kinds: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    heads, ats, columns, base = [], [], [[] for _ in kinds], 0
    for b in batches:
        for x in b.column("blob"):
            raw = x.as_buffer()
            nk, ns = np.frombuffer(raw, "<u4", 2)
            heads.append(np.frombuffer(raw, _HEAD, nk, 8).copy())
            off = 8 + nk * _HEAD.itemsize
            ats.append(np.frombuffer(raw, "<u4", ns, off).astype(np.int32) + np.int32(base))
            off += 4 * ns
            for c, kind in zip(columns, kinds, strict=True):
                c.append(np.frombuffer(raw, kind, ns, off).copy())
                off += np.dtype(kind).itemsize * ns
            base += int(nk)
    if not heads:
        return np.empty(0, _HEAD), np.empty(0, np.int32), [np.empty(0, k) for k in kinds]
    return np.concatenate(heads), np.concatenate(ats), [np.concatenate(c) for c in columns]


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "blob"])


def sent_signatures(docs: DataFrame, size: int, parts: int, common: int) -> DataFrame:
    """(doc_id, text) to (part, blob): the signatures of each task's distinct sets, packed, for the task that counts them; a signature that ``common`` sets of one flush have goes with its holders to any."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task, so a large group of copies sends each signature once from each task
        keys, slack, n, sizes, sigs = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            at = np.repeat(np.arange(len(keys)), [len(x) for x in sigs])
            flat = np.concatenate(sigs)
            to = (((flat >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
            held = np.diff(np.append(first, len(flat)))
            often = np.zeros(len(flat), bool)
            often[order] = np.repeat(held >= common, held)
            heads = [np.array(x, kind) for x, kind in ((keys, np.uint64), (slack, np.int32), (n, np.int32), (sizes, np.int32))]
            rows = []
            if often.any():
                # the holders by their own key, and one of each signature, as its mark, to where it is counted
                spread = ((mix(heads[0][at[often]], 42) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                rows += _pack(*heads, at[often], [flat[often].astype("<u4"), to[often], np.full(often.sum(), HELD_HERE, np.uint8)], spread)
                mark = order[first[held >= common]]
                rows += _pack(*heads, at[mark], [flat[mark].astype("<u4"), to[mark], np.full(len(mark), MARK, np.uint8)], to[mark])
            few = ~often
            rows += _pack(*heads, at[few], [flat[few].astype("<u4"), to[few], np.zeros(few.sum(), np.uint8)], to[few])
            for x in (keys, slack, n, sizes, sigs):
                x.clear()
            return _blobs(rows)

        waiting = 0
        for b in batches:
            for t in byte_texts(b.column("text")):
                s = shingle_set(t, size)
                key = set_keys(s)[0]
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                for nxt, less, sig in signatures(s):
                    keys.append(key | nxt)
                    slack.append(less)
                    n.append(len(sig))
                    sizes.append(len(s))
                    sigs.append(sig)
                    waiting += len(sig)
                if waiting >= FLUSH:
                    yield flush()
                    waiting = 0
        if sigs:
            yield flush()

    return docs.mapInArrow(emit, "part int, blob binary")


def kept_signatures(docs: DataFrame, size: int = SIZE, shingles: int = 0) -> DataFrame:
    """(doc_id, text) to (bucket, node, n, rank): for each distinct set that may have a partner, its k+1 rarest shared signatures. node is the set's key, n its size, rank the share of its signatures that others have.

    ``shingles``: how many all sets have, at most; the number of partitions grows with it.

    Where a signature is common, its holders go to any task, with the mark that it is, and only the mark goes to the task where its other holders are
    counted. Marked or counted there, it gets the same number everywhere, which is all that the choice of the rarest asks for."""
    parts = max(partitions(docs.sparkSession), -(-shingles // HELD))
    common = max(2, min(COMMON, HELD * FLUSH // max(shingles, 1)))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The signatures that two sets or more have, with how many have them, dealt by key."""
        heads, at, (sig, home, role) = _unpack(batches, ["<u4", "<i4", "u1"])
        if not len(sig):
            return
        uniq, back = np.unique(heads["key"], return_inverse=True)
        pick = np.empty(len(uniq), np.int64)
        pick[back] = np.arange(len(back))
        marks, counted = np.unique(sig[role == MARK]), role == 0
        # signature and set in one number, in place, as this is the most that a task holds
        code = sig[counted].astype(np.uint64)
        code <<= np.uint64(32)
        code |= back.astype(np.uint64)[at[counted]]
        code.sort()
        code = code[np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1]))]
        low = (code >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(low)), bool), low[1:] != low[:-1])))
        many = np.diff(np.append(first, len(low)))
        count = np.where(np.isin(low[first], marks), MANY, many)
        hold = np.repeat(count > 1, many)
        low, own, count = low[hold], (code[hold] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.repeat(count, np.where(count > 1, many, 0))
        at_home = np.full(len(low), TaskContext.get().partitionId())
        here = np.flatnonzero(role == HELD_HERE)
        if len(here):
            # each set once for each signature, though several tasks may have sent it
            one = np.unique(np.stack((home[here].astype(np.int64) << 32 | sig[here], back[at[here]])), axis=1)
            low, own = np.concatenate((low, (one[0] & 0xFFFFFFFF).astype(np.uint32))), np.concatenate((own, one[1]))
            count, at_home = np.concatenate((count, np.full(one.shape[1], MANY))), np.concatenate((at_home, one[0] >> 32))
        to = ((mix(uniq[own] & ~np.uint64(1), 40) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        wide = mix(low.astype(np.uint64) | at_home.astype(np.uint64) << np.uint64(32), 41) >> np.uint64(1)  # 32 bits name it only within its home
        yield _blobs(list(_pack(uniq, heads["slack"][pick], heads["n"][pick], heads["size"][pick], own, [wide.astype("<u8"), count.astype("<u4")], to)))
        del heads, at, sig, uniq, back, pick, code, low, own, count, wide, to, home, role, counted, at_home
        pa.default_memory_pool().release_unused()  # the worker goes on with other stages

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, at, (sig, count) = _unpack(batches, ["<u8", "<u4"])
        if not len(sig):
            return
        uniq, back = np.unique(heads["key"], return_inverse=True)
        pick = np.empty(len(uniq), np.int64)
        pick[back] = np.arange(len(back))
        own = back[at]
        order = np.lexsort((sig, count, own))
        own, sig, count = own[order], sig[order], count[order]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (sig[1:] != sig[:-1])))  # copies of a set may have been counted at both places
        own, sig, count = own[new], sig[new], count[new]
        shared = np.bincount(own, minlength=len(uniq))
        need = heads["slack"][pick].astype(np.int64) + shared
        rank = np.arange(len(own)) - np.repeat(np.cumsum(shared) - shared, shared)
        hold = rank < need[own]
        own, sig, count = own[hold], sig[hold], count[hold]
        typical = shared / np.maximum(heads["n"][pick], 1)
        node, size = (uniq[own] & ~np.uint64(1)).astype(np.int64), heads["size"][pick][own]
        yield pa.RecordBatch.from_arrays([pa.array(sig.astype(np.int64)), pa.array(node), pa.array(size, pa.int32()), pa.array(typical[own], pa.float64())], ["bucket", "node", "n", "rank"])

    blob = "part int, blob binary"
    first = sent_signatures(docs, size, parts, common).repartitionById(parts, F.col("part")).mapInArrow(share, blob)
    return first.repartitionById(parts, F.col("part")).mapInArrow(keep, "bucket long, node long, n int, rank double")


def shingle_arrays(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(node, text) to (node, key, shingles array<long>), key being that of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, size) for t in byte_texts(b.column("text"))]
            keys = pa.array([set_keys(x)[0] for x in sets], pa.int64())
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))
            kind = pa.LargeListArray if ends[-1] > 2**31 - 1 else pa.ListArray
            yield pa.RecordBatch.from_arrays([b.column("node"), keys, kind.from_arrays(pa.array(ends, pa.int64() if kind is pa.LargeListArray else pa.int32()), flat)], ["node", "key", "shingles"])

    return docs.mapInArrow(run, "node long, key long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by exact counts."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("same"))
    return both.where(f"100 * same >= {PERCENT} * (na + nb - same)").select("a", "b")


def _compare(group: pa.Table) -> pa.Table:
    """One block: rows with outer = true against rows with outer = false; one link to each component is enough."""
    outer = group.column("outer").to_numpy(zero_copy_only=False)
    nodes, comps = group.column("node").to_numpy(), group.column("component").to_numpy()
    sets = group.column("shingles").combine_chunks()
    ends = sets.offsets.to_numpy()
    flat = sets.values.to_numpy(zero_copy_only=False)
    own = [flat[ends[i] : ends[i + 1]] for i in range(len(nodes))]
    inner = np.flatnonzero(~outer)
    out_a, out_b = [], []
    if len(inner):
        size = np.array([len(own[i]) for i in inner])
        every, whose = np.concatenate([own[i] for i in inner]), np.repeat(np.arange(len(inner)), size)
        order = np.argsort(every, kind="stable")
        every, whose = every[order], whose[order]
        for i in np.flatnonzero(outer):
            lo, hi = np.searchsorted(every, own[i], "left"), np.searchsorted(every, own[i], "right")
            some = hi - lo
            at = np.repeat(lo - np.cumsum(some) + some, some) + np.arange(some.sum())
            same = np.bincount(whose[at], minlength=len(inner))
            near = (100 * same >= PERCENT * (len(own[i]) + size - same)) & (comps[inner] != comps[i])
            _, one = np.unique(comps[inner][near], return_index=True)
            mates = nodes[inner][near][one]
            out_a += [nodes[i]] * len(mates)
            out_b += mates.tolist()
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def linked(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Components (node, component) of the links between nodes that share a bucket; None where no bucket has two nodes.

    ``members``: (bucket, node, n, rank), n being the size of the node's set; settled. ``sets_of``: wanted nodes (node) to (node, shingles).
    In each bucket all are compared with the node of the largest rank, as far as their sizes allow a link.
    """
    top = members.groupBy("bucket").agg(F.max(F.struct("rank", "node", "n")).alias("top"), F.count("*").alias("m")).where("m > 1").select("bucket", "m", F.col("top.node").alias("rep"), F.col("top.n").alias("rep_n"))
    rest = members.join(top, "bucket").where("node <> rep").select("bucket", "node", "n", "rep", "rep_n", "m")
    fit = f"100 * least(n, rep_n) >= {PERCENT} * greatest(n, rep_n)"
    pairs = settled(rest.where(fit).select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct())
    many = settled(rest.where("m > 2").select("bucket", "node", "n"))
    if pairs.isEmpty() and many.isEmpty():
        return None
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(many.select("node")).distinct()
    sets = settled(sets_of(wanted))
    comp = components(verified(pairs, sets))
    more = remaining(many, comp, sets)
    return comp if more is None else components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def remaining(many: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links that comparing with one node of each bucket can't show: between its others (bucket, node, n) where they belong to several components.

    Components that such buckets name together form a cluster; what lies outside its largest component is compared with all of it.
    """
    named = many.join(comp, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    span = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket", "low")
    apart = settled(named.join(span, "bucket").select("node", "n", "component", "low").distinct())
    if apart.isEmpty():
        return None
    clusters = components(apart.select(F.col("component").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    member = settled(apart.select("node", "n", "component").distinct().join(clusters, "component"))
    weight = member.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.count("*").alias("nodes"))
    stats = weight.groupBy("cluster").agg(F.max(F.struct("nodes", "n", "component")).alias("main"), F.sum("n").alias("all"))
    blocks = lambda n, most: F.greatest(F.ceil(n / most), F.least(F.ceil(n / LEAST), F.lit(SPREAD))).cast("int")
    stats = stats.select("cluster", F.col("main.component").alias("main"), blocks(F.col("all") - F.col("main.n"), OUTER).alias("outers"), blocks(F.col("all"), INNER).alias("inners"))
    member = member.join(stats, "cluster").join(sets, "node")
    deal = F.xxhash64("node")
    outer = member.where("component <> main").withColumn("o", F.pmod(deal, F.col("outers"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("inners") - 1)))
    inner = member.withColumn("i", F.pmod(deal, F.col("inners"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outers") - 1)))
    cols = [F.col("cluster"), F.col("o").cast("int").alias("o"), F.col("i").cast("int").alias("i"), "node", "component", "shingles"]
    blocks = outer.select(*cols, F.lit(True).alias("outer")).union(inner.select(*cols, F.lit(False).alias("outer")))
    return blocks.groupBy("cluster", "o", "i").applyInArrow(_compare, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_shingles, component_id).

    Two documents link when 100 * intersection >= 75 * union of their sets of distinct ``size``-word
    shingles; component_id is the smallest doc_id that links reach. A null or blank text has no
    shingles and its own id as component. Repeated rows are returned as often as they come; a row
    with a null id is returned with its class's smallest id, or null. Rows that repeat an id with other texts
    link by their own texts. An empty table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col)
    table = settled(set_table(docs, size))
    same = ["key", "key2", "n_shingles"]
    nodes = settled(table.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("first")).where("first is not null"))
    shingles = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    kept = settled(kept_signatures(docs, size, shingles))
    listed = table.where("n_shingles > 0").join(nodes, same, "left").select("doc_id", "n_shingles", "key", F.coalesce("first", "doc_id").alias("first"))
    blank = table.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        firsts = nodes.join(wanted, nodes.key == wanted.node).select("first", "node")
        texts = docs.join(firsts, docs.doc_id == firsts["first"]).select("node", "text")
        # an id that repeats with several texts gives sets that aren't the node's
        return shingle_arrays(texts, size).where("node = key").groupBy("node").agg(F.first("shingles").alias("shingles"))

    comp = linked(kept, sets_of)
    if comp is None:
        return listed.select("doc_id", "n_shingles", F.col("first").alias("component_id")).union(blank)
    least = comp.join(nodes.select(F.col("key").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    reached = comp.join(least, "component").select(F.col("node").alias("key"), "least")
    return listed.join(reached, "key", "left").select("doc_id", "n_shingles", F.coalesce("least", "first").alias("component_id")).union(blank)

"""Filter interaction audit: what each of several filters removes, in every order in which they may stand.

A table-driven transducer over bytes reads each text once. Its state is the class of the byte before, its
input the class of the next, and its table says what a step emits: a word begins, a word ends, a code point
goes on, a capital, a symbol. Tasks run it over blocks of many texts at a time, as one look-up of (state, class) for
each byte. Word spans go into a hash table with open addressing, where an equal hash counts as the same
word only after its bytes have been compared.

Spark does the rest on rows without texts: copies are told by SHA-256 and length, documents are counted by part and
by which filters they fail, and all orders follow from those counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tasks import byte_texts
from .shingles import mix

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = b"#$%&*|"
#: Bytes of texts that share a pass.
BLOCK = 1 << 18

# Classes of bytes.
BLANK, PLAIN, CAPITAL, SYMBOL, LEAD, CONTINUED = range(6)
# What a step emits.
BEGINS, ENDS, INNER, UPPER, SIGN = 1, 2, 4, 8, 16

CLASSES = np.full(256, PLAIN, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = BLANK
CLASSES[65:91] = CAPITAL
CLASSES[list(SYMBOLS)] = SYMBOL
CLASSES[128:192] = CONTINUED
CLASSES[192:] = LEAD


def _table() -> np.ndarray:
    """What each step emits, by state and class; a text begins and ends in the state of a blank."""
    t = np.zeros((6, 6), np.uint8)
    for state in range(6):
        for c in range(6):
            t[state, c] = (
                (BEGINS if state == BLANK and c != BLANK else 0)
                | (ENDS if state != BLANK and c == BLANK else 0)
                | (INNER if c == CONTINUED else 0)
                | (UPPER if c == CAPITAL else 0)
                | (SIGN if c == SYMBOL else 0)
            )
    return t.ravel()


TABLE = _table()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_down(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers


class WordTable:
    """Distinct words of texts in one buffer: a hash table of spans, open addressing, with bytes compared."""

    def __init__(self, buffer: bytes, room: int = 1 << 15):
        self.windows = np.ndarray(max(len(buffer), 1), "<u8", buffer + bytes(8), strides=(1,))
        self.slots = np.full(room, -1, np.int64)
        self.spans = np.zeros((4, 0), np.int64)  # start, length, text, hash

    def _same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes at a and b are the same; eight at a time."""
        same, rest = np.ones(len(a), bool), np.arange(len(a))
        at = 0
        while len(rest):
            left = np.minimum(length[rest] - at, 8)
            keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64)
            equal = (self.windows[a[rest] + at] ^ self.windows[b[rest] + at]) & keep == 0
            same[rest[~equal]] = False
            at += 8
            rest = rest[equal & (length[rest] > at)]
        return same

    def add(self, spans: np.ndarray) -> np.ndarray:
        """Puts in the spans that aren't there; says which were new."""
        known = self.spans.shape[1]
        while (known + spans.shape[1]) * 2 > len(self.slots):
            self.slots = np.full(len(self.slots) * 4, -1, np.int64)
            self._place(self.spans, np.arange(known))
        both = np.concatenate((self.spans, spans), axis=1)
        new = self._place(both, np.arange(known, both.shape[1]))
        fresh = np.flatnonzero(new[known:])
        kept = np.concatenate((np.arange(known), fresh + known))
        if len(fresh) < spans.shape[1]:
            number = np.full(both.shape[1], -1, np.int64)
            number[kept] = np.arange(len(kept))
            full = self.slots >= 0
            self.slots[full] = number[self.slots[full]]
        self.spans = both[:, kept]
        return fresh

    def _place(self, spans: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Gives each of ``rest`` a slot of its own or finds its like; which got their own."""
        start, length, text, h = spans
        own, step = np.zeros(spans.shape[1], bool), 0
        mask = len(self.slots) - 1
        while len(rest):
            slot = (h[rest] + step) & mask
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rest[free]  # of several that want a slot the last gets it
            there = self.slots[slot]
            own[rest[there == rest]] = True
            like = (there != rest) & (h[there] == h[rest]) & (length[there] == length[rest]) & (text[there] == text[rest])
            like[like] = self._same(start[rest[like]], start[there[like]], length[rest[like]])
            rest = rest[(there != rest) & ~like]
            step += 1
        return own


def measured(buffer: bytes, ends: np.ndarray) -> np.ndarray:
    """Rows (words, distinct words, code points, capitals, symbols), a column for each text; text i of ``buffer`` ends before ends[i]."""
    n = len(ends)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    out = np.zeros((5, n), np.int64)
    table = WordTable(buffer)
    at = 0
    while at < len(buffer):
        end = min(at + BLOCK, len(buffer))
        while end < len(buffer) and CLASSES[buffer[end]] != BLANK and not ends[np.searchsorted(ends, end)] == end:
            end += 1
        raw = np.frombuffer(buffer, np.uint8, end - at, at)
        kind = CLASSES[raw]
        state = np.empty_like(kind)
        state[0], state[1:] = BLANK, kind[:-1]
        state[begins[(begins > at) & (begins < end)] - at] = BLANK
        said = TABLE[state * np.uint8(6) + kind]

        def each(what: int, said=said, at=at) -> np.ndarray:
            places = np.flatnonzero((said & what) != 0) + at
            return np.searchsorted(places, ends) - np.searchsorted(places, begins)

        out[2] += np.clip(ends, at, end) - np.clip(begins, at, end) - each(INNER)
        out[3] += each(UPPER)
        out[4] += each(SIGN)
        starts = np.flatnonzero((said & BEGINS) != 0)
        if len(starts):
            text = np.searchsorted(ends, starts + at, "right")
            stops = np.flatnonzero((said & ENDS) != 0)
            # a word also ends where its text or the block does
            after = np.append(stops, len(raw))[np.searchsorted(stops, starts)]
            after = np.minimum(after, ends[text] - at)
            up, down = _up_down(max(len(raw) + 1, BLOCK + 64))
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
            h = mix((sums[after] - sums[starts]) * down[starts] + text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            spans = np.stack((starts + at, after - starts, text, (h >> np.uint64(2)).astype(np.int64)))
            out[0] += np.bincount(text, minlength=n)
            out[1] += np.bincount(text[table.add(spans)], minlength=n)
        at = end
    return out


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BLOCK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def text_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, text_key, n_words, n_distinct, n_chars, n_capitals, n_symbols), one row for each row of ``docs``. text_key: SHA-256 and length of the text; null texts and parts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in _groups(list(byte_texts(b.column("text")))):
                facts = measured(b"".join(texts), np.cumsum([len(t) for t in texts]))
                rest = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([rest.column("doc_id").cast(pa.int64()), rest.column("part"), rest.column("text_key"), *map(pa.array, facts)], names)
                at += len(texts)

    counts = ("n_words", "n_distinct", "n_chars", "n_capitals", "n_symbols")
    names = ["doc_id", "part", "text_key", *counts]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].alias("text"))
    rows = rows.select("doc_id", "part", F.concat_ws(":", F.sha2(text, 256), F.octet_length(text)).alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, text_key string, " + ", ".join(f"{c} long" for c in counts))


def failures() -> Column:
    """Bits of the filters A to D that a row of text_facts fails."""
    conditions = (
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("n_capitals") > CAPITAL_PERCENT * F.col("n_chars"),
        F.col("n_symbols") > 0,
    )
    total = F.lit(0)
    for k, c in enumerate(conditions):
        total = total + F.when(c, 1 << k).otherwise(0)
    return total


def patterns(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, n, n_good, n_toxic): documents of each part by the set of filters they fail, bit k for the filter k of FILTERS.

    A row fails E if a smaller id has the same text anywhere in the table; a row with a null id doesn't, nor
    do rows that repeat the smallest id. A document is good, or toxic, if any of its labels says so. Copies
    are counted before they meet: no key gathers more rows than there are sets of filters, labels and parts.
    """
    rows = text_facts(docs, id_col, text_col, part_col).select("doc_id", "part", "text_key", failures().alias("own"))
    rows = rows.groupBy("doc_id", "part", "text_key", "own").agg(F.count("*").alias("c"))
    said = labels.groupBy(labels["doc_id"].alias("labelled")).agg(F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("bad"))
    rows = rows.join(said.where("labelled is not null and (good or bad)"), rows["doc_id"] == said["labelled"], "left")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "bad")]
    copies = rows.groupBy("text_key", "part", "own", *flags).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("n_null"), first.alias("first"))
    least = copies.groupBy(F.col("text_key").alias("key")).agg(F.min("first.doc_id").alias("least"))
    met = copies.join(least, copies["text_key"] == least["key"], "left")
    held = F.col("n_null") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    halves = met.select("part", "good", "bad", F.explode(F.array(F.struct(F.col("own").alias("fails"), held.alias("n")), F.struct((F.col("own") + 16).alias("fails"), (F.col("n") - held).alias("n")))).alias("x"))
    return halves.where("x.n > 0").groupBy("part", F.col("x.fails").alias("fails")).agg(F.sum("x.n").alias("n"), *(F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(a) for c, a in (("good", "n_good"), ("bad", "n_toxic"))))


def orders(filters: Sequence[str] = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the filter): all orders of ``filters``, 600 rows for five."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    return [("".join(o), k + 1, sum(bit[x] for x in o[:k]), bit[f]) for o in permutations(filters) for k, f in enumerate(o)]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part, order of the filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    The parts are all values of ``part_col``, null as the empty string; an empty table has none. Steps that
    remove nothing have their rows too. See ``patterns`` for null ids, repeated rows and labels.
    """
    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(before).alias("before"), F.lit(bit).alias("bit")) for o, k, before, bit in orders()))
    fails, bit, before = F.col("fails"), F.col("s.bit"), F.col("s.before")
    hit, earlier = fails.bitwiseAND(bit) > 0, fails.bitwiseAND(before) > 0
    # a document that fails k filters is removed by each of them in 120 / k of the orders
    share = F.expr(f"{len(orders()) // len(FILTERS)} div greatest(bit_count(fails), 1)")

    def total(what: Column, n: str | Column) -> Column:
        return F.sum(F.when(what, F.col(n) if isinstance(n, str) else n).otherwise(0)).cast("long")

    return (
        patterns(docs, labels, id_col, text_col, part_col)
        .withColumn("s", F.explode(steps))
        .groupBy("part", "s.filter_order", "s.step")
        .agg(
            total(~hit & ~earlier, "n").alias("kept"),
            total(hit & ~earlier, "n").alias("removed"),
            total(hit & earlier, "n").alias("redundant"),
            total(fails == bit, "n").alias("unique_fails"),
            total(hit & ~earlier, "n_good").alias("good_lost"),
            total(hit & ~earlier, "n_toxic").alias("toxic_lost"),
            total(hit, F.col("n") * share).alias("shapley"),
        )
    )

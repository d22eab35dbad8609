"""Byte-level BPE by our own merges: a priority queue of merge ranks over a doubly linked list of symbols.

Stale queue entries are skipped when popped. Decoding concatenates vocabulary strings. Words recur, so a
worker keeps the ids of the words it has seen.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._tasks import id_and_text

#: Words whose ids a worker keeps; beyond them it starts anew. Longer words aren't kept.
MEMORY, LONGEST = 150_000, 64
#: Characters of text whose results go back to Spark together.
WINDOW = 1 << 21
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_kept: dict[str, Bpe] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict(zip(plain, map(chr, plain), strict=True))
    shown |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
    return [shown[b] for b in range(256)]


class Bpe:
    """Encodes and decodes by a vocabulary file of the tokenizers library (model BPE, byte level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        #: By the two ids: the rank, counted from 1, above the id of what they become.
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(pairs, 1)}
        self.byte_ids = [vocab.get(c, -1) for c in letters]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(_WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merges, lowest rank first, leftmost first among equals. A merged-away symbol is -1; after and prev link the others."""
        n, get = len(ids), self.merges.get
        queue = [(m, i) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1]))]
        if not queue:
            return ids
        heapq.heapify(queue)
        prev, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ids.append(-1)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            m, i = pop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != m:
                continue  # stale
            ids[i] = new = m & 0xFFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                prev[k] = i
                if m := get(new << 20 | ids[k]):
                    push(queue, (m, i))
            h = prev[i]
            if h >= 0 and (m := get(ids[h] << 20 | new)):
                push(queue, (m, h))
        return [x for x in ids if x >= 0]

    def word(self, w: str) -> bytes:
        """The ids of a word, as 32-bit numbers in a row."""
        ids = array("I", self.merge([self.byte_ids[b] for b in w.encode()])).tobytes()
        if len(w) <= LONGEST:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[w] = ids
        return ids

    def encode(self, text: str) -> array:
        known, out = self.known, array("I")
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part])
            else:
                out.frombytes(b"".join([known.get(w) or self.word(w) for w in self.words.findall(part)]))
        return out

    def decode(self, ids: array) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def loaded(path: str) -> Bpe:
    if path not in _kept:
        _kept[path] = Bpe(path)
    return _kept[path]


def _little(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool | None = None) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_tokens, ids_sha256, decoded_sha256), and with ``with_ids`` also ids array<int>, with ``with_text`` (as ``with_ids`` where not given) decoded string.

    ids are those of the tokenizers library without added special tokens; special strings inside a text
    become their own ids. A null text counts as empty: 0 tokens, digests of nothing. Null ids and repeated
    rows are returned as they come; other columns are dropped; an empty table gives no rows.
    """

    with_text = with_ids if with_text is None else with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary_path)
        for b in batches:
            start, size, rows = 0, 0, []
            for at, x in enumerate(b.column("text")):
                ids = bpe.encode(x.as_py() or "")
                text = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(_little(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), np.frombuffer(ids, np.int32) if with_ids else None, text if with_text else None))
                size += len(text)
                if size >= WINDOW or at + 1 == len(b):
                    yield batch(b.column("doc_id").slice(start, at + 1 - start), rows)
                    start, size, rows = at + 1, 0, []

    def batch(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        if with_ids:
            ends = pa.array(np.cumsum([0, *(r[0] for r in rows)]), pa.int32())
            columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[3] for r in rows]), pa.int32()))]
        if with_text:
            columns.append(pa.array([r[4] for r in rows], pa.string()))
        return pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), *columns], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)

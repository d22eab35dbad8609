"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, between a character that isn't white space and a following run of
spaces or line breaks: the pre-tokenizer always ends a match there and what follows depends on nothing
before it, so lengths add up. A cut text's pieces recur, so each task encodes a piece once and keeps its
length; new pieces go to the library in batches of equal bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._tasks import id_and_text

LIMIT = 1024
BATCH_BYTES = 1 << 20
#: Pieces whose lengths a worker keeps; beyond them it starts anew.
MEMORY = 1_000_000
#: Characters of a text that are looked at together.
WINDOW = 1 << 22
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space other than space and line feed, by Unicode or by Python: it may join what lies around it.
_OTHER = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
#: For texts with such characters: letters and digits end a match before white space of any kind.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
_kept: dict[str, tuple] = {}


def _tokenizer(name: str) -> tuple:
    if name not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(name)
        t.no_truncation()
        t.no_padding()
        _kept[name] = t, {}
    return _kept[name]


def pieces(text: str) -> list[str]:
    """``text`` cut at safe boundaries."""
    if _OTHER.search(text):
        return _SAFE.split(text)
    return _PIECE.findall(text)


def lengths(tokenizer, texts: list[str], known: dict[str, int]) -> list[int]:
    """Tokens of each text. ``known``: lengths of pieces so far, extended here."""
    if len(known) > MEMORY:
        known.clear()
    cut = [pieces(t) for t in texts]
    new = list({p for ps in cut for p in ps if p not in known})
    at = 0
    while at < len(new):
        end, size = at, 0
        while end < len(new) and (end == at or size + len(new[end]) * 2 <= BATCH_BYTES):
            size += len(new[end]) * 2
            end += 1
        for p, e in zip(new[at:end], tokenizer.encode_batch_fast(new[at:end], add_special_tokens=False), strict=True):
            known[p] = len(e)
        at = end
    return [sum(map(known.__getitem__, ps)) for ps in cut]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_bytes, n_tokens, over_limit).

    n_tokens is what the tokenizers library gives for the whole text with ``tokenizer_path``, without
    added special tokens, truncation or padding. A null text counts as empty: 0 bytes, 0 tokens. Null ids
    and repeated rows are returned as they come; other columns are dropped; an empty table gives no rows.
    A text without any safe boundary is encoded in one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(tokenizer_path)
        for b in batches:
            ids, n_bytes, n_tokens, waiting, size = b.column("doc_id").cast(pa.int64()), [], [], [], 0
            for x in b.column("text"):
                t = x.as_py() or ""
                n_bytes.append(x.as_buffer().size if t else 0)
                waiting.append(t)
                size += len(t)
                if size >= WINDOW:
                    n_tokens += lengths(tokenizer, waiting, known)
                    waiting, size = [], 0
            n_tokens += lengths(tokenizer, waiting, known)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

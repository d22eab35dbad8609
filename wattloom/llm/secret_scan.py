"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived that every match's text must
meet. Texts are taken in segments of a few MB; a segment's index holds, for each trigram that some query
asks for, the rows with it. Queries intersect and unite these postings; only the rows that are left are
verified with the expression itself. Rules without any mandatory trigram scan all rows. A segment's index
never leaves its task, so nothing is shuffled and no trigram, however common, meets in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tasks import byte_texts, id_and_text

#: Bytes of texts that share an index, about; bytes of a text that are looked at together.
SEGMENT = 4 << 20
BLOCK = 1 << 20
#: Strings that a part of an expression may stand for before its trigrams are given up, and characters of a class.
STRINGS, CLASS = 64, 6


class Rule(NamedTuple):
    """``pattern``: ASCII, for Python's bytes and for RE2 alike. A match counts if its ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _cased(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_cased(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The kinds that every scan tells, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the maximal runs of that length
)
# Published forms of keys and tokens, by kind.
EXTRA = (
    Rule("temporary_access", r"ASIA[A-Z0-9]{16}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("google_api", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("mailgun", r"key-[0-9a-z]{32}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{50,}"),
    Rule("hugging_face", r"hf_[A-Za-z]{34}"),
    Rule("digital_ocean", r"do[opr]_v1_[0-9a-f]{64}"),
    Rule("shopify", r"shp(at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    Rule("square", r"sq0(atp|csp)-[A-Za-z0-9_-]{22,43}"),
    Rule("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN ([A-Z]+ ){0,2}PRIVATE KEY( BLOCK)?-----"),
    Rule("bearer", rf"{_cased('bearer')}\x20+[A-Za-z0-9+/_.~-]{{20,}}=*"),
    Rule("storage_key", r"AccountKey=[A-Za-z0-9+/]{40,}={0,2}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9_.~%-]{1,64}:[!#-.0-9;-?A-~]{3,128}@"),
    Rule("vault", r"hvs\.[A-Za-z0-9_-]{24,}"),
)
RULES = (*BASE, *EXTRA)

#: A query is a trigram, ("and" | "or", queries), or None: all rows.
Query = str | tuple | None


def _join(kind: str, parts: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "or" and (None in parts or not parts):
        return None
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _any_of(strings: set[str]) -> Query:
    """One of ``strings``; what asks for more than another does not is left out."""
    each = {frozenset(s[i : i + 3] for i in range(len(s) - 2)): s for s in sorted(strings)}
    least = [s for own, s in each.items() if not any(other < own for other in each)]
    return _join("or", (_join("and", (s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(least)))


def _strings(items) -> set[str] | None:
    """All strings that ``items`` of a parsed expression match, in lower case, if they are few."""
    found = {""}
    for op, arg in items:
        match str(op):
            case "LITERAL":
                one = {chr(arg).lower()}
            case "IN":
                one = _class(arg)
            case "SUBPATTERN":
                one = _strings(arg[3])
            case "BRANCH":
                each = [_strings(x) for x in arg[1]]
                one = None if None in each else set().union(*each)
            case "MAX_REPEAT" | "MIN_REPEAT":
                low, high, what = arg
                base = _strings(what) if int(high) <= 4 else None
                one = base and set().union(*({"".join(p) for p in product(base, repeat=n)} for n in range(low, int(high) + 1) if len(base) ** n <= STRINGS))
                if base and len(base) ** int(high) > STRINGS:
                    one = None
            case _:
                one = None
        if one is None or len(found) * len(one) > STRINGS:
            return None
        found = {a + b for a in found for b in one}
    return found


def _class(members) -> set[str] | None:
    found: set[str] = set()
    for op, arg in members:
        if str(op) == "LITERAL":
            found.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < CLASS:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= CLASS else None


def _items(items) -> Query:
    parts: list[Query] = []
    run = {""}

    def end() -> None:
        nonlocal run
        parts.append(_any_of(run))
        run = {""}

    for item in items:
        op, arg = str(item[0]), item[1]
        one = _strings([item])
        if one is not None:
            if len(run) * len(one) > STRINGS:
                end()
            run = {a + b for a in run for b in one}
            continue
        if op == "SUBPATTERN":
            end()
            parts.append(_items(arg[3]))
        elif op == "BRANCH":
            end()
            parts.append(_join("or", (_items(x) for x in arg[1])))
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            first = _strings(arg[2])  # the first round follows what stands before
            if first is not None and len(run) * len(first) <= STRINGS:
                run = {a + b for a in run for b in first}
                end()
            else:
                end()
                parts.append(_items(arg[2]))
        else:
            end()
    end()
    return _join("and", parts)


def trigram_query(pattern: str) -> Query:
    """What trigrams, in lower case, the text of any match of ``pattern`` holds; None if none is certain."""
    return _items(re._parser.parse(pattern))


def _asked(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_asked, query[1]))


class Index:
    """Rows of a segment by trigram, for the trigrams ``asked`` for."""

    def __init__(self, asked: Iterable[str]):
        self.slot = {t: k for k, t in enumerate(sorted(asked), 1)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, k in self.slot.items():
            self.table[int.from_bytes(t.encode("latin-1"))] = k
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32
        self.none = np.zeros(0, np.int64)

    def build(self, texts: list[bytes]) -> None:
        found: list[np.ndarray] = []
        for i, t in enumerate(texts):
            for at in range(0, max(len(t) - 2, 0), BLOCK):
                raw = self.lower[np.frombuffer(t, np.uint8, min(BLOCK + 2, len(t) - at), at)]
                slots = self.table[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
                found.append(np.unique(slots[slots > 0]).astype(np.int64) << 40 | i)
        both = np.unique(np.concatenate(found)) if found else self.none
        self.rows = both & (1 << 40) - 1
        self.ends = np.searchsorted(both >> 40, np.arange(1, len(self.slot) + 2))

    def postings(self, trigram: str) -> np.ndarray:
        k = self.slot[trigram] - 1
        return self.rows[self.ends[k] : self.ends[k + 1]]

    def candidates(self, query: Query, n: int) -> np.ndarray:
        """Rows, ascending, that meet the query."""
        if query is None:
            return np.arange(n)
        if isinstance(query, str):
            return self.postings(query)
        each = (self.candidates(q, n) for q in query[1])
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, each)


def _code_points(text: bytes, at: list[int]) -> list[int]:
    """Byte offsets as offsets in code points."""
    if text.isascii() or not at:
        return at
    places, before, out, last = sorted(set(at)), {}, 0, 0
    for p in places:
        part = np.frombuffer(text, np.uint8, p - last, last)
        out += int(np.count_nonzero((part & 0xC0) != 0x80))
        before[p], last = out, p
    return [before[p] for p in at]


def _segments(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SEGMENT:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (doc_id, spans), spans an array of (kind, start, end) by start, then in the order of ``rules``.

    start and end are code points, end exclusive; for each rule the matches are leftmost and don't overlap,
    and those whose group is too short are dropped. A null text counts as empty. Null ids and repeated rows
    are returned as they come; other columns are dropped; an empty table gives no rows.
    """
    queries = [trigram_query(r.pattern) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, found = Index(set().union(*map(_asked, queries))), [re.compile(r.pattern.encode()) for r in rules]
        for b in batches:
            at = 0
            ids = b.column("doc_id")
            for texts in _segments(byte_texts(b.column("text"))):
                index.build(texts)
                spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for i in index.candidates(query, len(texts)):
                        spans[i] += [(m.start(), k, m.end()) for m in found[k].finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                rows = []
                for text, own in zip(texts, spans, strict=True):
                    own.sort()
                    starts, ends = (_code_points(text, [s[j] for s in own]) for j in (0, 2))
                    rows.append([{"kind": rules[s[1]].kind, "start": x, "end": y} for s, x, y in zip(own, starts, ends, strict=True)])
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)).cast(pa.int64()), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])
                at += len(texts)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """(doc_id, spans) as counts of the base kinds, their hash, and all spans as text."""
    kinds = [r.kind for r in base]

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    own = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(told(own), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))

"""Personal data replaced by keyed surrogates of the same kind and format.

The same entity always becomes the same surrogate (coreference), different entities never share one
(distinctness), and without the key the original can't be told.

Numbers, addresses and secrets go through a keyed permutation of all values of their format (a Feistel
network over the places of digits and letters, walked until it lands within the format), which can't
collide. Numbers agree in all their forms, with and without separators; country codes, check digits and the prefixes of
tokens stay valid. Names keep their title, script, case and gendered ending and are built from syllables by a keyed hash, so many
that collisions are rare at any size of a corpus; names in scripts without syllables here are permuted letter by letter.
Names are found after one of the listed titles, in every script that has capitals, and their words then everywhere in the same
document where they begin with a capital, whatever the case of the rest; names that no listed title introduces are not found. E-mail addresses may have letters
of any script. All surrogates are checked in Spark: of the entities that share one, all but the first
get another attempt, until none do.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tasks import settled


def _runs(codes: list[int]) -> list[tuple[int, int]]:
    """Sorted numbers as runs: (first, last)."""
    out: list[tuple[int, int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


#: Entities with an attempt of their own that are sent to all executors. With 500 ** SYLLABLES / 5 bodies of names so many need 50 million distinct words of names.
EXCEPTIONS = 100_000
#: Characters of text that go back to Spark together.
WINDOW = 1 << 20
SYLLABLES = 4
_TITLES_M = "Mr|Sir|Herr|Monsieur|M|Señor|Sr|Don|Signor|Господин|Г-н"
_TITLES_N = "Dr|Dra|Prof|Doctor|Professor|Doktor|Docteur|Professeur|Profesor|Profesora|Доктор|Профессор"
_TITLES_F = "Mrs|Ms|Miss|Madam|Frau|Mme|Madame|Mlle|Señora|Sra|Señorita|Doña|Signora|Госпожа|Г-жа"
#: Combining marks, which \w leaves out, as ranges of a character class.
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in _runs([c for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M"]))
#: Letters that a name may begin with.
_CAPITALS = "".join(f"{chr(a)}-{chr(b)}" for a, b in _runs([c for c in range(0x41, 0x10000) if unicodedata.category(chr(c)) in ("Lu", "Lt")]))
_NAME = rf"[{_CAPITALS}][\w{_MARKS}'’-]+"
#: Kind: pattern, and what a text must contain for it to be tried.
KINDS = {
    "email": (rf"(?<![\w{_MARKS}.+-])\w[\w{_MARKS}.%+-]*@[^\W_](?:(?:[^\W_]|[{_MARKS}-])*(?:[^\W_]|[{_MARKS}]))?(?:\.[^\W_](?:(?:[^\W_]|[{_MARKS}-])*(?:[^\W_]|[{_MARKS}]))?)*\.(?:[A-Za-z]{{2,24}}(?![A-Za-z0-9])|[^\W\d_](?:[^\W\d_]|[{_MARKS}]){{1,23}}(?![^\W_]))", "@"),
    "secret": (r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)[\"']?\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_/+-]{12,})|\b(?P<secret2>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{40,64})\b", None),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", None),
    "card": (r"(?<![\d.-])(?:\d{4}[ -]){3}\d{4}(?![\d-])|(?<![\d.-])\d{13,19}(?![\d-])", None),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", None),
    "ip6": (r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{4,39}(?![\w:])", None),
    "ip": (r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)", None),
    "phone": (r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?(?![\w-])|(?<![\w+])\+\d{1,3}[ .-]?\d{6,12}(?!\d)|(?<![\w+.-])(?:0\d{1,5}[ /-]|\(0\d{1,5}\) ?)\d{4,9}(?![\w-])", None),
    "name": (rf"\b(?P<title>{_TITLES_M}|{_TITLES_F}|{_TITLES_N})\.? (?:(?:{_TITLES_N})\.? )*(?P<name>{_NAME}(?: {_NAME}){{0,2}})", None),
}
_ANY = re.compile(r"[@\d]|(?i:token|secret|passw|key)|[0-9A-Fa-f]:|" + rf"\b(?:{_TITLES_M}|{_TITLES_F}|{_TITLES_N})\b")
_PATTERNS = {k: re.compile(p) for k, (p, _) in KINDS.items()}
_DIGIT, _FEMALE, _NEUTRAL = re.compile(r"\d"), re.compile(rf"(?:{_TITLES_F})$"), re.compile(rf"(?:{_TITLES_N})$")
_WORD, _PIECE, _TAIL = re.compile(rf"[\w{_MARKS}]+(?:['’-][\w{_MARKS}]+)*"), re.compile(rf"[\w{_MARKS}]+"), re.compile(r"(?:['’][sS]|['’-])+$")
_TITLE, _KEYISH = re.compile(rf"\b(?:{_TITLES_M}|{_TITLES_F}|{_TITLES_N})\b"), re.compile(r"(?i)token|secret|passw|key|AKIA|gh[pousr]_|sk-|[0-9a-f]{40}")
_DIGITS, _LOW, _UP, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Country codes of two digits.
_TWO = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}
_PREFIX = re.compile(r"AKIA|gh[pousr]_|sk-")
#: Of each script 20 beginnings of a syllable, 5 vowels, 5 ends (none that could belong to the next beginning), and the endings of men's, women's and family names.
SCRIPTS = {
    "LATIN": ("b d f g h k l m n p r s t v z br dr gr st tr".split(), "aeiou", ("", "n", "l", "r", "m"), ("r", "na", "k")),
    "CYRILLIC": ("б в г д з к л м н п р с т ф х ч ш бр ст тр".split(), "аеиоу", ("", "н", "л", "р", "м"), ("р", "на", "к")),
    "GREEK": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ ψ κρ τρ πρ".split(), "αειου", ("", "ν", "λ", "ρ", "μ"), ("ς", "να", "κης")),
}


@lru_cache(10_000)
def _script(name: str) -> str:
    """The script that all letters of a word have, else nothing."""
    found = {unicodedata.name(c, "").split(" ")[0] for c in name if c.isalpha()}
    return found.pop() if len(found) == 1 else ""


def _bits(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=32).digest(), "big")


def permuted(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed bijection on range(size): a balanced Feistel network on the next even number of bits, walked until it is in range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            mine = 0
            for block in range(0, half, 256):
                mine = mine << 256 | _bits(key, tweak, size, r, block, right)
            left, right = right, left ^ (mine & mask)
        value = left << half | right
        if value < size:
            return value


def _alike(key: bytes, kind: str, value: str, alphabets: list[str | None]) -> str:
    """Replaces the places that have an alphabet, as one number, within all values of this format."""
    number, size, used = 0, 1, []
    for c, a in zip(value, alphabets, strict=True):
        if a:
            number, size = number * len(a) + a.index(c), size * len(a)
            used.append(a)
    form = "".join("." if a else c for c, a in zip(value, alphabets, strict=True)) + "|" + "".join(str(len(a)) + a[0] for a in used)
    number, out = permuted(key, f"{kind}|{form}", number, size), []
    for a in reversed(used):
        number, k = divmod(number, len(a))
        out.append(a[k])
    return "".join(out.pop() if a else c for c, a in zip(value, alphabets, strict=True))


@lru_cache(10_000)
def _kin(c: str) -> str | None:
    """The letters or digits of other scripts that are like ``c``: of its 128 code points, its category, and whether case can be turned and back."""
    if c.isascii() or unicodedata.category(c) not in ("Lu", "Ll", "Lo", "Nd"):
        return None
    like = lambda x: (unicodedata.category(x), x.upper().lower() == x, x.lower() == x)
    block = ord(c) // 128 * 128
    return "".join(x for x in map(chr, range(block, block + 128)) if like(x) == like(c))


def _letters(value: str) -> list[str | None]:
    return [next((a for a in (_DIGITS, _LOW, _UP) if c in a), None) or _kin(c) for c in value]


def _luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def canonical(kind: str, value: str) -> str:
    """The form in which mentions of one entity agree: addresses in lower case, numbers without their separators."""
    if kind == "email":
        return value.lower()
    if kind.startswith("name"):
        return value.replace("’", "'").lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(value).compressed
    if kind == "iban":
        return value.replace(" ", "")
    if kind in ("phone", "card", "ssn"):
        return "+" * value.startswith("+") + "".join(c for c in value if c.isdigit())
    return value


def formed(kind: str, mention: str, new: str) -> str:
    """A surrogate of the canonical value in the form of a mention, with its separators or case."""
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind.startswith("name"):
        return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]
    if kind in ("phone", "card", "ssn", "iban"):
        own = iter(c for c in new if c.isalnum())
        return "".join(next(own) if c.isalnum() else c for c in mention)
    return new


def _country(value: str) -> int:
    """Characters of the plus sign and the country code of a number that starts with them."""
    return 2 if value[1:2] in ("1", "7") else 3 if value[1:3] in _TWO else 4


def _check(value: str) -> str:
    """The check digits of an IBAN by its other characters."""
    rest = int("".join(str(int(c, 36)) for c in value[4:] + value[:2] + "00"))
    return f"{98 - rest % 97:02d}"


def _valid_iban(key: bytes, value: str) -> str:
    """Country and length stay, the account is permuted, the check digits follow."""
    new = value[:2] + "00" + _alike(key, f"iban {value[:2]}", value[4:], _letters(value[4:]))
    return new[:2] + _check(new) + new[4:]


@lru_cache(50_000)
def surrogate(key: bytes, kind: str, value: str, attempt: int = 0, syllables: int = SYLLABLES) -> str:
    """The surrogate of a canonical value. Kinds of names: name-m, name-f (given) and name-x (family)."""
    if kind.startswith("name"):
        low = canonical(kind, value)
        if _script(low) in SCRIPTS:
            onsets, vowels, codas, (man, woman, family) = SCRIPTS[_script(low)]
            bits, out = _bits(key, "name", low, attempt), []
            for k in range(syllables):
                for part in (onsets, vowels, codas if k < syllables - 1 else ("",)):
                    bits, i = divmod(bits, len(part))
                    out.append(part[i])
            low = "".join(out) + {"name-m": man, "name-f": woman}.get(kind, family)
        else:
            for _ in range(attempt + 1):
                low = _alike(key, "name", low, _letters(low))
        return formed(kind, value, low)
    for _ in range(attempt + 1):
        if kind == "ip6":
            n = permuted(key, "ip6", int(ipaddress.IPv6Address(value)), 1 << 128)
            value = str(ipaddress.IPv6Address(n))
        elif kind == "ip":
            n = permuted(key, "ip", int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32)
            value = ".".join(map(str, n.to_bytes(4, "big")))
        elif kind == "card":
            digits = [c for c in value if c.isdigit()]
            rest = _luhn("".join(digits))
            new = _alike(key, f"card{rest}", "".join(digits[:-1]), [_DIGITS] * (len(digits) - 1))
            last = next(d for d in _DIGITS if _luhn(new + d) == rest)
            it = iter(new + last)
            value = "".join(next(it) if c.isdigit() else c for c in value)
        elif kind == "email":
            stay = len(value) - value.rindex(".")  # the top-level domain
            value = _alike(key, kind, value, [*_letters(value[:-stay]), *[None] * stay])
        elif kind == "phone" and value.startswith("+"):
            code = _country(value)
            value = _alike(key, kind, value, [*[None] * code, *_letters(value[code:])])
        elif kind == "iban":
            if value[2:4] == _check(value):  # a valid one stays valid
                value = _valid_iban(key, value)
            else:
                value = _alike(key, kind, value, [None, None, *_letters(value[2:])])
        elif kind == "secret":
            stay = m.end() if (m := _PREFIX.match(value)) else 0  # what tells the kind of a token
            kinds = [_HEX] * len(value) if re.fullmatch("[0-9a-f]+", value) else [*[None] * stay, *_letters(value[stay:])]
            value = _alike(key, kind, value, kinds)
        else:
            value = _alike(key, kind, value, _letters(value))
    return value


def _is_ip6(value: str) -> bool:
    """Whether this is an address, with four digits at least: what is shorter may be a slice or a scope of a program."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return sum(c != ":" for c in value) >= 4


def _of_name(word: str, known: dict[str, str]) -> str | None:
    """The kind of a word that is one of a document's names, but for its case; a word that begins with a small letter is none, unless its script has no capitals."""
    return None if word[0].islower() else known.get(canonical("name", word))


def mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order, not overlapping; of overlapping finds the earlier kind in KINDS stays."""
    if not _ANY.search(text):
        return []
    digits, found, known = bool(_DIGIT.search(text)), [], {}
    for kind, pattern in _PATTERNS.items():
        if kind == "email" and "@" not in text or kind == "ip6" and ":" not in text or kind in ("iban", "card", "ssn", "ip", "phone") and not digits or kind == "name" and not _TITLE.search(text) or kind == "secret" and not _KEYISH.search(text):
            continue
        for m in pattern.finditer(text):
            if kind == "secret":
                found.append((*(m.span("secret") if m["secret"] else m.span("secret2")), kind))
            elif kind == "name":
                at, words = m.start("name"), m["name"].split(" ")
                given = "name-f" if _FEMALE.match(m["title"]) else "name-x" if _NEUTRAL.match(m["title"]) else "name-m"
                for i, w in enumerate(words):
                    core = _TAIL.sub("", w) or w
                    found.append((at, at + len(core), "name-x" if i == len(words) - 1 else given))
                    known.setdefault(canonical("name", core), found[-1][2])
                    at += len(w) + 1
            elif kind != "ip6" or _is_ip6(m[0]):
                found.append((*m.span(), kind))
    if known:  # their other mentions, without a title
        for m in _WORD.finditer(text):
            if not (core := _TAIL.sub("", m[0])):
                continue
            if (kind := _of_name(core, known)):
                found.append((m.start(), m.start() + len(core), kind))
            elif core != (w := m[0]) or not w.isalnum():
                found += [(m.start() + p.start(), m.start() + p.end(), kind) for p in _PIECE.finditer(w) if (kind := _of_name(p[0], known))]
    taken, out = bytearray(), []
    if len(found) > 1:
        taken = bytearray(max(e for _, e, _ in found))
    for s, e, kind in found:
        if len(found) == 1 or not any(taken[s:e]):
            if len(found) > 1:
                taken[s:e] = b"\1" * (e - s)
            out.append((s, e, kind))
    return sorted(out)


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int], syllables: int) -> tuple[str, int]:
    found = mentions(text)
    if not found:
        return text, 0
    out, at = [], 0
    for s, e, kind in found:
        value = text[s:e]
        name = canonical(kind, value)
        new = surrogate(key, kind, name, attempts.get((kind, name), 0), syllables)
        out += [text[at:s], formed(kind, value, new)]
        at = e
    return "".join([*out, text[at:]]), len(found)


def entity_table(docs: DataFrame, key: bytes, syllables: int) -> DataFrame:
    """The distinct entities of all texts: (kind, value, surrogate), each task's repeats left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({(k, canonical(k, t[s:e])) for x in b.column("text") if (t := x.as_py()) for s, e, k in mentions(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array([surrogate(key, k, v, 0, syllables) for k, v in found], pa.string())], ["kind", "value", "surrogate"])

    return docs.select("text").mapInArrow(run, "kind string, value string, surrogate string").distinct()


def collisions(entities: DataFrame, key: bytes, syllables: int, bound: int = EXCEPTIONS) -> dict[tuple[str, str], int] | None:
    """The entities that need another attempt than 0, with it; None when there are more than ``bound``."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, v, a = (b.column(c).to_pylist() for c in ("kind", "value", "attempt"))
            new = [surrogate(key, *x, syllables) for x in zip(k, v, a, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("value"), b.column("attempt"), pa.array(new, pa.string())], ["kind", "value", "attempt", "surrogate"])

    table = entities.withColumn("attempt", F.lit(0))
    while True:
        # A surrogate's first holder keeps it: the one with the lowest attempt, then the smallest value.
        shared = table.groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "value")).alias("first"), F.count("*").alias("n")).where("n > 1").select("surrogate", "first")
        lose = table.join(shared, "surrogate").where(F.struct("attempt", "kind", "value") != F.col("first"))
        lose = settled(lose.select("kind", "value", (F.col("attempt") + 1).cast("int").alias("attempt")))
        n = lose.count()
        moved = table.where("attempt > 0").join(lose.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", F.col("attempt").cast("int").alias("attempt"))
        if n == 0:
            rows = moved.limit(bound + 1).collect()
            return None if len(rows) > bound else {(r["kind"], r["value"]): r["attempt"] for r in rows}
        if n > bound:
            return None
        new = lose.mapInArrow(again, "kind string, value string, attempt int, surrogate string")
        table = settled(table.select("kind", "value", F.col("attempt").cast("int").alias("attempt"), "surrogate").join(lose.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(new))


def with_surrogates(b: pa.RecordBatch, at: int, key: bytes, attempts: dict[tuple[str, str], int], syllables: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with column ``at`` replaced, and n_entities; some WINDOW characters at once, so that a worker doesn't hold all new texts."""
    start, size, out = 0, 0, []
    for i, x in enumerate(b.column(at)):
        t = x.as_py()
        out.append((None, 0) if t is None else replaced(t, key, attempts, syllables))
        size += len(t or "")
        if size >= WINDOW or i + 1 == len(b):
            columns = b.slice(start, i + 1 - start).columns
            columns[at] = pa.array([new for new, _ in out], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in out], pa.int64())], [*b.schema.names, "n_entities"])
            start, size, out = i + 1, 0, []


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", syllables: int = SYLLABLES) -> DataFrame:
    """All rows and columns of ``docs`` with personal data in ``text_col`` replaced, and n_entities, the mentions replaced.

    A null text stays null with 0 mentions. An existing n_entities is replaced. Equal texts get equal
    results; null ids don't matter; an empty table gives no rows. Surrogates depend on ``key`` and, where two
    names' surrogates collide, on which names occur together.
    """
    raw = hashlib.sha256(key.encode()).digest()
    docs = docs.drop("n_entities")
    text = docs.select(docs[text_col].alias("text"))
    attempts = collisions(settled(entity_table(text, raw, syllables)), raw, syllables)
    if attempts is None:
        raise ValueError(f"more than {EXCEPTIONS} entities share a surrogate: names need more than {syllables} syllables")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from with_surrogates(b, at, raw, attempts, syllables)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType())]))


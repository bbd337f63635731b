"""PII (method: surrogate generation).

Personal data and secrets are found by pattern and replaced by keyed
surrogates of the same type, script and format: digits for digits, letters of
the same alphabet and case, a valid check digit where there was one, a given
name of the same gender.

A surrogate is a permutation of its format's values: with a keyed Feistel
permutation P over the ``M`` values of a format, ``x`` becomes
``P^-1((P(x) + 1) mod M)``.  This is one cycle through all values, so two
entities never share a surrogate, no entity is its own, and the same entity
has the same surrogate in every document, without any table of entities to
gather or to share.  Phone numbers, cards and names are normalised first
(separators, case), so their spellings corefer.  ``collisions`` checks
distinctness over a corpus.

The work is per document; nothing is shuffled.

Defined cases: a null text stays null; an empty one empty; a text without
entities is returned as it was; names are found only as a listed given name
with a surname after it, or after a title, and other names stay as they are; a
one-value format can't change and is masked with ``*``; repeated rows get a row
each; an empty table gives no rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, small_batches

KEY = b"surrogate-key"      # a deployment passes its own

# Alphabets (inclusive code point ranges), titles, given names.
ALPHABETS = [("0", "9"), ("a", "z"), ("A", "Z"), ("à", "ö"), ("ø", "ÿ"), ("À", "Ö"), ("Ø", "Þ"), ("α", "ω"), ("Α", "Ω"),
             ("а", "я"), ("А", "Я"), ("ء", "ي"), ("א", "ת"), ("अ", "ह"), ("ぁ", "ゖ"), ("ァ", "ヺ"), ("一", "鿿"), ("가", "힣")]
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
TITLES = {"mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "don": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f",
          "madame": "f", "mme": "f", "mlle": "f", "señora": "f", "doña": "f", "dr": "", "prof": "", "господин": "m", "госпожа": "f"}
GIVEN = {("m", "latin"): "James John Robert Michael William David Thomas Charles Daniel Peter Hans Klaus Jürgen Stefan Pierre Jacques "
                         "Louis Antoine Carlos Juan Miguel José".split(),
         ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Emma Ursula Monika Sabine Petra Marie Claire "
                         "Sophie Camille María Carmen Lucía Isabel".split(),
         ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей".split(),
         ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split()}
_GENDER = {name: (key, k) for key, names in GIVEN.items() for k, name in enumerate(names)}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = [
    ("email", r"[\w.+%-]*[\w+%-]@(?:[\w-]+\.)+[^\W\d_]{2,}"),
    ("secret", r"(?i:\b(?:token|api[_-]?key|secret(?:[_-]?key)?|access[_-]?key|password|passwd|pwd)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret_value>[^\s\"',;]{6,})"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv6", r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"),
    ("ipv4", rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"),
    ("key", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})\b"),
]
_ENTITY = re.compile("|".join(f"(?P<{name}>{p})" for name, p in PATTERNS))
# what any match of the patterns has in it; without a digit or '@', a label, a key's prefix, or only letters of hex digits
_HINT = re.compile(r"[\d@]|(?i:passw|secret|token|pwd|api[_-]?key|access[_-]?key)|AKIA|gh[pousr]_|sk-|[a-f]{32}|[A-F]{32}|(?:[a-fA-F]{1,4}:){7}")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞА-Я][^\W\d_]+")
_SURNAME = re.compile(r"\.?[ \xa0]+([A-ZÀ-ÖØ-ÞА-Я][^\W\d_]+)")


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    value: str
    gender: str = ""


class Surrogates:
    """Keyed permutations of formats."""

    def __init__(self, key: bytes = KEY, rounds: int = 8):
        self.key, self.rounds = key, rounds
        self.of = functools.lru_cache(maxsize=50_000)(self._of)

    def _round(self, tag: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            out += hmac.new(self.key, tag + bytes((i, block & 255)) + half.to_bytes(size, "big"), hashlib.sha256).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _feistel(self, tag: bytes, x: int, size: int, back: bool) -> int:
        """A permutation of range(size): a balanced network, walked until it lands inside."""
        bits = max(1, (max(1, (size - 1).bit_length()) + 1) // 2)
        low = (1 << bits) - 1
        while True:
            a, b = x >> bits, x & low
            for i in (range(self.rounds - 1, -1, -1) if back else range(self.rounds)):
                a, b = (b ^ self._round(tag, i, a, bits), a) if back else (b, a ^ self._round(tag, i, b, bits))
            x = a << bits | b
            if x < size:
                return x

    def shift(self, tag: str, x: int, size: int) -> int:
        """The next value of the keyed cycle through range(size)."""
        t = tag.encode("utf-8") + size.to_bytes((size.bit_length() + 7) // 8, "big")
        y = (self._feistel(t, x, size, False) + 1) % size
        return self._feistel(t, y, size, True)

    def symbols(self, tag: str, places: list[tuple[int, int]]) -> list[int]:
        """Permutes a sequence of (digit, radix) places as one number."""
        x = size = 0
        size = 1
        for digit, radix in places:
            x, size = x * radix + digit, size * radix
        if size < 2:
            return [d for d, _ in places]
        x = self.shift(tag + repr([r for _, r in places]), x, size)
        out = []
        for _, radix in reversed(places):
            x, d = divmod(x, radix)
            out.append(d)
        return out[::-1]

    def spell(self, tag: str, text: str, fixed: Callable[[int], bool] = lambda i: False, hexed: bool = False) -> str:
        """Every letter or digit by another of its alphabet; the rest stays."""
        at, places, sets = [], [], []
        for i, ch in enumerate(text):
            letters = None if fixed(i) else "0123456789abcdef" if hexed and ch in "0123456789abcdef" else alphabet(ch)
            if letters:
                at.append(i)
                sets.append(letters)
                places.append((letters.index(ch), len(letters)))
        template = "".join("." if i in set(at) else ch for i, ch in enumerate(text))
        out = list(text)
        for i, letters, d in zip(at, sets, self.symbols(tag + template, places)):
            out[i] = letters[d]
        made = "".join(out)
        return made if made != text else re.sub(r"\w", "*", text)

    def _of(self, kind: str, value: str, gender: str) -> str:
        return getattr(self, kind)(value, gender)

    def digits(self, tag: str, value: str, keep: int = 0) -> str:
        """Digits permuted apart from their separators, so that spellings of a number agree."""
        ds = [int(c) for c in value if c.isdecimal()]
        new = iter(ds[:keep] + self.symbols(f"{tag}{ds[:keep]}", [(d, 10) for d in ds[keep:]]))
        return "".join(str(next(new)) if c.isdecimal() else c for c in value)

    def email(self, value: str, gender: str) -> str:
        local, _, domain = value.rpartition("@")
        new = self.spell("email", local.lower())
        new = "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new, local))
        labels = domain.split(".")
        if "example" not in [x.lower() for x in labels[-2:]]:
            domain = ".".join([self.spell("domain", x.lower()) for x in labels[:-1]] + [labels[-1].lower(), "example"])
        return f"{new}@{domain}"

    def secret(self, value: str, gender: str) -> str:
        return self.spell("secret", value, hexed=re.fullmatch("[0-9a-f]+", value) is not None)

    def key_(self, value: str, gender: str) -> str:
        prefix = re.match(r"AKIA|gh[pousr]_|sk-|", value).end()
        return self.spell("secret", value, lambda i: i < prefix, hexed=re.fullmatch("[0-9a-f]+", value) is not None)

    def iban(self, value: str, gender: str) -> str:
        plain = value.replace(" ", "")
        body = self.spell("iban" + plain[:2], plain[4:])
        check = 98 - iban_rest(plain[:2] + "00" + body) if iban_rest(plain) == 1 else int(plain[2:4])
        new = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in value)

    def ipv6(self, value: str, gender: str) -> str:
        groups = self.symbols("ipv6", [(int(g, 16), 65536) for g in value.split(":")])
        return ":".join(f"{g:x}" for g in groups)

    def ipv4(self, value: str, gender: str) -> str:
        return ".".join(map(str, self.symbols("ipv4", [(int(o), 256) for o in value.split(".")])))

    def phone(self, value: str, gender: str) -> str:
        country = re.match(r"\+(\d{1,3})(?=[ .(-])", value)
        return self.digits("phone", value, len(country[1]) if country else 0)

    def ssn(self, value: str, gender: str) -> str:
        return self.digits("ssn", value)

    def card(self, value: str, gender: str) -> str:
        ds = "".join(c for c in value if c.isdecimal())
        if luhn(ds):
            body = self.digits("luhn", ds[:-1], 1)
            made = next(body + c for c in "0123456789" if luhn(body + c))
            new = iter(made)
            return "".join(next(new) if c.isdecimal() else c for c in value)
        # numbers that fail the check keep failing it: a surrogate that passes takes the next one on
        made = self.digits("card", ds, 1)
        while luhn(made):
            made = self.digits("card", made, 1)
        new = iter(made)
        return "".join(next(new) if c.isdecimal() else c for c in value)

    def given(self, value: str, gender: str) -> str:
        key, k = _GENDER[value]
        return GIVEN[key][self.shift("given" + "".join(key), k, len(GIVEN[key]))]

    def surname(self, value: str, gender: str) -> str:
        """Vowels by vowels and consonants by consonants, in the same case; other scripts by alphabet."""
        low = value.lower()
        if len(low) != len(value) or not all(c in VOWELS + CONSONANTS for c in low):
            return self.spell("surname", value)
        sets = [VOWELS if c in VOWELS else CONSONANTS for c in low]
        new = self.symbols("surname", [(s.index(c), len(s)) for s, c in zip(sets, low)])
        return "".join(s[d].upper() if c.isupper() else s[d] for s, d, c in zip(sets, new, value))


@functools.lru_cache(maxsize=4096)
def alphabet(ch: str) -> str | None:
    for a, z in ALPHABETS:
        if a <= ch <= z:
            return "".join(map(chr, range(ord(a), ord(z) + 1)))
    return None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def names(text: str) -> Iterator[Entity]:
    """Names after a title, and listed given names before a surname."""
    done = 0
    for m in _CAPITAL.finditer(text):
        word = m[0]
        if m.start() < done:
            continue
        gender = TITLES.get(word.lower())
        if gender is not None and word[0].isupper():
            first = _SURNAME.match(text, m.end())
            if first is None:
                continue
            start, end, word = first.start(1), first.end(1), first[1]
            if word not in _GENDER:
                yield Entity(start, end, "surname", word, gender)
                done = end
                continue
        elif word in _GENDER:
            start, end, gender = m.start(), m.end(), _GENDER[word][0][0]
        else:
            continue
        last = _SURNAME.match(text, end)
        if last and text[end] != ".":
            yield Entity(start, end, "given", word, gender)
            yield Entity(last.start(1), last.end(1), "surname", last[1], gender)
            done = last.end(1)


def entities(text: str) -> list[Entity]:
    """What a text holds, in order and without overlaps."""
    found = []
    if _HINT.search(text):
        for m in _ENTITY.finditer(text):
            kind = m.lastgroup if m.lastgroup != "secret_value" else "secret"
            group = "secret_value" if kind == "secret" else kind
            found.append(Entity(m.start(group), m.end(group), kind, m[group]))
    for e in names(text):
        if not any(f.start < e.end and e.start < f.end for f in found):
            found.append(e)
    return sorted(found)


def replaced(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[Entity, str]]]:
    """The text with its surrogates, and each entity with its own."""
    out, at, pairs = [], 0, []
    for e in entities(text):
        new = surrogates.of("key_" if e.kind == "key" else e.kind, e.value, e.gender)
        out += [text[at:e.start], new]
        at = e.end
        pairs.append((e, new))
    return "".join(out) + text[at:], pairs


def with_surrogates(docs: DataFrame, key: bytes = KEY, name: str = "found", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct of text (surrogates put in), n_entities and kinds."""
    def make():
        surrogates = Surrogates(key)

        def run(texts: pa.Array) -> list[pa.Array]:
            done = [(None, []) if t is None else replaced(t, surrogates) for t in texts.to_pylist()]
            return [pa.array([t for t, _ in done], pa.string()), pa.array([len(p) for _, p in done], pa.int32()),
                    pa.array([",".join(e.kind for e, _ in p) for _, p in done], pa.string())]
        return run

    return annotate(docs, make, "text string, n_entities int, kinds string", name, keep)


def pseudonymize(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text (with surrogates), n_entities, kinds (of the entities, in order, joined by commas)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    return with_surrogates(docs, key, "found", ["doc_id"]).select("doc_id", "found.*")


def entity_table(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, end, kind, value, surrogate: one row for each entity (personal data in clear; for audits)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            rows = [(d, e.start, e.end, e.kind, e.value, new) for d, t in zip(*(c.to_pylist() for c in batch.columns))
                    for e, new in replaced(t or "", surrogates)[1]]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))],
                ["doc_id", "start", "end", "kind", "value", "surrogate"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start int, end int, kind string, value string, surrogate string")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that two different entities of a kind share, and entities that are their own: none, if all is well."""
    return (found.select("kind", "value", "surrogate").distinct().groupBy("kind", "surrogate")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("value") == F.col("surrogate")).alias("same")).where("n > 1 OR same"))

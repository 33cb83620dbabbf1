"""Keyed surrogates for personal data.

Each detected entity is replaced by one of its own kind and format: the variable characters of its canonical form (digits,
hexadecimal digits, letters of its script) are read as a number x below N, and the surrogate is the number that follows x in
a secret cyclic order of all N. That order is a keyed permutation (a Feistel network of BLAKE2b), so within a format

* equal entities get equal surrogates wherever they stand, in whatever case or punctuation (coreference),
* different entities get different ones, and none gets itself: the map is one cycle (distinctness).

Collision checks walk on along the cycle while a number is no valid surrogate (a card number whose checksum does not hold as
the original's does, an address of another class, a name that a list holds), which keeps both properties. surrogate_collisions()
verifies them over a whole corpus. Nothing is gathered or shuffled to replace: it is a map over documents.

Names are replaced where a title shows them ("Mr. John Smith", "Frau Anna Schulz", "г-жа Иванова") and wherever else the same text
has one of their parts: a listed given name by one of the same gender and script, other names letter by letter (vowels by
vowels, consonants by consonants, letters of other scripts by letters of their kind) with the endings that tell gender in
many languages kept. A part of a name has one surrogate, whether it stands first, last or alone.

Digits of every script count by their value, so equal numbers get equal surrogates, and each stays in its own script. What has no
other value of its format becomes its kind in brackets.

Contract: a null text stays null; texts of any length are searched whole; every row gives a row, all columns kept, n_chars (if
there, and a whole number) recounted. A column for the count whose name is taken gets underscores. An empty table gives no rows.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections import OrderedDict
from functools import lru_cache
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, over

# Given names by script and gender, titles by gender.
NAMES = {
    ("latin", "m"): "james john robert michael william david richard thomas hans peter klaus jürgen pierre jean louis carlos jose luis miguel antonio".split(),
    ("latin", "f"): "mary patricia jennifer linda elizabeth barbara susan anna ursula monika petra marie sophie camille claire maria carmen lucia elena sofia".split(),
    ("cyrillic", "m"): "иван сергей алексей дмитрий андрей михаил николай павел".split(),
    ("cyrillic", "f"): "анна мария елена ольга наталья татьяна ирина светлана".split(),
}
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr г-н".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra г-жа".split(),
    "": "Dr Prof".split(),
}
#: Letters that stand for one another.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "äöüáéíóúàèìòùâêîôûëïñçß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь")
ROUNDS = 8

_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?![\w-])")
_NUMBER = re.compile(r"""
    (?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d|\w))
  | (?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<card>(?<![\w-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\w-])|(?<![\w-])\d{4}[ -]?\d{6}[ -]?\d{5}(?![\w-]))
  | (?P<phone>(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?)(?![\w-])|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d){7,12}(?![\w-]))
""", re.X)  # fmt: skip
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|rk|ghp|gho|xox[abp])[-_][0-9A-Za-z_-]{16,128}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])")
_DIGIT = re.compile(r"\d")
_HEX = re.compile(r"[0-9a-f]{32}|[0-9A-F]{32}")
_TITLED = re.compile(r"(?<!\w)(" + "|".join(t for ts in TITLES.values() for t in ts) + "(?!\\w))(\\.?[  ])([^\\W\\d_]{2,})(?:([  -])([^\\W\\d_]{2,}))?")
_TITLES = [t for ts in TITLES.values() for t in ts]
LISTED = {x for names in NAMES.values() for x in names}
_ALIKE = {c: letters for letters in LETTERS for c in letters} | {c: "0123456789" for c in "0123456789"}
#: Characters of a block of letters, for the scripts that LETTERS lacks.
SPAN = 256


def steady(c: str) -> bool:
    """Whether the capital of a letter leads back to it."""
    return len(c.upper()) == 1 and c.upper().lower() == c


@lru_cache(4096)
def alike(c: str) -> str:
    """The characters that may stand for c (in lower case): for letters of other scripts, those of the same block, script and kind."""
    if c in _ALIKE:
        return _ALIKE[c]
    if not c.isalpha():
        return c
    kind = lambda x: (unicodedata.category(x), unicodedata.name(x, "").partition(" ")[0], steady(x), x.lower() == x, x in _ALIKE)
    first = ord(c) // SPAN * SPAN
    return "".join(x for x in map(chr, range(first, first + SPAN)) if kind(x) == kind(c))


class Surrogates:
    """Surrogates under one key. Results are kept for the latest of at most `held` entities."""

    def __init__(self, key: bytes, held: int = 100_000):
        if len(key) < 16:
            raise ValueError("a key has 16 bytes at least")
        self.key, self.held, self.known = sha256(key).digest(), held, OrderedDict()

    def round_value(self, tweak: str, i: int, x: int) -> int:
        return int.from_bytes(blake2b(f"{tweak}|{i}|{x}".encode(), key=self.key, digest_size=32).digest(), "big")

    def permuted(self, tweak: str, n: int, x: int, back: bool = False) -> int:
        """A keyed permutation of 0 .. n-1, or its inverse."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        wide = self.round_value if half <= 250 else lambda t, i, v: int.from_bytes(b"".join(self.round_value(t, i * 1000 + k, v).to_bytes(32, "big") for k in range(half // 256 + 1)), "big")
        while True:
            left, right = x >> half, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ (wide(tweak, i, left) & mask), left
                else:
                    left, right = right, left ^ (wide(tweak, i, right) & mask)
            x = left << half | right
            if x < n:
                return x

    def follower(self, tweak: str, n: int, x: int) -> int:
        """The number after x in the secret cyclic order of 0 .. n-1."""
        return self.permuted(tweak, n, (self.permuted(tweak, n, x) + 1) % n, back=True)

    def replaced(self, kind: str, text: str, alphabets: list[str], valid=lambda s: True) -> str:
        """The first valid string after text on the cycle of strings with text[i] in alphabets[i]."""
        found = self.known.get((kind, text))
        if found is None:
            n = 1
            for a in alphabets:
                n *= len(a)
            x = 0
            for c, a in zip(text, alphabets, strict=True):
                x = x * len(a) + a.index(c)
            tweak = f"{kind}|{'|'.join(alphabets)}"
            while True:
                x = rest = self.follower(tweak, n, x) if n > 1 else x
                out = []
                for a in reversed(alphabets):
                    rest, digit = divmod(rest, len(a))
                    out.append(a[digit])
                found = "".join(reversed(out))
                if valid(found) or found == text:  # round the whole cycle: the only valid one
                    break
            self.known[kind, text] = found
            if len(self.known) > self.held:
                self.known.popitem(last=False)
        return found

    def spelled(self, kind: str, text: str, keep: int = 0, valid=lambda s: True) -> str:
        """text with each letter or digit replaced by one of its like, the case and the last `keep` letters kept."""
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        last = len(low) - keep
        alphabets = [alike(c) if i < last else c for i, c in enumerate(low)]
        out = self.replaced(kind, low, alphabets, valid)
        return "".join(b.upper() if a != c and len(b.upper()) == 1 else b for a, b, c in zip(text, out, low, strict=True))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def address_class(octets: list[int]) -> str:
    a, b = octets[:2]
    return "own" if a == 10 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32) else "loop" if a == 127 else "zero" if a == 0 else "many" if a >= 224 else "open"


def is_digit(c: str) -> bool:
    return c.isdecimal()


def plain_digits(text: str) -> str:
    """text with the digits of all scripts as 0-9."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if is_digit(c) else c for c in text)


def digits_of(text: str) -> str:
    return plain_digits("".join(filter(is_digit, text)))


def like(digit: str, c: str) -> str:
    """digit in the script of the digit c; other characters as they are."""
    return chr(ord(c) - unicodedata.decimal(c) + int(digit)) if not c.isascii() and is_digit(c) and is_digit(digit) else digit


def fill(shape: str, chars: str, variable) -> str:
    """shape with its variable characters replaced in turn by chars."""
    rest = iter(chars)
    return "".join(like(next(rest), c) if variable(c) else c for c in shape)


def is_address(text: str) -> bool:
    parts = text.split(".")
    return all(str(int(x)) == x and int(x) < 256 for x in parts)


class Replacer:
    def __init__(self, key: bytes):
        self.s = Surrogates(key)

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        host = self.s.spelled("host", ".".join(labels[:-1]))
        return f"{self.s.spelled('local', local)}@{host}.{labels[-1]}"

    def ip(self, text: str) -> str:
        plain = plain_digits(text)
        if not is_address(plain):  # no address, nor is what replaces it
            digits = digits_of(text)
            return fill(text, self.s.replaced("dotted" + re.sub("[0-9]", "0", plain), digits, ["0123456789"] * len(digits), lambda d: not is_address(fill(plain, d, is_digit))), is_digit)
        octets = [int(x) for x in plain.split(".")]
        kind = address_class(octets)
        x = int.from_bytes(bytes(octets), "big")
        while True:
            x = self.s.follower("ip", 1 << 32, x)
            octets = list(x.to_bytes(4, "big"))
            if address_class(octets) == kind:
                return "".join(like(c, text[0]) for c in ".".join(map(str, octets)))

    def card(self, text: str) -> str:
        digits = digits_of(text)
        holds = luhn(digits)
        tail = self.s.replaced(f"card{digits[0]}{holds}", digits[1:], ["0123456789"] * (len(digits) - 1), lambda t: luhn(digits[0] + t) == holds)
        return fill(text, digits[0] + tail, is_digit)

    def ssn(self, text: str) -> str:
        digits = digits_of(text)
        return fill(text, self.s.replaced("ssn", digits, ["0123456789"] * len(digits)), is_digit)

    def phone(self, text: str) -> str:
        head = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        cut = head.end() if head else 0
        digits = digits_of(text[cut:])
        return text[:cut] + fill(text[cut:], self.s.replaced("phone", digits, ["0123456789"] * len(digits)), is_digit)

    def iban(self, text: str) -> str:
        plain = plain_digits(text).replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        holds = iban_check(country, account) == check
        new = self.s.replaced(f"iban{country}{holds}", account, ["0123456789" if is_digit(c) else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in account], lambda t: holds or iban_check(country, t) != check)
        return fill(text, country + (iban_check(country, new) if holds else check) + new, lambda c: c != " ")

    def secret(self, text: str) -> str:
        if _HEX.match(text):
            digits = "0123456789abcdef"
            out = self.s.replaced("hex", text.lower(), [digits] * len(text))
            return out.upper() if text.upper() == text and text.lower() != text else out
        cut = 4 if text[:4] == "AKIA" else re.match(r"[A-Za-z]+[-_]", text).end()
        sets = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return text[:cut] + self.s.replaced("token" + text[:cut], text[cut:], [next((a for a in sets if c in a), c) for c in text[cut:]])

    def family(self, name: str) -> str:
        """The surrogate of a part of a name: of its list if it is listed, else letter by letter, never a listed one."""
        low = name.lower()
        for (script, sex), names in NAMES.items():
            if low in names:
                order = sorted(names, key=lambda x: hmac.digest(self.s.key, f"{script}{sex}{x}".encode(), "sha256"))
                out = order[(order.index(low) + 1) % len(order)]
                return out.upper() if len(name) > 1 and name.isupper() else out.title() if name[:1].isupper() else out
        keep = min(2 if low[-1:] in ("а", "о", "я") else 1, max(0, len(name) - 2))
        return self.s.spelled(f"name{keep}", name, keep, lambda x: x not in LISTED)

    def titled(self, m: re.Match) -> tuple[int, str, list[str]]:
        """Where the name ends, its surrogate with the title, and its parts."""
        title, gap, first, joint, second = m.groups()
        if second and not second[0].islower():
            return m.end(), title + gap + self.family(first) + joint + self.family(second), [first, second]
        return m.end(3), title + gap + self.family(first), [first]

    def entities(self, text: str):
        """(kind, start, end, surrogate) of all entities, none within another."""
        found = []
        if "@" in text:
            found += [("email", m.start(), m.end(), self.email(m[0])) for m in _EMAIL.finditer(text)]
        found += [("secret", m.start(), m.end(), self.secret(m[0])) for m in _SECRET.finditer(text)]
        if _DIGIT.search(text):
            found += [(m.lastgroup, m.start(), m.end(), getattr(self, m.lastgroup)(m[0])) for m in _NUMBER.finditer(text)]
        if any(t in text for t in _TITLES):
            parts: set[str] = set()
            for m in _TITLED.finditer(text):
                end, new, own = self.titled(m)
                found.append(("name", m.start(), end, new))
                parts.update(x for x in own if not x[0].islower())
            if parts:  # the same names where no title shows them
                again = re.compile(r"(?<![\w@.])(?:" + "|".join(map(re.escape, sorted(parts))) + r")(?!\w|@)")
                found += [("name", m.start(), m.end(), self.family(m[0])) for m in again.finditer(text)]
        end = 0
        for kind, a, b, new in sorted(found, key=lambda x: (x[1], -x[2])):
            if a >= end:
                yield kind, a, b, new if new != text[a:b] else f"[{kind}]"
                end = b

    def text(self, text: str | None) -> tuple[str | None, int]:
        """The text with surrogates, and how many."""
        if text is None:
            return None, 0
        out, at, n = [], 0, 0
        for _, a, b, new in self.entities(text):
            out += [text[at:a], new]
            at, n = b, n + 1
        return "".join([*out, text[at:]]), n


#: The setting that has a deployment's own secret, and the key of the test corpus, which stands in where it is not set.
SETTING, TEST_KEY = "spark.accessloom.surrogates.key", "accessloom surrogate key of the test corpus"


def key_of(spark: SparkSession) -> bytes:
    return spark.conf.get(SETTING, TEST_KEY).encode()


def with_surrogates(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """docs with surrogates in text; n_chars recounted; count: name of a column to add with the number of entities."""
    names = docs.columns
    at = names.index("text")
    recount = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, T.IntegralType)
    count = count and free_name(count, names)

    def run(batches):
        replacer = Replacer(key)
        for batch in batches:
            new = [replacer.text(x) for x in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array([x for x, _ in new], pa.string())
            if recount:
                k = names.index("n_chars")
                cols[k] = pa.array([None if x is None else len(x) for x, _ in new], batch.schema.types[k])
            fields = [pa.field(f.name, c.type) for f, c in zip(batch.schema, cols)]
            if count:
                cols.append(pa.array([n for _, n in new], pa.int64()))
                fields.append(pa.field(count, pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    fields = [*docs.schema.fields, *([T.StructField(count, T.LongType())] if count else [])]
    return over(docs, run, T.StructType(fields))


def entity_rows(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, entity (as it stands) and surrogate of every occurrence."""

    def run(batches):
        replacer = Replacer(key)
        for batch in batches:
            found = [(k, t[a:b], new) for t in batch.column(0).to_pylist() if t is not None for k, a, b, new in replacer.entities(t)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*found) if found else [()] * 3)], names=["kind", "entity", "surrogate"])

    return over(docs.select(F.col("text").cast("string").alias("text")), run, "kind string, entity string, surrogate string")


def surrogate_collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """Surrogates that stand for more than one entity, or for themselves; none, unless the scheme is broken. Entities that
    differ in case alone are one; other ways to write an entity have surrogates written the same way."""
    pairs = entity_rows(docs, key).where("surrogate <> concat('[', kind, ']')").select("kind", F.lower("entity").alias("entity"), F.lower("surrogate").alias("surrogate")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("entity")).where("n > 1 or entity = surrogate")


def checked_surrogates(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """with_surrogates(), after a check of all entities of docs for collisions. The error names their kinds alone."""
    kinds = [r.kind for r in surrogate_collisions(docs, key).select("kind").distinct().collect()]
    if kinds:
        raise ValueError(f"surrogates collide: {', '.join(sorted(kinds))}")
    return with_surrogates(docs, key, count)

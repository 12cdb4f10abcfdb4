"""Format-preserving pseudonyms for personal numbers and dates.

A value is recognised by its format and must pass its own check (Luhn, mod 97, a calendar, number
ranges); where the text goes on like the value, shorter ends are tried until the check passes. It is then permuted by a keyed Feistel network over the set of valid values of its kind,
so the result has the same format and passes the same check, equal values get equal pseudonyms in
every document, and whoever holds the key can undo it. Values that fail their check stay.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfsieve.llm.common import fresh, table

ROUNDS = 10
KEY_SETTING = "perfsieve.llm.pseudonymKey"
# Only for runs without a key of their own: whoever reads this can undo the pseudonyms.
DEMO_KEY = "demo key, set perfsieve.llm.pseudonymKey"
MEMO = 100_000

FIRST_DAY = dt.date(1900, 1, 1).toordinal()
LAST_DAY = dt.date(2099, 12, 31).toordinal()
MONTHS = "January February March April May June July August September October November December".split()


class Feistel:
    """Keyed permutations of the whole numbers below n, for any n."""

    def __init__(self, key: str, rounds: int = ROUNDS):
        self.key = hashlib.sha256(key.encode()).digest()
        self.rounds = rounds

    def _mix(self, kind: str, n: int, turn: int, half: int, bits: int) -> int:
        size = bits // 8 + 1
        data = f"{kind}|{n}|{turn}|{half}".encode()
        if size <= 64:
            return int.from_bytes(hashlib.blake2b(data, digest_size=size, key=self.key).digest()) & ((1 << bits) - 1)
        return int.from_bytes(hashlib.shake_256(self.key + data).digest(size)) & ((1 << bits) - 1)

    def permute(self, kind: str, n: int, value: int, back: bool = False, valid: Callable[[int], bool] | None = None) -> int:
        """The image of ``value``; images outside the n values, or not ``valid``, are permuted again."""
        bits = max(1, math.ceil((n - 1).bit_length() / 2))
        mask = (1 << bits) - 1
        while True:
            left, right = value >> bits, value & mask
            for turn in reversed(range(self.rounds)) if back else range(self.rounds):
                if back:
                    left, right = right ^ self._mix(kind, n, turn, left, bits), left
                else:
                    left, right = right, left ^ self._mix(kind, n, turn, right, bits)
            value = left << bits | right
            if value < n and (valid is None or valid(value)):
                return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        double = int(digit) * (2 if place % 2 == 0 else 1)
        total += double - 9 if double > 9 else double
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    source = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(source), shape)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _card(f: Feistel, text: str, back: bool) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    n = len(digits) - 1
    new = str(f.permute("card", 10**n, int(digits[:-1]), back)).zfill(n)
    return _refill(text, new + luhn_digit(new))


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    """The country code stays; the rest is permuted."""
    country = re.match(r"\+[0-9]{1,3}", text)
    head = country.end() if country else 0
    if country and head == len(text):
        return None
    rest = _digits(text[head:])
    if not 8 <= len(rest) + max(0, head - 1) <= 15 or len(rest) < 6:
        return None
    return text[:head] + _refill(text[head:], str(f.permute(f"phone{text[:head]}", 10 ** len(rest), int(rest), back)).zfill(len(rest)))


def _ssn_ok(value: int) -> bool:
    area, group, serial = value // 1_000_000, value // 10_000 % 100, value % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    value = int(_digits(text))
    if not _ssn_ok(value):
        return None
    return _refill(text, str(f.permute("ssn", 10**9, value, back, _ssn_ok)).zfill(9))


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)))
    return ".".join(map(str, f.permute("ip", 1 << 32, value, back).to_bytes(4)))


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    """The country stays; letters and digits of the account are permuted among their like."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account, n, value = plain[4:], 1, 0
    for c in account:
        base = 10 if c.isdigit() else 26
        value, n = value * base + (int(c) if c.isdigit() else ord(c) - 65), n * base
    shape = "".join("9" if c.isdigit() else "A" for c in account)
    value, new = f.permute(f"iban{plain[:2]}{shape}", n, value, back), ""
    for c in reversed(shape):
        value, place = divmod(value, 10 if c == "9" else 26)
        new = (str(place) if c == "9" else chr(65 + place)) + new
    check = 98 - _iban_number(new + plain[:2] + "00") % 97
    source = iter(f"{plain[:2]}{check:02d}{new}")
    return "".join(" " if c == " " else next(source) for c in text)


_WORD_CHARS = "abcdefghijklmnopqrstuvwxyz"


def _email(f: Feistel, text: str, back: bool) -> str | None:
    """Digits and letters of the part before the @ are permuted among their like; case and marks stay."""
    local, at, host = text.partition("@")
    shape = re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", local)))
    n, value = 1, 0
    for c, kind in zip(local, shape, strict=True):
        if kind == "9":
            n, value = n * 10, value * 10 + int(c)
        elif kind in "aA":
            n, value = n * 26, value * 26 + _WORD_CHARS.index(c.lower())
    if n == 1:
        return None
    value, new = f.permute(f"mail{shape}", n, value, back), []
    for c, kind in zip(reversed(local), reversed(shape), strict=True):
        if kind == "9":
            value, place = divmod(value, 10)
            c = str(place)
        elif kind in "aA":
            value, place = divmod(value, 26)
            c = _WORD_CHARS[place].upper() if kind == "A" else _WORD_CHARS[place]
        new.append(c)
    return "".join(reversed(new)) + at + host


def _date(year: int, month: int, day: int) -> int | None:
    try:
        place = dt.date(year, month, day).toordinal()
    except ValueError:
        return None
    return place - FIRST_DAY if FIRST_DAY <= place <= LAST_DAY else None


def _new_day(f: Feistel, place: int | None, back: bool, late: bool = False) -> dt.date | None:
    """``late`` keeps to days after the 12th, where day and month cannot be mistaken for each other."""
    if place is None:
        return None
    valid = (lambda p: dt.date.fromordinal(FIRST_DAY + p).day > 12) if late else None
    kind = "late date" if late else "date"
    return dt.date.fromordinal(FIRST_DAY + f.permute(kind, LAST_DAY - FIRST_DAY + 1, place, back, valid))


def _iso_date(f: Feistel, text: str, back: bool) -> str | None:
    mark = text[4]
    year, month, day = map(int, text.split(mark))
    new = _new_day(f, _date(year, month, day), back)
    return new and f"{new.year:04d}{mark}{new.month:02d}{mark}{new.day:02d}"


def _dot_date(f: Feistel, text: str, back: bool) -> str | None:
    """Day.month.year, with or without leading zeros (all parts with them if one has)."""
    day, month, year = text.split(".")
    new = _new_day(f, _date(int(year), int(month), int(day)), back)
    return new and f"{new.day:02d}.{new.month:02d}.{new.year:04d}"


def _slash_date(f: Feistel, text: str, back: bool) -> str | None:
    """Month/day/year; a first number over 12 makes it day/month/year."""
    one, two, year = map(int, text.split("/"))
    if one > 12:
        new = _new_day(f, _date(year, two, one), back, late=True)
        return new and f"{new.day:02d}/{new.month:02d}/{new.year:04d}"
    new = _new_day(f, _date(year, one, two), back)
    return new and f"{new.month:02d}/{new.day:02d}/{new.year:04d}"


def _month(name: str) -> int:
    return next(i for i, m in enumerate(MONTHS, 1) if m[:3].lower() == name[:3].lower())


def _word_date(f: Feistel, text: str, back: bool) -> str | None:
    """12 March 2020 or March 12, 2020."""
    name = re.search(r"[A-Za-z]+", text).group()
    day, year = map(int, re.findall(r"[0-9]+", text))
    new = _new_day(f, _date(year, _month(name), day), back)
    if new is None:
        return None
    month = MONTHS[new.month - 1]
    return f"{new.day} {month} {new.year}" if text[0].isdigit() else f"{month} {new.day}, {new.year}"


# Characters of an IBAN by country (the registry's).
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27,
    DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FK=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HN=28, HR=21, HU=28,
    IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22,
    MK=19, MN=20, MR=27, MT=31, MU=30, NI=28, NL=18, NO=15, OM=23, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, RU=33, SA=24,
    SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SO=23, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20, YE=30,
)


def _iban_ends(text: str, start: int, end: int) -> Iterator[int]:
    """The end by the country's length, then that of the whole match."""
    left, at = IBAN_LENGTHS.get(text[start : start + 2], 0), start
    while left and at < end:
        left -= text[at] != " "
        at += 1
    if at > start and not left and not text[at : at + 1].isalnum():
        yield at
    yield end


_GAP = re.compile(r"[ .-](?=[0-9])")
# What a phone number stops before: the shapes of dates, also with pseudonyms in them.
_DATE_NEXT = re.compile(
    r" (?:[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\2[0-9]{4}"
    rf"|[0-9]{{1,2}} (?i:{'|'.join(MONTHS)}) [0-9]{{4}})(?![0-9])"
)


def _phone_ends(text: str, start: int, end: int) -> Iterator[int]:
    """The end before a date or a number of its own, then ever earlier gaps. Only shapes count, which pseudonyms keep.

    From ten digits on, a space after a group of six or more digits or after a group that another mark
    joins on ends the number. Groups of a few digits with nothing but spaces cannot be told apart.
    """
    gaps = [m.start() for m in _GAP.finditer(text, start, end)] if text[start] == "+" else []
    for n, gap in enumerate(gaps):
        if text[gap] != " ":
            continue
        digits = len(_digits(text[start:gap]))
        apart = n > 0 and (text[gaps[n - 1]] != " " or gap - gaps[n - 1] > 6)
        if (digits >= 10 and apart) or (digits >= 8 and _DATE_NEXT.match(text, gap)):
            yield gap
            yield from reversed(gaps[:n])
            return
    yield end
    yield from reversed(gaps)


# Where a match may end, in the order to try; that of other kinds is fixed by their patterns.
_ENDS: dict[str, Callable[[str, int, int], Iterator[int]]] = {"iban": _iban_ends, "phone": _phone_ends}

_NAMES = "|".join(MONTHS)
# Kind, pattern, transformation; the first kind whose pattern fits and whose check passes wins a place.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"[^\W_][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _email),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", _iban),
    ("ip", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", _ip),
    ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{4}/[0-9]{2}/[0-9]{2}(?![0-9/])", _iso_date),
    ("date", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?!\.?[0-9])", _dot_date),
    ("date", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])", _slash_date),
    ("date", rf"[0-9]{{1,2}} (?i:{_NAMES}) [0-9]{{4}}(?![0-9])|(?i:{_NAMES}) [0-9]{{1,2}}, [0-9]{{4}}(?![0-9])", _word_date),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    (
        "phone",
        r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,5}\))?(?:[ .-]?[0-9]{2,5}){1,5}(?![0-9])"
        r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
        _phone,
    ),
    ("card", r"[0-9]{13,19}(?![0-9])|[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])", _card),
]
# A place where a value may start: not inside a word, a number or a longer dotted number.
_START = r"(?<!\w)(?<![0-9][.,])"
_ANY = re.compile(_START + r"(?=[\w(+])(?:" + "|".join(f"(?P<k{n}>{p})" for n, (_, p, _) in enumerate(KINDS)) + ")")
_EACH = [re.compile(_START + f"(?:{p})") for _, p, _ in KINDS]
_LIKELY = re.compile(r"[0-9@]")


class Pseudonymiser:
    def __init__(self, key: str):
        self.feistel = Feistel(key)
        self.memo: dict[tuple[int, str], str | None] = {}

    def _new(self, kind: int, value: str, back: bool) -> str | None:
        if back:
            return KINDS[kind][2](self.feistel, value, True)
        if (kind, value) not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[kind, value] = KINDS[kind][2](self.feistel, value, False)
        return self.memo[kind, value]

    def _first(self, kind: int, text: str, start: int, end: int, back: bool) -> tuple[str | None, int, int]:
        """(new value, start, end) of the first of a match's ends that passes the check."""
        ends = _ENDS.get(KINDS[kind][0])
        for stop in ends(text, start, end) if ends else (end,):
            new = self._new(kind, text[start:stop], back)
            if new is not None:
                return new, start, stop
        return None, start, end

    def replace(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """(new text, (kind, start, end) of each value in ``text``)."""
        if not _LIKELY.search(text):
            return text, []
        out, found, last, at = [], [], 0, 0
        while match := _ANY.search(text, at):
            at = match.start() + 1
            for kind in range(int(match.lastgroup[1:]), len(KINDS)):
                fit = _EACH[kind].match(text, match.start())
                new, start, end = self._first(kind, text, fit.start(), fit.end(), back) if fit else (None, 0, 0)
                if new is not None:
                    out += [text[last:start], new]
                    found.append((KINDS[kind][0], start, end))
                    last = at = end
                    break
        return "".join([*out, text[last:]]), found


FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
_ARROW = pa.struct([("text", pa.string()), ("kinds", pa.list_(pa.string()))])


def _replacer(key: str, back: bool):
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = Pseudonymiser(key)
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                new, found = (None, []) if text is None else names.replace(text, back)
                out.append({"text": new, "kinds": [kind for kind, _, _ in found]})
            yield pa.array(out, _ARROW)

    return replace


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with the personal values of ``text_col`` replaced (or, with ``back``, restored).

    All rows and other columns stay; ``kinds`` names a column to add with the kind of every value in
    order of place. Null texts stay null, empty ones empty; equal rows get equal results. Dates
    come out with the zeros of their format (5.3.2020 as dd.mm.yyyy), so only they may not come back
    character by character. Rows never meet, so hot values need no care.
    """
    new = fresh(docs, "_new")
    replace = F.arrow_udf(_replacer(key, back), FOUND, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    marked = docs.withColumn(new, replace(F.col(text_col)))
    columns = [F.col(new)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*columns, *([F.col(new)["kinds"].alias(kinds)] if kinds else []))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonymise(docs, spark.conf.get(KEY_SETTING, DEMO_KEY), kinds="kinds")
    return found.select(
        "doc_id",
        F.size("kinds").cast("long").alias("n_values"),
        F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"),
        "text",
    )


QUERIES = {"op8_feistel_pseudonyms": _query}
CHECKS: dict[str, str] = {}

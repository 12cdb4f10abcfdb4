"""String features, note cleaning and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perfsieve.constants import (
    BUG_ID_TOKEN,
    BUG_URL_TOKEN,
    CATEGORY_TOKEN_LENGTH,
    LONG_NUMBER_TOKEN,
    NO_NOTES,
)

# White space and word boundaries are the Unicode ones, whatever the JVM's defaults.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"

# What is masked in a note, in this order.
MASKS = [
    (rf"(?i)https?://{NOT_SPACE}*bugzilla{NOT_SPACE}*", BUG_URL_TOKEN),
    (rf"(?i){WORD_START}bug{SPACE}*#?{SPACE}*\p{{Nd}}+{WORD_END}", BUG_ID_TOKEN),
    (rf"{WORD_START}\p{{Nd}}{{4,}}{WORD_END}", LONG_NUMBER_TOKEN),
]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def length_chars(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def length_words(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def normalize_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def fill_empty(text: Column) -> Column:
    """Stripped text, or a marker when nothing is left."""
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"\A\z", NO_NOTES)


def sanitize(text: Column) -> Column:
    """Tracker links, bug references and long numbers replaced by tokens."""
    masked = F.coalesce(text, F.lit(""))
    for pattern, token in MASKS:
        masked = F.regexp_replace(masked, pattern, token)
    return strip(masked)


def category_token_v1(name: str, value: Column) -> Column:
    clean = F.regexp_replace(strip(F.lower(value.cast("string"))), " ", "_")
    return F.coalesce(F.concat(F.lit(f"{name}="), F.regexp_replace(clean, r"[^a-z0-9_\-.]", "")), F.lit(""))


def clean_category(value: Column) -> Column:
    clean = F.regexp_replace(F.lower(strip(value.cast("string"))), f"{SPACE}+", "_")
    clean = F.regexp_replace(clean, r"[^A-Za-z0-9_\-.]+", "")
    return F.when(clean == "", F.lit("empty")).otherwise(F.substring(clean, 1, CATEGORY_TOKEN_LENGTH))


def category_token_v2(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(clean_category(value), F.lit("missing")))


def _product_error(a: Column, b: Column, product: Column) -> Column:
    """Exact rounding error of the double product a*b (Dekker's splitting)."""

    def halves(x: Column) -> tuple[Column, Column]:
        scaled = x * F.lit(134217729.0)
        high = scaled - (scaled - x)
        return high, x - high

    a1, a2 = halves(a)
    b1, b2 = halves(b)
    return ((a1 * b1 - product) + a1 * b2 + a2 * b1) + a2 * b2


_POWERS = [10.0**i for i in range(23)]


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rounded(scaled: Column, error: Column) -> Column:
    """Nearest whole number to scaled + error, the exact value behind a rounded product; ties to even."""
    whole = F.floor(scaled)
    part = scaled - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return whole + F.when(up, 1).otherwise(0)


def format_1f(value: Column) -> Column:
    """One decimal as C's ``%.1f`` prints it, for magnitudes below 1e15."""
    ten = F.lit(10.0)

    def text_of(x: Column) -> Column:
        tenths = _let(F.abs(x) * ten, lambda s: _rounded(s, _product_error(F.abs(x), ten, s)))
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
        digits = _let(tenths, lambda n: F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string")))
        return F.concat(sign, digits)

    return F.when(value.isNotNull(), _let(value.cast("double"), text_of))


def format_4g(value: Column) -> Column:
    """Four significant digits as C's ``%.4g`` prints them.

    The JVM formatter rounds the shortest decimal form, C the binary value; they differ for values
    such as 123.35. The digits here come from an error-free product, so ties fall as in C for
    magnitudes from 1e-19 to 1e25; outside, the JVM formatter's digits are used.
    """

    def pick(i: Column) -> Column:
        return F.get(F.array(*[F.lit(p) for p in _POWERS]), i.cast("int"))

    def with_exponent(size: Column, guess: Column) -> Column:
        # log10 may be off by one next to a power of ten; these powers are exact where used.
        over = F.when(guess.between(-1, 21) & (size >= pick(guess + 1)), 1).otherwise(0)
        under = F.when(guess.between(0, 22) & (size < pick(guess)), 1).otherwise(0)
        return _let((guess + over - under).cast("int"), lambda exponent: shown(size, exponent))

    def shown(size: Column, exponent: Column) -> Column:
        grown = _let(
            pick(3 - exponent),
            lambda p: _let(size * p, lambda s: F.struct(s.alias("s"), _product_error(size, p, s).alias("err"))),
        )
        shrunk = _let(
            pick(exponent - 3),
            lambda p: _let(
                size / p,
                lambda s: _let(
                    s * p, lambda back: F.struct(s.alias("s"), (size - back - _product_error(s, p, back)).alias("err"))
                ),
            ),
        )
        exact = F.when(exponent <= 3, grown).otherwise(shrunk)
        return F.when(~exponent.between(-19, 25), jvm_text(size)).otherwise(
            _let(exact, lambda x: _let(_rounded(x["s"], x["err"]), lambda digits: place(digits, exponent)))
        )

    def place(digits: Column, exponent: Column) -> Column:
        carried = digits >= 10000
        text = F.when(carried, F.lit("1000")).otherwise(digits.cast("string"))
        final = exponent + F.when(carried, 1).otherwise(0)
        return _let(
            F.struct(text.alias("d"), final.alias("e")),
            lambda x: F.when(x["e"].between(-4, 3), fixed(x["d"], x["e"])).otherwise(scientific(x["d"], x["e"])),
        )

    def joined(lead: Column, tail: Column) -> Column:
        return F.when(tail == "", lead).otherwise(F.concat(lead, F.lit("."), tail))

    def fixed(d: Column, e: Column) -> Column:
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), F.rtrim(d, F.lit("0")))
        large = joined(F.substring(d, F.lit(1), e + 1), F.rtrim(F.substring(d, e + 2, F.lit(4)), F.lit("0")))
        return F.when(e < 0, small).otherwise(large)

    def scientific(d: Column, e: Column) -> Column:
        mantissa = joined(F.substring(d, 1, 1), F.rtrim(F.substring(d, 2, 3), F.lit("0")))
        power = F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+"))
        return F.concat(mantissa, power, F.lpad(F.abs(e).cast("string"), 2, "0"))

    def jvm_text(size: Column) -> Column:
        return _let(
            F.format_string("%.3e", size),
            lambda t: F.concat(
                joined(F.substring(t, 1, 1), F.rtrim(F.substring(t, 3, 3), F.lit("0"))), F.substring(t, 6, 10)
            ),
        )

    def whole_text(x: Column) -> Column:
        size = F.abs(x)
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
        finite = F.when(size == 0, "0").otherwise(
            _let(F.floor(F.log10(size)), lambda guess: with_exponent(size, guess))
        )
        return F.when(F.isnan(x), "nan").otherwise(
            F.concat(sign, F.when(size == float("inf"), "inf").otherwise(finite))
        )

    return F.when(value.isNotNull(), _let(value.cast("double"), whole_text))


def key_value(name: str, value: Column, data_type: str) -> Column:
    """``name=value``; null stays null so that ``concat_ws`` skips it."""
    if data_type in ("double", "float"):
        shown = F.when(F.isnan(value), None).otherwise(format_4g(value))
    elif data_type == "boolean":
        shown = F.initcap(value.cast("string"))
    else:
        shown = value.cast("string")
    return F.concat(F.lit(f"{name}="), shown)


def option_list(text: Column) -> Column:
    """Comma list, lower-cased, spaces removed, task paths shortened to their runner's name."""
    return F.regexp_replace(label_list(text), r"taskcluster-projects/[^,]*", "taskcluster")


def label_list(text: Column) -> Column:
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit(""))


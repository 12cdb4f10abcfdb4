"""Numeric, calendar and lookup features of one row."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from perfsieve.constants import DEFAULT_WEIGHT, PRIORITY_WEIGHTS

# Substring -> operating system, tested in this order.
OS_BY_SUBSTRING = [
    ("android", "android"),
    ("fenix", "android"),
    ("linux", "linux"),
    ("mac", "mac"),
    ("osx", "mac"),
    ("win", "windows"),
]
# Substring -> processor architecture, tested in this order.
ARCH_BY_SUBSTRING = [
    ("aarch64", "aarch64"),
    ("arm64", "aarch64"),
    ("arm", "arm"),
    ("x86_64", "x64"),
    ("x64", "x64"),
    ("64-bit", "x64"),
    ("x86", "x86"),
    ("32-bit", "x86"),
    ("-64", "x64"),
    (" 64", "x64"),
    ("-32", "x86"),
    (" 32", "x86"),
]


def clean_number(text: Column) -> Column:
    """Number hidden in text such as ``(1,``; 0 when there is none."""
    return F.coalesce(F.regexp_replace(text.cast("string"), "[(),]", "").try_cast("double"), F.lit(0.0))


def day_of_week(t: Column) -> Column:
    """Monday is 0."""
    return F.weekday(t)


def is_weekend(t: Column) -> Column:
    return F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0))


def hour_sin(t: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * F.hour(t) / F.lit(24))


def hour_cos(t: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * F.hour(t) / F.lit(24))


def severity_weight(label: Column, priority: Column) -> Column:
    """Training weight from the bug's priority; 1 for rows without a bug."""
    name = F.upper(F.trim(priority))
    weight = F.lit(DEFAULT_WEIGHT)
    for known, value in PRIORITY_WEIGHTS.items():
        weight = F.when(name == known, F.lit(value)).otherwise(weight)
    has_bug = F.coalesce(label.cast("int"), F.lit(0)) != 0
    return F.when(has_bug, weight).otherwise(F.lit(DEFAULT_WEIGHT))


def signed_log_z(value: Column, center: Column, spread: Column, count: Column) -> Column:
    """Sign-preserving log1p of the z-score; 0 when it is undefined or rests on fewer than 2 points."""
    raw = F.try_divide(value - center, spread + F.lit(1e-4))
    z = F.signum(raw) * F.log1p(F.abs(raw))
    usable = (count >= 2) & z.isNotNull() & ~F.isnan(z) & (F.abs(z) != F.lit(float("inf")))
    return F.when(usable, z).otherwise(F.lit(0.0))


def relative_change(before: Column, after: Column) -> Column:
    return (after - before) / F.greatest(F.abs(before), F.lit(1e-9))


def related_count(text: Column) -> Column:
    """How many pipe-separated parts consist of digits only."""
    parts = F.split(F.btrim(strip_spaces(text.cast("string")), F.lit("|")), r"\|")
    return F.coalesce(F.size(F.filter(parts, lambda p: p.rlike(r"^\p{Nd}+\z"))), F.lit(0))


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+\z", "")


def platform_os(text: Column) -> Column:
    name = F.lower(text)
    chain = F.split_part(name, F.lit("-"), F.lit(1))
    for part, os_name in reversed(OS_BY_SUBSTRING):
        chain = F.when(name.contains(part), F.lit(os_name)).otherwise(chain)
    return F.coalesce(chain, F.lit("unknown"))


def platform_arch(text: Column) -> Column:
    name = F.lower(text)
    chain = F.lit("unknown")
    for part, arch in reversed(ARCH_BY_SUBSTRING):
        chain = F.when(name.contains(part), F.lit(arch)).otherwise(chain)
    return chain


def _count(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, [c.cast("int") for c in conditions])


def bin_index(value: Column, edges: list[float] | None) -> Column:
    """Index of the bin holding ``value`` (left-closed search); -1 for null or without edges."""
    if not edges:
        return F.lit(-1)
    below = _count([value > F.lit(float(e)) for e in edges])
    index = F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), below - 1))
    return F.when(value.isNull(), F.lit(-1)).otherwise(index)


def bin_token(name: str, value: Column, edges: list[float] | None, n_bins: int) -> Column:
    """``name=q<k>`` with k scaled to 0..n_bins-1; sign tokens without edges; ``missing`` for null."""
    missing = F.when(value.isNull(), F.lit(f"{name}=missing"))
    if not edges:
        sign = F.when(value > 0, "pos").when(value < 0, "neg").otherwise("zero")
        return missing.otherwise(F.concat(F.lit(f"{name}="), sign))
    top = len(edges) - 2
    upto = _count([value >= F.lit(float(e)) for e in edges]) - 1
    b = F.greatest(F.lit(0), F.least(upto, F.lit(top)))
    q = F.bround(b * F.lit(float(n_bins - 1)) / F.lit(max(1, top))).cast("int")
    return missing.otherwise(F.concat(F.lit(f"{name}=q"), q.cast("string")))

"""Hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hash values that path decisions go by; two digits decide each thing.
SPACE = 10_000


def path_hash(path: Column) -> Column:
    """sha256 of a path as a number, modulo SPACE: eight 32-bit digits by Horner's rule."""
    digest = F.sha2(path, 256)
    digits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: (a * 4294967296 + x) % SPACE)


def percent(fraction: float) -> int:
    """A fraction in whole percent, cut off."""
    return int(float(fraction) * 100)


def held_out(bucket: Column, fraction: float) -> Column:
    """Whether a path hash falls under the held-out share."""
    return bucket % 100 < percent(fraction)


def fim_chosen(bucket: Column, rate: float) -> Column:
    """Whether a path hash asks for a fill-in-the-middle rewrite; independent of held_out."""
    return F.floor(bucket / 100) % 100 < percent(rate)


def fim_mode(bucket: Column) -> Column:
    return F.when(bucket % 2 == 0, "psm").otherwise("spm")


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of sha256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def content_id(prefix: str, *parts: Column) -> Column:
    """An id that is the same for the same content: prefix and 8 hex digits of the parts' sha256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8))

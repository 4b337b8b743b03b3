"""Scalar expressions over text, money, hashes and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that scanners mistake for digits.
CONFUSED, DIGITS = "OoIilLZzSsBb", "001111225588"
_DIGIT = r"[OoIilLZzSsBb0-9]"
REFERENCE = rf"(?i)MP\s*({_DIGIT}{{5,10}})\s*[-–—_]\s*W\s*({_DIGIT}{{2,10}})"
#: Words that no generated text may hold, because leads aren't verdicts.
BANNED = ("fraud", "fraudulent", "corrupt[A-Za-z]*", "embezzl[A-Za-z]*", "guilty", "criminal")
_LETTER = r"\p{L}\p{N}_"
WORDING = rf"(?i)(^|[^{_LETTER}])({'|'.join(BANNED)})([^{_LETTER}]|$)"
AMOUNT = r"(?i)(?:rs|inr|₹)\s*\.?\s*([0-9,]+(?:\.[0-9]+)?)\s*(crore|cr|lakh|lac|l)?\b"


def squeeze(text: Column, most: int | None = None) -> Column:
    """Collapse white space; cut to ``most`` characters with an ellipsis."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return out if most is None else F.when(F.length(out) > most, F.concat(F.rtrim(F.substring(out, 1, most - 1)), F.lit("…"))).otherwise(out)


def money(amount: Column) -> Column:
    """Rupees in crore or lakh; none is unknown."""
    x = amount.cast("double")
    return F.when(x.isNull() | (x == 0), "unknown").when(x >= 1e7, F.format_string("Rs %.2f crore", x / 1e7)).when(x >= 1e5, F.format_string("Rs %.2f lakh", x / 1e5)).otherwise(F.format_string("Rs %.0f", x))


def counted(n: Column, noun: str) -> Column:
    return F.concat(F.format_number(n.cast("long"), 0), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def label(name: Column) -> Column:
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))


def reference(text: Column) -> Column:
    """A work's reference in scanned text, with mistaken digits corrected; null if there is none."""
    fix = lambda part: F.translate(F.regexp_extract(text, REFERENCE, part), CONFUSED, DIGITS)
    return F.when(F.regexp(text, F.lit(REFERENCE)), F.concat(F.lit("MP"), fix(1), F.lit("-W"), fix(2)))


def amount_value(number: Column, unit: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    scale = F.when(u.isin("cr", "crore"), 1e7).when(u.isin("lakh", "lac", "l"), 1e5).otherwise(1.0)
    return F.replace(number, F.lit(",")).try_cast("double") * scale


def amount(text: Column) -> Column:
    """A rupee amount in text, with its unit."""
    return amount_value(F.nullif(F.regexp_extract(text, AMOUNT, 1), F.lit("")), F.regexp_extract(text, AMOUNT, 2))


def line_confidence(lines: Column, fragment: Column) -> Column:
    """The best confidence of the lines that hold a fragment, else 0."""
    return F.coalesce(F.array_max(F.transform(F.filter(lines, lambda x: F.contains(x["text"], fragment)), lambda x: x["confidence"])), F.lit(0.0))


def guarded(text: Column) -> Column:
    """Generated text, trimmed; empty if it holds a banned word."""
    return F.when(F.regexp(text, F.lit(WORDING)), "").otherwise(F.trim(text))


def row_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def hex64(text: Column) -> Column:
    """Sixteen hex digits as a signed 64-bit number."""
    high, low = (F.conv(F.substring(text, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)

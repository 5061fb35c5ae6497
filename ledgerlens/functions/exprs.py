"""Column expressions shared by the operators. None of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null where nothing matches or the group is empty."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def to_int(c: Column) -> Column:
    return c.try_cast("int")


def number(c: Column) -> Column:
    """A printed number with thousands separators; null if it is none."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def round_to(c: Column, places: int) -> Column:
    """Half away from zero on the binary value, the same in every engine."""
    s = float(10**places)
    return F.signum(c) * F.floor(F.abs(c) * s + F.lit(0.5)) / s


def parse_amount(c: Column) -> Column:
    """First amount with two decimals in a text; negative with a trailing minus or a leading minus or ``($``."""
    body = first_match(c, r"([0-9,]+\.[0-9]{2})")
    minus = F.trim(c).rlike(r"-$|^-|^\(\$")
    return F.when(minus, -number(body)).otherwise(number(body))


def parse_trailing_minus(c: Column) -> Column:
    """A whole text that is a number of any precision, with an optional sign in front or behind."""
    t = F.trim(c)
    ok = t.rlike(r"^-?[0-9,]*\.?[0-9]+-?$")
    value = number(F.regexp_replace(t, "-", ""))
    return F.when(ok, F.when(t.rlike("^-|-$"), -value).otherwise(value))


def iso_date(c: Column) -> Column:
    """Eight digits as yyyy-MM-dd, else the trimmed text."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{8}$"), F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(t)


def readable_chars(c: Column) -> Column:
    """Characters that are neither white space nor control characters; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)[\s\x00-\x1f\x7f-\x9f]", "")), F.lit(0))


def upc_suffix(upc: Column, material: Column) -> Column:
    """'suffix5' if the code ends in the material's last five digits (zero-filled), 'suffix4' for four, else null."""
    u, m = digits(upc), digits(material)
    m5 = F.when(F.length(m) < 5, F.lpad(m, 5, "0")).otherwise(m)
    some = (u != "") & (m != "")
    return F.when(some & u.endswith(F.right(m5, F.lit(5))), "suffix5").when(some & u.endswith(F.right(m5, F.lit(4))), "suffix4")


def description_tokens(c: Column) -> Column:
    """Distinct words of a description in upper case; ``& - / , .`` part words; an empty list for null."""
    words = F.split(F.trim(F.translate(F.upper(F.coalesce(c, F.lit(""))), "&-/,.", "     ")), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def net_unit_price(unit_price: Column, quantity: Column, promo: Column) -> Column:
    """Unit price less the promotion per unit, to six places; the unit price where there is none."""
    none = (F.coalesce(quantity, F.lit(0.0)) == 0) | promo.isNull()
    return F.when(none, unit_price).otherwise(round_to(unit_price - F.try_divide(F.abs(promo), quantity), 6))


#: Phrases by which a receiving note says that nothing is short.
NO_SHORTAGE = (
    r"\bover\s*/\s*short\s*[:=]?\s*0\b",
    r"\b(short|shortage)\s*(cases|qty|quantity)?\s*[:=]?\s*0\b",
    r"\bno\s+shortage\b",
    r"\bdelivered\s+in\s+full\b",
    r"\bfull\s+delivery\b",
)


def says_no_shortage(notes: Column) -> Column:
    return F.coalesce(notes.rlike("(?i)" + "|".join(NO_SHORTAGE)), F.lit(False))


def plausible_cases(c: Column) -> Column:
    """A count of cases from 0 to 19,999 after dropping decimals; false for null and for text."""
    return F.coalesce(c.try_cast("double").cast("bigint").between(0, 19_999), F.lit(False))

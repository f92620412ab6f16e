"""Checksums and text signals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and decimal digits, as the maskers understand them.
ALNUM = r"[\p{L}\p{Nd}]"


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Nd}]", "")


def compact(c: Column) -> Column:
    """Letters and digits, in upper case."""
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def luhn(c: Column) -> Column:
    """12 to 19 ASCII digits with a right check digit."""
    plain = c.rlike("^[0-9]{12,19}$")
    return F.coalesce(plain & F.call_function("luhn_check", F.when(plain, c).otherwise(F.lit("0"))), F.lit(False))


def iban(c: Column) -> Column:
    """15 to 34 letters and digits, country and check digits first, remainder 1 by 97."""
    text = compact(c)
    turned = F.concat(F.substring(text, 5, 30), F.substring(text, 1, 4))
    chars = F.split(turned, "")

    def add(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(ch == "", acc).when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    remainder = F.aggregate(chars, F.lit(0), add)
    return F.coalesce(F.when(text.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), remainder == 1).otherwise(F.lit(False)), F.lit(False))


def swiss_ahv(c: Column) -> Column:
    """13 digits from 756 on, whose weights 1 and 3 give the last one."""
    d = digits_only(c)
    total = sum((F.substring(d, k + 1, 1).try_cast("int") * (1 if k % 2 == 0 else 3) for k in range(12)), F.lit(0))
    return F.coalesce(d.rlike("^756[0-9]{10}$") & ((10 - total % 10) % 10 == F.substring(d, 13, 1).try_cast("int")), F.lit(False))


def signals(c: Column) -> Column:
    """What gates ask of a text: length, digits, upper-case letters, whether six stand together."""
    return F.struct(
        F.length(c).alias("length"),
        F.length(F.regexp_replace(c, "[^0-9]", "")).alias("digits"),
        F.length(F.regexp_replace(c, "[^A-Z]", "")).alias("upper"),
        c.rlike("[A-Z]{6}").alias("upper_run"),
    )

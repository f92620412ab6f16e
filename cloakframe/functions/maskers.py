"""Maskers as column expressions. All give null for null; ph is the placeholder."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.checksums import compact, digits_only

_ALNUM = r"\p{L}\p{Nd}"


def _pad(padding: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", padding)


def _some(c: Column, masked: Column) -> Column:
    return F.when(c.isNotNull(), masked)


def _pads(n: Column, padding: str) -> Column:
    return F.repeat(F.lit(padding), n.cast("int"))


def redact(c: Column, ph: str) -> Column:
    return _some(c, F.lit(ph))


def partial(c: Column, keep: int, padding: str = "*") -> Column:
    """All but the last keep letters and digits are hidden; separators stay; too short texts show nothing."""
    n = F.length(F.regexp_replace(c, f"[^{_ALNUM}]", ""))
    every = F.regexp_replace(c, f"[{_ALNUM}]", _pad(padding))
    if not keep:
        return every
    but_last = F.regexp_replace(c, f"(?s)[{_ALNUM}](?=(?:[^{_ALNUM}]*[{_ALNUM}]){{{keep}}})", _pad(padding))
    return F.when(n <= keep, every).otherwise(but_last)


def email(c: Column, ph: str, padding: str = "*") -> Column:
    """First letters of both parts and the ending stay. The last @ parts them."""
    domain = F.substring_index(c, "@", -1)
    local = F.substring(c, F.lit(1), F.length(c) - F.length(domain) - 1)
    ending = F.substring_index(domain, ".", -1)
    dot = F.length(domain) - F.length(ending) - 1  # before the last dot
    hidden = F.when(domain.contains(".") & (dot > 0), F.concat(F.substring(domain, 1, 1), _pads(dot - 1, padding), F.lit("."), ending)).otherwise(F.concat(F.substring(domain, 1, 1), _pads(F.length(domain) - 1, padding)))
    whole = F.concat(F.substring(local, 1, 1), _pads(F.length(local) - 1, padding), F.lit("@"), hidden)
    return _some(c, F.when(c.contains("@") & (F.length(local) > 0) & (F.length(domain) > 0), whole).otherwise(F.lit(ph)))


def _fours(c: Column) -> Column:
    return F.regexp_replace(c, "(.{4})(?!$)", "$1 ")


def iban(c: Column, ph: str, keep: int = 4, padding: str = "*") -> Column:
    """Four leading and up to four trailing characters, in groups of four."""
    text = compact(c)
    keep = min(keep, 4)
    hidden = F.concat(F.substring(text, 1, 4), _pads(F.length(text) - 4 - keep, padding), F.substring(text, F.length(text) - keep + 1, F.lit(keep)) if keep else F.lit(""))
    good = text.rlike(r"^\p{L}{2}\p{Nd}{2}") & F.length(text).between(15, 34)
    return _some(c, F.when(good, _fours(hidden)).otherwise(F.lit(ph)))


def pan(c: Column, ph: str, padding: str = "*") -> Column:
    """The last four digits, in groups of four; fewer than twelve digits show nothing."""
    d = digits_only(c)
    hidden = F.concat(_pads(F.length(d) - 4, padding), F.substring(d, F.length(d) - 3, F.lit(4)))
    return _some(c, F.when(F.length(d) >= 12, _fours(hidden)).otherwise(F.lit(ph)))


def phone(c: Column, ph: str, padding: str = "*") -> Column:
    """The last two digits, and after a + the first two; the layout stays."""
    n = F.length(digits_only(c))
    ends = r"(?s)\p{Nd}(?=(?:\P{Nd}*\p{Nd}){2})"
    lead = F.regexp_extract(c, r"(?s)^(\+\P{Nd}*\p{Nd}\P{Nd}*\p{Nd})", 1)
    rest = F.substring(c, F.length(lead) + 1, F.length(c))
    hidden = F.when(c.startswith("+"), F.concat(lead, F.regexp_replace(rest, ends, _pad(padding)))).otherwise(F.regexp_replace(c, ends, _pad(padding)))
    return _some(c, F.when(n >= 6, hidden).otherwise(F.lit(ph)))


def name(c: Column, padding: str = "*") -> Column:
    """The first letter of each run of letters."""
    return F.regexp_replace(c, r"(?<=\p{L})\p{L}", _pad(padding))


def ip(c: Column, ph: str) -> Column:
    """IPv4 without its last number; of IPv6 up to three leading groups."""
    text = F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")
    v4 = F.concat(F.regexp_extract(text, r"^(\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3})\.\p{Nd}{1,3}$", 1), F.lit(".0"))
    lead = F.regexp_extract(text, r"(?s)^([^:]+(?::[^:]+){0,2})", 1)
    v6 = F.when((F.size(F.split(text, ":", -1)) >= 3) & (F.length(lead) > 0), F.concat(lead, F.lit("::"))).otherwise(F.lit(ph))
    return _some(c, F.when(text.contains(":"), v6).when(text.rlike(r"^\p{Nd}{1,3}(\.\p{Nd}{1,3}){3}$"), v4).otherwise(F.lit(ph)))


def year_of_text(c: Column, ph: str) -> Column:
    """The year of an ISO date; other text shows nothing."""
    good = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return _some(c, F.when(F.try_to_date(F.when(good, c), "yyyy-MM-dd").isNotNull(), F.substring(c, 1, 4)).otherwise(F.lit(ph)))


def year_of_date(c: Column, kind: str) -> Column:
    """The first day of a date's year, in its own type."""
    return F.trunc(c, "year") if kind == "date" else F.date_trunc("year", c).cast(kind)

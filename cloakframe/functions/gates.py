"""Native gates: which detectors can match a text at all, and what a whole value is, without Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions import checksums, pure


def may_match(c: Column, d: pure.Detector) -> Column:
    """A necessary condition of the detector's findings; true for one that states none."""
    hinted = [reduce(Column.__or__, [F.lower(c).contains(h) for h in d.hints])] if d.hints else []
    needs = [c.contains(d.needs)] * bool(d.needs) + hinted + [c.rlike(d.loose)] * bool(d.loose)
    return reduce(Column.__and__, needs) if needs else F.lit(True)


def bits(c: Column, detectors: tuple[pure.Detector, ...] = pure.DETECTORS) -> Column:
    """A bit for each detector that may match, the first one's lowest."""
    return sum((F.when(may_match(c, d), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, d in enumerate(detectors)), F.lit(0).cast("long"))


def gate(c: Column, detectors: tuple[pure.Detector, ...] = pure.DETECTORS) -> Column:
    """Whether any of the detectors may match."""
    return reduce(Column.__or__, [may_match(c, d) for d in detectors])


def trimmed(c: Column) -> Column:
    """Without blanks and control characters at its ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _ipv6(t: Column) -> Column:
    groups = F.filter(F.split(t, ":"), lambda g: g != "")
    short = t.contains("::")
    bare = (t.startswith(":") & ~t.startswith("::")) | (t.endswith(":") & ~t.endswith("::"))
    once = ~t.contains(":::") & (F.size(F.split(t, "::")) <= 2)
    return once & ~bare & F.forall(groups, lambda g: F.length(g) <= 4) & F.when(short, F.size(groups) <= 7).otherwise(F.size(groups) == 8)


def _bic(t: Column) -> Column:
    return F.substring(t, 5, 2).isin(*sorted(pure.COUNTRIES)) & (((F.length(t) == 11) & t.endswith("XXX")) | t.rlike("[0-9]"))


#: The checks of built-in detectors as expressions over the matched value.
CHECKS = {"swiss-ahv": checksums.swiss_ahv, "iban": checksums.iban, "payment-card": lambda t: checksums.luhn(checksums.digits_only(t)), "ipv6": _ipv6, "bic": _bic}


def category(c: Column, cap: int) -> Column:
    """The category whose built-in detector takes the whole trimmed value, the first of them; else null.

    Values longer than cap have none. A value is a detector's if the first match is all of it.
    """
    t, out = trimmed(c), F.lit(None).cast("string")
    for d in reversed(pure.DETECTORS):
        first = F.regexp_extract(t, d.pattern.pattern, d.pattern.groups) == t
        out = F.when(may_match(t, d) & first & (CHECKS[d.name](t) if d.name in CHECKS else F.lit(True)), F.lit(d.category)).otherwise(out)
    return F.when((t != "") & (F.length(t) <= cap), out)

"""Texts of database errors without the values they quote."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions import pure
from cloakframe.functions.gates import gate, trimmed
from cloakframe.functions.keys import Key
from cloakframe.operators.text import Chosen, classify, mask_text, sanitizer
from cloakframe.plans.compiler import Engine
from cloakframe.plans.policy import STRICT, Policy
from cloakframe.plans.vocab import CATEGORIES, Declaration

#: What stands for key values, quoted text, and a bare identifier.
KEY_VALUES = r"(?s)\)=\(.*\)"
QUOTED = r'"[^"]*"'
SINGLE_QUOTED = re.compile(r"'[^']*'")
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]{0,63}(?:\.[A-Za-z_$][A-Za-z0-9_$]{0,63}){0,2}")
#: SQLSTATE classes and what kind of error they are; those that quote values.
CLASSES = {"23": "IntegrityConstraintViolation", "22": "Data", "42": "SyntaxError", "40": "TransactionRollback", "08": "NonTransientConnection", "0A": "FeatureNotSupported"}
QUOTES_VALUES = ("22", "23")
LINKS = 16


def _quote(ph: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", ph)


def key_values(c: Column, policy: Policy = STRICT) -> Column:
    return F.regexp_replace(c, KEY_VALUES, f")=({_quote(policy.placeholder)})")


def primary(c: Column, policy: Policy = STRICT, key: Key | None = None, detectors: Chosen | None = None) -> Column:
    return mask_text(key_values(c, policy), policy, key, detectors)


hint = primary


def detail(c: Column, policy: Policy = STRICT, key: Key | None = None, detectors: Chosen | None = None) -> Column:
    """Null unless its values stand where they can be replaced."""
    masked = key_values(c, policy)
    return F.when(c == "", c).when(masked != c, mask_text(masked, policy, key, detectors))


def where(c: Column, policy: Policy = STRICT, key: Key | None = None, detectors: Chosen | None = None) -> Column:
    return mask_text(F.regexp_replace(c, QUOTED, f'"{_quote(policy.placeholder)}"'), policy, key, detectors)


def without_quoted_values(text: str, ph: str) -> str:
    """Single-quoted spans replaced, but for a last one that is a bare identifier outside quoted SQL."""
    spans = [m.span() for m in SINGLE_QUOTED.finditer(text)]
    if not spans:
        return text
    a, b = spans[-1]
    if text[:a].count('"') % 2 == 0 and IDENTIFIER.fullmatch(text[a + 1 : b - 1]):
        spans.pop()
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], f"'{ph}'"]
        at = b
    return "".join(out) + text[at:]


def unquoted(c: Column, policy: Policy = STRICT) -> Column:
    """The same as an expression: all spans replaced, or all but the last if that is a name."""
    parts = F.split(c, "'", -1)
    # Quotes pair up from the left; an odd one out opens nothing.
    paired = F.size(parts) - 1 - (F.size(parts) - 1) % 2
    last = F.get(parts, paired - 1)
    before = F.array_join(F.slice(parts, 1, F.greatest(paired - 1, F.lit(0))), "'")
    name = last.rlike(rf"^(?:{IDENTIFIER.pattern})\z") & (F.length(F.regexp_replace(before, '[^"]', "")) % 2 == 0)
    stays = F.when(F.coalesce(name, F.lit(False)), paired - 1).otherwise(F.lit(-1))
    inside = lambda x, i: F.when((i % 2 == 1) & (i < paired) & (i != stays), F.lit(policy.placeholder)).otherwise(x)
    return F.array_join(F.transform(parts, inside), "'")


def primary_quoted(c: Column, policy: Policy = STRICT, key: Key | None = None, detectors: Chosen | None = None) -> Column:
    """The message of an error whose class quotes values."""
    return mask_text(unquoted(key_values(c, policy), policy), policy, key, detectors)


def quotes_values(state: Column) -> Column:
    """Whether errors of this SQLSTATE quote values; false without one."""
    return F.coalesce(F.substring(state, 1, 2).isin(*QUOTES_VALUES), F.lit(False))


def error_class(state: Column) -> Column:
    """The kind of error that an SQLSTATE stands for."""
    kinds = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.substring(state, 1, 2)), F.lit("Generic"))


def sanitized(policy: Policy = STRICT, key: Key | None = None, prefix: str = "", detectors: Chosen | None = None) -> list[Column]:
    """The columns of an error: texts masked, names and codes kept, the internal query gone."""
    c = lambda n: F.col(prefix + n)
    stated = key_values(c("message"), policy)
    message = F.when(quotes_values(c("sqlstate")), unquoted(stated, policy)).otherwise(stated)
    return [
        *[c(n).alias(n) for n in ("severity", "sqlstate", "schema", "table", "column", "constraint")],
        mask_text(message, policy, key, detectors).alias("message"),
        detail(c("detail"), policy, key, detectors).alias("detail"),
        hint(c("hint"), policy, key, detectors).alias("hint"),
        where(c("where"), policy, key, detectors).alias("where"),
        F.lit(None).cast("string").alias("internal_query"),
        error_class(c("sqlstate")).alias("error_class"),
    ]


def chain(messages: Column, policy: Policy = STRICT, key: Key | None = None, states: Column | None = None, detectors: Chosen | None = None) -> Column:
    """Messages of an error's causes: LINKS of them without key values, quoted values and findings, then only the placeholder.

    states has each link's SQLSTATE; quoted values go where its class quotes values.
    """
    chosen, ph = detectors or pure.DETECTORS, policy.placeholder
    safe = sanitizer(policy, key, chosen)

    def link(text: str | None, state: str | None) -> str | None:
        if text is None:
            return None
        text = re.sub(KEY_VALUES, lambda _: f")=({ph})", text)
        return safe(without_quoted_values(text, ph) if state and state[:2] in QUOTES_VALUES else text)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, kinds in batches:
            out = []
            for own, of in zip(texts.to_pylist(), kinds.to_pylist(), strict=True):
                of = (of or []) + [None] * LINKS
                out.append(None if own is None else [link(t, of[k]) if k < LINKS or t is None else ph for k, t in enumerate(own)])
            yield pa.array(out, pa.list_(pa.string()))

    # A chain none of whose links may hold anything doesn't go to Python.
    due = lambda x: F.coalesce(gate(x, chosen) | x.contains(")=(") | x.contains("'") | (F.length(x) > policy.max_text), F.lit(False))
    kinds = F.lit(None).cast("array<string>") if states is None else states
    plain = F.transform(messages, lambda m, i: F.when((i < LINKS) | m.isNull(), m).otherwise(F.lit(ph)))
    return F.coalesce(run(F.when(F.exists(messages, due), messages), kinds), plain)


def parameter(c: Column, kind: str, policy: Policy = STRICT, key: Key | None = None) -> Column:
    """A bound parameter for a log: text that is one recognised value is masked as such, the rest by type."""
    if kind == "string":
        engine, t, found = Engine(policy, key), trimmed(c), classify(c, policy)
        out = F.lit(policy.placeholder)
        for category in sorted({d.category for d in pure.DETECTORS}):
            if CATEGORIES[category].strategy not in ("AUTO", "SCAN", "PRESERVE_FORMAT"):
                out = F.when(found == category, engine._text(t, Declaration(category))).otherwise(out)
        return F.when(c.isNotNull(), out).otherwise(F.lit("null"))
    if kind == "binary":
        return F.coalesce(F.concat(F.lit("<byte["), F.octet_length(c).cast("string"), F.lit("]>")), F.lit("null"))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.lit(f"<{kind}>"))


class SanitizedError(Exception):
    """A failed read or write of a database, without values in its message."""


def guarded(run, policy: Policy = STRICT):  # noqa: ANN001, ANN201
    """Runs a database read or write; an error comes out with its values replaced and no cause."""
    try:
        return run()
    except Exception as e:  # noqa: BLE001
        text = re.sub(KEY_VALUES, lambda _: f")=({policy.placeholder})", str(e))
        message = pure.sanitize(without_quoted_values(text, policy.placeholder), policy.placeholder, None, policy.max_text)[0]
    raise SanitizedError(message)

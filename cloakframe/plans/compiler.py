"""Schema and policy become column expressions: the masked projection of a DataFrame.

The whole plan is made on the driver from the schema: one expression for each column, a bare
attribute where nothing is to be done. Only text that must be scanned goes to Python, gated, in
helper columns (nested arrays for text within containers) that the projection then takes apart.

Field metadata: "pii" declares (see policy.metadata), "type" names a type for type declarations,
"kind" is one of uri, leaf (an id that isn't text), set, sorted_set, uncapped.

Tokens need a table, not an expression: a text column of its own that is declared TOKENIZE goes
through the engine's vault before the projection. Without a vault, or within a container, the
strategy fails, as does HASH without a key: the value becomes the placeholder, or under THROW the
plan isn't made at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions import maskers, pure
from cloakframe.functions.gates import gate
from cloakframe.functions.keys import Key, pseudonym
from cloakframe.operators.text import checked_uri, sanitizer, text_udf
from cloakframe.plans.policy import PREFIX, STRICT, MaskingFailed, MissingSecret, Overrides, Policy, declared, from_conf
from cloakframe.plans.vocab import Declaration, Drop, Keep
from cloakframe.ship import ship

CustomMasker = Callable[[Column, Declaration], Column]
_TEXT_ONLY = ("AUTO", "SCAN", "PRESERVE_FORMAT")


class Tokens(Protocol):
    """What gives tokens for the values of a column: a vault."""

    def tokenize(self, df: DataFrame, column: str, category: str) -> DataFrame: ...


@dataclass(frozen=True)
class Engine:
    """Everything a plan needs besides the schema."""

    policy: Policy = STRICT
    key: Key | None = None
    overrides: Overrides = field(default_factory=Overrides)
    types: dict[str, Declaration] = field(default_factory=dict)
    maskers: dict[str, CustomMasker] = field(default_factory=dict)
    detectors: tuple[pure.Detector, ...] = ()
    element_wise: bool = False
    vault: Tokens | None = None

    @staticmethod
    def with_defaults() -> Engine:
        """Strict, with a random key: pseudonyms of two sessions can't be compared. For tests."""
        return Engine(key=Key.random())

    def chosen(self) -> tuple[pure.Detector, ...]:
        """The engine's detectors, which replace the built-in ones; without any the built-in ones."""
        return self.detectors or pure.DETECTORS

    def detector(self, d: pure.Detector) -> Engine:
        """With a detector after the others: it gets what none of them claims."""
        return replace(self, detectors=(*self.chosen(), d))

    def detector_first(self, d: pure.Detector) -> Engine:
        """With a detector before the others: it wins ties."""
        return replace(self, detectors=(d, *self.chosen()))

    def install(self) -> Engine:
        """Makes this the engine that installed() gives, for code that gets none handed."""
        _INSTALLED[:] = [self]
        return self

    def value(self, c: Column, d: Declaration | str) -> Column:
        """One text value by its declaration or category, without a change of type."""
        d = (Declaration(d) if isinstance(d, str) else d).normalised()
        return c if not self.policy.applies(d.sensitivity) else self._text(c, d)

    def native(self, d: Declaration) -> bool:
        return d.masker is not None or d.resolved() in self.maskers or d.resolved() not in _TEXT_ONLY

    def _text(self, c: Column, d: Declaration) -> Column:
        """Text by a strategy that needs no Python; the others show the placeholder here."""
        s, ph, pad = d.resolved(), d.replacement or self.policy.placeholder, d.padding
        if d.masker is not None:
            return d.masker(c, d)
        if s in self.maskers:
            return self.maskers[s](c, d)
        if s == "NULLIFY":
            return F.lit(None).cast("string")
        if s == "HASH" and self.key:
            return pseudonym(c, self.key)
        if s == "PARTIAL":
            return maskers.partial(c, d.visible, pad)
        if s == "NAME":
            return maskers.name(c, pad)
        if s == "EMAIL":
            return maskers.email(c, ph, pad)
        if s == "IBAN":
            return maskers.iban(c, ph, d.visible, pad)
        if s == "PAN":
            return maskers.pan(c, ph, pad)
        if s == "PHONE":
            return maskers.phone(c, ph, pad)
        if s == "IP":
            return maskers.ip(c, ph)
        if s == "DATE_GENERALIZE":
            return maskers.year_of_text(c, ph)
        return maskers.redact(c, ph)

    def python(self, d: Declaration | None) -> Callable[[str | None], str | None]:
        """The masker for strategies that need Python; None scans undeclared text."""
        policy, key, detectors = self.policy, self.key, self.chosen()
        ph = (d.replacement if d else "") or policy.placeholder
        if d is None or d.resolved() == "SCAN":
            return sanitizer(replace(policy, placeholder=ph), key, detectors)

        def run(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                if d.resolved() == "PRESERVE_FORMAT":
                    return pure.mask(text, d, ph, key)
                found = pure.classify(text, detectors, policy.max_text)
                return pure.mask(text, Declaration(found, replacement=d.replacement, padding=d.padding), ph, key) if found else ph
            except Exception:  # noqa: BLE001  fails closed: no message or cause may hold the value
                if policy.failure != "THROW":
                    return ph
            raise MaskingFailed("a value could not be masked")

        return run


def from_settings(spark, **parts) -> Engine:  # noqa: ANN001, ANN003
    """The engine that spark.conf names: its policy, and its key from `secret` or `secret-file`.

    Without a secret it's refused (MissingSecret) unless `ephemeral-key` is true, as pseudonyms under a
    random key can't be compared with any others. The key's salt is `salt`. parts are an engine's others.
    """
    get = lambda name: spark.conf.get(PREFIX + name, None)
    secret = get("secret")
    if secret is None and get("secret-file"):
        with open(get("secret-file"), encoding="utf-8") as f:
            secret = f.read().strip()
    if secret is None and (get("ephemeral-key") or "false").lower() != "true":
        raise MissingSecret(f"{PREFIX}secret or {PREFIX}secret-file must be set, or {PREFIX}ephemeral-key to true")
    key = Key.random() if secret is None else Key.of_secret(secret, get("salt").encode()) if get("salt") else Key.of_secret(secret)
    return Engine(from_conf(spark), key, **parts)


_INSTALLED: list[Engine] = []


def installed() -> Engine:
    """The engine installed last in this process; an error if there is none."""
    if not _INSTALLED:
        raise LookupError("no engine is installed")
    return _INSTALLED[0]


def _deep(c: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """f at the elements that stand below depth arrays."""
    return f(c) if not depth else F.transform(c, lambda x: _deep(x, depth - 1, f))


def _any(c: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """Whether f holds for any element below depth arrays."""
    return F.coalesce(f(c), F.lit(False)) if not depth else F.coalesce(F.exists(c, lambda x: _any(x, depth - 1, f)), F.lit(False))


def _count(c: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """How many elements below depth arrays f holds for."""
    if not depth:
        return F.when(f(c), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _count(x, depth - 1, f)), F.lit(0).cast("long"))


def _changed(c: Column, masked: Column, depth: int, policy: Policy) -> Column:
    """How many texts below depth arrays held something; where masked is null a text stayed, and a cut is no finding."""
    if not depth:
        cut = (F.length(c) > policy.max_text) & (masked == F.concat(F.substring(c, 1, policy.max_text), F.lit(policy.placeholder)))
        return F.when((masked != c) & ~cut, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    pairs = F.zip_with(c, masked, lambda a, b: _changed(a, b, depth - 1, policy))
    return F.coalesce(F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long"))


def zero(kind: T.DataType) -> Column:
    """What masking leaves of a value that isn't text: zero for numbers, null for the rest."""
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(None).cast(kind)


@dataclass
class Plan:
    """helpers are computed first; columns then use them."""

    engine: Engine
    helpers: list[Column] = field(default_factory=list)
    signals: list[tuple[str, str]] = field(default_factory=list)  # (path, what the plan decided)
    counters: list[tuple[str, str, Column]] = field(default_factory=list)  # (signal, path, how often in a row)
    tokens: dict[str, str] = field(default_factory=dict)  # column and category of those the vault has done

    def fails(self, d: Declaration, path: str) -> str | None:
        """Why the declared strategy can't be applied here, or null."""
        if d.masker is not None or d.resolved() in self.engine.maskers:
            return None
        if d.resolved() == "TOKENIZE" and path not in self.tokens:
            return "no vault, or not a column of its own" if self.engine.vault else "no vault"
        return "no key" if d.resolved() in ("HASH", "PRESERVE_FORMAT") and self.engine.key is None else None

    def action(self, f: T.StructField, path: str) -> Declaration | Keep | Drop | None:
        """Dropped, kept, declared for the path, in the schema (over its type), by type; else None."""
        o, tag = self.engine.overrides, (f.metadata or {}).get("type")
        if path in o.dropped:
            return Drop()
        own = declared(f.metadata)
        if isinstance(own, (Keep, Drop)):
            return own
        if path in o.by_path:
            return o.by_path[path]
        typed = self.engine.types.get(tag) if tag else None
        if own and typed:
            return own.over(typed)
        return own or typed or o.by_type.get(tag or "") or o.by_type.get(f.dataType.simpleString())

    def text(self, c: Column, d: Declaration | None, get: Column, at: list[Column], path: str) -> Column:
        """Masked text; get leads to it from the row, below as many arrays as at has places."""
        if d is not None and d.resolved() == "TOKENIZE" and path in self.tokens:
            return c
        if d is not None and self.fails(d, path):
            return maskers.redact(c, d.replacement or self.engine.policy.placeholder)
        if d is not None and self.engine.native(d):
            return self.engine._text(c, d)
        cap, name, depth = self.engine.policy.max_text, f"__masked{len(self.helpers)}", len(at)
        scans = d is None or d.resolved() == "SCAN"
        asked = get
        if scans:
            # Only gated texts go to Python, and no array none of whose texts is.
            due = lambda x: gate(x, self.engine.chosen()) | (F.length(x) > cap)
            asked = _deep(get, depth, lambda x: F.when(due(x), x))
            asked = F.when(_any(get, depth, due), asked) if depth else asked
            self.counters.append(("scanned" if d else "unannotated", path, _changed(get, F.col(name), depth, self.engine.policy)))
            self.counters.append(("text_truncated", path, _count(get, depth, lambda x: F.length(x) > cap)))
        self.helpers.append(text_udf(self.engine.python(d), depth)(asked).alias(name))
        out = F.col(name)
        for k in at:
            out = F.get(out, k)
        return F.coalesce(out, c)

    def leaf(self, c: Column, kind: T.DataType, d: Declaration, get: Column, at: list[Column], path: str) -> Column:
        """A declared value, in its own type."""
        d = d.normalised()
        if not self.engine.policy.applies(d.sensitivity):
            return c
        self.signals.append((path, d.resolved()))
        self.counters.append(("masked", path, _count(get, len(at), lambda x: x.isNotNull())))
        if why := self.fails(d, path):
            if self.engine.policy.failure == "THROW":
                raise MaskingFailed(f"{path}: {d.resolved()} can't be applied: {why}")
            self.counters.append(("failed", path, _count(get, len(at), lambda x: x.isNotNull())))
        if isinstance(kind, T.StringType):
            return self.text(c, d, get, at, path)
        if isinstance(kind, T.StructType) and len(kind.fields) == 1 and isinstance(kind.fields[0].dataType, T.StringType):
            only = kind.fields[0].name
            masked = self.text(c[only], d, _deep(get, len(at), lambda x: x[only]), at, path)
            return F.when(c.isNotNull(), F.struct(masked.alias(only)))
        if d.resolved() == "NULLIFY":
            return F.lit(None).cast(kind)
        if d.resolved() == "DATE_GENERALIZE" and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return maskers.year_of_date(c, kind.simpleString())
        if isinstance(kind, T.ArrayType) and self.engine.element_wise and isinstance(kind.elementType, T.StringType) and self.engine.native(d):
            return F.transform(c, lambda x: self.engine._text(x, d))
        return F.when(c.isNotNull(), zero(kind))

    def member(self, c: Column, f: T.StructField, get: Column, at: list[Column], path: str, depth: int) -> Column | None:
        """A field's expression; None if it's dropped."""
        act = self.action(f, path)
        if isinstance(act, Drop):
            return None
        if isinstance(act, Keep):
            return c
        if act is not None:
            return self.leaf(c, f.dataType, act, get, at, path)
        return self.descend(c, f.dataType, get, at, path, depth, (f.metadata or {}).get("kind"))

    def touched(self, kind: T.DataType, path: str, hint: str | None) -> bool:
        """Whether anything below can change, so that what can't stays a bare attribute."""
        scans = self.engine.policy.scan_text
        if isinstance(kind, T.StringType):
            return scans and hint != "leaf"
        if isinstance(kind, T.ArrayType):
            return True
        if isinstance(kind, T.MapType):
            return True
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                act = self.action(f, f"{path}.{f.name}")
                if isinstance(act, (Declaration, Drop)) or (act is None and self.touched(f.dataType, f"{path}.{f.name}", (f.metadata or {}).get("kind"))):
                    return True
        return False

    def descend(self, c: Column, kind: T.DataType, get: Column, at: list[Column], path: str, depth: int, hint: str | None = None) -> Column:
        """An undeclared value: its text is scanned, and so are its parts."""
        policy = self.engine.policy
        if depth > policy.max_depth:
            self.signals.append((path, "DEPTH"))
            self.counters.append(("depth_exceeded", path, _count(get, len(at), lambda x: x.isNotNull())))
            return F.lit(None).cast(kind)
        if not self.touched(kind, path, hint):
            return c
        if isinstance(kind, T.StringType):
            masked = self.text(c, None, get, at, path)
            return checked_uri(c, masked) if hint == "uri" else masked
        if isinstance(kind, T.StructType):
            parts = []
            for f in kind.fields:
                inner = self.member(c[f.name], f, _deep(get, len(at), lambda x, n=f.name: x[n]), at, f"{path}.{f.name}", depth + 1)
                parts.append((F.lit(None).cast(f.dataType) if inner is None else inner).alias(f.name))
            return F.when(c.isNotNull(), F.struct(*parts))
        cap = policy.max_elements
        if isinstance(kind, T.ArrayType):
            cut = (lambda x: x) if hint == "uncapped" else (lambda x: F.slice(x, 1, cap))
            if hint != "uncapped":
                self.counters.append(("collection_truncated", path, _count(get, len(at), lambda x: F.size(x) > cap)))
            inner = F.transform(cut(c), lambda x, i: self.descend(x, kind.elementType, _deep(get, len(at), cut), [*at, i], f"{path}[]", depth + 1))
            return F.array_distinct(inner) if hint == "set" else F.array_sort(inner) if hint == "sorted_set" else inner
        if isinstance(kind, T.MapType):
            entries = lambda m: F.slice(F.map_entries(m), 1, cap)
            self.counters.append(("collection_truncated", path, _count(get, len(at), lambda x: F.size(x) > cap)))

            def entry(e: Column, i: Column) -> Column:
                part = lambda name: _deep(get, len(at), lambda m: F.transform(entries(m), lambda x: x[name]))
                k = self.descend(e["key"], kind.keyType, part("key"), [*at, i], f"{path}{{key}}", depth + 1) if policy.mask_keys else e["key"]
                v = self.descend(e["value"], kind.valueType, part("value"), [*at, i], f"{path}{{}}", depth + 1)
                return F.struct(k.alias("key"), v.alias("value"))

            return last_wins(F.transform(entries(c), entry))
        return c


def last_wins(entries: Column) -> Column:
    """A map of the entries. Masked keys may collide; the last one's value stays."""
    keys = F.array_distinct(entries["key"])
    value = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    once = F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value")))
    return F.map_from_entries(F.when(F.size(keys) == F.size(entries), entries).otherwise(once))


def mask(df: DataFrame, engine: Engine, drop: bool = False, seen: Observation | None = None) -> DataFrame:
    """df with the same columns and types, masked. A dropped column is null, or with drop goes.

    seen observes the run: the rows, and each signal by path, as `signal|path` (see operators.observe).
    """
    if engine.policy.failure == "PASS_THROUGH":
        raise ValueError("a policy that passes values through on failure isn't run")
    ship(df.sparkSession)
    plan, columns = Plan(engine), []
    rows = df
    for f in df.schema.fields:
        act = plan.action(f, f.name)
        if engine.vault and isinstance(act, Declaration) and isinstance(f.dataType, T.StringType) and (d := act.normalised()).resolved() == "TOKENIZE" and engine.policy.applies(d.sensitivity):
            plan.tokens[f.name] = d.category
            rows = engine.vault.tokenize(rows, f.name, d.category)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out = plan.member(c, f, c, [], f.name, 1)
        if out is None and drop:
            continue
        columns.append((F.lit(None).cast(f.dataType) if out is None else out).alias(f.name))
    source = rows.select("*", *plan.helpers) if plan.helpers else rows
    if seen is not None:
        sums = [F.sum(c).alias(f"{signal}|{path}") for (signal, path), c in _by_name(plan.counters).items()]
        source = source.observe(seen, F.count(F.lit(1)).alias("rows"), *sums)
    return source.select(*columns)


def _by_name(counters: list[tuple[str, str, Column]]) -> dict[tuple[str, str], Column]:
    """Counters of one signal and path as one."""
    out: dict[tuple[str, str], Column] = {}
    for signal, path, c in counters:
        out[signal, path] = out[signal, path] + c if (signal, path) in out else c
    return out


def serialise(df: DataFrame, engine: Engine, column: str = "json") -> DataFrame:
    """Each row as JSON: declared values as masked text whatever their type, dropped ones left out."""
    plan, text = Plan(engine), []
    for f in df.schema.fields:
        act = plan.action(f, f.name)
        plain = isinstance(act, Declaration) and not isinstance(f.dataType, (T.StringType, T.StructType, T.ArrayType, T.MapType))
        text.append(F.col(f"`{f.name}`").cast("string").alias(f.name, metadata=f.metadata) if plain else F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata))
    masked = mask(df.select(*text), engine, drop=True)
    return masked.select(F.to_json(F.struct(*[f"`{c}`" for c in masked.columns]), {"ignoreNullFields": "false"}).alias(column))

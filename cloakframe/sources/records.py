"""Message records: value, key and headers of a Kafka-like stream or batch.

Columns are those of Spark's Kafka source (key, value, headers, topic and so on); value and key are
binary or text. The same plan serves both directions and batch and streaming.

A value is text, JSON whose strings are scanned, or JSON of a schema with declarations. In the last
case declared properties are masked as declared, all others are scanned and stay, explicit nulls and
untouched numbers too. A value that can't be masked (bytes that aren't text, or not an object of that
schema) is withheld: the record doesn't go on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions import pure
from cloakframe.functions.gates import gate
from cloakframe.operators.text import mask_text, text_udf
from cloakframe.plans.compiler import Engine, installed, mask
from cloakframe.plans.policy import PREFIX
from cloakframe.ship import ship
from cloakframe.sources.jsonio import mask_json, masks_names

FORMATS = ("text", "json")


@dataclass(frozen=True)
class Settings:
    """mask.keys, headers.redact, key.format and value.format, as in a connector's options."""

    mask_keys: bool = False
    redact_headers: tuple[str, ...] = ()
    key_format: str = "text"
    value_format: str = "text"

    def __post_init__(self) -> None:
        if self.key_format not in FORMATS or self.value_format not in FORMATS:
            raise ValueError(f"a format is one of {', '.join(FORMATS)}")

    @staticmethod
    def from_conf(spark) -> Settings:  # noqa: ANN001
        """The settings that stand in spark.conf below records."""
        names = ("mask.keys", "headers.redact", "key.format", "value.format")
        return Settings.of({n: v for n in names if (v := spark.conf.get(f"{PREFIX}records.{n}", None)) is not None})

    @staticmethod
    def of(options: dict[str, str]) -> Settings:
        names = tuple(n.strip().lower() for n in options.get("headers.redact", "").split(",") if n.strip())
        form = lambda k: options.get(k, "text").strip().lower()
        return Settings(options.get("mask.keys", "false").strip().lower() == "true", names, form("key.format"), form("value.format"))


class _Number(str):
    """A number as it's written."""


def _loads(text: str):  # noqa: ANN202
    return json.loads(text, parse_float=_Number, parse_int=_Number)


def _dumps(x) -> str:  # noqa: ANN001
    if isinstance(x, _Number):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dumps(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_dumps, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def _merged(x, masked, kind: T.DataType, scan: Callable, dropped: tuple = ()):  # noqa: ANN001, ANN202
    """What was sent, with the properties that the schema knows as they were masked, and the others scanned."""
    if x is None:
        return None
    if isinstance(kind, T.StructType) and isinstance(x, dict) and isinstance(masked, dict):
        known = {f.name: f.dataType for f in kind.fields}
        return {(k if k in known else scan(k, True)): _merged(v, masked.get(k), known[k], scan) if k in known else scan(v, False) for k, v in x.items()}
    if isinstance(kind, T.ArrayType) and isinstance(x, list) and isinstance(masked, list):
        return [_merged(a, b, kind.elementType, scan) for a, b in zip(x, masked, strict=False)]
    if isinstance(x, _Number) and isinstance(masked, _Number) and float(x) == float(masked):
        return x
    return masked


def _merger(schema: T.StructType, engine: Engine):  # noqa: ANN202
    """A function of the original and the masked JSON; null where they can't be brought together."""
    policy, key, detectors = engine.policy, engine.key, engine.chosen()
    names = masks_names(policy)

    def safe(t: str) -> str:
        return pure.sanitize(t, policy.placeholder, key, policy.max_text, detectors)[0]

    def scan(x, name: bool):  # noqa: ANN001, ANN202
        if name:
            return safe(x) if names else x
        if isinstance(x, _Number) or not isinstance(x, (str, list, dict)):
            return x
        if isinstance(x, str):
            return safe(x) if policy.scan_text else x
        return [scan(y, False) for y in x] if isinstance(x, list) else {scan(k, True): scan(v, False) for k, v in x.items()}

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, masked in batches:
            out = []
            for text, done in zip(texts.to_pylist(), masked.to_pylist(), strict=True):
                try:
                    x = None if text is None or done is None else _loads(text)
                    out.append(_dumps(_merged(x, _loads(done), schema, scan)) if isinstance(x, dict) else None)
                except Exception:  # noqa: BLE001  withheld
                    out.append(None)
            yield pa.array(out, pa.string())

    return run


def _masked(df: DataFrame, column: str, schema: T.StructType | None, form: str, engine: Engine, failed: str) -> DataFrame:
    """The column masked in its own type, and whether a value that was there could not be."""
    kind = df.schema[column].dataType
    binary = isinstance(kind, T.BinaryType)
    raw = F.try_validate_utf8(F.col(column).cast("string")) if binary else F.col(column)
    if schema is None:
        masked = (mask_json if form == "json" else mask_text)(raw, engine.policy, engine.key, engine.detectors or None)
        return df.withColumn(failed, F.col(failed) | (F.col(column).isNotNull() & raw.isNull())).withColumn(column, masked.cast(kind))
    keep = {"pii": {"keep_as_is": "not part of the message"}}
    parsed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__rest", metadata=keep),
        raw.alias("__raw", metadata=keep),
        F.from_json(raw, T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "__corrupt"}).alias("__parsed", metadata=keep),
    )
    # from_json gives a struct that has lost the schema's metadata: it's put back for the plan.
    typed = parsed.select("__rest", "__raw", F.col("__parsed.__corrupt").isNotNull().alias("__bad", metadata=keep), *[F.col(f"__parsed.`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.fields])
    typed = typed.select(*[F.col(c).alias(c, metadata=keep) for c in ("__rest", "__raw", "__bad")], *[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.fields])
    done = mask(typed, engine)
    text = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]), {"ignoreNullFields": "false"})
    whole = _merger(schema, engine)(F.when(~F.col("__bad"), F.col("__raw")), F.when(~F.col("__bad"), text))
    out = done.select("__rest", whole.cast(kind).alias("__value"))
    rest = [F.col(f"__rest.`{c}`").alias(c) for c in df.columns if c not in (column, failed)]
    lost = F.col(f"__rest.`{failed}`") | (F.col(f"__rest.`{column}`").isNotNull() & F.col("__value").isNull())
    return out.select(*rest, lost.alias(failed), F.col("__value").alias(column))


def mask_headers(c: Column, settings: Settings, engine: Engine) -> Column:
    """Headers by name become the placeholder; what isn't UTF-8 stays."""
    named = F.array(*[F.lit(n) for n in settings.redact_headers]).cast("array<string>")
    ph = F.lit(engine.policy.placeholder).cast("binary")
    return F.transform(c, lambda h: F.struct(h["key"].alias("key"), F.when(F.array_contains(named, F.lower(h["key"])), F.when(h["value"].isNotNull(), ph)).otherwise(h["value"]).alias("value")))


def mask_records(df: DataFrame, engine: Engine | None = None, settings: Settings = Settings(), value_schema: T.StructType | None = None, key_schema: T.StructType | None = None, failed: str | None = None) -> DataFrame:
    """Records with masked values, keys if asked for, and headers; a null value (tombstone) stays null.

    Records whose value or key can't be masked are withheld. With the name of a column in failed they
    stay, without that value, and the column tells them; under THROW they fail the job.
    """
    engine = engine or installed()
    ship(df.sparkSession)
    mark = failed or "__failed"
    out = _masked(df.withColumn(mark, F.lit(False)), "value", value_schema, settings.value_format, engine, mark)
    if settings.mask_keys and "key" in df.columns:
        out = _masked(out, "key", key_schema, settings.key_format, engine, mark)
    if "headers" in df.columns:
        out = _masked_headers(out, settings, engine)
    if engine.policy.failure == "THROW":
        out = out.withColumn(mark, F.when(F.col(mark), F.raise_error("a record could not be masked").cast("boolean")).otherwise(F.lit(False)))
    if failed:
        return out.select(*df.columns, failed)
    return out.filter(~F.col(mark)).select(*df.columns)


def _masked_headers(df: DataFrame, settings: Settings, engine: Engine) -> DataFrame:
    """Header values that are UTF-8 text are scanned too: those that the gate lets through, as one array."""
    named, policy = mask_headers(F.col("headers"), settings, engine), engine.policy
    due = lambda x: F.coalesce(gate(x, engine.chosen()) | (F.length(x) > policy.max_text), F.lit(False))
    texts = F.transform(named, lambda h: F.try_validate_utf8(h["value"].cast("string")))
    asked = F.when(F.exists(texts, due), F.transform(texts, lambda x: F.when(due(x), x)))
    staged = df.withColumn("__named", named).withColumn("__texts", text_udf(engine.python(None), 1)(asked))
    scanned = F.transform("__named", lambda h, i: F.struct(h["key"].alias("key"), F.coalesce(F.get("__texts", i).cast("binary"), h["value"]).alias("value")))
    return staged.withColumn("headers", F.when(F.col("headers").isNotNull(), scanned)).drop("__named", "__texts")


def split_failures(df: DataFrame, failed: str = "failed", column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records that go on, records withheld, without their value) of masked records with that mark."""
    return df.filter(~F.col(failed)).drop(failed), df.filter(F.col(failed)).drop(failed, column)

"""Log events: message template and arguments, context, key values, and the chain of exceptions.

Columns: template string, args array<string>, mdc map<string,string>, kv array<struct<key,value>>,
thrown array<struct<class_name,message,stack>>, markers array<struct<name,payload>>; others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cloakframe.functions import pure
from cloakframe.plans.compiler import Engine, mask
from cloakframe.plans.policy import metadata
from cloakframe.plans.vocab import Keep

WITHHELD = "[message withheld]"


def fill(template: str, args: list[str | None]) -> str:
    """The template's {} filled in order; \\{} stays; what is left over of the arguments is dropped."""
    out, at, k = [], 0, 0
    while k < len(args):
        hole = template.find("{}", at)
        if hole < 0:
            break
        if hole and template[hole - 1] == "\\" and not (hole > 1 and template[hole - 2] == "\\"):
            out.append(template[at : hole - 1] + "{}")
        else:
            out.append(template[at:hole] + ("null" if args[k] is None else args[k]))
            k += 1
        at = hole + 2
    return "".join(out) + template[at:]


def formatted(template: Column, args: Column, engine: Engine) -> Column:
    """The message as it's written: masked template, masked arguments, and the whole scanned again,
    as a value may come about only where both meet."""
    policy, key, detectors = engine.policy, engine.key, engine.chosen()

    @F.pandas_udf(StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def safe(text: str | None) -> str | None:
            return pure.sanitize(text, policy.placeholder, key, policy.max_text, detectors)[0]

        def one(t: str | None, a) -> str | None:  # noqa: ANN001
            if t is None:
                return None
            try:
                return safe(fill(safe(t), [safe(x) for x in (a if a is not None else [])]))
            except Exception:  # noqa: BLE001  fails closed
                return WITHHELD

        for templates, arguments in batches:
            yield pd.Series([one(t, a) for t, a in zip(templates, arguments, strict=True)])

    return run(template, args)


#: Columns that hold text of the application; all others stay as they are.
TEXT = ("template", "args", "mdc", "kv", "thrown", "markers")


def mask_events(df: DataFrame, engine: Engine) -> DataFrame:
    """Events with every text masked and the message filled in; names of classes and markers stay."""
    keep = metadata(Keep("not text of the application"))
    stay = [c for c in df.columns if c not in TEXT]
    typed = df
    for c in stay:
        typed = typed.withColumn(c, F.col(f"`{c}`").alias(c, metadata=keep))
    message = formatted(F.col("template"), F.col("args"), engine).alias("message", metadata=keep)
    named = typed.select("*", message)
    parts = named
    if "thrown" in df.columns:
        parts = parts.withColumn("__classes", F.col("thrown.class_name").alias("__classes", metadata=keep))
    if "markers" in df.columns:
        parts = parts.withColumn("__names", F.col("markers.name").alias("__names", metadata=keep))
    out = mask(parts, engine)
    if "thrown" in df.columns:
        out = out.withColumn("thrown", F.transform("thrown", lambda t, i: t.withField("class_name", F.get("__classes", i)))).drop("__classes")
    if "markers" in df.columns:
        out = out.withColumn("markers", F.transform("markers", lambda m, i: m.withField("name", F.get("__names", i)))).drop("__names")
    return out

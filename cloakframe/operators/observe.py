"""Signals of a run: counters that ride along with it, and what was found as a relation.

A masked DataFrame can be observed: `mask(df, engine, seen=Observation())`. Its counters are named
`signal|path`, besides `rows`:

* masked: declared values; scanned: texts declared for scanning that held something
* unannotated: undeclared texts that held something, the one to alert on
* failed: values whose strategy can't be applied there, as TOKENIZE without a vault
* depth_exceeded, collection_truncated, text_truncated: values that met a limit
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cloakframe.operators.text import scan
from cloakframe.plans.compiler import Engine, Plan, mask

SIGNALS = ("masked", "scanned", "unannotated", "failed", "depth_exceeded", "collection_truncated", "text_truncated")
#: Gets a signal, a path, and how often.
Sink = Callable[[str, str, int], None]
LOG = logging.getLogger(__name__)


def observed(df: DataFrame, engine: Engine, name: str = "masking") -> tuple[DataFrame, Observation]:
    """df masked, and the observation that has its counters once it has run."""
    seen = Observation(name)
    return mask(df, engine, seen=seen), seen


def counters(seen: Observation) -> list[tuple[str, str, int]]:
    """(signal, path, how often) of a run, without those that never happened. Waits for the run."""
    return [(*k.split("|", 1), n) for k, n in sorted(seen.get.items()) if "|" in k and n]


def report(seen: Observation, *sinks: Sink) -> None:
    """Gives a run's counters to all sinks. One that fails is logged and keeps none of the others from them."""
    for signal, path, n in counters(seen):
        for sink in sinks:
            try:
                sink(signal, path, n)
            except Exception:  # noqa: BLE001
                LOG.exception("a sink failed on %s at %s", signal, path)


def decided(df: DataFrame, engine: Engine) -> list[tuple[str, str]]:
    """What the plan does by path: the strategy of each declared column, and DEPTH where it stops."""
    plan = Plan(engine)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        plan.member(c, f, c, [], f.name, 1)
    return plan.signals


def findings_by(df: DataFrame, column: str, *by: str) -> DataFrame:
    """How many findings of each category a column has, by other columns."""
    return scan(df, column, list(by)).groupBy(*by, "category").agg(F.count("*").alias("findings"))

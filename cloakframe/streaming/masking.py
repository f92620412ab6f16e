"""Masked streams: the batch plan on readStream, withheld records to a side sink, tokens with a TTL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloakframe.plans.compiler import Engine
from cloakframe.sources.logs import mask_events
from cloakframe.sources.records import Settings, mask_records, split_failures


def mask_stream(stream: DataFrame, engine: Engine | None = None, settings: Settings = Settings(), value_schema: T.StructType | None = None) -> DataFrame:
    """Masked records of a stream; their place in it stays, and those that can't be masked are withheld."""
    return mask_records(stream, engine, settings, value_schema)


def _put(df: DataFrame, number: int, path: str) -> None:
    """Writes a batch below its number: a batch that runs again replaces what it wrote."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def write_masked(stream: DataFrame, engine: Engine, sink: str, withheld: str, checkpoint: str, settings: Settings = Settings(), value_schema: T.StructType | None = None, **options: str):  # noqa: ANN201
    """Starts a query that writes masked records, and what couldn't be masked (without the value) aside.

    Each batch is masked once, and lies below its number in both places.
    """

    def batch(df: DataFrame, number: int) -> None:
        marked = mask_records(df, engine, settings, value_schema, failed="failed").persist()
        try:
            good, bad = split_failures(marked)
            _put(good, number, sink)
            _put(bad, number, withheld)
        finally:
            marked.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def write_events(stream: DataFrame, engine: Engine, sink: str, checkpoint: str, **options: str):  # noqa: ANN201
    """Starts a query that writes masked log events: what an appender between a logger and its file does."""

    def batch(df: DataFrame, number: int) -> None:
        _put(mask_events(df, engine), number, sink)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def tokens_with_ttl(stream: DataFrame, value: str, category: str, ttl_seconds: int = 900) -> DataFrame:
    """(value, token) once for each new value of a stream; a token is drawn anew when its time is over.

    State is one token for each live value, and goes when it expires.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import base64
        import os

        for _ in batches:
            pass
        if state.hasTimedOut:
            state.remove()
            return
        if not state.exists:
            state.update((f"tok_{category.lower()}_{base64.urlsafe_b64encode(os.urandom(12)).decode().rstrip('=')}",))
            state.setTimeoutDuration(ttl_seconds * 1000)
            yield pd.DataFrame({"value": [key[0]], "token": [state.get[0]]})

    rows = stream.filter(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("value"))
    return rows.groupBy("value").applyInPandasWithState(run, "value string, token string", "token string", "append", GroupStateTimeout.ProcessingTimeTimeout)

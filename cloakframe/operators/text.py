"""Text operators: masked text, findings, and classification of whole values.

Native gates, one for each detector, decide which texts go to Python at all, and which detectors
look at them there; other texts come back as they are. Equal texts of a batch are masked once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from cloakframe.functions import pure
from cloakframe.functions.gates import bits, category, gate
from cloakframe.functions.keys import Key
from cloakframe.plans.policy import STRICT, MaskingFailed, Policy

FINDING = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("category", StringType()), StructField("detector", StringType()), StructField("confident", BooleanType())])
_FINDING = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("detector", pa.string()), ("confident", pa.bool_())]))
Chosen = tuple[pure.Detector, ...]


def _mapped(texts: pa.Array, run: Callable[[str], str | None]) -> pa.Array:
    """run over the distinct texts of an array, or of arrays in it; null stays null."""
    if pa.types.is_list(texts.type) or pa.types.is_large_list(texts.type):
        sizes = pc.fill_null(pc.list_value_length(texts), 0)
        ends = pc.cumulative_sum(sizes).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, _mapped(texts.flatten(), run), mask=texts.is_null())
    coded = texts.dictionary_encode()
    return pa.array([run(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def text_udf(run: Callable[[str], str | None], depth: int = 0):  # noqa: ANN201
    """run as a function of a text column, or of text that stands below depth arrays."""
    kind: DataType = StringType()
    for _ in range(depth):
        kind = ArrayType(kind)

    @F.arrow_udf(kind)
    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _mapped(texts, run)

    return mapped


def sanitizer(policy: Policy, key: Key | None, detectors: Chosen) -> Callable[[str], str | None]:
    """A text's masking in Python. What fails shows the placeholder, or raises without the value."""

    def run(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return pure.sanitize(text, policy.placeholder, key, policy.max_text, detectors)[0]
        except Exception:  # noqa: BLE001  fails closed: no message or cause may hold the value
            if policy.failure != "THROW":
                return policy.placeholder
        raise MaskingFailed("a text could not be masked")

    return run


def mask_text(c: Column, policy: Policy = STRICT, key: Key | None = None, detectors: Chosen | None = None) -> Column:
    """The text with detected spans masked. Only gated texts, no longer than needed, reach Python."""
    cap, chosen = policy.max_text, detectors or pure.DETECTORS

    @F.arrow_udf(StringType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        runs: dict[int, Callable[[str], str | None]] = {}
        for texts, which in batches:
            out = []
            for text, mask in zip(texts.to_pylist(), which.to_pylist(), strict=True):
                if text is not None and mask not in runs:
                    runs[mask] = sanitizer(policy, key, tuple(d for k, d in enumerate(chosen) if mask >> k & 1))
                out.append(None if text is None else runs[mask](text))
            yield pa.array(out, pa.string())

    found = bits(c, chosen)
    ask = (found != 0) | (F.length(c) > cap)
    return F.coalesce(run(F.when(ask, F.substring(c, 1, cap + pure.MARGIN + 1)), found), c)


def findings(c: Column, detectors: Chosen | None = None) -> Column:
    """The text's findings as an array; whole texts are read."""
    chosen = detectors or pure.DETECTORS

    @F.arrow_udf(ArrayType(FINDING))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = FINDING.fieldNames()
        for texts, which in batches:
            out = []
            for text, mask in zip(texts.to_pylist(), which.to_pylist(), strict=True):
                own = tuple(d for k, d in enumerate(chosen) if mask is not None and mask >> k & 1)
                out.append([dict(zip(names, f, strict=True)) for f in pure.scan(text, own)])
            yield pa.array(out, _FINDING)

    return F.coalesce(run(F.when(gate(c, chosen), c), bits(c, chosen)), F.array().cast(ArrayType(FINDING)))


def named(*names: str) -> Chosen:
    """The built-in detectors of these names, in their order; without names all of them."""
    return tuple(d for d in pure.DETECTORS if not names or d.name in names)


def scan(df: DataFrame, column: str, keep: list[str], detectors: Chosen | None = None, apart: bool = False) -> DataFrame:
    """A row for each finding in the column: keep, then start, end, category, detector, confident, value.

    Findings are those of the detectors given alone: where one of another would take precedence over
    an overlapping one, it must be among them. With apart each detector's stand by themselves, and those
    of two may overlap.
    """
    chosen = detectors or pure.DETECTORS
    found = F.concat(*[findings(F.col(column), (d,)) for d in chosen]) if apart else findings(F.col(column), chosen)
    rows = df.filter(gate(F.col(column), chosen)).select(*keep, F.col(column).alias("__text"), F.explode(found).alias("__finding"))
    value = F.substring("__text", F.col("__finding.start") + 1, F.col("__finding.end") - F.col("__finding.start"))
    return rows.select(*keep, "__finding.*", value.alias("value"))


def classify(c: Column, policy: Policy = STRICT) -> Column:
    """The category that the whole trimmed value is, or null."""
    return category(c, policy.max_text)


def preserve_format(c: Column, key: Key) -> Column:
    """Other characters of the same kinds, the same for equal values."""
    return text_udf(lambda t: None if t is None else pure.preserve_format(t, key))(c)


#: What a URI looks like: a scheme, a colon, no blanks or brackets.
URI = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]*$"


def checked_uri(c: Column, masked: Column) -> Column:
    """A masked URI; null if what came out isn't a URI any more."""
    return F.when(masked.rlike(URI) | (masked == c), masked)


def mask_uri(c: Column, policy: Policy = STRICT, key: Key | None = None, detectors: Chosen | None = None) -> Column:
    """A URI scanned as text; null if what comes out isn't a URI any more."""
    return checked_uri(c, mask_text(c, policy, key, detectors))


def exposure(found: DataFrame, *by: str) -> DataFrame:
    """Numbers of findings by category and detector, with subtotals, over the columns given."""
    return found.rollup(*by, "category", "detector").agg(F.count("*").alias("findings"), F.count_if(~F.col("confident")).alias("fragments"))

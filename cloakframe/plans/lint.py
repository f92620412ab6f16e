"""Checks of a schema and its policy before a job runs."""

from __future__ import annotations

import inspect
from dataclasses import dataclass

from pyspark.sql import types as T

from cloakframe.plans.policy import Overrides, declared
from cloakframe.plans.vocab import NEVER_REVEAL, Declaration, Keep

ERROR, WARNING = "error", "warning"
#: Words that don't justify anything.
EMPTY_WORDS = {"todo", "tbd", "fixme", "n/a", "na", "none", "xxx", "-", "?", "."}


@dataclass(frozen=True)
class Problem:
    severity: str
    path: str
    check: str
    message: str


def _fields(schema: T.StructType, path: str = ""):  # noqa: ANN202
    for f in schema.fields:
        own = f"{path}{f.name}"
        yield own, f
        kind = f.dataType
        while isinstance(kind, (T.ArrayType, T.MapType)):
            own += "[]" if isinstance(kind, T.ArrayType) else "{}"
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(kind, T.StructType):
            yield from _fields(kind, f"{own}.")


def lint(schema: T.StructType, overrides: Overrides = Overrides(), strict: bool = True, element_wise: bool = False) -> list[Problem]:
    """Problems of declarations in the schema's metadata and in the overrides, errors first."""
    found: list[Problem] = []
    fields = dict(_fields(schema))
    severe = ERROR if strict else WARNING

    def check(path: str, d: Declaration, kind: T.DataType) -> None:
        if d.keep > 0 and d.category in NEVER_REVEAL:
            found.append(Problem(WARNING, path, "partial-reveal", f"no part of {d.category} is ever shown; keep has no effect"))
        if d.masker is not None:
            try:
                inspect.signature(d.masker).bind(None, d)
            except (TypeError, ValueError):
                found.append(Problem(severe, path, "custom-masker", "the masker can't be called with a column and a declaration"))
        single = isinstance(kind, T.StructType) and len(kind.fields) == 1 and isinstance(kind.fields[0].dataType, T.StringType)
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) and not single and not element_wise:
            found.append(Problem(severe, path, "rebuildable", "a declared container becomes null as a whole; declare its parts"))

    for path, f in fields.items():
        own = declared(f.metadata)
        pii = (f.metadata or {}).get("pii") or {}
        if "keep_as_is" in pii:
            why = (pii["keep_as_is"] or "").strip()
            if not why:
                found.append(Problem(severe, path, "justification", "a column that stays needs a reason"))
            elif why.lower() in EMPTY_WORDS:
                found.append(Problem(WARNING, path, "justification", "the reason is a placeholder"))
            if "category" in pii or path in overrides.by_path:
                found.append(Problem(severe, path, "contradiction", "declared both to be masked and to stay"))
        if isinstance(own, Declaration) and not isinstance(own, Keep):
            check(path, own, f.dataType)
    for path, d in overrides.by_path.items():
        if path not in fields:
            found.append(Problem(WARNING, path, "ineffective", "there is no such column"))
        else:
            check(path, d, fields[path].dataType)
    found += [Problem(WARNING, path, "ineffective", "there is no such column") for path in overrides.dropped if path not in fields]
    return sorted(found, key=lambda p: (p.severity != ERROR, p.path, p.check))

"""The masking policy, overrides, and their settings in spark.conf."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from cloakframe.plans.vocab import HIGH, LOW, SENSITIVITIES, Declaration, Drop, Keep

PREFIX = "spark.cloakframe."


@dataclass(frozen=True)
class Policy:
    threshold: int = LOW
    failure: str = "REDACT"
    placeholder: str = "****"
    max_depth: int = 32
    max_elements: int = 1000
    max_text: int = 8192
    scan_text: bool = True
    mask_keys: bool = True

    def __post_init__(self) -> None:
        if min(self.max_depth, self.max_elements, self.max_text) < 1:
            raise ValueError("the limits must be 1 or more")
        if self.failure not in ("REDACT", "THROW", "PASS_THROUGH"):
            raise ValueError(f"unknown failure mode {self.failure}")

    def applies(self, sensitivity: int) -> bool:
        return sensitivity >= self.threshold


STRICT = Policy()
RELAXED = Policy(threshold=HIGH, scan_text=False, mask_keys=False)


@dataclass(frozen=True)
class Overrides:
    """Declarations by dotted column path and by type tag; they come before those in the schema."""

    by_path: dict[str, Declaration] = field(default_factory=dict)
    by_type: dict[str, Declaration] = field(default_factory=dict)
    dropped: frozenset[str] = frozenset()


class MissingSecret(ValueError):
    """No secret was given and an ephemeral key wasn't asked for."""


class MaskingFailed(RuntimeError):
    """A value could not be masked, and the policy's failure mode is THROW. No message holds a value."""


def from_conf(spark) -> Policy:  # noqa: ANN001
    """The policy that spark.conf names: a preset, and settings that replace single fields of it."""
    get = lambda name: spark.conf.get(PREFIX + name, None)
    policy = {"strict": STRICT, "relaxed": RELAXED}[(get("preset") or "strict").lower()]
    kinds = {
        "threshold": ("threshold", lambda v: SENSITIVITIES.index(v.upper())),
        "failure-mode": ("failure", str.upper),
        "placeholder": ("placeholder", str),
        "max-depth": ("max_depth", int),
        "max-collection-elements": ("max_elements", int),
        "max-text-length": ("max_text", int),
        "scan-unannotated-text": ("scan_text", lambda v: v.lower() == "true"),
        "mask-map-keys": ("mask_keys", lambda v: v.lower() == "true"),
    }
    return replace(policy, **{name: read(v) for key, (name, read) in kinds.items() if (v := get(key)) is not None})


def metadata(declaration: Declaration | Keep | Drop) -> dict:
    """Column metadata that carries a declaration in the schema."""
    if isinstance(declaration, Keep):
        return {"pii": {"keep_as_is": declaration.justification}}
    if isinstance(declaration, Drop):
        return {"pii": {"drop": True}}
    return {"pii": {n: getattr(declaration, n) for n in declaration.__dataclass_fields__ if n != "masker"}}


def declared(meta: dict | None) -> Declaration | Keep | Drop | None:
    """The declaration in a field's metadata."""
    found = (meta or {}).get("pii")
    if found is None:
        return None
    if "keep_as_is" in found:
        return Keep(found["keep_as_is"])
    return Drop() if found.get("drop") else Declaration(**found)

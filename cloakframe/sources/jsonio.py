"""JSON text: every string at any depth is scanned, and property names if asked for.

Only the strings of a text that holds a finding are written anew; numbers, blanks, repeated
properties and everything else stay as they stand.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions import pure
from cloakframe.functions.gates import gate
from cloakframe.functions.keys import Key
from cloakframe.operators.text import Chosen, text_udf
from cloakframe.plans.policy import STRICT, MaskingFailed, Policy

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?', re.DOTALL)


def masks_names(policy: Policy) -> bool:
    """Property names are scanned where map keys are masked or undeclared text is scanned."""
    return policy.mask_keys or policy.scan_text


def masked_strings(text: str, names: bool, f: Callable[[str], str]) -> str:
    """The JSON text with f applied to its strings. ValueError if it isn't JSON."""
    json.loads(text)

    def one(m: re.Match) -> str:
        name = m[1] or ""
        if name and not names:
            return m[0]
        raw = m[0][: len(m[0]) - len(name)]
        value = json.loads(raw, strict=False)
        new = f(value)
        return m[0] if new == value else json.dumps(new, ensure_ascii=False) + name

    return _STRING.sub(one, text)


def masker(policy: Policy, key: Key | None, detectors: Chosen) -> Callable[[str], str]:
    """Masks a JSON text; what isn't JSON, or can't be masked, shows the placeholder or raises without the value."""
    names = masks_names(policy)

    def run(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return masked_strings(text, names, lambda t: pure.sanitize(t, policy.placeholder, key, policy.max_text, detectors)[0])
        except Exception:  # noqa: BLE001  fails closed: no message or cause may hold the value
            if policy.failure != "THROW":
                return json.dumps(policy.placeholder)
        raise MaskingFailed("a JSON text could not be masked")

    return run


def mask_json(c: Column, policy: Policy = STRICT, key: Key | None = None, detectors: Chosen | None = None) -> Column:
    """JSON text with its strings masked; text that isn't JSON, or can't be masked, shows the placeholder."""
    chosen = detectors or pure.DETECTORS
    # Property syntax always has a colon, so the gate looks at what else there is; escapes go too.
    bare = F.regexp_replace(c, r'"\s*:', '"')
    ask = gate(bare, chosen) | c.contains("\\") | (F.length(c) > policy.max_text) | F.try_parse_json(c).isNull()
    return F.coalesce(text_udf(masker(policy, key, chosen))(F.when(ask, c)), c)

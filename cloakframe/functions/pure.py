"""Detectors, maskers and the text sanitizer in Python, for use inside Arrow functions.

Offsets and lengths count code points. Word boundaries and \\d, \\w, \\s are ASCII. Every masker that
fails shows the placeholder, and no message holds a value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from cloakframe.functions.keys import Key
from cloakframe.plans.vocab import CATEGORIES, Declaration

#: Fixed value: ISO 3166 country codes, 249 of them.
COUNTRIES = frozenset(
    "AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY CZ DE DJ DK DM DO DZ "
    "EC EE EG EH ER ES ET FI FJ FK FM FO FR GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM IN IO IQ IR IS IT JE JM JO JP KE KG KH KI KM KN KP KR KW KY KZ "
    "LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW MX MY MZ NA NC NE NF NG NI NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA "
    "RE RO RS RU RW SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST SV SX SY SZ TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ UA UG UM US UY UZ VA VC VE VG VI VN VU WF WS YE YT ZA ZM ZW".split()
)


def _letter_or_digit(c: str) -> bool:
    return c.isalpha() or c.isdecimal()


def compact(text: str) -> str:
    return "".join(filter(_letter_or_digit, text)).upper()


def digits_only(text: str) -> str:
    return "".join(filter(str.isdecimal, text))


def luhn(text: str) -> bool:
    if not 12 <= len(text) <= 19 or not (text.isascii() and text.isdigit()):
        return False
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(text))))
    return total % 10 == 0


def iban(text: str) -> bool:
    t = compact(text)
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", t)) and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def swiss_ahv(text: str) -> bool:
    d = digits_only(text)
    return len(d) == 13 and d.isascii() and d.startswith("756") and (10 - sum(int(x) * (1, 3)[k % 2] for k, x in enumerate(d[:12])) % 10) % 10 == int(d[12])


def ipv6(text: str) -> bool:
    short = text.find("::")
    if ":::" in text or (short >= 0 and text.find("::", short + 1) > short):
        return False
    if (text[0] == ":" and text[:2] != "::") or (text[-1] == ":" and text[-2:] != "::"):
        return False
    groups = [g for g in text.split(":") if g]
    return all(len(g) <= 4 for g in groups) and (len(groups) <= 7 if short >= 0 else len(groups) == 8)


def bic(text: str) -> bool:
    return text[4:6] in COUNTRIES and ((len(text) == 11 and text.endswith("XXX")) or any(map(str.isdigit, text)))


@dataclass(frozen=True)
class Signals:
    length: int
    digits: int
    upper: int
    upper_run: int
    chars: frozenset

    @staticmethod
    def of(text: str) -> Signals:
        runs = re.findall("[A-Z]+", text)
        return Signals(len(text), sum(map(len, re.findall("[0-9]+", text))), sum(map(len, runs)), max(map(len, runs), default=0), frozenset(text))

    def all(self, chars: str) -> bool:
        return self.chars.issuperset(chars)

    def any(self, chars: str) -> bool:
        return not self.chars.isdisjoint(chars)


_BOUND = re.compile(r"\b", re.ASCII)


@dataclass(frozen=True)
class Detector:
    """Finds a category by a pattern (group 1 if it has one), a check of the match, and a gate.

    needs is a text, hints are lower-case words of which one (in any case), and loose is a pattern
    without word bounds, that every text with a finding has: the engine asks them of a text before any
    Python does, the cheap ones first. Without them every text is looked at.

    Where a match fails the check and inner is set, parts of it from one word bound to another that
    match by themselves are checked too, the first, then the longest: the value may stand beside others.
    """

    name: str
    category: str
    pattern: re.Pattern
    check: Callable[[str], bool] | None = None
    gate: Callable[[Signals], bool] | None = None
    needs: str = ""
    loose: str = ""
    hints: tuple[str, ...] = ()
    inner: bool = False

    def detect(self, text: str) -> list[tuple[int, int]]:
        if self.inner:
            return self._inner(text)
        group = 1 if self.pattern.groups else 0
        return [m.span(group) for m in self.pattern.finditer(text) if m.start(group) >= 0 and (self.check is None or self.check(m[group]))]

    def _inner(self, text: str) -> list[tuple[int, int]]:
        out, at = [], 0
        while m := self.pattern.search(text, at):
            ends = [m.end(), *(b.start() for b in reversed(list(_BOUND.finditer(text, m.start() + 1, m.end() - 1))))]
            end = next((e for e in ends if self.pattern.fullmatch(text, m.start(), e) and self.check(text[m.start() : e])), None)
            if end is not None:
                out.append((m.start(), end))
            # What begins within a failed match is looked at from its next word bound on.
            at = end if end is not None else m.start() + 1
        return out

    def might_match(self, s: Signals) -> bool:
        return self.gate is None or self.gate(s)


def detector(name: str, category: str, pattern: str, check: Callable[[str], bool] | None = None, gate: Callable[[Signals], bool] | None = None, needs: str = "", loose: str = "", hints: tuple[str, ...] = (), inner: bool = False) -> Detector:
    return Detector(name, category, re.compile(pattern, re.ASCII), check, gate, needs, loose, hints, inner)


#: What each detector accepts, and the necessary conditions, in order of priority.
DETECTORS = (
    detector("private-key", "CREDENTIAL", r"(-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z ]+ )?PRIVATE KEY-----)", gate=lambda s: s.all("-BEGIN"), needs="PRIVATE KEY-----", loose=r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----"),
    detector("jwt", "CREDENTIAL", r"\b(eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]*)", gate=lambda s: s.all("eyJ."), needs="eyJ", loose=r"eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{4}"),
    detector("bearer-token", "CREDENTIAL", r"(?i)\b(?:bearer|basic)\s+([A-Za-z0-9._\-~+/]{8,}={0,2})", gate=lambda s: s.any("bB") and s.length >= 15, loose=r"(?i)(?:bearer|basic)[ \t\n\x0B\f\r]+[A-Za-z0-9._\-~+/]{8}", hints=("bearer", "basic")),
    detector("assigned-secret", "CREDENTIAL", r"(?i)\b(?:pass(?:word|wd)?|secret|api[_\-]?key|access[_\-]?token|client[_\-]?secret|private[_\-]?key)\s*[=:]\s*\"?([^\s\"',;&]{4,})\"?", gate=lambda s: s.any("=:"), loose=r"(?i)(?:pass|passwd|password|secret|key|token)[ \t\n\x0B\f\r]*[=:]", hints=("pass", "secret", "key", "token")),
    detector("swiss-ahv", "NATIONAL_ID", r"\b(756[.\- ]?\d{4}[.\- ]?\d{4}[.\- ]?\d{2})\b", swiss_ahv, lambda s: s.digits >= 13 and s.all("756"), needs="756", loose=r"756[.\- ]?[0-9]{4}[.\- ]?[0-9]{4}[.\- ]?[0-9]{2}"),
    detector("iban", "IBAN", r"\b([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3}(?! ?[A-Z0-9]))?))\b", iban, lambda s: s.length >= 14 and s.upper >= 2 and s.digits >= 2, loose=r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11}"),
    detector("payment-card", "PAN", r"\b(\d(?:[ \-]?\d){11,18})\b", lambda t: luhn(digits_only(t)), lambda s: s.digits >= 12, loose=r"[0-9](?:[ \-]?[0-9]){11}", inner=True),
    detector("email", "EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}", gate=lambda s: s.any("@"), needs="@", loose=r"[A-Za-z0-9._%+\-]@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2}"),
    detector("phone-e164", "PHONE", r"(?<![\w+])(\+[1-9]\d{0,2}[ .\-]?(?:\(?\d{1,4}\)?[ .\-]?){1,4}\d{2,4})(?![\w])", gate=lambda s: s.any("+") and s.digits >= 4, needs="+", loose=r"\+[1-9][0-9]{0,2}[ .\-]?\(?[0-9]"),
    detector("ipv4", "IP_ADDRESS", r"\b((?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d))\b", gate=lambda s: s.any(".") and s.digits >= 4, needs=".", loose=r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"),
    detector("ipv6", "IP_ADDRESS", r"(?<![\w:.])((?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:])", ipv6, lambda s: s.any(":"), needs=":", loose=r":[0-9A-Fa-f]{0,4}:"),
    detector("bic", "BIC", r"\b([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", bic, lambda s: s.upper_run >= 6, loose=r"[A-Z]{6}[A-Z0-9]{2}"),
)

# ---- maskers: the same as the column expressions ----


def mask_partial(text: str, keep: int, padding: str) -> str:
    n, seen, out = sum(map(_letter_or_digit, text)), 0, []
    for c in text:
        if _letter_or_digit(c):
            seen += 1
            out.append(c if keep < n and seen > n - keep else padding)
        else:
            out.append(c)
    return "".join(out)


def mask_email(text: str, ph: str, padding: str) -> str:
    local, at, domain = text.rpartition("@")
    if not at or not local or not domain:
        return ph
    dot = domain.rfind(".")
    end = domain[dot:] if dot > 0 else ""
    return f"{local[0]}{padding * (len(local) - 1)}@{domain[0]}{padding * (len(domain) - len(end) - 1)}{end}"


def _fours(text: str) -> str:
    return " ".join(text[k : k + 4] for k in range(0, len(text), 4))


def mask_iban(text: str, ph: str, keep: int, padding: str) -> str:
    t, keep = compact(text), min(keep, 4)
    if not 15 <= len(t) <= 34 or not (t[:2].isalpha() and t[2:4].isdecimal()):
        return ph
    return _fours(t[:4] + padding * (len(t) - 4 - keep) + (t[-keep:] if keep else ""))


def mask_pan(text: str, ph: str, padding: str) -> str:
    d = digits_only(text)
    return _fours(padding * (len(d) - 4) + d[-4:]) if len(d) >= 12 else ph


def mask_phone(text: str, ph: str, padding: str) -> str:
    n, seen, out, lead = len(digits_only(text)), 0, [], 2 * text.startswith("+")
    if n < 6:
        return ph
    for c in text:
        if c.isdecimal():
            out.append(c if seen < lead or seen >= n - 2 else padding)
            seen += 1
        else:
            out.append(c)
    return "".join(out)


def mask_name(text: str, padding: str) -> str:
    return "".join(padding if c.isalpha() and k and text[k - 1].isalpha() else c for k, c in enumerate(text))


def mask_ip(text: str, ph: str) -> str:
    text = text.strip("".join(map(chr, range(33))))
    if ":" in text:
        groups = text.split(":")
        lead = []
        for g in groups[:3]:
            if not g:
                break
            lead.append(g)
        return ":".join(lead) + "::" if len(groups) >= 3 and lead else ph
    parts = text.split(".")
    return ".".join(parts[:3]) + ".0" if len(parts) == 4 and all(1 <= len(p) <= 3 and p.isdecimal() for p in parts) else ph


def mask_year(text: str, ph: str) -> str:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text, re.ASCII):
        return ph
    try:
        date.fromisoformat(text)
    except ValueError:
        return ph
    return text[:4]


def preserve_format(text: str, key: Key) -> str:
    """Digits for digits and letters for letters, drawn from the text's pseudonym."""
    seed = key.pseudonym(text).encode()

    def stream():  # noqa: ANN202
        n = 0
        while True:
            yield from hashlib.sha256(seed + n.to_bytes(4, "big")).digest()
            n += 1

    draws = stream()

    def below(bound: int) -> int:
        return next(d for d in draws if d < 256 - 256 % bound) % bound

    out = []
    for c in text:
        if c.isdecimal():
            out.append(chr(ord("0") + below(10)))
        elif c.isupper() or c.istitle():
            out.append(chr(ord("A") + below(26)))
        elif c.isalpha():
            out.append(chr(ord("a") + below(26)))
        else:
            out.append(c)
    return "".join(out)


def mask(text: str | None, d: Declaration, ph: str, key: Key | None) -> str | None:
    """One value by its declaration; a strategy that can't be applied shows the placeholder."""
    if text is None:
        return None
    ph, s, pad, keep = d.replacement or ph, d.resolved(), d.padding, d.visible
    try:
        if s == "NULLIFY":
            return None
        if s == "HASH":
            return key.pseudonym(text)
        if s == "PRESERVE_FORMAT":
            return preserve_format(text, key)
        if s == "PARTIAL":
            return mask_partial(text, keep, pad)
        if s == "NAME":
            return mask_name(text, pad)
        if s == "IBAN":
            return mask_iban(text, ph, keep, pad)
        two = {"EMAIL": mask_email, "PAN": mask_pan, "PHONE": mask_phone}.get(s)
        if two:
            return two(text, ph, pad)
        one = {"IP": mask_ip, "DATE_GENERALIZE": mask_year}.get(s)
        return one(text, ph) if one else ph
    except Exception:  # noqa: BLE001  fails closed: the value must not show, not even in a message
        return ph


# ---- the sanitizer ----

#: Characters beyond the cap that are read, so that an identifier across it is seen.
MARGIN = 64
Finding = tuple[int, int, str, str, bool]  # start, end, category, detector, confident


def scan(text: str | None, detectors: tuple[Detector, ...] = DETECTORS) -> list[Finding]:
    """Findings in order without overlap. What an overlapping one has beyond the last is a fragment
    of its own, not confident. Earlier, then longer, then earlier detectors win."""
    if not text:
        return []
    s = Signals.of(text)
    found = [(a, b, k) for k, d in enumerate(detectors) if d.might_match(s) for a, b in d.detect(text)]
    found.sort(key=lambda f: (f[0], f[0] - f[1], f[2]))
    out: list[Finding] = []
    end = 0
    for a, b, k in found:
        if b <= end:
            continue
        d = detectors[k]
        out.append((max(a, end), b, d.category, d.name, a >= end))
        end = b
    return out


def classify(text: str | None, detectors: tuple[Detector, ...] = DETECTORS, cap: int = 8192) -> str | None:
    """The category whose detector takes the whole trimmed text."""
    t = (text or "").strip("".join(map(chr, range(33))))
    if not t or len(t) > cap:
        return None
    s = Signals.of(t)
    return next((d.category for d in detectors if d.might_match(s) and any(span == (0, len(t)) for span in d.detect(t))), None)


def mask_span(text: str, f: Finding, ph: str, key: Key | None) -> str:
    strategy = CATEGORIES[f[2]].strategy
    if not f[4] or strategy in ("AUTO", "SCAN"):
        return ph
    return mask(text[f[0] : f[1]], Declaration(f[2]), ph, key) or ""


_ARMOUR = re.compile(r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----")


def sanitize(text: str | None, ph: str = "****", key: Key | None = None, cap: int = 8192, detectors: tuple[Detector, ...] = DETECTORS) -> tuple[str | None, list[Finding], int | None]:
    """The text with its findings masked, the findings, and where it was cut if it's longer than cap.

    A long text is read MARGIN characters beyond the cap; a finding across the cap, or a private
    key that begins before it and doesn't end in what is read, moves the cut to its start.
    """
    if not text:
        return text, [], None
    head = text[: cap + MARGIN] if len(text) > cap else text
    found = scan(head, detectors)
    cut = None
    if len(text) > cap:
        cut = min([cap, *(f[0] for f in found if f[0] < cap < f[1])])
        for m in _ARMOUR.finditer(head):
            if m.start() < cut and not any(f[0] <= m.start() < f[1] for f in found) and m.start() < cap:
                cut = min(cut, m.start())
        found = [f for f in found if f[1] <= cut]
    out, at = [], 0
    for f in found:
        out += [text[at : f[0]], mask_span(text, f, ph, key)]
        at = f[1]
    out.append(text[at:cut] if cut is not None else text[at:])
    return "".join(out) + (ph if cut is not None else ""), found, cut

"""Categories, strategies and sensitivities, and the declarations built from them."""

from __future__ import annotations

from dataclasses import dataclass, replace

LOW, MEDIUM, HIGH, CRITICAL = range(4)
SENSITIVITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

REDACT_ON_FAILURE, THROW, PASS_THROUGH = "REDACT", "THROW", "PASS_THROUGH"

#: The strategies' names.
STRATEGIES = ("AUTO", "REDACT", "PARTIAL", "HASH", "TOKENIZE", "NULLIFY", "EMAIL", "IBAN", "PAN", "PHONE", "NAME", "IP", "DATE_GENERALIZE", "PRESERVE_FORMAT", "SCAN")


@dataclass(frozen=True)
class Category:
    strategy: str
    keep: int
    sensitivity: int


#: Each category's default strategy, visible trailing characters and sensitivity.
CATEGORIES = {
    "UNSPECIFIED": Category("AUTO", -1, HIGH),
    "EMAIL": Category("EMAIL", -1, HIGH),
    "PHONE": Category("PHONE", 2, HIGH),
    "FULL_NAME": Category("NAME", -1, HIGH),
    "POSTAL_ADDRESS": Category("REDACT", -1, HIGH),
    "DATE_OF_BIRTH": Category("DATE_GENERALIZE", -1, HIGH),
    "IBAN": Category("IBAN", 4, HIGH),
    "ACCOUNT_NUMBER": Category("PARTIAL", 4, HIGH),
    "BIC": Category("PARTIAL", 3, HIGH),
    "PAN": Category("PAN", 4, CRITICAL),
    "CARD_VERIFICATION_VALUE": Category("REDACT", 0, CRITICAL),
    "CARD_EXPIRY": Category("REDACT", 0, CRITICAL),
    "NATIONAL_ID": Category("PARTIAL", 0, CRITICAL),
    "TAX_ID": Category("PARTIAL", 0, CRITICAL),
    "IDENTITY_DOCUMENT": Category("PARTIAL", 0, CRITICAL),
    "CUSTOMER_ID": Category("HASH", -1, HIGH),
    "CREDENTIAL": Category("REDACT", 0, CRITICAL),
    "BIOMETRIC": Category("REDACT", 0, CRITICAL),
    "IP_ADDRESS": Category("IP", -1, HIGH),
    "DEVICE_ID": Category("HASH", -1, HIGH),
    "GEO_LOCATION": Category("REDACT", -1, HIGH),
    "FINANCIAL_AMOUNT": Category("REDACT", 0, HIGH),
    "FREEFORM_TEXT": Category("SCAN", -1, HIGH),
}
#: Categories of which no part is ever shown, and the strategies that they allow.
NEVER_REVEAL = {"CARD_VERIFICATION_VALUE", "CREDENTIAL", "BIOMETRIC", "CARD_EXPIRY"}
SAFE_FOR_ALL = {"REDACT", "HASH", "TOKENIZE", "NULLIFY"}


@dataclass(frozen=True)
class Declaration:
    """What a column holds and how to mask it. sensitivity HIGH and keep -1 stand for "unset"."""

    category: str = "UNSPECIFIED"
    sensitivity: int = HIGH
    strategy: str = "AUTO"
    keep: int = -1
    padding: str = "*"
    replacement: str = ""
    masker: object = None
    purpose: str = ""

    def __post_init__(self) -> None:
        if self.category not in CATEGORIES:
            raise ValueError(f"unknown category {self.category}")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.keep < -1:
            raise ValueError("keep must be -1 or more")
        if len(self.padding) != 1:
            raise ValueError("padding must be one character")

    @property
    def never_reveal(self) -> bool:
        return self.category in NEVER_REVEAL

    def normalised(self) -> Declaration:
        """With the category's sensitivity where none is set; nothing of some categories is shown."""
        if self.never_reveal:
            return replace(self, keep=0, sensitivity=CRITICAL)
        return replace(self, sensitivity=CATEGORIES[self.category].sensitivity) if self.sensitivity == HIGH else self

    @property
    def visible(self) -> int:
        """Trailing characters that stay: the declaration's, else the category's, never below 0."""
        return self.keep if self.keep >= 0 else max(CATEGORIES[self.category].keep, 0)

    def resolved(self) -> str:
        """The strategy at plan time: the category's for AUTO, and a safe one for what is never shown."""
        s = CATEGORIES[self.category].strategy if self.strategy == "AUTO" else self.strategy
        return "REDACT" if self.never_reveal and s not in SAFE_FOR_ALL and self.masker is None else s

    def over(self, base: Declaration) -> Declaration:
        """This declaration's attributes where they differ from the defaults, else those of base."""
        blank = Declaration()
        names = self.__dataclass_fields__
        return Declaration(**{n: getattr(self, n) if getattr(self, n) != getattr(blank, n) else getattr(base, n) for n in names})


@dataclass(frozen=True)
class Keep:
    """A column that stays as it is, with the reason."""

    justification: str


class Drop:
    """A column that goes."""

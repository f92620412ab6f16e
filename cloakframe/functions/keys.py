"""Keys: HKDF from a secret, key ids, purposes, and keyed pseudonyms as column expressions."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default salt; pseudonyms made elsewhere need the salt that was used there.
SALT = b"cloakframe/mask-key"
#: Fixed values of the derivation.
KEY_INFO, ID_INFO, PURPOSE = b"pseudonymization/v1", b"key-id/v1", b"purpose/"
PREFIX = "~"
SECRET_BYTES, KEY_BYTES, ID_BYTES, OUTPUT_BYTES = 16, 32, 4, 12
BLOCK_BYTES = 64  # of SHA-256


def _url64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def expand(key: bytes, info: bytes, length: int) -> bytes:
    out, block = b"", b""
    for n in range(1, -(-length // 32) + 1):
        block = hmac.digest(key, block + info + bytes([n]), "sha256")
        out += block
    return out[:length]


@dataclass(frozen=True, repr=False)
class Key:
    material: bytes
    ephemeral: bool = False

    def __post_init__(self) -> None:
        if len(self.material) < SECRET_BYTES:
            raise ValueError(f"a key needs {SECRET_BYTES} bytes or more")

    def __repr__(self) -> str:
        return f"Key({self.id}, material hidden)"

    @staticmethod
    def of_secret(secret: str, salt: bytes = SALT) -> Key:
        raw = secret.encode()
        if len(raw) < SECRET_BYTES:
            raise ValueError(f"a secret needs {SECRET_BYTES} bytes or more; pseudonyms under a short one can be guessed")
        return Key(expand(hmac.digest(salt, raw, "sha256"), KEY_INFO, KEY_BYTES))

    @staticmethod
    def random() -> Key:
        """A key for one session; it's drawn once, on the driver."""
        return Key(os.urandom(KEY_BYTES), True)

    @property
    def id(self) -> str:
        return _url64(expand(self.material, ID_INFO, ID_BYTES))

    def for_purpose(self, purpose: str) -> Key:
        return Key(expand(self.material, PURPOSE + purpose.encode(), KEY_BYTES), self.ephemeral)

    def pads(self) -> tuple[bytes, bytes]:
        """The inner and outer block of HMAC-SHA256."""
        key = hashlib.sha256(self.material).digest() if len(self.material) > BLOCK_BYTES else self.material
        key = key.ljust(BLOCK_BYTES, b"\0")
        return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)

    def pseudonym(self, value: str, size: int = OUTPUT_BYTES) -> str:
        return f"{PREFIX}{self.id}:{_url64(hmac.digest(self.material, value.encode('utf-8', 'surrogatepass'), 'sha256')[:size])}"


def pseudonym(value: Column, key: Key, size: int = OUTPUT_BYTES) -> Column:
    """The keyed pseudonym of a text column, from built-in functions. The pads stand in the plan."""
    if not 8 <= size <= 32:
        raise ValueError("a pseudonym has 8 to 32 bytes")
    inner, outer = (F.unhex(F.lit(p.hex())) for p in key.pads())
    mac = F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256))
    text = F.translate(F.base64(F.substring(mac, 1, size)), "+/=\r\n", "-_")
    return F.concat(F.lit(f"{PREFIX}{key.id}:"), text)


def pseudonym_matches(value: Column, hashed: Column, keys: list[Key], size: int = OUTPUT_BYTES) -> Column:
    """Whether hashed is value's pseudonym under the key whose id it bears, the current or an earlier one."""
    found = F.lit(False)
    for key in reversed(keys):
        found = F.when(F.substring_index(hashed, ":", 1) == PREFIX + key.id, pseudonym(value, key, size) == hashed).otherwise(found)
    return F.coalesce(found & hashed.contains(":"), F.lit(False))

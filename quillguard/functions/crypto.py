"""Hashing, keyed hashing, authenticated encryption and encodings over columns.

Keys given as bytes become literals of the plan, where explain() shows them; pass a Column (from a broadcast or joined key
table) where plans are logged. Sessions of secure_session() redact them besides.
"""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = bytes | Column


def encode(x: Column, form: str = "hex") -> Column:
    """Binary as lower-case hex or base64."""
    if form not in ("hex", "base64"):
        raise ValueError(f"unknown encoding: {form}")
    return F.lower(F.hex(x)) if form == "hex" else _base64(x)


def _base64(x: Column) -> Column:
    """In one line: some settings break lines."""
    return F.translate(F.base64(x), "\r\n", "")


def decode(x: Column, form: str = "hex") -> Column:
    return F.unhex(x) if form == "hex" else F.unbase64(x)


def digest(data: Column, algorithm: str = "sha256", salt: Key | None = None, form: str = "hex") -> Column:
    """Of salt and data."""
    bits = {"sha256": 256, "sha512": 512}[algorithm]
    raw = data.cast("binary")
    if salt is not None:
        raw = F.concat(F.lit(salt) if isinstance(salt, bytes) else salt.cast("binary"), raw)
    hexed = F.sha2(raw, bits)
    return hexed if form == "hex" else _base64(F.unhex(hexed))


def _pads(key: bytes, block: int, bits: int) -> tuple[bytes, bytes]:
    import hashlib

    if len(key) > block:
        key = hashlib.new(f"sha{bits}", key).digest()
    key = key.ljust(block, b"\0")
    return bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)


def _hmac(data: Column, key: bytes, bits: int) -> Column:
    inner, outer = _pads(key, 64 if bits == 256 else 128, bits)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), data.cast("binary")), bits))
    return F.sha2(F.concat(F.lit(outer), first), bits)


def hmac_sha256(data: Column, key: bytes) -> Column:
    """Lower-case hex; composed of built-in hashes with the pads of the key made on the driver."""
    return _hmac(data, key, 256)


def hmac_sha512(data: Column, key: bytes) -> Column:
    return _hmac(data, key, 512)


def keyed_hash(data: Column, key: bytes, algorithm: str = "sha256", form: str = "hex") -> Column:
    h = _hmac(data, key, 256 if algorithm == "sha256" else 512)
    return h if form == "hex" else _base64(F.unhex(h))


def hash_value(data: Column, algorithm: str = "sha256", salt: bytes | None = None, keyed: bool = False, form: str = "hex") -> Column:
    """struct<value, algorithm, salt>: what verify_hash needs. A salt of 16 bytes is drawn on the driver if there is none."""
    salt = generate_salt() if salt is None else salt
    value = keyed_hash(data, salt, algorithm, form) if keyed else digest(data, algorithm, salt, form)
    return F.struct(value.alias("value"), F.lit(algorithm).alias("algorithm"), encode(F.lit(salt)).alias("salt"))


def verify_hash(data: Column, hashed: Column, salt: bytes, algorithm: str = "sha256", keyed: bool = False, form: str = "hex") -> Column:
    return (keyed_hash(data, salt, algorithm, form) if keyed else digest(data, algorithm, salt, form)) == hashed


def generate_salt(n: int = 16) -> bytes:
    return os.urandom(n)


def generate_key() -> bytes:
    return os.urandom(32)


def _key(key: Key) -> Column:
    if isinstance(key, bytes):
        if len(key) != 32:
            raise ValueError("a key has 32 bytes")
        return F.lit(key)
    return key


def encrypt(data: Column, key: Key, form: str = "base64") -> Column:
    """AES-256-GCM: nonce of 12 bytes, ciphertext, tag of 16, encoded."""
    return encode(F.aes_encrypt(data.cast("binary"), _key(key), F.lit("GCM")), form)


def decrypt_raw(data: Column, key: Key) -> Column:
    """Null if the key or the data is wrong."""
    return F.try_aes_decrypt(data, _key(key), F.lit("GCM"))


def decrypt(data: Column, key: Key, form: str = "base64") -> Column:
    return decrypt_raw(decode(data, form), key).cast("string")


#: Names of literals that plans and events hide, for sessions that hold keys.
REDACTION = {"spark.sql.redaction.string.regex": r"(?i)x'[0-9a-f]{32,}'|0x[0-9a-f]{32,}|[0-9A-F]{64,}"}


def secure_session(builder):
    for k, v in REDACTION.items():
        builder = builder.config(k, v)
    return builder

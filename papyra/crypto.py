"""Keys, and authenticated encryption by Spark's own AES-GCM."""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from papyra.errors import DecryptionFailed

AAD = "papyra-1"
BAD_PAYLOAD = "papyra: a payload doesn't authenticate"


@contextmanager
def decrypting() -> Iterator[None]:
    """Reads of encrypted documents: a payload that doesn't authenticate is DecryptionFailed."""
    try:
        yield
    except Exception as e:
        if BAD_PAYLOAD in str(e):
            raise DecryptionFailed() from e
        raise


def random_key() -> bytes:
    return secrets.token_bytes(32)


def random_salt(size: int = 16) -> bytes:
    return secrets.token_bytes(size)


def derive_key(password: str, salt: bytes, *, algorithm: str = "pbkdf2", iterations: int = 210_000) -> bytes:
    """A 256-bit key from a password, by PBKDF2-HMAC-SHA256 or HKDF-SHA256."""
    secret = password.encode()
    if algorithm == "pbkdf2":
        return hashlib.pbkdf2_hmac("sha256", secret, salt, iterations, 32)
    if algorithm == "hkdf":
        pseudo = hmac.digest(salt or bytes(32), secret, "sha256")
        return hmac.digest(pseudo, b"papyra.aes.gcm\x01", "sha256")
    raise ValueError(f"unknown algorithm {algorithm}")


def hide_key(spark: SparkSession, key: bytes) -> None:
    """Keeps a key, in any of its forms, out of the text of plans."""
    forms = [key.hex().upper(), key.hex(), base64.b64encode(key).decode()]
    for pad in (_pad(key, 0x36), _pad(key, 0x5C)):
        forms += [pad.hex(), pad.hex().upper()]
    pattern = "|".join(f.replace("+", r"\+").replace("/", r"\/") for f in forms)
    old = spark.conf.get("spark.sql.redaction.string.regex", "") or ""
    if pattern not in old:
        spark.conf.set("spark.sql.redaction.string.regex", f"{old}|{pattern}" if old else pattern)


def encrypt(payload: Column, key: bytes) -> Column:
    return F.aes_encrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.lit(AAD))


def decrypt(payload: Column, key: bytes) -> Column:
    """Null where the key is wrong or the bytes were changed."""
    return F.try_aes_decrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(AAD))


def _pad(key: bytes, byte: int) -> bytes:
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    return bytes(b ^ byte for b in key.ljust(64, b"\0"))


def hmac_hex(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a string column, as lowercase hex."""
    inner = F.unhex(F.sha2(F.concat(F.lit(_pad(key, 0x36)), text.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(_pad(key, 0x5C)), inner), 256)


def hmac_text(text: str, key: bytes) -> str:
    return hmac.digest(key, text.encode(), "sha256").hex()


def seal(spark: SparkSession, data: bytes, key: bytes) -> bytes:
    return bytes(spark.createDataFrame([(data,)], "d binary").select(encrypt(F.col("d"), key).alias("d")).first()["d"])


def unseal(spark: SparkSession, data: bytes, key: bytes) -> bytes:
    got = spark.createDataFrame([(data,)], "d binary").select(decrypt(F.col("d"), key).alias("d")).first()["d"]
    if got is None:
        raise DecryptionFailed()
    return bytes(got)

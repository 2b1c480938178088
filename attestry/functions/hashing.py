"""Hash columns. SHA-256 is built in; BLAKE2b-256 and canonical JSON need a small Arrow helper."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


@F.pandas_udf(T.StringType())
def blake2b_hex(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else hashlib.blake2b(bytes(b), digest_size=32).hexdigest())


def hash_hex(data: Column, algorithm: str = "sha256") -> Column:
    if algorithm == "sha256":
        return sha256_hex(data)
    if algorithm == "blake2b":
        return blake2b_hex(data.cast("binary"))
    raise ValueError(f"unknown hash {algorithm!r}")


def block_id(raw: Column, algorithm: str = "sha256") -> Column:
    return F.concat(F.lit("0x"), hash_hex(raw, algorithm))


def _number(v: float) -> str:
    """A double in the shortest form JavaScript prints, as canonical JSON asks for."""
    if v == 0:
        return "0"
    if v == int(v) and abs(v) < 1e21:
        return str(int(v))
    text = repr(v)
    if "e" in text:
        mantissa, exp = text.split("e")
        power = int(exp)
        if -7 < power < 0:
            digits = mantissa.replace(".", "").lstrip("-")
            return ("-" if v < 0 else "") + "0." + "0" * (-power - 1) + digits
        return f"{mantissa}e{'+' if power > 0 else '-'}{abs(power)}"
    return text


def canonical(v) -> str:
    """Canonical JSON text of a parsed value: sorted keys, no white space, shortest numbers."""
    if isinstance(v, dict):
        keys = sorted(v, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(v[k])}" for k in keys) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, int):
        if abs(v) > 2**53 - 1:
            raise ValueError("integer out of range")
        return str(v)
    if not math.isfinite(v):
        raise ValueError("not finite")
    return _number(v)


@F.pandas_udf(T.StringType())
def canonical_text(text: pd.Series) -> pd.Series:
    """Canonical form of JSON documents; null for what is not JSON or has no canonical form."""
    def one(s):
        if s is None:
            return None
        try:
            out = canonical(json.loads(s))
            out.encode("utf-8")
            return out
        except (ValueError, RecursionError):
            return None

    return text.map(one)


def canonical_hash(text: Column, algorithm: str = "sha256") -> Column:
    return block_id(canonical_text(text), algorithm)


def commitment(salt: Column, canonical_value: Column, algorithm: str = "sha256") -> Column:
    """base64url of the hash of salt bytes followed by the canonical value."""
    data = F.concat(salt, canonical_value.cast("binary"))
    return base64url(F.unhex(hash_hex(data, algorithm)))


def hmac_sha256(key: bytes, data: Column) -> Column:
    """HMAC-SHA256 from two built-in hashes; the padded keys are constants of the job."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    padded = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), data.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(F.lit(outer), first), 256))


def blind_token(key: bytes, kind: Column, value: Column) -> Column:
    return base64url(hmac_sha256(key, F.concat_ws(":", kind, value)))


def packed(id_hex: Column) -> Column:
    """An id as bytes for a shuffle, half as long where it is `0x` and 64 lower-case hex digits; one to one, and in no order."""
    plain = id_hex.rlike("^0x[0-9a-f]{64}$")
    return F.concat(F.when(plain, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), F.when(plain, F.unhex(F.substr(id_hex, F.lit(3)))).otherwise(id_hex.cast("binary")))


def unpacked(id_bytes: Column) -> Column:
    """The id of `packed` bytes."""
    rest = F.substring(id_bytes, 2, 2**31 - 1)
    return F.when(F.hex(F.substring(id_bytes, 1, 1)) == "01", F.concat(F.lit("0x"), F.lower(F.hex(rest)))).otherwise(rest.cast("string"))

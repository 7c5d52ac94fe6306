"""Webhook signature check and secret scanning as built-in column expressions.

HMAC-SHA256 is composed from ``sha2`` and ``unhex`` only: the two padded keys are made once on
the driver from the secret (a few bytes, not data) and enter the plan as literals, so every
row's check runs inside codegen without a Python UDF.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords the secret scan looks for (service configuration).
SECRET_KEYWORDS = ["password", "api_key", "secret", "token"]

_BLOCK = 64  # SHA-256 block size in bytes


def hmac_pads(secret: str) -> tuple[str, str]:
    """Hex of (key XOR ipad, key XOR opad) for HMAC-SHA256 (RFC 2104)."""
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    ipad = bytes(b ^ 0x36 for b in key).hex()
    opad = bytes(b ^ 0x5C for b in key).hex()
    return ipad, opad


def hmac_sha256_hex(payload: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of ``payload`` (string or binary) under ``secret``."""
    ipad, opad = hmac_pads(secret)
    body = payload.cast("binary")
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), body), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)


def signature_of(payload: Column, secret: str) -> Column:
    """The ``sha256=<hex>`` header value for ``payload``."""
    return F.concat(F.lit("sha256="), hmac_sha256_hex(payload, secret))


def verify_signature(payload: Column, signature: Column, secret: str) -> Column:
    """S3: true when ``signature`` equals the expected header; empty or null signature -> false."""
    sig = F.coalesce(signature, F.lit(""))
    return (sig != "") & (sig == signature_of(payload, secret))


# Keyword at an ASCII word boundary or after an underscore; the same text runs in Java regex and in RE2.
_EDGE_L = r"(\A|[^A-Za-z0-9])"
_EDGE_R = r"([^A-Za-z0-9_]|\z)"


def keyword_pattern(kw: str) -> str:
    return f"(?i){_EDGE_L}{kw}{_EDGE_R}"


# A value to mask: a quoted one as a whole (to its closing quote on the line, over escaped ones), else up to a blank.
_VALUE = (r"""(?:"[^"\\\r\n]+(?:\\[^\r\n][^"\\\r\n]*)*"|"(?:\\[^\r\n][^"\\\r\n]*)+"|"""
          r"""'[^'\\\r\n]+(?:\\[^\r\n][^'\\\r\n]*)*'|"?[^ \t\n\f\r"]+"?)""")


def masked_pattern(possessive: bool = True) -> str:
    """``<keyword> = value`` / ``"<keyword>": "a value"`` / ``DB_<keyword>='a value'`` with the value to mask.

    A quoted value's repeats are ``possessive`` for Java's engine, which else backs up over long values; an engine that
    never backs up (RE2) has no such marks and matches the same."""
    value = _VALUE.replace("]+(", "]++(").replace("]*)*", "]*+)*+").replace("]*)+", "]*+)++") if possessive else _VALUE
    blank = r"[ \t\n\f\r]*"
    return rf"""(?i)(\A|[^A-Za-z0-9])({"|".join(SECRET_KEYWORDS)})(["']?{blank}[=:]{blank}){value}"""


# A case-insensitive pattern that starts with an alternation gives the regex engine no literal
# to skip ahead with, so it tries every position of a long text. Each regex below runs only when
# a plain substring search of the lower-cased text finds the keyword (a necessary condition).

def _has(lowered: Column, kw: str) -> Column:
    return F.instr(lowered, kw) > 0


def _any_keyword(lowered: Column) -> Column:
    out = _has(lowered, SECRET_KEYWORDS[0])
    for k in SECRET_KEYWORDS[1:]:
        out = out | _has(lowered, k)
    return out


def found_keywords(text: Column, lowered: Column | None = None) -> Column:
    """Keywords present in ``text``, in list order. Pass ``lowered = lower(text)`` when it is
    already a column, so the text is lower-cased once."""
    low = F.lower(text) if lowered is None else lowered
    return F.array_compact(F.array(*[F.when(_has(low, k) & text.rlike(keyword_pattern(k)), F.lit(k))
                                     for k in SECRET_KEYWORDS]))


def redact(text: Column, lowered: Column | None = None) -> Column:
    """Mask the value of every keyword assignment with ``***``."""
    low = F.lower(text) if lowered is None else lowered
    return F.when(_any_keyword(low), F.regexp_replace(text, masked_pattern(), "$1$2$3***")).otherwise(text)


def count_assignments(text: Column, lowered: Column | None = None) -> Column:
    low = F.lower(text) if lowered is None else lowered
    return F.when(_any_keyword(low), F.regexp_count(text, F.lit(masked_pattern()))).otherwise(F.lit(0))

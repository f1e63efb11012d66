"""Deterministic ids: SHA-256 of a canonical JSON array, the first 128 bits in base 32, 64 more as a check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the text form: no i, l, o or u.
DIGITS = "0123456789abcdefghjkmnpqrstvwxyz"
VERSION = 1


def canonical_array(prefix: str, kind: str, *parts: Column) -> Column:
    """["prefix",1,"kind",...] as compact JSON; the parts are strings."""
    quoted = [F.regexp_extract(F.to_json(F.array(p.cast("string"))), r"^\[(.*)\]$", 1) for p in parts]
    return F.concat(F.lit(f'["{prefix}",{VERSION},"{kind}"'), *(F.concat(F.lit(","), q) for q in quoted), F.lit("]"))


def digest_hex(prefix: str, kind: str, *parts: Column) -> Column:
    return F.sha2(canonical_array(prefix, kind, *parts).cast("binary"), 256)


def base32(hex32: Column) -> Column:
    """128 bits, given as 32 hex digits, as 26 digits."""
    half = lambda at: F.lpad(F.conv(F.substring(hex32, at, 16), 16, 2), 64, "0")
    bits = F.concat(F.lit("00"), half(1), half(17))
    digit = lambda b, i: F.substring(F.lit(DIGITS), F.conv(F.substring(b, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    # the bits are worked out once, not once for each digit
    return F.transform(F.array(bits), lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: digit(b, i)), ""))[0]


def analytical_id(prefix: str, kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-v{VERSION}-"), base32(F.substring(digest_hex(prefix, kind, *parts), 1, 32)))


def check_bits(prefix: str, kind: str, *parts: Column) -> Column:
    return F.substring(digest_hex(prefix, kind, *parts), 33, 16)


# Where the 64-bit FNV-1a hash begins, and its prime.
_FNV_START, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv64(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes as 16 hex digits; for short texts, as every byte is a step. Null stays null."""
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")

    def step(h: Column, byte: Column) -> Column:
        low = F.pmod(h, number(256))
        mixed = h - low + low.cast("int").bitwiseXOR(byte).cast("decimal(20,0)")
        return F.pmod(mixed.cast("decimal(20,0)") * F.lit(str(_FNV_PRIME)).cast("decimal(13,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")

    pairs = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("([0-9A-F]{2})"), F.lit(1))
    hashed = F.aggregate(F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int")), number(_FNV_START), step)
    return F.lower(F.lpad(F.conv(hashed.cast("string"), 10, 16), 16, "0"))

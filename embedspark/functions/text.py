"""Text expressions: prefixing, offline tokenising and token hashing, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from embedspark.constants import SPECIAL_TOKENS, TOKEN_PATTERN


def prefixed(prefix: Column | str, text: Column | str) -> Column:
    """``"<prefix>: <text>"``; a text that already carries a prefix gets a second one."""
    return F.concat(prefix, F.lit(": "), text)


def tokens(text: Column | str) -> Column:
    """Lower-cased letter or digit runs and single other visible characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(token_array: Column | str) -> Column:
    """Token count including the two special tokens."""
    return F.size(token_array) + F.lit(SPECIAL_TOKENS)


def token_hash(token: Column) -> Column:
    """36-bit hash: the first nine hex digits of the md5 of the token."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 9), 16, 10).cast("bigint")


def hash_slot(value: Column, width: int) -> Column:
    """Slot of a hashed token: its first eight hex digits modulo the width."""
    return F.pmod(F.shiftright(value, 4), F.lit(width)).cast("int")


def hash_sign(value: Column) -> Column:
    """Sign of a hashed token: even last digit is +1, odd is -1."""
    return F.when(F.pmod(value, F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1))


def signed_slots(token_array: Column | str, width: int) -> Column:
    """One signed number per token, ``sign * (slot + 1)``: all the hashing encoder needs."""
    return F.transform(
        F.transform(token_array, token_hash),
        lambda value: hash_sign(value) * (hash_slot(value, width) + 1),
    )

"""The built-in tokenizer: word, number, blank-run and single-character pieces.

Line breaks are always tokens of their own, and the dialect markers end in a line break
or punctuation. No token can therefore cross the border of a rendered piece, so piece-wise
counts and labels equal those of the whole rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN_PATTERN = r"\p{L}+|\p{N}+|[ \t]+|(?s:.)"
ID_BITS = 31  # ids are the low bits of the token's CRC-32: no vocabulary join, no hot-token skew


def token_strings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_id(token: Column) -> Column:
    return F.crc32(token.cast("binary")).bitwiseAND(2**ID_BITS - 1).cast("int")


def token_ids(text: Column) -> Column:
    return F.transform(token_strings(text), token_id)


def token_count(text: Column) -> Column:
    """Number of tokens, without building the ids."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long")


def special_id(token: str | None) -> Column:
    """Id of a special token such as the end-of-document marker (one id, never split)."""
    return F.lit(None).cast("int") if token is None else token_id(F.lit(token))


def estimate_tokens(chars: Column) -> Column:
    """Fallback when no tokenizer is at hand: at least one token, plus template overhead."""
    return F.greatest(F.lit(1), F.floor(chars / F.lit(3.6))).cast("long") + F.lit(32)

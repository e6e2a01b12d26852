"""Column builders for pre-tokens, bytes, token pairs, merges and special tokens. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pre-token pattern. (?U) gives \s, \p{L} and \p{N} their Unicode meaning in Java.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pretokens(text: Column) -> Column:
    """array<string>: the pre-tokens of a text, which concatenate to it; null and empty text have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), F.lit(0)), F.array().cast("array<string>"))


def byte_hex(text: Column) -> Column:
    """array<string>: two lower-case hex digits for each UTF-8 byte; linear in the length."""
    return F.regexp_extract_all(F.lower(F.hex(F.encode(text, "UTF-8"))), F.lit(".."), F.lit(0))


def byte_ids(text: Column) -> Column:
    """array<int>: the UTF-8 bytes of a text."""
    return F.transform(F.coalesce(byte_hex(text), F.array().cast("array<string>")), lambda x: F.conv(x, 16, 10).cast("int"))


def pairs(tokens: Column) -> Column:
    """array<struct<l, r>> of neighbours; empty below two tokens."""
    return F.arrays_zip(
        F.slice(tokens, 1, F.greatest(F.lit(0), F.size(tokens) - 1)).alias("l"),
        F.slice(tokens, 2, F.greatest(F.lit(0), F.size(tokens) - 1)).alias("r"),
    )


def spelled(tokens: Column) -> Column:
    """A token list as one string, `<hex>` for each token: merges become plain replacements."""
    return F.when(F.size(tokens) > 0, F.concat(F.lit("<"), F.array_join(tokens, "><"), F.lit(">"))).otherwise(F.lit(""))


def unspelled(word: Column) -> Column:
    """The token list (hex) of a spelled word."""
    return F.regexp_extract_all(word, F.lit("[0-9a-f]+"), F.lit(0))


def merge_pair(word: Column, left: Column, right: Column) -> Column:
    """A spelled word with all occurrences of a pair merged, left to right and without overlap."""
    return F.replace(word, F.concat(F.lit("<"), left, F.lit("><"), right, F.lit(">")), F.concat(F.lit("<"), left, right, F.lit(">")))


def split_specials(text: Column, specials: list[str]) -> Column:
    """array<string>: a text cut at special tokens, which are kept; the first in the list wins where two match; no empty parts."""
    if not specials:
        return F.filter(F.array(text), lambda p: p != "")
    either = "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in specials)
    # Each special, or the shortest run up to the next one or the end.
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?:{either})|.+?(?={either}|\\z)"), F.lit(0))
    return F.filter(found, lambda p: p != "")


def is_special(part: Column, specials: list[str]) -> Column:
    """Whether a part of split_specials() is a special token itself."""
    return part.isin(*specials) if specials else F.lit(False)


def decoded(token_bytes: Column) -> Column:
    """Text of bytes; invalid UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(token_bytes.cast("string"))

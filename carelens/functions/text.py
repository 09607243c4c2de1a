"""Text normalisation (strip like Python's ``str.strip``, blank -> NULL, alias maps)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

# The characters Python's ``str.strip()`` removes, derived from ``str.isspace``
# (Unicode White_Space plus the four information separators).
WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace exactly as ``str.strip()`` (a character-set trim, no regex)."""
    return F.trim(c, F.lit(WHITESPACE))


def tidy(text: Column) -> Column:
    """True for texts that begin and end with a visible ASCII character (texts compare by their bytes)."""
    last = F.substring(text, -1, 1)
    return (text >= "!") & (text < "\x7f") & (last >= "!") & (last < "\x7f")


def normalize_text(c: Column) -> Column:
    """Strip surrounding whitespace; an empty result becomes NULL.

    Most texts begin and end with a visible ASCII character: those stay as they are, without the slow trim.
    """
    text = c.cast("string")
    return F.when(tidy(text), text).otherwise(F.nullif(strip(text), F.lit("")))


def null_tokens_to_null(c: Column, tokens: Iterable[str]) -> Column:
    """Fields whose raw text is a null token become NULL (checked before trimming)."""
    return F.when(~c.isin(*tokens) | c.isNull(), c)


def lookup(c: Column, mapping: Mapping, value_type: str | None = None) -> Column:
    """``mapping[c]`` as a CASE chain (code-generated equality tests); missing keys give NULL."""
    out = None
    for key, value in mapping.items():
        out = (F.when(c == F.lit(key), F.lit(value)) if out is None
               else out.when(c == F.lit(key), F.lit(value)))
    if out is None:
        out = F.lit(None)
    return out.cast(value_type) if value_type else out


def canonical_text(text: Column, aliases: Mapping[str, str]) -> Column:
    """Case-insensitive alias lookup on already-normalised text; unknown values stay as they are."""
    return F.coalesce(lookup(F.upper(text), aliases), text)


def canonicalize(c: Column, aliases: Mapping[str, str]) -> Column:
    """Normalise raw text, then apply the alias map."""
    return canonical_text(normalize_text(c), aliases)


def _plain_letters() -> tuple[str, str]:
    """(accented lower-case letters, their letters without accents), from their canonical decompositions."""
    accented, plain = [], []
    for code in range(0x80, 0x2E80):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        base = "".join(x for x in parts if not unicodedata.combining(x))
        if len(parts) > len(base) == 1 and c == c.lower():
            accented.append(c)
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _plain_letters()
_MARKS = "".join(chr(code) for code in range(0x300, 0x370))


def fold(c: Column) -> Column:
    """A key under which texts are equal that differ only in case, accents or trailing blanks.

    It compares as the source's collation does, and being a plain string it can be stored and pushed to a scan.
    """
    return F.rtrim(fold_letters(c))


def fold_letters(c: Column) -> Column:
    """``fold`` that keeps trailing blanks, for patterns."""
    # characters without a counterpart (combining marks) are dropped
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), _ACCENTED + _MARKS, _PLAIN)

"""Text expressions. All stay JVM-side and inside code generation."""

from __future__ import annotations

import operator
import re
import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What str.strip() and str.split() take as white space.
WHITE = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())
ASCII_WHITE = r"\t-\r\x{1c}-\x{20}"
EXOTIC_WHITE = "".join(ch for ch in WHITE if ord(ch) > 0x7F)

BOM = "\ufeff"
BOM_AS_LATIN1 = "ï»¿"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """(from, to) for ``translate``: accented letters to their base, then marks to nothing."""
    letters, bases, marks = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category == "Mn":
            marks.append(ch)
        elif category[0] != "C" and unicodedata.decomposition(ch):
            nfd = unicodedata.normalize("NFD", ch)
            base = [part for part in nfd if unicodedata.category(part) != "Mn"]
            if nfd != ch and len(base) == 1:
                letters.append(ch)
                bases.append(base[0])
    return "".join(letters) + "".join(marks), "".join(bases)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), *_folding())


def fold_long(text: Column) -> Column:
    """``fold`` for long texts: plain ASCII skips the table look-up.

    It mentions its input four times, so keep it in a projection of its own.
    """
    lowered = F.lower(text)
    plain = F.octet_length(lowered) == F.char_length(lowered)
    return F.when(plain, lowered).otherwise(F.translate(lowered, *_folding()))


def fold_text(text: str) -> str:
    """``fold`` for a driver-side constant."""
    source, target = _folding()
    table = dict(zip(source, target)) | dict.fromkeys(source[len(target):], "")
    return text.lower().translate(str.maketrans(table))


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 that was read as Latin-1, where the bytes are valid UTF-8.

    No damage count is needed: a repaired ``Ã`` or ``ï`` comes from two bytes
    of which the first already showed as ``Ã``, so a repair never adds marks.
    """
    clean = F.replace(F.replace(text, F.lit(BOM), F.lit("")), F.lit(BOM_AS_LATIN1), F.lit(""))
    as_bytes = F.when(~clean.rlike(r"[^\x{00}-\x{FF}]"), F.encode(clean, "ISO-8859-1"))
    return strip(F.coalesce(F.try_validate_utf8(as_bytes.cast("string")), clean))


def repair_text(text: str) -> str:
    """``repair_mojibake`` for a header name on the driver."""
    clean = text.replace(BOM, "").replace(BOM_AS_LATIN1, "")
    try:
        return clean.encode("latin-1").decode("utf-8").strip()
    except UnicodeError:
        return clean.strip()


def clean_cell(text: Column) -> Column:
    """Drop byte-order marks and outer white space."""
    return strip(F.replace(text, F.lit(BOM), F.lit("")))


def _plain_spaces(text: Column) -> Column:
    """Stripped text with ASCII white space only, which a small character class can match."""
    bare = strip(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, bare).otherwise(
        F.translate(bare, EXOTIC_WHITE, " " * len(EXOTIC_WHITE))
    )


def ws_rejoin(text: Column, trailing: bool = True) -> Column:
    """Words joined by one space; the word-by-word reply keeps a space after the last.

    The pattern matches only what changes: a lone space is left alone.
    """
    change = rf"[\t-\r\x{{1c}}-\x{{1f}}][{ASCII_WHITE}]*| [{ASCII_WHITE}]+"
    joined = F.regexp_replace(_plain_spaces(text), change, " ")
    if not trailing:
        return joined
    return F.concat(joined, F.when(strip(text) == "", F.lit("")).otherwise(F.lit(" ")))


def words(text: Column) -> Column:
    """White-space tokens of the whole text; an empty text has none."""
    none = F.array().cast("array<string>")
    return F.when(strip(text) == "", none).otherwise(
        F.split(_plain_spaces(text), f"[{ASCII_WHITE}]+")
    )


# Up to here a chain of byte searches beats one pattern with many branches.
MAX_CHAIN = 64


def _checked(terms) -> list[str]:
    terms = list(dict.fromkeys(fold_text(t) for t in terms))
    if not terms or any(not t.strip() for t in terms):
        raise ValueError("need one or more terms, none of them blank")
    return terms


def _any_of(folded: Column, terms: list[str]) -> Column:
    """Some term occurs; a term that holds a shorter one adds nothing."""
    core = [t for t in terms if not any(o != t and o in t for o in terms)]
    if len(core) > MAX_CHAIN:
        return folded.rlike("|".join(map(re.escape, core)))
    return reduce(operator.or_, [F.contains(folded, F.lit(t)) for t in core])


def contains_any(folded: Column, terms, mode: str = "substring") -> Column:
    """True where a folded text holds one of the terms (folded here).

    ``substring`` hits inside longer words; ``word`` asks for word limits and
    runs its pattern only on texts with a substring hit. The input is
    mentioned many times: pass a column, not a long expression.
    """
    terms = _checked(terms)
    found = _any_of(folded, terms)
    if mode == "substring":
        return found
    if mode == "word":
        return found & as_words(folded, terms)
    raise ValueError(f"unknown mode {mode!r}")


def as_words(folded: Column, terms) -> Column:
    """One of the terms stands between word limits."""
    body = "|".join(re.escape(t) for t in _checked(terms))
    return folded.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{body})(?![\p{{L}}\p{{N}}])")


def matched_terms(folded: Column, terms, mode: str = "substring") -> Column:
    """The terms found, in list order."""
    terms = _checked(terms)
    if len(terms) <= MAX_CHAIN:
        hits = [F.when(contains_any(folded, [t], mode), F.lit(t)) for t in terms]
        return F.array_compact(F.array(*hits))
    # A long list is a literal array that one expression walks.
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(folded, t))
    if mode == "substring":
        return found
    limits = "(?<![\\p{L}\\p{N}])", "(?![\\p{L}\\p{N}])"
    quoted = lambda t: F.concat(F.lit(limits[0] + "\\Q"), t, F.lit("\\E" + limits[1]))
    return F.filter(found, lambda t: F.rlike(folded, quoted(t)))

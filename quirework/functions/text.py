"""Scalar text functions: normalisation, escaping, cell repair, style bits, byte-string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOLD, ITALICS, SERIF, MONOSPACED = 1, 2, 4, 8
DASHES = "­‐‑‒–—―−"
# Letters with marks and their base forms; and letters that stand for several.
_MARKED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ"
_BASE = "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC"
_LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "ﬁ": "fi", "ﬂ": "fl", "Æ": "AE", "Œ": "OE"}


def normalise(s: Column) -> Column:
    """Control characters and hard spaces become spaces, dashes ``-``, letters with marks their base forms."""
    s = F.regexp_replace(s, r"[\x00-\x1F\x7F ]", " ")
    s = F.translate(s, DASHES + _MARKED, "-" * len(DASHES) + _BASE)
    for letter, plain in _LIGATURES.items():
        s = F.replace(s, F.lit(letter), F.lit(plain))
    return s


def join_hyphen(s: Column) -> Column:
    return F.regexp_replace(s, "-$", "")


def all_caps(s: Column) -> Column:
    return s == F.upper(s)


def fix_number(s: Column) -> Column:
    """A cell that reads as a bare fraction gets its leading zero: ``. 25`` is ``0.25``."""
    return F.regexp_replace(s, r"^\.\s*([0-9]+)$", "0.$1")


def csv_cell(s: Column, separator: str = ",") -> Column:
    """Quotes doubled; ``,`` and ``;`` always quote; other separators quote only where needed; empty is ``""``."""
    s = F.coalesce(s, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    if separator in ",;":
        return quoted
    return F.when((s == "") | s.contains('"') | s.contains(separator), quoted).otherwise(s)


def xml_escape(s: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(plain), F.lit(entity))
    return s


def has_style(bits: Column, style: int) -> Column:
    return bits.bitwiseAND(F.lit(style)) != 0


def with_style(bits: Column, style: int, on: bool = True) -> Column:
    return bits.bitwiseOR(F.lit(style)) if on else bits.bitwiseAND(F.lit(~style))


def cell_tag(region_type: Column, header: Column) -> Column:
    """Element name of a region type: cells by header flag, rows ``tr``, columns none, others themselves."""
    return (
        F.when(region_type == "tableCell", F.when(header, "th").otherwise("td"))
        .when(region_type == "tableRow", "tr").when(region_type == "tableCol", F.lit(None)).otherwise(region_type)
    )


def full_match(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def hyphenated(s: Column, following: Column) -> Column:
    """A word ends in a hyphen and the next begins in lower case (no dictionary is consulted)."""
    return s.rlike(r"\p{L}-$") & following.rlike(r"^\p{Ll}")


def line_end_trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"[\r\n]+$", "")

"""Object identities: hash of a type name, 128-bit local ids in hex, and their XOR with the document's id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.geometry import Box, box_text


def name_hash(s: Column) -> Column:
    """The 32-bit string hash h = 31 h + c over UTF-16 units, as a non-negative long (for basic-plane text)."""
    codes = F.transform(F.split(s, ""), F.ascii)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))


def hex_low(v: Column, digits: int) -> Column:
    return F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(16**digits))), digits, "0")


def local_uid(type_: Column, first_page: Column, last_page: Column, x: Box) -> Column:
    """32 hex digits: type hash, first and last page, left, top, right, bottom. Boxes on one page have last page -1."""
    return F.concat(
        hex_low(name_hash(type_), 8), hex_low(first_page, 4), hex_low(last_page, 4), hex_low(x.l, 4), hex_low(x.t, 4),
        hex_low(x.r, 4), hex_low(x.b, 4),
    )


def document_key(doc_id: Column) -> Column:
    """A document id as 32 hex digits; other ids are replaced by their hash, four times."""
    s = doc_id.cast("string")
    return F.when(s.rlike("^[0-9A-Fa-f]{32}$"), F.upper(s)).otherwise(F.repeat(hex_low(name_hash(s), 8), 4))


def uuid(uid: Column, doc_id: Column) -> Column:
    key = document_key(doc_id)
    parts = []
    for i in range(4):
        a, b = (F.conv(F.substring(x, 8 * i + 1, 8), 16, 10).cast("long") for x in (uid, key))
        parts.append(hex_low(a.bitwiseXOR(b), 8))
    return F.concat(*parts)


def layout_id(type_: Column, page: Column, x: Box) -> Column:
    return F.concat(type_, F.lit("@"), page.cast("string"), F.lit("."), box_text(x))


def annotation_id(type_: Column, first: Column, last: Column, separator: str = "@") -> Column:
    return F.concat(type_, F.lit(separator), first, F.lit("-"), last)

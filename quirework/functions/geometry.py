"""Box predicates and arithmetic on columns.

A box is four integer columns ``l, r, t, b``; right and bottom edges are open
wherever a point is tested against a box.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    l: Column
    r: Column
    t: Column
    b: Column

    @property
    def width(self) -> Column:
        return self.r - self.l

    @property
    def height(self) -> Column:
        return self.b - self.t

    @property
    def area(self) -> Column:
        return self.width.cast("long") * self.height.cast("long")

    @property
    def cx(self) -> Column:
        return halved(self.l + self.r)

    @property
    def cy(self) -> Column:
        return halved(self.t + self.b)


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}") for c in "lrtb"])


def halved(x: Column) -> Column:
    return div(x, F.lit(2))


def div(x: Column, y: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", x, y)


def point_in(x: Column, y: Column, o: Box) -> Column:
    return (x >= o.l) & (x < o.r) & (y >= o.t) & (y < o.b)


def centre_in(i: Box, o: Box) -> Column:
    return point_in(i.cx, i.cy, o)


def contains(o: Box, i: Box) -> Column:
    return (o.l <= i.l) & (i.r <= o.r) & (o.t <= i.t) & (i.b <= o.b)


def overlaps(a: Box, b: Box) -> Column:
    return (a.l < b.r) & (b.l < a.r) & (a.t < b.b) & (b.t < a.b)


def overlap_area(a: Box, b: Box) -> Column:
    w = F.least(a.r, b.r) - F.greatest(a.l, b.l)
    h = F.least(a.b, b.b) - F.greatest(a.t, b.t)
    return F.when((w > 0) & (h > 0), w.cast("long") * h.cast("long")).otherwise(F.lit(0).cast("long"))


def box_text(x: Box) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", x.l, x.r, x.t, x.b), F.lit("]"))


def parse_box(text: Column) -> list[Column]:
    """``l, r, t, b`` of ``[l,r,t,b]``; null where the text isn't a box."""
    whole = r"^\[(-?\d+),(-?\d+),(-?\d+),(-?\d+)\]$"
    found = F.when(text.rlike(whole), text)
    return [F.regexp_extract(found, whole, i + 1).try_cast("int").alias(c) for i, c in enumerate("lrtb")]


def translate(x: Box, dx: Column, dy: Column) -> Box:
    return Box(x.l + dx, x.r + dx, x.t + dy, x.b + dy)


def aggregate_box(x: Box) -> list[Column]:
    """Aggregates of the enclosing box: nulls if it would be empty."""
    l, r, t, b = F.min(x.l), F.max(x.r), F.min(x.t), F.max(x.b)
    real = (l < r) & (t < b)
    return [F.when(real, c).alias(n) for c, n in zip((l, r, t, b), "lrtb")]


def scale(v: Column, own: int, target: int, mode: str = "R") -> Column:
    """A length measured at ``own`` dpi, at ``target`` dpi: rounded (R), down (F) or up (C), by integer arithmetic."""
    plus = {"R": own // 2, "F": 0, "C": own - 1}[mode]
    return div(v * target + plus, F.lit(own))


def scale_box(x: Box, own: int, target: int, mode: str = "R") -> Box:
    """Mode I shrinks to the inside, O grows to the outside, R rounds."""
    low, high = {"R": "RR", "I": "CF", "O": "FC"}[mode]
    return Box(scale(x.l, own, target, low), scale(x.r, own, target, high), scale(x.t, own, target, low), scale(x.b, own, target, high))


def turned(direction: Column, clockwise: bool) -> Column:
    """Text direction after turning by 90 degrees; an absent direction is ``lr``."""
    ring = ["lr", "td", "ud", "bu"]
    step = 1 if clockwise else -1
    at = F.coalesce(direction, F.lit("lr"))
    out = at
    for i, d in enumerate(ring):
        out = F.when(at == d, ring[(i + step) % 4]).otherwise(out)
    return out

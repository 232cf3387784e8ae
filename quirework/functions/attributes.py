"""Attributes of layout objects: fields first, then the open map of further attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.geometry import box, box_text

#: field-backed attributes by name; each gives a string
VIRTUAL: dict[str, Callable[[], Column]] = {
    "documentId": lambda: F.col("doc_id").cast("string"),
    "pageId": lambda: F.col("page_id").cast("string"),
    "boundingBox": lambda: box_text(box()),
    "firstWord": lambda: F.col("first_pos").cast("string"),
    "lastWord": lambda: F.col("last_pos").cast("string"),
    "fontSize": lambda: F.col("font_size").cast("string"),
    "bold": lambda: F.when(F.col("bold"), "true"),
    "string": lambda: F.col("str"),
    "nextRelation": lambda: F.col("rel"),
    "textDirection": lambda: F.coalesce("direction", F.lit("lr")),
}
_NEEDS = {
    "documentId": ("doc_id",), "pageId": ("page_id",), "boundingBox": ("l", "r", "t", "b"), "firstWord": ("first_pos",), "lastWord": ("last_pos",),
    "fontSize": ("font_size",), "bold": ("bold",), "string": ("str",), "nextRelation": ("rel",), "textDirection": ("direction",),
}
_transformers: dict[str, Callable[[Column], Column]] = {}


def transformer(name: str) -> Callable[[Callable[[Column], Column]], Callable[[Column], Column]]:
    """Register a function that every value of an attribute passes through."""

    def register(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        _transformers[name] = f
        return f

    return register


def attribute(items: DataFrame, name: str, default: str | None = None) -> Column:
    """An attribute of each row: the field if the table has it, else the entry of ``attrs``, else the default."""
    values = []
    if name in VIRTUAL and all(c in items.columns for c in _NEEDS[name]):
        values.append(VIRTUAL[name]())
    if "attrs" in items.columns:
        values.append(F.try_element_at("attrs", F.lit(name)))
    value = F.coalesce(*values, F.lit(default).cast("string"))
    return _transformers[name](value) if name in _transformers else value


def names_of(items: DataFrame) -> Column:
    """Sorted names of the attributes that a row has."""
    fields = [F.when(VIRTUAL[n]().isNotNull(), n) for n in VIRTUAL if all(c in items.columns for c in _NEEDS[n])]
    own = F.array_compact(F.array(*fields)) if fields else F.array().cast("array<string>")
    if "attrs" in items.columns:
        own = F.array_union(own, F.coalesce(F.map_keys("attrs"), F.array().cast("array<string>")))
    return F.array_sort(own)


def set_attributes(items: DataFrame, values: dict[str, str], replace: bool = True) -> DataFrame:
    """Entries added to ``attrs``; without ``replace`` those that are there stay."""
    new = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    old = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    loser, winner = (old, new) if replace else (new, old)
    kept = F.map_filter(loser, lambda k, v: ~F.map_contains_key(winner, k))
    return items.withColumn("attrs", F.map_concat(kept, winner))


def remove_attributes(items: DataFrame, *names: str) -> DataFrame:
    return items.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.isin(*names)))

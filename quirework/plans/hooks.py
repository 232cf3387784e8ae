"""Registries of pluggable parts: page-feature anchors, tokenizers and page-image stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Anchor = Callable[[DataFrame, dict], DataFrame]
_anchors: dict[str, Anchor] = {}
_tokenizers: dict[str, Callable[[Column], Column]] = {}
_images: list[tuple[int, str, Callable[[DataFrame], DataFrame]]] = []


def anchor(kind: str) -> Callable[[Anchor], Anchor]:
    def register(f: Anchor) -> Anchor:
        _anchors[kind] = f
        return f

    return register


def match_anchor(words: DataFrame, parameters: dict) -> DataFrame:
    """``doc_id, matches`` of the anchor that the parameters' ``kind`` names (page features unless given)."""
    return _anchors[parameters.get("kind", "pageFeature")](words, parameters)


@anchor("pageFeature")
def page_feature(words: DataFrame, p: dict) -> DataFrame:
    from quirework.operators.styles import anchor_matches

    return anchor_matches(
        words, p["area"], p["pattern"], p.get("dpi", 72), p.get("minFontSize", 0), p.get("maxFontSize", 72), p.get("bold"),
        p.get("allCaps", False), p.get("maxPageId", 0),
    )


def tokenizer(name: str) -> Callable[[Callable[[Column], Column]], Callable[[Column], Column]]:
    def register(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        _tokenizers[name] = f
        return f

    return register


@tokenizer("default")
def inner_punctuation(text: Column) -> Column:
    """Words with inner marks, numbers, and single other characters."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}+(?:['’-]\p{L}+)*|[0-9]+(?:[.,][0-9]+)*|[^\s\p{L}0-9]"), F.lit(0))


@tokenizer("space")
def white_space(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def tokenized(text: Column, name: str = "default") -> Column:
    return _tokenizers[name](text)


def image_store(name: str, priority: int = 0) -> Callable:
    """Register a function from pages to rows ``doc_id, page_id, payload``; higher priority is asked first."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        _images.append((-priority, name, f))
        _images.sort(key=lambda x: x[:2])
        return f

    return register


def page_images(pages: DataFrame) -> DataFrame:
    """Pages with the payload of the first store that has one."""
    out = pages.withColumn("payload", F.lit(None).cast("binary"))
    for i, (_, _, store) in enumerate(_images):
        p = store(pages).select("doc_id", "page_id", F.col("payload").alias(f"p{i}"))
        out = out.join(p, ["doc_id", "page_id"], "left").withColumn("payload", F.coalesce("payload", f"p{i}")).drop(f"p{i}")
    return out

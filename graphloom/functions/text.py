"""Text expressions. Patterns are Unicode-aware, as ``(?U)`` asks of Java."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def non_empty(c: Column) -> Column:
    """The value, or null if it is an empty string."""
    return F.when(c != "", c)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def brand_key(name: Column) -> Column:
    """The key under which spellings of a brand meet. The order of the steps matters."""
    # fixed values: storefront wording around a brand's name
    for pattern in (r"(?iU)^visit\s+(the\s+)?", r"(?iU)\s+store$", r"(?iU)^by\s+"):
        name = F.regexp_replace(strip(name) if pattern.startswith(r"(?iU)^visit") else name, pattern, "")
    return squeeze(F.lower(name))


def brand_of(details: Column, store: Column) -> Column:
    """The first non-empty of Brand, Manufacturer and store, stripped afterwards: a blank Brand hides the store."""
    raw = F.coalesce(*[non_empty(F.try_element_at(details, F.lit(k))) for k in ("Brand", "Manufacturer")], non_empty(store))
    return non_empty(strip(raw))


def description(title: Column, features: Column, texts: Column) -> Column:
    """Title, the first five features and 500 characters of description."""
    # fixed values: five features, 500 characters
    first = F.array_join(F.slice(F.coalesce(features, F.array().cast("array<string>")), 1, 5), " | ")
    body = F.substring(F.array_join(F.coalesce(texts, F.array().cast("array<string>")), " "), 1, 500)
    return F.concat_ws(" ", *[non_empty(x) for x in (F.coalesce(title, F.lit("")), first, body)])


def as_paths(categories: Column, kind: str) -> Column:
    """Category paths; each member of a flat list is a path of its own."""
    return categories if kind.startswith("array<array") else F.transform(categories, lambda x: F.array(x))

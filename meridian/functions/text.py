"""Text normalisation, hashing, matching and chunking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def content_hash(c: Column) -> Column:
    """SHA-256, in hex, of the stripped lower-cased text."""
    return F.sha2(strip(F.lower(c)), 256)


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(text: Column, terms, lowered: bool = False) -> Column:
    """Whether any term, lower-cased, is a substring of the lower-cased text (no word boundaries);
    ``lowered``: the text is lower-cased already."""
    low = text if lowered else F.lower(text)
    if isinstance(terms, Column):
        return F.coalesce(bound(low, lambda x: F.exists(terms, lambda t: F.contains(x, F.lower(t)))), F.lit(False))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(t.lower())) for t in terms))


#: Chunks are cut from pieces of so many chunks each, and not each from the text's start.
_PIECE = 100


def chunks(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Overlapping chunks of the white-space-collapsed text, as an array."""
    step = size - overlap
    wide = step * _PIECE

    def piece(t: Column, at: Column) -> Column:
        last = F.least(F.lit(_PIECE - 1), F.floor((F.length(t) - 1 - at) / step).cast("int"))
        return bound(F.substring(t, at + 1, F.lit(wide + overlap)), lambda m: F.transform(F.sequence(F.lit(0), last), lambda j: F.substring(m, j * step + 1, F.lit(size))))

    def cut(t: Column) -> Column:
        return F.when(F.length(t) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(wide)), lambda at: piece(t, at)))).otherwise(F.expr("cast(array() as array<string>)"))

    return bound(collapse(F.coalesce(text, F.lit(""))), cut)


def token_passages(text: Column, size: int = 2000) -> Column:
    """Passages of ``size`` white-space tokens, as an array."""
    words = F.filter(F.split(collapse(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    cut = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(size)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))).otherwise(F.expr("cast(array() as array<string>)"))
    return bound(words, cut)


def strip_fence(c: Column) -> Column:
    """A model's answer without the fence of back-ticks around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*```[A-Za-z]*[ \t]*\n?", ""), r"\n?[ \t]*```\s*$", ""))


def json_set(c: Column, key: str, value: Column) -> Column:
    """A flat JSON object with ``key`` set to a text; null or broken objects count as empty. Values
    come out as texts."""
    old = F.coalesce(F.from_json(c, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    others = F.map_filter(old, lambda k, _: k != key)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(key), value.cast("string"))))

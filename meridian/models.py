"""Pluggable model calls with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation verbs by lens.
GENERAL = ("OWNS", "WORKS_FOR", "OPERATES", "LOCATED_IN", "AFFILIATED_WITH", "ALLIED_WITH", "HOSTILE_TO", "ATTACKED", "FOUNDED_BY", "BORN_IN", "SPOKEN_AT", "CRITICIZED", "SUPPORTED")
FINANCIAL = ("INVESTED_IN", "ACQUIRED", "SHORTING", "SUPPLIES", "LITIGATING_AGAINST", "BOARD_MEMBER_OF", "AFFILIATED_WITH", "WORKS_FOR", "FINANCES", "LOBBIED_BY", "FUNDED_BY", "SUED_BY", "MANUFACTURES", "REGULATES", "SUBSIDIARY_OF", "EXECUTIVE_OF")
MILITARY = ("AT_WAR_WITH", "ATTACKED", "HOSTILE_TO", "TARGETING", "DEPLOYED_TO", "COMMANDS", "SANCTIONED_BY", "ALLIED_WITH", "OPERATES", "AFFILIATED_WITH", "SUPPLIED_ARMS_TO", "TRAINED_BY", "OCCUPYING", "DEFENDING", "BOMBED")
INVESTIGATIVE = ("FLEW_ON", "VISITED_RESIDENCE", "PHOTOGRAPHED_WITH", "MENTIONED_IN_TESTIMONY", "EMPLOYED_BY", "FINANCED_BY", "SUBPOENAED", "ASSOCIATED_WITH", "LEGAL_COUNSEL_FOR")
VOCABULARY = frozenset((*GENERAL, *FINANCIAL, *MILITARY, *INVESTIGATIVE))


def lens(category: Column) -> Column:
    """The verbs that a mission category offers."""
    verbs = lambda v: F.array(*map(F.lit, v))
    return F.when(category.isin("FINANCIAL", "TECH_FINANCE"), verbs(FINANCIAL)).when(category == "MILITARY", verbs(MILITARY)).otherwise(verbs(GENERAL))


def embed_text(text: str | None, size: int = 64) -> list[float]:
    """Hashed character trigrams, L2-normalised; null or empty text: no vector."""
    if not text:
        return []
    out = [0.0] * size
    low = f" {text.lower()} "
    for i in range(len(low) - 2):
        h = int.from_bytes(hashlib.blake2b(low[i : i + 3].encode(), digest_size=8).digest(), "little")
        out[h % size] += 1.0 if h >> 63 else -1.0
    length = sum(x * x for x in out) ** 0.5
    return [x / length for x in out] if length else []


def embedder(fn: Callable[[str | None], list[float]] = embed_text):
    """A pandas UDF around an embedding function; a failing text gives an empty vector."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return fn(t)
            except Exception:  # noqa: BLE001  a model failure is an empty result by contract
                return []

        return s.map(one)

    return run


def extract(text: str | None, gazetteer: dict[str, str]) -> list[dict]:
    """Entities by a gazetteer of name to type, in order of first mention."""
    found = []
    for name, kind in gazetteer.items():
        m = re.search(rf"(?<!\w){re.escape(name)}(?!\w)", text or "")
        if m:
            found.append((m.start(), {"name": name, "type": "LOCATION" if kind == "GPE" else kind}))
    return [x for _, x in sorted(found, key=lambda x: x[0])]


def extractor(gazetteer: dict[str, str]):
    """A pandas UDF of ``extract``: a text's entities in order of first mention. A failing text gives
    none."""

    @F.pandas_udf("array<struct<name:string,type:string>>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return extract(t, gazetteer)
            except Exception:  # noqa: BLE001  a model failure is an empty result by contract
                return []

        return s.map(one)

    return run


def same_entity(a: Column, b: Column) -> Column:
    """Offline verification: names equal apart from case, or a short edit apart."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x == y) | (F.levenshtein(x, y) <= F.greatest(F.lit(1), F.floor(F.least(F.length(x), F.length(y)) / 5)))

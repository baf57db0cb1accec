"""Language identification by language-bitmask n-gram filters.

Training counts byte trigrams per language over all labelled training rows. A trigram with at least
``min_share`` of its language's trigrams belongs to the language, so a language has at most
1 / min_share of them, whatever the corpus. All languages share one Bloom filter whose cells are
bit masks, one bit a language: the AND of a trigram's ``HASHES`` cells gives every language that
contains it at once. A text's popcount of a language, corrected for that filter slice's false
positives, is the share of its trigrams that the language knows; the largest share decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import LOWER, mix64, slices, stored, table, texts

HASHES = 3
UNKNOWN = "und"
_LETTER = re.compile(rb"[A-Za-z]")


def _grams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))


def _padded(t: bytes) -> bytes:
    return b" " + t.translate(LOWER) + b" "


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) of ``labelled`` (text, lang): counts of byte trigrams, summed over all rows."""

    def run(batches):
        parts: dict[str, list] = {}
        sums: dict[str, tuple] = {}

        def fold(lang):
            found = np.bincount(np.concatenate(parts.pop(lang)), minlength=1)
            keys = np.flatnonzero(found)
            if lang in sums:
                both = np.concatenate((sums[lang][0], keys))
                keys, at = np.unique(both, return_inverse=True)
                sums[lang] = keys, np.bincount(at, np.concatenate((sums[lang][1], found[found > 0]))).astype(np.int64)
            else:
                sums[lang] = keys, found[keys]

        waiting: dict[str, int] = {}
        for batch in slices(batches):
            for t, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                g = _grams(_padded(t))
                parts.setdefault(lang, []).append(g)
                waiting[lang] = waiting.get(lang, 0) + len(g)
                if waiting[lang] > 2_000_000:
                    fold(lang)
                    waiting[lang] = 0
        for lang in list(parts):
            fold(lang)
        for lang, (keys, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return labelled.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class BitmaskFilter:
    """The bit-sliced Bloom filter: ``cells`` is (words of 64 languages, cells)."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray]) -> None:
        self.langs = langs
        most = max((len(g) for g in grams.values()), default=1)
        self.bits = max(12, int(np.ceil(np.log2(12 * most + 1))))
        self.cells = np.zeros((max(1, -(-len(langs) // 64)), 1 << self.bits), np.uint64)
        for i, lang in enumerate(langs):
            for at in self._places(grams[lang]):
                self.cells[i // 64, at] |= np.uint64(1 << (i % 64))
        fill = np.array([((self.cells[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.false = fill**HASHES

    def _places(self, grams: np.ndarray):
        h = mix64(grams.astype(np.uint64) + np.uint64(0x51ED270B7A1F))
        for k in range(HASHES):
            yield ((h >> np.uint64(20 * k)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def shares(self, data: bytes) -> np.ndarray:
        """Corrected share of the trigrams of ``data`` in each language."""
        grams, n = np.unique(_grams(data), return_counts=True) if len(data) > 1 << 14 else (_grams(data), None)
        places = list(self._places(grams))
        total = max(1, int(n.sum()) if n is not None else len(grams))
        out = np.empty(len(self.langs))
        for w in range(len(self.cells)):
            mask = self.cells[w, places[0]]
            for at in places[1:]:
                mask = mask & self.cells[w, at]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                has = (mask >> np.uint64(i % 64)) & np.uint64(1)
                count = np.count_nonzero(has) if n is None else int(n[has > 0].sum())
                out[i] = (count / total - self.false[i]) / max(1e-9, 1 - self.false[i])
        return np.clip(out, 0.0, 1.0)

    def predict(self, t: bytes | None) -> tuple[str, float]:
        """Language and share; ``und`` for null texts, texts without a letter, or no language."""
        if not t or not self.langs or not (_LETTER.search(t) or any(c.isalpha() for c in t.decode())):
            return UNKNOWN, 0.0
        got = self.shares(_padded(t))
        best = int(got.argmax())
        return self.langs[best], float(got[best])


def train(labelled: DataFrame, min_share: float = 2e-5) -> BitmaskFilter:
    """The filter of ``labelled`` (text, lang); null texts or languages teach nothing."""
    counts = stored(gram_counts(labelled.where("text is not null and lang is not null").select("text", "lang")), "language-grams")
    # one row a language, joined back: no task gets a whole language
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = counts.join(total, "lang").where(F.col("n") / F.col("total") >= min_share).select("lang", "gram").collect()
    grams: dict[str, list[int]] = {}
    for lang, gram in rows:
        grams.setdefault(lang, []).append(gram)
    langs = sorted(grams)
    return BitmaskFilter(langs, {k: np.array(sorted(v), np.uint64) for k, v in grams.items()})


def identify(docs: DataFrame, model: BitmaskFilter, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (replaced if there).

    Predictions read nothing but the text; ``keep_text=False`` leaves that column out. Ties go to
    the first language by name. Null or letterless texts get (``und``, 0.0); empty tables, repeated
    rows and nulls elsewhere pass as they are.
    """
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    kept = [c for c in names if keep_text or c != text]

    def run(batches):
        for batch in slices(batches):
            got = [held.value.predict(t) for t in texts(batch.column(names.index(text)))]
            same = [batch.column(names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*same, pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], [*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.select(*kept).schema.add("lang_pred", "string").add("score", "double"))


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_query(spark, sf_dir: str) -> DataFrame:
    """op8: language of all documents, taught by those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model, keep_text=False)

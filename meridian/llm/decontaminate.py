r"""Benchmark decontamination with an FM-index per training shard.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A task cuts its
documents into shards of about ``shard_words`` words and indexes each shard: words that no test
phrase holds can lie inside no occurrence, so they become separators, and what stands between
separators is indexed if it is as long as the shortest phrase. The index is a suffix array by prefix
doubling, its Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled at every
``sample``-th word and at each run's start. All test phrases (windows of ``window`` consecutive
words, shorter items whole) are searched backward together through wavelet ranks; occurrences are
located by LF steps to a sampled position and merged to removal spans.

The test set is read in blocks of a bounded number of words; each block is one pass over all rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import table, texts

#: Word bytes stay (A-Z lower-cased), all others become a blank.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, lower-cased; null: none."""
    return text.translate(_WORDS).split() if text else []


class WaveletMatrix:
    """Rank and access over an integer sequence, a bit plane a level."""

    def __init__(self, seq: np.ndarray, levels: int) -> None:
        self.levels, self.ones, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, at = np.zeros_like(at), at.copy()
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            low1, at1 = ones[low], ones[at]
            low, at = np.where(bit, zeros + low1, low - low1), np.where(bit, zeros + at1, at - at1)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the places."""
        out, at = np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            here = ones[at]
            bit = ones[at + 1] - here
            out = out * 2 + bit
            at = np.where(bit, zeros + here, at - here)
        return out


class FMIndex:
    """Index of a sequence of symbols 1.. in which 0 separates runs; it must end with 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16) -> None:
        n = len(text)
        gaps = text == 0
        # separators differ from each other, so comparisons end at the next one
        rank = np.where(gaps, np.cumsum(gaps) - 1, text.astype(np.int64) + int(gaps.sum()))
        order, step = np.argsort(rank, kind="stable"), 0
        while True:
            sorted_ranks = rank[order]
            dense = np.empty(n, np.int64)
            dense[order] = np.cumsum(np.concatenate(([0], sorted_ranks[1:] != sorted_ranks[:-1])))
            if n == 0 or dense[order[-1]] == n - 1:
                break
            step = step * 2 or 1
            after = np.zeros(n, np.int64)
            after[: n - step] = dense[step:] + 1 if step < n else 0
            rank = dense * (n + 1) + after
            order = np.argsort(rank, kind="stable")
        before = text[order - 1].astype(np.int64)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        self.wavelet = WaveletMatrix(before, max(1, int(symbols).bit_length()))
        marked = (order % sample == 0) | (before == 0)
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.samples = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array intervals [low, high) of each row of ``phrases``; empty where low == high."""
        last = phrases[:, -1]
        low, high = self.below[last].copy(), self.below[last + 1].copy()
        live = np.flatnonzero(low < high)
        for k in range(phrases.shape[1] - 2, -1, -1):
            if not len(live):
                break
            c = phrases[live, k]
            both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.below[c] + both[: len(c)], self.below[c] + both[len(c) :]
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by LF steps to a sampled one."""
        at, steps, out = rows.copy(), np.zeros_like(rows), np.empty_like(rows)
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            done = self.marks[here + 1] > self.marks[here]
            out[live[done]] = self.samples[self.marks[here[done]]] + steps[live[done]]
            live, here = live[~done], here[~done]
            c = self.wavelet.access(here)
            at[live] = self.below[c] + self.wavelet.rank(c, here)
            steps[live] += 1
        return out


class Phrases:
    """A block of the test set: vocabulary, distinct phrases by length, and the items of each."""

    def __init__(self, items: list[tuple], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = [x for x, _ in items]
        phrases: dict[tuple, set] = {}
        for k, (_, words) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                phrases.setdefault(tuple(ids[i : i + window]), set()).add(k)
        self.tables = []
        for size in sorted({len(p) for p in phrases}):
            rows = [p for p in phrases if len(p) == size]
            self.tables.append((np.array(rows, np.int64), [sorted(phrases[p]) for p in rows]))
        self.shortest = min((len(p) for p in phrases), default=0)


def _shard_hits(docs: list[list[bytes]], block: Phrases, sample: int) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
    """Per document: the merged word spans (start, end) that hold occurrences, and the items seen."""
    spans, seen = [[] for _ in docs], [set() for _ in docs]
    sizes = np.array([len(d) for d in docs], np.int64)
    total = int(sizes.sum())
    if not total or not block.shortest:
        return spans, seen
    get = block.vocabulary.get
    ids = np.fromiter((i for d in docs for i in map(get, d, repeat(0))), np.int64, total)
    # runs of known words within a document
    inside = np.concatenate(([False], ids > 0, [False]))
    starts_doc = np.zeros(total + 1, bool)
    starts_doc[np.cumsum(sizes)[:-1]] = True
    starts_doc[0] = True
    known = ids > 0
    begin = np.flatnonzero(known & (starts_doc[:-1] | ~inside[:-2]))
    end = np.flatnonzero(known & (np.concatenate((starts_doc[1:-1], [True])) | ~inside[2:])) + 1
    long = end - begin >= block.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return spans, seen
    size = end - begin
    place = np.cumsum(size + 1) - (size + 1)  # where each run starts in the indexed text
    text = np.zeros(int((size + 1).sum()), np.int64)
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(place, size) + offset] = ids[np.repeat(begin, size) + offset]
    index = FMIndex(text, len(block.vocabulary), sample)
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    first = np.cumsum(sizes) - sizes
    cover = np.zeros(total + 1, np.int64)
    for phrases, owners in block.tables:
        low, high = index.search(phrases)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        if not len(which):
            continue
        rows = np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        at = index.locate(rows)
        run = np.searchsorted(place, at, side="right") - 1
        word = begin[run] + at - place[run]
        np.add.at(cover, word, 1)
        np.add.at(cover, word + phrases.shape[1], -1)
        for d, p in {*zip(doc_of[word].tolist(), which.tolist(), strict=True)}:
            seen[d].update(owners[p])
    hit = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
    cut = np.append(starts_doc[:-1], True)
    left = np.flatnonzero(hit[1:-1] & (~hit[:-2] | cut[:-1]))
    right = np.flatnonzero(hit[1:-1] & (~hit[2:] | cut[1:])) + 1
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        d = int(doc_of[a])
        spans[d].append((a - int(first[d]), b - int(first[d])))
    return spans, seen


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shard_words: int = 1_000_000, sample: int = 16, block_words: int = 500_000, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (``keep_text=False``: but the text) plus ``n_words``, ``hit_words``
    (merged word spans in occurrences), ``removal`` (the same in code points) and ``items`` (ids of
    items with occurrences, sorted as strings); columns of these names are replaced.

    Null and wordless texts have no words and no hits; null or wordless items match nothing; items
    with a null id mark words but are not listed. An empty test set leaves everything clean.
    Repeated rows are judged each by itself.
    """
    names = ("n_words", "hit_words", "removal", "items")
    spark = docs.sparkSession
    docs = docs.drop(*names)
    rows = bench.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    # a block is about block_words words (6 bytes each); a hash of the item deals them out
    blocks = max(1, -(-total // (6 * block_words)))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.lit(None).cast("array<struct<start:long,end:long>>"), "removal": F.lit(None).cast("array<struct<start:long,end:long>>"), "items": F.array().cast("array<string>")})
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else rows
        held = spark.sparkContext.broadcast(Phrases([(i, words_of(t.encode())) for i, t in part.collect()], window))
        out = _search_pass(out, held, text, shard_words, sample, keep_text or k < blocks - 1)
    return out


def _search_pass(docs: DataFrame, held, text: str, shard_words: int, sample: int, keep_text: bool) -> DataFrame:
    columns = docs.columns
    kept = [c for c in columns if keep_text or c != text]

    def shard(parts: list) -> pa.Table:
        data = pa.Table.from_batches(parts)
        bodies = texts(data.column(text))
        split = [words_of(t) for t in bodies]
        block = held.value
        spans, seen = _shard_hits(split, block, sample)
        old_spans, old_items = data.column("hit_words").to_pylist(), data.column("items").to_pylist()
        removal, items = [], []
        for i, old in enumerate(old_spans):
            if old:
                spans[i] = _merged(spans[i] + [(x["start"], x["end"]) for x in old])
            items.append(sorted({*old_items[i], *(x for k in seen[i] if (x := block.items[k]) is not None)}))
            if spans[i]:
                at = [m.span() for m in _WORD.finditer(bodies[i].decode())]
                removal.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in spans[i]])
            else:
                removal.append([])
        made = {"n_words": pa.array([len(w) for w in split], pa.int64()), "hit_words": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS), "removal": pa.array(removal, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}
        return pa.table({c: made.get(c, data.column(c) if c not in made else None) for c in kept})

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            # about 6 bytes a word
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                waiting.append(piece)
                size += piece.column(columns.index(text)).nbytes // 6 if piece.num_rows else 0
                if size >= shard_words:
                    yield from shard(waiting).to_batches()
                    waiting, size = [], 0
        if waiting:
            yield from shard(waiting).to_batches()

    return docs.mapInArrow(run, docs.select(*kept).schema)


def removed(text, spans):
    """``text`` without the removal spans: DataFrame columns in, column out."""
    keep = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))).alias("out")))
    return F.when(F.size(spans) > 0, F.concat(keep["out"], F.substring(text, (keep["at"] + 1).cast("int"), F.length(text)))).otherwise(text)


def hit_count():
    """Words of ``hit_words``, and the contamination rule: a twentieth of all words."""
    n = F.aggregate("hit_words", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return n, (n > 0) & (20 * n >= F.col("n_words"))


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    """op3: contamination of all documents by all benchmark items."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    n, dirty = hit_count()
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), dirty.alias("contaminated"))


def sha_items(items: list[str]) -> str:
    """The digest of a list of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

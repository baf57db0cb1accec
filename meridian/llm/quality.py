"""Quality rules: an isolation forest on rule statistics.

Per document the rules' statistics are measured over the whole text. Trees of random splits are
grown on a bounded sample of rows (``trees`` times ``leaf_sample``, the smallest hashes of the id); a
document's mean path length gives its anomaly score in every tree. The threshold is calibrated over
all labelled rows: of the thresholds that reject at most ``lost`` of the good documents, the one that
rejects most bad ones. Documents that fail a base rule go whatever their score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import hashed_sample, mix64, stored, table, texts

#: Words found twice or more within windows of so many.
REPEAT_WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_K = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_upper", "n_lines", "n_bang")
_SPACES = b" \t\n\x0b\x0c\r"


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The rule statistics of a text, in the order of ``COUNTS`` and ``_MORE``; null: zeros."""
    if not text:
        return (0,) * (len(COUNTS) + len(_MORE))
    words = text.split()
    n = len(words)
    code_points = len(text) if text.isascii() else len(text.decode())
    chars = code_points - (len(text) - len(text.translate(None, _SPACES)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = text.split(b"\n")
    seen, dup, full = set(), 0, 0
    for line in lines:
        if line and not line.isspace():
            full += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n) if n else np.empty(0, np.uint64)
    if n > REPEAT_WINDOW:
        w = np.zeros(n - REPEAT_WINDOW + 1, np.uint64)
        for i in range(REPEAT_WINDOW):
            w = w * _K + h[i : n - REPEAT_WINDOW + 1 + i]
        w = mix64(w)
        order = np.argsort(w)
        s = w[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            cover[at] += 1
            np.subtract.at(cover, at + REPEAT_WINDOW, 1)
            repeat = int((np.cumsum(cover[:-1]) > 0).sum())
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    bang = len(text) - len(text.translate(None, b"!?"))
    return n, chars, symbols, dup, repeat, upper, full, bang


def features(c: dict) -> np.ndarray:
    """Feature rows from columns of counts: shares that clean prose of any length keeps alike.
    Repeats count from the share on that prose with a boilerplate line or two has anyway."""
    n, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    over = lambda share: np.maximum(0.0, share - 0.25)
    # short texts scatter: shares are shrunk towards nothing by some pseudo-counts
    return np.column_stack([np.minimum(chars / n, 40), c["n_symbols"] / (chars + 100), over(c["n_dup_lines"] / (lines + 2)), over(c["n_repeat_words"] / (n + 20)), np.maximum(0.0, c["n_upper"] / (chars + 100) - 0.05), c["n_bang"] / (chars + 100)]).astype(np.float64)


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Isolation trees in flat arrays, each grown on ``leaf_sample`` rows drawn from ``data``, on all
    where there are no more."""

    def __init__(self, data: np.ndarray, trees: int, leaf_sample: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size = min(leaf_sample, len(data))
        self.trees, self.norm = [], max(_average_path(max(size, 1)), 1e-9)
        depth = int(np.ceil(np.log2(max(2, leaf_sample))))
        for _ in range(trees if len(data) else 0):
            self.trees.append(self._grow(data[rng.choice(len(data), size, replace=False)], depth, rng))

    @staticmethod
    def _grow(rows: np.ndarray, limit: int, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, length = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            me = len(feature)
            for a, v in ((feature, -1), (cut, 0.0), (left, me), (right, me), (length, depth + _average_path(len(part)))):
                a.append(v)
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            can = np.flatnonzero(high > low)
            if depth < limit and len(part) > 1 and len(can):
                f = int(rng.choice(can))
                x = float(rng.uniform(low[f], high[f]))
                under = part[:, f] < x
                feature[me], cut[me] = f, x
                left[me] = node(part[under], depth + 1)
                right[me] = node(part[~under], depth + 1)
            return me

        node(rows, 0)
        return tuple(map(np.array, (feature, cut, left, right, length)))

    def score(self, data: np.ndarray) -> np.ndarray:
        """Anomaly score of each row: 2 ** -(mean path / expected path), 0 to 1."""
        if not self.trees:
            return np.zeros(len(data))
        total = np.zeros(len(data))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(data), np.int64)
            while True:
                f = feature[at]
                go = np.flatnonzero(f >= 0)
                if not len(go):
                    break
                here = at[go]
                at[go] = np.where(data[go, f[go]] < cut[here], left[here], right[here])
            total += length[at]
        return np.exp2(-total / len(self.trees) / self.norm)


def measure(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (``keep_text=False``: but the text) plus the counts, one long each.
    Null texts count as empty."""
    names = [*COUNTS, *_MORE]
    docs = docs.drop(*names)
    columns = docs.columns
    kept = [c for c in columns if keep_text or c != text]

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in texts(batch.column(columns.index(text)))]
            made = np.array(rows, np.int64).reshape(len(rows), len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in kept), *(pa.array(made[:, i]) for i in range(len(names)))], [*kept, *names])

    schema = docs.select(*kept).schema
    for c in names:
        schema = schema.add(c, "long")
    return docs.mapInArrow(run, schema)


def base_failed():
    """Fewer than 20 words, or over 30 % of the words in repeats."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", trees: int = 64, leaf_sample: int = 256, lost: float = 0.01, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` plus the counts, ``anomaly`` (0 to 1), ``base_failed`` and ``kept``.

    ``labels``: (id_col, quality 0/1); null ids or qualities are left out, several labels of an id
    count each. Without bad labels no document is rejected by the forest. Null texts have zero counts
    and fail the base rules. Repeated rows get the same verdict. Empty tables give empty results.
    """
    spark = docs.sparkSession
    names = [*COUNTS, *_MORE]
    rows = stored(measure(docs.drop("anomaly", "base_failed", "kept"), text, keep_text), "quality-counts")
    # the forest learns from a bounded sample: trees * leaf_sample rows, least hash first
    data = hashed_sample(rows.where(~base_failed()).select(id_col, *names), F.col(id_col), trees * leaf_sample).drop(id_col).toPandas()
    forest = spark.sparkContext.broadcast(IsolationForest(features({c: data[c].to_numpy(np.float64) for c in names}), trees, leaf_sample))
    columns = rows.columns

    def run(batches):
        for batch in batches:
            x = features({c: batch.column(columns.index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in names})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.value.score(x), pa.float64())], [*columns, "anomaly"])

    scored = stored(rows.mapInArrow(run, rows.select("*").schema.add("anomaly", "double")), "quality-scores")
    # a histogram of 1000 bins by label: all labelled rows, 2000 rows on the driver at most
    marked = labels.where("quality is not null").select(F.col(id_col).alias("_id"), "quality")
    known = scored.where(~base_failed()).select(F.col(id_col).alias("_id"), F.least(F.floor(F.col("anomaly") * 1000), F.lit(999)).alias("bin")).join(marked, "_id")
    counts = known.groupBy("bin").agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad")).toPandas()
    limit = threshold(counts, lost)
    verdict = ~base_failed() & (F.col("anomaly") * 1000 < limit)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", verdict)


def threshold(counts: pd.DataFrame, lost: float) -> int:
    """Bin from which documents are rejected; 1001: none is. Of the thresholds that reject most bad
    documents, and of those fewest good ones, the middle: as far from the good as from the bad."""
    good, bad = np.zeros(1001), np.zeros(1001)
    good[counts["bin"].to_numpy(int)] = counts["good"]
    bad[counts["bin"].to_numpy(int)] = counts["bad"]
    if not bad.sum():
        return 1001
    above_good, above_bad = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    allowed = np.flatnonzero((above_good <= lost * max(1.0, good.sum())) & (above_bad > above_good))
    if not len(allowed):
        return 1001
    best = allowed[above_bad[allowed] == above_bad[allowed].max()]
    best = best[above_good[best] == above_good[best].min()]
    return int((best[0] + best[-1] + 1) // 2)


def quality_query(spark, sf_dir: str) -> DataFrame:
    """op9: quality verdicts on all documents."""
    done = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep_text=False)
    return done.select("doc_id", *COUNTS, "base_failed", "kept")

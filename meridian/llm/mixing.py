"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws ``key = -ln(u) / weight`` with u from a hash of its id, so heavier documents
tend to come first and reruns agree. A source takes floor(target / words) complete epochs; the rest
of its target is filled with documents in key order until their prefix sum reaches it.

The order is never built for a whole source: keys fall into ``buckets`` fixed ranges, the ranges'
words are summed (combined before the shuffle), and only the one range per source where the budget
ends is sorted. A source with a third of all rows is spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridian.llm.common import stored, table

#: White space that ends a word, as a Java character class.
_SPACE = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Words (runs of anything but ASCII white space) of a text; null: 0."""
    pieces = F.size(F.split(text, f"{_SPACE}+", -1)) - F.rlike(text, F.lit(f"^{_SPACE}")).cast("int") - F.rlike(text, F.lit(f"{_SPACE}$")).cast("int")
    return F.when(text.isNull() | (F.length(text) == 0), 0).otherwise(pieces).cast("long")


def unit_hash(name: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, share: float, cycle: tuple[int, ...], cap: float) -> DataFrame:
    """``sizes`` (source, total) to (source, total, target): ``share`` of all words by the weights of
    ``cycle``, dealt to the sources in code-point order (null last), none above ``cap`` times its
    words, the excess reshared by weight. One row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    weighed = sizes.select("source", "total", deal.cast("long").alias("w"))
    # in order of the level at which each reaches its cap
    order = Window.orderBy(F.col("total") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("total").over(everything) - cap * F.coalesce(F.sum("total").over(before), F.lit(0))) / F.sum("w").over(after)
    ranked = weighed.select("*", F.row_number().over(order).alias("i"), level.alias("level")).withColumn("capped", F.col("level") * F.col("w") >= cap * F.col("total"))
    first = ranked.withColumn("cut", F.min(F.when(~F.col("capped"), F.struct("i", "level"))).over(everything))
    held = F.col("cut").isNull() | (F.col("i") < F.col("cut.i"))
    return first.select("source", "total", F.when(held, cap * F.col("total")).otherwise(F.col("cut.level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, text: str = "text", id_col: str = "doc_id", source: str = "source", share: float = 1.5, cycle: tuple[int, ...] = (3, 1, 2), cap: float = 2.0, buckets: int = 4096, seed: str = "mix") -> DataFrame:
    """The mix of ``docs``: (id_col, size, source_size, target, taken), one row per row of ``docs``.

    ``quality`` (id_col, weight double) scales the keys: it must be positive; ids without a row, and
    null or non-positive weights, count as 1, several rows as their mean. Null texts have size 0; a
    null source is a source of its own; rows with a null id are drawn by their text. Repeated rows
    are sampled each for itself, ties going by id and then size. An empty table gives an empty result.
    """
    id_ = F.col(id_col)
    # the key's name: the id, or the text's hash where there is none
    name = F.when(id_.isNotNull(), id_.cast("string")).otherwise(F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    base = docs.select(id_.alias("id"), name.alias("name"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    if quality is not None:
        w = quality.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("name")).agg(F.avg("weight").alias("weight"))
        base = base.join(w, "name", "left")
    else:
        base = base.withColumn("weight", F.lit(1.0))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    key = -F.ln(unit_hash(F.col("name"), seed)) / weight
    rows = stored(base.select("id", "source", "size", key.alias("key")).withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key")))).cast("int")), "mix-rows")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("total")), share, cycle, cap)
    epochs = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("total"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("done", F.sum("words").over(upto))
    # the range of keys in which the budget ends: the first whose prefix sum passes it
    ends = running.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).where(F.col("done") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("done") - F.col("words")).alias("before"))).alias("end"))
    plan = stored(plan.join(ends.select(F.col("source").alias("s"), "end"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "total", "target", "epochs", "rest", F.col("end.bucket").alias("last"), F.col("end.before").alias("before")), "mix-plan")
    # one row a source: sent to every task while there are at most 100,000 sources
    small = F.broadcast(plan) if plan.count() <= 100_000 else plan
    dealt = rows.join(small, F.col("source").eqNullSafe(F.col("s")))
    inside = F.col("bucket") == F.col("last")
    clear = dealt.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.when(F.col("last").isNull() | (F.col("bucket") < F.col("last")), F.col("size")).otherwise(0))
    in_order = Window.partitionBy("s").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    edge = dealt.where(inside).withColumn("extra", F.when(2 * start + F.col("size") <= 2 * F.col("rest"), F.col("size")).otherwise(0))
    return clear.unionByName(edge).select(F.col("id").alias(id_col), "size", F.col("total").alias("source_size"), "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """Sampling weights from quality labels: 1.5 for good, 0.5 for bad documents."""
    return labels.where("doc_id is not null and quality is not null").select("doc_id", (0.5 + F.col("quality")).cast("double").alias("weight"))


def mixing_query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents mixed to 150 % of their words."""
    return mix_sources(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels")))


MIXING_SQL = r"""
WITH w AS (SELECT doc_id, avg(0.5 + quality) AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
           / coalesce(CASE WHEN weight > 0 THEN weight END, 1.0) AS key
  FROM documents LEFT JOIN w USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
n AS (SELECT source, total, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
r AS (SELECT source, total, w, row_number() OVER o AS i,
         (1.5::DOUBLE * (sum(total) OVER ())::BIGINT - 2.0::DOUBLE * coalesce((sum(total) OVER (ORDER BY total / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
           / (sum(w) OVER (ORDER BY total / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM n WINDOW o AS (ORDER BY total / w, source NULLS LAST)),
c AS (SELECT *, (SELECT min(i) FROM r WHERE NOT level * w >= 2.0::DOUBLE * total) AS cut FROM r),
t AS (SELECT source, total, CASE WHEN cut IS NULL OR i < cut THEN 2.0::DOUBLE * total ELSE (SELECT level FROM r WHERE r.i = c.cut) * w END AS target FROM c),
p AS (SELECT source, total, target, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS epochs FROM t),
x AS (SELECT d.doc_id, d.size, p.total, p.target, p.epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target,
       (epochs * size + CASE WHEN 2 * before + size <= 2 * (target - epochs * total) THEN size ELSE 0 END)::BIGINT AS taken
FROM x
"""

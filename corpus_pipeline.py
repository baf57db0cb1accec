"""The corpus pipeline: five training-data operators in a row, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import decontaminate, language_id, mixing, ngram_join, secrets
from meridian.llm.common import stored, table

#: Languages that stay: all that the labelled documents teach, or a tuple of their names.
TARGETS: tuple[str, ...] | None = None
#: Documents are rejected below this share of known trigrams.
LEAST_SCORE = 0.3
#: Ids of at most this many bytes go to every task; more are joined by a shuffle.
SMALL = 32 << 20


def _apart(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns named like those in ``made`` renamed, and the columns as they were."""
    names = {c: f"_own_{c}" for c in docs.columns if c in made}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a target language; others, and such as are in none the labels teach, go.

    Null, empty and letterless texts have no language and go. Repeated rows and rows without an id
    are judged by their text like any other; without labelled rows nothing is known and all go. An
    empty table stays empty."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))).select("text", "lang"))
    wanted = F.col("lang_pred") != language_id.UNKNOWN if TARGETS is None else F.col("lang_pred").isin(*TARGETS)
    rows, own = _apart(docs, ("lang_pred", "score"))
    return language_id.identify(rows, model).where(wanted & (F.col("score") >= LEAST_SCORE)).select(*own)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the smallest id (rows without an id
    last, ties by a hash of the row). Rows are told apart by all their columns, so different texts
    of one id are different documents; of rows equal in every column one stays. Documents without
    words are in no class and all stay. An empty table stays empty."""
    hashable = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.withColumn("_row", F.xxhash64(*hashable))
    classes = stored(ngram_join.jaccard_components(rows, id_col="_row").where("n_shingles > 0").select("_row", "component_id"), "pipeline-classes")
    # only classes of two rows or more have anything to lose
    crowded = classes.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = classes.join(crowded, "component_id", "left_semi").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    keys = rows.select("_row", "doc_id").distinct().join(members, "_row")
    keepers = keys.groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    extra = stored(members.select("_row").join(keepers.select("_row"), "_row", "left_anti"), "pipeline-duplicates")
    extra = F.broadcast(extra) if extra.count() * 16 <= SMALL else extra
    kept = rows.join(extra, "_row", "left_anti")
    twice = stored(classes.groupBy("_row").agg(F.count("*").alias("n")).where("n > 1").select("_row"), "pipeline-repeated")
    n = twice.count()
    if not n:
        return kept.select(*docs.columns)
    twice = F.broadcast(twice) if n * 16 <= SMALL else twice
    once = kept.join(twice, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.join(twice, "_row", "left_anti").unionByName(once).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate. Null and wordless texts are clean and stay;
    an empty benchmark or table changes nothing."""
    rows, own = _apart(docs, ("n_words", "hit_words", "removal", "items"))
    _, dirty = decontaminate.hit_count()
    return decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark")).where(~dirty).select(*own)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` follows the text. Null texts stay
    null; repeated rows and rows without an id get their own text's spans."""
    rows, own = _apart(docs, ("secret_base", "secret_spans", "_key", "_parts"))
    found = secrets.find_secrets(rows)
    text = secrets.redact(F.col("text"), F.col("secret_spans"))
    clean = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.size("secret_spans") > 0, length).otherwise(F.col("n_chars")))
    return clean.select(*own)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that each source gives to the mix, one row a document. A null source is a source of
    its own, null texts have no words, rows without an id are drawn by their text; an empty table
    gives no rows."""
    return mixing.mix_sources(docs, mixing.label_weights(table(spark, sf_dir, "labels")))


STAGES = [("language ID", languages), ("n-gram Jaccard join", duplicates), ("benchmark decontamination", contamination), ("secret scans", redaction), ("mixing", mix)]

#: The language, index and component stages are not expressible in SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

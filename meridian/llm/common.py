"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z only, byte by byte, so that UTF-8 sequences pass unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only (the path may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, which every node can read.

    Where the setting is missing on a single machine (tests) it is set to a folder in the warehouse;
    on a cluster, whose nodes need not share the warehouse, that is an error. Tables written here
    stay until ``remove_scratch``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/meridian-{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> None:
    """Removes this application's intermediate tables; results that were not written are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage ends here, so a
    lost executor costs a re-read and not a re-run."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> list:
    """UTF-8 bytes (or None) of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: A task works on so many bytes of a batch (one row at least) at a time.
SLICE_BYTES = 2 << 20


def slices(batches):
    """``batches``, cut to pieces of about ``SLICE_BYTES``."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed_sample(df: DataFrame, key: Column, n: int, total: int | None = None) -> DataFrame:
    """The ``n`` rows of least hash of ``key``, all where there are no more: the same rows on every
    run. A threshold on the hash thins the rows where they are, so that no task and not the driver
    gets many more than ``n`` of them to sort; it is raised while too few rows pass, as where many
    rows share a key."""
    count = df.count() if total is None else total
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 40)))
    share = min(1.0, 1.5 * n / max(1, count))
    while share < 1.0 and hashed.where(F.col("_hash") < int(share * (1 << 40))).count() < n:
        share = min(1.0, 8 * share)
    thin = hashed if share == 1.0 else hashed.where(F.col("_hash") < int(share * (1 << 40)))
    return thin.orderBy("_hash", *df.columns).limit(n).drop("_hash")


#: ``scan`` folds blocks of so many elements: a fold copies its result at every step.
_BLOCK = 256


def scan(values: Column, step, zero: int = 0) -> Column:
    """What ``step`` (of two int columns, associative) makes of all elements before each one: an
    array of ints as long as ``values``, in time near to linear."""
    first = F.array(F.lit(zero))
    last = lambda a: F.element_at(a, -1)
    fold = lambda a: F.aggregate(a, first, lambda acc, x: F.concat(acc, F.array(step(last(acc), x))))
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(_BLOCK))
    inner = F.transform(starts, lambda at: fold(F.slice(values, at + 1, F.lit(_BLOCK))))
    outer = lambda blocks: fold(F.transform(blocks, last))
    # bound once each: a lambda's argument is evaluated once, its body's copies are not
    whole = F.transform(F.array(inner), lambda blocks: F.flatten(F.zip_with(blocks, F.slice(outer(blocks), F.lit(1), F.size(blocks)), lambda b, o: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda v: step(o, v)))))
    return F.element_at(whole, 1)

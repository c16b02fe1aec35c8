"""Shared plumbing of the training-data operators: shared-folder tables, Arrow text access, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a fresh temporary one where it is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            root = have.get()
        elif not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="readforge-ckpt-")
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def run_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/readforge/{label}-{uuid.uuid4().hex}"


#: Rows of whole texts that Python gets at once: the usual 10,000 can be as large as an executor.
BATCH = 256


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """What is run meanwhile hands Python at most so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back; rows: most that Python gets at once."""
    path = run_folder(df.sparkSession, label)
    with small_batches(df.sparkSession, rows) if rows else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a table ``materialize`` wrote, when whatever was made of it is a table itself."""
    files = table.inputFiles()
    if files:
        sc = table.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 buffer of a null-free Arrow string or binary array as uint8, with its n + 1 offsets from 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_blocks(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def connected_components(edges: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star rounds over joins; every round is written to the shared
    folder, so that no round depends on an executor's disk, and nothing but two sums reaches the driver.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs, "edges")
    seen = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # tables of their own, so that the joins below have plain shuffles and Spark can split that of a large group's centre
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges-large")
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "edges-down")
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, pairs = pairs, materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for table in (before, low, large, down):
            discard(table)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def ranked(df: DataFrame, group: list[str], order: Column, name: str, per_bucket: int = 20_000) -> DataFrame:
    """Add ``name``: gapless row numbers from 0 in each group, by the signed 64-bit ``order`` and then all columns.

    Rows are numbered inside buckets of the order value and shifted by the sizes of the buckets before,
    so a group of any size is numbered by many tasks. Buckets follow the row count; rows with one same
    order value share a bucket.
    """
    from pyspark.sql import Window as W

    n = df.count()
    buckets = max(1, -(-n // per_bucket))
    columns = df.columns
    keyed = df.withColumn("_order", order)
    # top bits of the order value, spread over the buckets
    keyed = keyed.withColumn("_bucket", F.floor((F.col("_order").cast("double") / 18446744073709551616.0 + 0.5) * buckets).cast("long"))
    sizes = keyed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = keyed.withColumn("_in", F.row_number().over(W.partitionBy(*group, "_bucket").orderBy("_order", *[c for c in columns if c not in group])))
    on = [*group, "_bucket"]
    joined = inside.alias("a").join(before.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on])
    return joined.select(*[F.col(f"a.{c}") for c in columns], (F.col("_in") - 1 + F.col("_before")).cast("long").alias(name))

"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on one machine (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if folder is None:
        folder = tempfile.mkdtemp(prefix="ridgeline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again.

    This cuts the lineage: executors that are lost later cost a reread, not a
    recomputation. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ridgeline-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df after an eager reliable checkpoint in the shared folder; keeps its partitioning."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum over the rows before in that order.

    Rows are dealt by ranges of the order; a range adds what the ranges before
    it hold in all, so no task sees more than its range and one row a range.
    """
    ranged = df.withColumns({f"__{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged = saved(ranged)  # the ranges stay what they are
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*[F.sum(f"__{n}").alias(f"__{n}_all") for n in sums])
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__{n}_all").over(before), F.lit(0)).alias(f"__{n}_before") for n in sums])
    here = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(totals), "__range")  # a row a range
    out = out.withColumns({n: F.col(f"__{n}_before") + F.coalesce(F.sum(f"__{n}").over(here), F.lit(0)) for n in sums})
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the number, from 1, of each row among those of its key; a hot key's rows are counted where they lie."""
    placed = saved(df.withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    counts = saved(counts.select(key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    turn = F.row_number().over(Window.partitionBy(key, "__part").orderBy(key))
    return placed.withColumn("__turn", turn).join(counts, [key, "__part"]).select(*df.columns, (F.col("__turn") + F.col("__before")).alias(name))


def word_count(text: Column | str) -> Column:
    """Number of words as a long; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Size of the bit maps that are broadcast in place of keys: at most 2**18 rows of 16 bytes.
FILTER_BITS = 1 << 24


def _with_bits(rows: DataFrame, keys: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Column]:
    spot = F.pmod(F.xxhash64(*names, F.lit(3)), F.lit(FILTER_BITS))
    word, bit = F.shiftright(spot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int"))
    words = keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.withColumns({"__spot": word, "__own": bit}).join(F.broadcast(words), F.col("__spot") == F.col("__word"), "left")
    return marked, F.coalesce(F.col("__bits").bitwiseAND(F.col("__own")), F.lit(0)) != 0


def maybe_among(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """The rows whose key may be among keys; surely all that are. What is broadcast has a fixed size."""
    marked, hit = _with_bits(rows, keys, names)
    return marked.filter(hit).select(*rows.columns)


def surely_not_among(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """The other rows of ``maybe_among``."""
    marked, hit = _with_bits(rows, keys, names)
    return marked.filter(~hit).select(*rows.columns)


def row_key() -> Column:
    """64 bits for doc_id and text: rows without a doc_id, or with one that others have, are told apart by their text.

    Only rows equal in both have one key; what is said of a row by its text holds for all of them.
    """
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose ``row_key`` isn't among keys (column __key). Only what may be among them is shuffled."""
    marked = docs.withColumn("__key", row_key())
    near = maybe_among(marked, keys, "__key").join(keys.select("__key").distinct(), "__key", "left_anti")
    return surely_not_among(marked, keys, "__key").select(*docs.columns).unionByName(near.select(*docs.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""What the training-data operators share: places of rows, dropping rows by place, batches for Python, byte tables."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.tables import materialise, new_folder

#: ASCII white space, as the contracts spell it.
WHITE = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch for Python. Rows of whole texts fill Spark's own bound (64 MB) in both JVM and Python.
ARROW_BYTES = "4m"
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches that Python gets by ARROW_BYTES, unless the session has a setting of its own."""
    if spark.conf.get(_ARROW) in ("67108864", "67108864b"):
        spark.conf.set(_ARROW, ARROW_BYTES)


def sampled(key: str, share: float | Column) -> Column:
    """True for about ``share`` of all keys, chosen by a hash, the same ones each time."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(float(1 << 40)) * share


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scan(df: DataFrame) -> bool:
    """Whether each row is one row of a stored table: a scan under filters and projections, and nothing else.

    Below anything that repeats or brings together rows (explode, join, union) a place does not tell rows apart.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def with_locator(df: DataFrame) -> DataFrame:
    """(doc, __file, __row): each row as a struct, and where it is stored: file path and row number in the file.

    A table read from Parquet has both already. Anything else is written to the shared folder first, so that
    the pair stays the same however often a task is repeated. No column of ``df`` can clash with the pair.
    """
    parts = [F.struct("*").alias("doc"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    if _scan(df):
        try:
            return df.select(*parts)
        except AnalysisException:  # other formats do not number their rows
            pass
    return materialise(df, "rows").select(*parts)


#: Bitmaps of 4 KB for 32,768 rows each that are broadcast at a time; with more, files are taken some after the others.
BITMAPS = 8_192


def _kept(located: DataFrame, bits: DataFrame) -> DataFrame:
    at = F.bitmap_bit_position(F.col("__row") + 1)  # counted from 1 there
    joined = located.join(F.broadcast(bits), (F.col("__file") == F.col("__f")) & (F.bitmap_bucket_number(F.col("__row") + 1) == F.col("__b")), "left")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (at % 8 + 1).cast("int")))
    return joined.where(F.col("__bits").isNull() | (bit == 0)).select("doc.*")


def without_rows(located: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``located`` (see :func:`with_locator`) whose places are not in ``dropped`` (__file, __row).

    The places become a bit for each row, by file and 32,768 rows, and go to all tasks; texts are never shuffled.
    Where all bitmaps together are too many for one broadcast, the files are dealt into groups with few enough, and
    each group is read (Spark prunes the other files), filtered and written before the next one's bitmaps are sent.
    """
    row = F.col("__row") + 1
    bits = dropped.groupBy(F.col("__file").alias("__f"), F.bitmap_bucket_number(row).alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("__bits"))
    bits = materialise(bits, "dropped")
    groups = -(-bits.count() // BITMAPS)
    if groups <= 1:
        return _kept(located, bits)
    # By a hash; half as many more groups, since their sizes differ.
    groups += -(-groups // 2)
    spark, folder = located.sparkSession, new_folder(located.sparkSession, "kept")
    for i in range(groups):
        own = located.where(F.pmod(F.xxhash64("__file"), F.lit(groups)) == i)
        _kept(own, bits.where(F.pmod(F.xxhash64("__f"), F.lit(groups)) == i)).write.mode("append").parquet(folder)
    return spark.read.schema(located.select("doc.*").schema).parquet(folder)


def power_table(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (a multiply and xor-shift finaliser)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))

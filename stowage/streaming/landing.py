"""Archives as they land in a folder: entries, and a row that says an archive was read to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from stowage.sources.archives import entries, errors

BLOB = "path string, modificationTime timestamp, length long, content binary"


def landing(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of archives (archive_id, content)."""
    stream = spark.readStream.format("binaryFile").schema(BLOB).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(F.col("path").alias("archive_id"), "content")


def ingest(spark: SparkSession, folder: str, out: str, files_per_batch: int = 64) -> StreamingQuery:
    """Write entries and completion rows of all archives in the folder so far; later runs take what is new.

    A batch that is repeated overwrites its own folder, so each archive is there once.
    """

    def batch(df: DataFrame, i: int) -> None:
        found = entries(df).select("archive_id", "entry_index", "path", "kind", "size")
        found.write.mode("overwrite").parquet(f"{out}/entries/batch={i}")
        done = df.select("archive_id").join(errors(df), "archive_id", "left")
        done.select("archive_id", F.col("error_kind").isNull().alias("complete"), "error").write.mode("overwrite").parquet(f"{out}/archives/batch={i}")

    stream = landing(spark, folder, files_per_batch)
    return stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start()


def sizes_by_day(entries: DataFrame, late: str = "1 day") -> DataFrame:
    """Entries and bytes by day of modification, for a stream of entries (mtime_ts, size): late ones within a watermark count."""
    return entries.withWatermark("mtime_ts", late).groupBy(F.window("mtime_ts", "1 day")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))

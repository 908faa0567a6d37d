"""Exact deduplication as a stateful stream.

A streaming aggregation keyed by digest keeps, in a RocksDB state store and without expiry, each digest's stable
identifier (the least id), content locator (file and row) and count. It is pre-aggregated before its shuffle, so a
text that fills a third of the table reaches the state as one row a task. Digests seen more than once are hits;
for these the full bytes are compared: the texts behind a digest are equal if the least equals the greatest.
Should digests ever collide, the groups concerned are told apart by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import WHITE, with_locator, without_rows
from stowage.operators.tables import exists, materialise, new_folder

#: State on disk, with bounded memory for all stores of an executor together.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    # No disk space set aside in advance: with many small stores that alone is megabytes for each.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Up to so many repeated digests are sent to all executors to pick the hits; beyond, a shuffle join does it.
BROADCAST_DIGESTS = 1_000_000
#: Stored digests that one micro-batch takes in.
BATCH_BYTES = 1 << 29


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stateful(stream: DataFrame) -> DataFrame:
    """The streaming aggregation: digest, first (identifier and locator of the row that stays), n."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row")).alias("first")
    return stream.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))


def run_stream(digests: DataFrame, folder: str, bytes_per_batch: int = BATCH_BYTES, load: str = "0") -> DataFrame:
    """Stream a table of digests through the state kept under ``folder``; the last state of each digest.

    The table is stored under the name ``load`` first, once: a load that is there whole is not stored or counted again,
    so a call that was interrupted is simply repeated and goes on from its checkpoint, and a call with another name
    adds its rows to the state. Each micro-batch writes the digests whose state it changed; one that is repeated after
    a failure writes the same folder again.
    """
    if not re.fullmatch(r"\w+", load):
        raise ValueError("load must consist of letters and digits")
    spark = digests.sparkSession
    if not exists(spark, f"{folder}/in/load-{load}/_SUCCESS"):
        digests.write.mode("overwrite").parquet(f"{folder}/in/load-{load}")
    stream = spark.readStream.schema(digests.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{folder}/in/*")
    with _settings(spark, STATE_STORE):
        query = (
            stateful(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch={i}"))
            .start()
        )
        query.awaitTermination()
    schema = "digest string, first struct<none: boolean, doc_id: {}, __file: string, __row: bigint>, n bigint, batch int"
    kind = dict(digests.dtypes)["doc_id"]
    if not exists(spark, f"{folder}/out"):  # an empty table makes no batch
        return spark.createDataFrame([], schema.format(kind)).drop("batch")
    out = spark.read.schema(schema.format(kind)).parquet(f"{folder}/out")
    # Each later state of a digest counts more rows, so the largest count is the last state.
    return out.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "n").alias("s")).select("digest", "s.first", "s.n")


def _earlier(state: DataFrame, rows: DataFrame, text_col: str) -> DataFrame | None:
    """doc_id, text, __file, __row of the rows of earlier loads that hits refer to, read where the state says they are."""
    own = rows.select("__file").distinct()
    there = materialise(state.where("n > 1").select("first.doc_id", F.col("first.__file").alias("__file"), F.col("first.__row").alias("__row")).join(own, "__file", "left_anti"), "earlier")
    files = [r[0] for r in there.select("__file").distinct().collect()]  # names of stored files
    if not files:
        return None
    read = state.sparkSession.read.parquet(*files).select(F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return there.join(read, ["__file", "__row"]).select("doc_id", "text", "__file", "__row")


def _classify(src: DataFrame, digest_of: Callable[[Column], Column], bytes_per_batch: int, state_dir: str | None, load: str, text_col: str) -> DataFrame:
    """src: doc_id, text, __file, __row."""
    spark = src.sparkSession
    folder = state_dir or new_folder(spark, "exact-dedup")
    sha = F.sha2(normalised(F.col("text")), 256)
    rows = src.select("doc_id", sha.alias("sha"), "__file", "__row").withColumn("digest", digest_of(F.col("sha")))
    state = run_stream(rows, folder, bytes_per_batch, load)
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/in/load-{load}")
    state = materialise(state, "state")
    out = rows.withColumnRenamed("digest", "d").join(state, F.col("d") == state.digest).drop("digest").withColumnRenamed("d", "digest")

    # 8 bytes each; what is picked by chance has a digest of its own and is compared with itself.
    hits = state.where("n > 1").select(F.xxhash64("digest").alias("hit"))
    repeated = hits.count()
    if repeated:
        texts = src.select("doc_id", "text", "__file", "__row", F.lit(True).alias("own"))
        if state_dir and (before := _earlier(state, rows, text_col)) is not None:
            texts = texts.unionByName(before.withColumn("own", F.lit(False)))
        texts = texts.select("doc_id", "__file", "__row", "own", normalised(F.col("text")).alias("norm"))
        texts = texts.withColumn("sha", F.sha2("norm", 256)).withColumn("digest", digest_of(F.col("sha")))
        picked = F.broadcast(hits) if repeated <= BROADCAST_DIGESTS else hits
        texts = texts.join(picked, F.xxhash64("digest") == F.col("hit"), "left_semi")
        unlike = texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("digest")
        unlike = materialise(unlike, "unlike")
        if not unlike.isEmpty():
            first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row")).alias("first")
            mixed = texts.join(unlike, "digest", "left_semi")
            groups = mixed.groupBy(F.col("norm").alias("_n")).agg(first, F.count(F.lit(1)).alias("n"))
            parted = mixed.where("own").join(groups, F.col("norm") == F.col("_n")).select("doc_id", "sha", "__file", "__row", "digest", "first", "n")
            out = out.join(unlike, "digest", "left_anti").unionByName(parted)
    stays = (F.col("first.__file") == F.col("__file")) & (F.col("first.__row") == F.col("__row"))
    return out.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.col("sha").alias("text_sha256"), "__file", "__row"
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_of: Callable[[Column], Column] = lambda sha: sha,
    bytes_per_batch: int = BATCH_BYTES,
    state_dir: str | None = None,
    load: str = "0",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space has become one space; null counts as
    empty. Of equal texts the row with the least id stays (null ids last; among repeats of an id the first
    stored); exactly one row of a group has kept true. ``digest_of`` shortens the SHA-256 that keys the state:
    results stay the same, collisions only cost time. Other columns play no part; no rows give no rows.

    With ``state_dir`` the state outlives the call, and later calls with other names ``load`` go on from it (ids of one
    type, texts in a Parquet column of one name that stays where it is: the state holds where each text is, and
    hits are compared with it there). Rows then are held against all loads so far: group_size counts those of
    earlier loads too, and no row is kept if the row that stays came earlier. Repeating a load changes nothing.
    """
    located = with_locator(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    src = located.select("doc.doc_id", "doc.text", "__file", "__row")
    return _classify(src, digest_of, bytes_per_batch, state_dir, load, text_col).drop("__file", "__row")


def drop_exact_duplicates(docs: DataFrame, state_dir: str | None = None, load: str = "0") -> DataFrame:
    """``docs`` without the rows that are not kept, all columns as they were, whatever their names.

    Null texts count as empty and are copies of each other; of repeated rows one stays; no rows give no rows.
    """
    located = with_locator(docs)
    found = _classify(located.select("doc.doc_id", "doc.text", "__file", "__row"), lambda sha: sha, BATCH_BYTES, state_dir, load, "text")
    return without_rows(located, found.where("NOT kept").select("__file", "__row"))

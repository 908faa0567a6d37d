"""Questions about entries: selection, duplicates, budgets, order, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.paths import ancestors, sanitise, without_slash

#: Default budgets; a value beyond its budget fails, one at it does not.
LIMITS = {"decoded_total": 4 << 30, "entry_bytes": 4 << 30, "entries": 1_000_000, "metadata_bytes": 64 << 20, "path_bytes": 64 << 10, "nesting": 64, "filter_depth": 4}


def select_members(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Entries named by a member (column member) or below it; one trailing slash is ignored. No members: all.

    Each entry meets the members by an equality join on its ancestors; there is no comparison of all with all.
    """
    if members.isEmpty():
        return entries
    wanted = members.select(without_slash(F.col("member")).alias("_m")).distinct()
    named = entries.select("archive_id", "entry_index", F.explode(ancestors(without_slash(F.col("path")))).alias("_m"))
    hits = named.join(wanted, "_m", "left_semi").select("archive_id", "entry_index").distinct()
    return entries.join(hits, ["archive_id", "entry_index"], "left_semi")


def unmatched_members(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Members that name no entry. Ancestors that are no member are left out before anything is shuffled apart."""
    wanted = members.select(without_slash(F.col("member")).alias("_m")).distinct()
    seen = entries.select(F.explode(ancestors(without_slash(F.col("path")))).alias("_m")).join(wanted, "_m", "left_semi").distinct()
    return members.join(seen, without_slash(F.col("member")) == F.col("_m"), "left_anti")


def duplicate_paths(entries: DataFrame) -> DataFrame:
    """Second and later entries of a safe path within an archive; the first one wins."""
    rows = entries.select("archive_id", "entry_index", "path", sanitise(F.col("path")).alias("safe")).where("safe IS NOT NULL")
    first = rows.groupBy("archive_id", "safe").agg(F.min("entry_index").alias("first_index"))
    return rows.join(first, ["archive_id", "safe"]).where("entry_index > first_index").select("archive_id", "entry_index", "path", "first_index")


#: Places of an archive that a window orders at a time.
BLOCK = 65_536


def running(entries: DataFrame, column: str, name: str, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """``entries`` with what ``how`` (sum, max) makes of a column over all rows before, in their archive; null for the first.

    Blocks of an archive are aggregated first and carried over a window of one row a block; within a block, rows are
    ordered by themselves. So a huge archive is many tasks' work. The join is a merge whatever sizes say: blocks are no
    fewer than archives, and well compressed ones would be broadcast through the driver.
    """
    rows = entries.withColumn("_block", F.floor(F.col("entry_index") / BLOCK))
    blocks = rows.groupBy("archive_id", "_block").agg(how(F.col(column)).alias("_of"))
    ahead = Window.partitionBy("archive_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("archive_id", "_block", how(F.col("_of")).over(ahead).alias("_ahead"))
    within = Window.partitionBy("archive_id", "_block").orderBy("entry_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", how(F.col(column)).over(within)).join(blocks.hint("merge"), ["archive_id", "_block"])
    both = F.when(F.col("_ahead").isNull(), F.col("_within")).when(F.col("_within").isNull(), F.col("_ahead"))
    both = both.otherwise(F.col("_ahead") + F.col("_within") if how is F.sum else F.greatest("_ahead", "_within"))
    return rows.withColumn(name, both).drop("_block", "_within", "_ahead")


def running_budget(entries: DataFrame, limit: int) -> DataFrame:
    """For each archive whose sizes add up beyond the limit: the first entry that crosses it, and the total there."""
    rows = running(entries.select("archive_id", "entry_index", F.col("size").cast("decimal(38,0)").alias("_size")), "_size", "_before")
    total = F.coalesce("_before", F.lit(0)) + F.coalesce("_size", F.lit(0))
    over = rows.select("archive_id", "entry_index", total.alias("total")).where(F.col("total") > F.lit(limit))
    return over.groupBy("archive_id").agg(F.min("entry_index").alias("entry_index"), F.min_by("total", "entry_index").cast("long").alias("total"))


def order_violations(entries: DataFrame, rank: Column) -> DataFrame:
    """Entries whose rank is below the largest rank before them."""
    rows = entries.select("archive_id", "entry_index", "path", rank.alias("rank")).where("rank IS NOT NULL")
    return running(rows, "rank", "before", F.max).where("rank < before").select("archive_id", "entry_index", "path", "rank", "before")


#: Bytes that an extent of a sparse file counts for.
EXTENT = 16


def metadata_bytes(entries: DataFrame) -> Column:
    """Variable bytes of an entry's metadata: path, link, names, comment, extended attributes, ACLs, extents, extensions.

    Columns that ``entries`` lacks count as empty. xattrs: map of binary, acl: array of binary, sparse and extensions as
    :func:`stowage.sources.archives.entries` makes them.
    """

    def total(name: str, each: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.aggregate(name, F.lit(0).cast("long"), lambda acc, x: acc + each(x)), F.lit(0).cast("long"))

    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    out = F.lit(0).cast("long")
    for name in ("path_raw" if "path_raw" in entries.columns else "path", "link_raw" if "link_raw" in entries.columns else "link_target", "user", "group", "comment"):
        if name in entries.columns:
            out = out + size(F.col(name))
    if "xattrs" in entries.columns:
        out = out + F.coalesce(F.aggregate(F.map_entries("xattrs"), F.lit(0).cast("long"), lambda acc, x: acc + size(x["key"]) + size(x["value"])), F.lit(0).cast("long"))
    if "acl" in entries.columns:
        out = out + total("acl", size)
    if "sparse" in entries.columns:
        out = out + F.lit(EXTENT) * F.greatest(F.coalesce(F.size("sparse"), F.lit(0)), F.lit(0))
    if "extensions" in entries.columns:
        out = out + total("extensions", lambda x: size(x["namespace"]) + size(x["key"]) + size(x["value"]))
    return out


def metadata_cost(entries: DataFrame) -> DataFrame:
    """Variable bytes of metadata for each archive."""
    return entries.groupBy("archive_id").agg(F.sum(metadata_bytes(entries)).alias("metadata_bytes"))


def over_limits(entries: DataFrame, limits: dict[str, int | None] = LIMITS) -> DataFrame:
    """(archive_id, limit, value) of every broken budget; a budget of None is off."""
    from stowage.functions.paths import nesting

    value = {
        "decoded_total": F.sum(F.col("size").cast("decimal(38,0)")), "entry_bytes": F.max("size"), "entries": F.count("*"), "metadata_bytes": F.sum(metadata_bytes(entries)),
        "path_bytes": F.max(F.octet_length("path")), "nesting": F.max(nesting(F.col("path"))),
    }
    on = [k for k in value if limits.get(k) is not None]
    sums = entries.groupBy("archive_id").agg(*(value[k].cast("long").alias(k) for k in on))
    pairs = F.array(*(F.struct(F.lit(k).alias("limit"), F.col(k).alias("value"), F.lit(limits[k]).cast("long").alias("most")) for k in on))
    return sums.select("archive_id", F.explode(pairs).alias("x")).select("archive_id", "x.limit", "x.value", "x.most").where("value > most")


def verify_report(entries: DataFrame) -> DataFrame:
    return entries.groupBy("archive_id").agg(F.count("*").alias("entry_count"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).alias("payload_bytes"))


def by_kind(entries: DataFrame) -> DataFrame:
    return entries.groupBy("archive_id", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


def inspect_records(entries: DataFrame) -> DataFrame:
    """JSON lines: one record for each entry and a last one that marks the archive as complete.

    Raw names are there as hexadecimal digits too, since a name need not be UTF-8. Fields without a value are left out.
    """
    path = F.col("path_raw") if "path_raw" in entries.columns else F.encode("path", "UTF-8")
    link = F.col("link_raw") if "link_raw" in entries.columns else F.encode("link_target", "UTF-8")
    body = F.struct(F.lit("entry").alias("type"), "path", F.lower(F.hex(path)).alias("path_raw_hex"), "kind", "size", "link_target", F.lower(F.hex(link)).alias("link_target_raw_hex"))
    rows = entries.select("archive_id", F.col("entry_index").cast("long").alias("seq"), F.to_json(body).alias("record"))
    ends = entries.groupBy("archive_id").agg(F.count("*").alias("entry_count"))
    ends = ends.select("archive_id", F.lit((1 << 63) - 1).cast("long").alias("seq"), F.to_json(F.struct(F.lit("complete").alias("type"), "entry_count")).alias("record"))
    return rows.union(ends)


def sparse_errors(entries: DataFrame) -> DataFrame:
    """Entries whose extents (array of offset, length) overlap, are out of order or reach beyond the logical size."""
    x = F.col("sparse")
    last = F.size(x)
    ordered = F.forall(F.sequence(F.lit(2), F.greatest(last, F.lit(2))), lambda i: (i > last) | (F.get(x, i - 2)["offset"] + F.get(x, i - 2)["length"] <= F.get(x, i - 1)["offset"]))
    within = F.forall(x, lambda e: (e["offset"] >= 0) & (e["length"] >= 0) & (e["offset"] + e["length"] <= F.col("size")))
    stored = F.aggregate(x, F.lit(0).cast("long"), lambda acc, e: acc + e["length"])
    return entries.where(x.isNotNull()).select("archive_id", "entry_index", (ordered & within).alias("valid"), stored.alias("stored"))

"""Archives as tables: entries, payloads, archives, errors."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import fields as ff
from stowage.functions.paths import byte_text, display
from stowage.operators.tables import ARROW_BYTES, small_batches
from stowage.sources import images
from stowage.sources.codecs import DECODED_TOTAL, FILTER_DEPTH, ArchiveError, decode
from stowage.sources.walkers import WALKERS, detect, zip_payload

#: Bytes of a payload in one row; a longer payload takes several rows.
CHUNK = 16 << 20

RAW = "archive_id string, entry_index long, format string, fields map<string,binary>, records map<string,binary>, size long, chunk_index int, payload binary, error_kind string, error string"


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: archive_id (its path) and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive_id"), "content")


#: An own format: whether some bytes are of it, and its walker.
Provider = tuple[Callable[[memoryview], bool], Callable[[memoryview, int], Iterator[tuple]]]


def _rows(archive_id: str, content: bytes, payloads: bool, depth: int, total: int, providers: dict[str, Provider]) -> Iterator[tuple]:
    index, kind = 0, None
    try:
        decoded, _ = decode(bytes(content), depth, total)
        data = memoryview(decoded)
        own = [name for name, (probe, _) in providers.items() if probe(data)]
        if len(own) > 1:
            raise ArchiveError("Protocol", f"several providers for one archive: {', '.join(own)}")
        kind = own[0] if own else images.detect_image(data) or detect(data)
        if kind is None:
            raise ArchiveError("Unsupported", "no known container")
        walk = providers[kind][1] if own else (WALKERS | images.WALKERS)[kind]
        for fields, records, size, body in walk(data, total):
            if not payloads:
                yield archive_id, index, kind, fields, records, size, 0, None, None, None
            else:
                if kind == "zip":
                    head = fields["head"]
                    flags, method = int.from_bytes(head[8:10], "little"), int.from_bytes(head[10:12], "little")
                    body = zip_payload(data, method, flags, int(fields["local"]), int(fields["stored"]), size, total)
                for k in range(max(1, -(-len(body) // CHUNK))):
                    yield archive_id, index, kind, fields, records, size, k, bytes(body[k * CHUNK : (k + 1) * CHUNK]), None, None
            index += 1
    except (ArchiveError, struct.error, IndexError, ValueError) as e:
        if not isinstance(e, ArchiveError):
            e = ArchiveError("Malformed", f"{kind}: {e}")
        yield archive_id, index, kind, {}, {}, None, 0, None, e.kind, str(e)


def raw_records(archives: DataFrame, payloads: bool = False, depth: int = FILTER_DEPTH, total: int = DECODED_TOTAL, providers: dict[str, Provider] | None = None) -> DataFrame:
    """Raw records of archives (archive_id, content), one archive after the other in each task, in batches of bounded size.

    ``providers`` go before the formats that are built in; a walker yields raw fields (name, and optionally kind, mode,
    uid, gid, mtime, link, each as bytes), extended records, size and payload.
    An archive that cannot be read further gives the records before that point and a last row with the error.
    """
    names = [c.split()[0] for c in RAW.split(", ")]
    small_batches(archives.sparkSession)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for archive_id, content in zip(batch["archive_id"], batch["content"], strict=True):
                for row in _rows(archive_id, b"" if content is None else content, payloads, depth, total, providers or {}):
                    rows.append(row)
                    held += 200 + len(row[7] or b"")
                    if held > ARROW_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content").mapInPandas(walk, RAW)


def _text(raw: Column) -> Column:
    """Bytes up to the first NUL; null if there are none."""
    cut = F.encode(F.substring_index(byte_text(raw), "\0", 1), "ISO-8859-1")
    return F.when(F.length(cut) > 0, cut)


def _field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def _record(name: str) -> Column:
    return F.try_element_at("records", F.lit(name))


def _number(name: str) -> Column:
    """A number of tar, cpio or ar headers; extended records go before the header."""
    return F.coalesce(_record(name).cast("string"), _field(name).cast("string")).cast("long")


def _decoded(raw: DataFrame, *more: str, strict: bool = False) -> DataFrame:
    """Typed columns from raw fields, in steps so that no expression is written out many times over.

    With ``strict`` an archive that cannot be read to its end stops the query; without, its error is in ``errors``.
    """
    fmt = F.col("format")
    is_tar, is_cpio, is_zip = fmt == "tar", fmt == "cpio", fmt == "zip"
    said = F.concat(F.lit("archive "), F.coalesce("archive_id", F.lit("null")), F.lit(": "), F.coalesce("error", F.col("error_kind")))
    rows = raw.where(F.when(F.col("error_kind").isNull(), True).otherwise(F.raise_error(said).cast("boolean")) if strict else F.col("error_kind").isNull())
    head = F.col("zip_head")
    rows = rows.withColumn("zip_head", F.when(is_zip, _field("head")))
    rows = rows.withColumns(
        {
            "name": _field("name"), "prefix": _text(_field("prefix")), "zip_attributes": ff.uint_le(head, 38, 4), "zip_date": ff.uint_le(head, 14, 2).cast("int"), "zip_time": ff.uint_le(head, 12, 2).cast("int"),
            "better": _record("7075"), "times": _record("5455"), "full_mode": F.when(is_zip, F.shiftright(ff.uint_le(head, 38, 4), 16)).otherwise(_number("mode")), "secs": _field("mtime").cast("string").cast("long"),
        }
    )
    joined = F.when(F.startswith(byte_text(_field("magic")), F.lit("ustar")) & F.col("prefix").isNotNull(), F.concat("prefix", F.lit(b"/"), F.coalesce(_text(F.col("name")), F.lit(b""))))
    tar_path = F.coalesce(_record("path"), _record("GNU.sparse.name"), _field("long_name"), joined, _text(F.col("name")))
    renamed = (F.substring("better", 1, 1) == F.lit(b"\1")) & (ff.uint_le(F.col("better"), 1, 4) == F.crc32("name"))
    zip_path = F.when(renamed, F.substring("better", 6, 1 << 30)).otherwise(F.col("name"))
    has_time = F.conv(F.hex(F.substring("times", 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1
    rows = rows.withColumns(
        {
            "path_raw": F.when(is_tar, tar_path).when(is_zip, zip_path).otherwise(F.col("name")),
            "pax_mtime": F.when(is_tar, ff.pax_time(_record("mtime").cast("string"))),
            "secs": F.when(is_zip, F.when(has_time, ff.uint_le(F.col("times"), 1, 4).cast("int").cast("long")).otherwise(ff.dos_seconds(F.col("zip_date"), F.col("zip_time")))).when(fmt == "iso9660", images.seconds("iso9660")).when(fmt == "cab", images.seconds("cab")).when(fmt == "xar", images.seconds("xar")).otherwise(F.col("secs")),
            "by_mode": F.col("full_mode").bitwiseAND(F.lit(0o170000)) != 0,
            "folder": (F.substring("name", -1, 1) == F.lit(b"/")) | (F.col("zip_attributes").bitwiseAND(F.lit(16)) != 0),
            "link_raw": F.when(is_tar, F.coalesce(_record("linkpath"), _field("long_link"), _text(_field("link")))).otherwise(_field("link")),
            "sparse_text": F.split(_record("sparse").cast("string"), ","),
        }
    )
    kind = (
        F.when(is_tar, ff.kind_of_tar(byte_text(_field("flag")))).when(is_cpio | is_zip & F.col("by_mode"), ff.kind_of_mode(F.col("full_mode")))
        .when(is_zip & F.col("folder"), "dir").otherwise(F.coalesce(_field("kind").cast("string"), F.lit("file")))
    )
    numbers = F.transform("sparse_text", lambda x: x.cast("long"))
    rows = rows.withColumn("kind", kind).withColumn("numbers", numbers)
    device = is_cpio | F.col("kind").isin("char", "block")
    extents = F.transform(F.sequence(F.lit(1), F.size("numbers") - 1, F.lit(2)), lambda i: F.struct(F.get("numbers", i - 1).alias("offset"), F.get("numbers", i).alias("length")))
    records = F.transform(F.map_entries("records"), lambda e: F.struct(F.concat("format", F.lit("-record")).alias("namespace"), e["key"].alias("key"), e["value"].alias("value")))
    return rows.select(
        "archive_id", "entry_index", "format", "size", "path_raw", display(F.col("path_raw")).alias("path"), "kind",
        F.when(is_zip & ~F.col("by_mode"), F.lit(None)).otherwise(F.col("full_mode").bitwiseAND(F.lit(0o7777))).cast("int").alias("mode"), _number("uid").alias("uid"), _number("gid").alias("gid"),
        F.coalesce(_record("uname"), _text(_field("user"))).alias("user"), F.coalesce(_record("gname"), _text(_field("group"))).alias("group"),
        F.coalesce("pax_mtime", F.when(F.col("secs").isNotNull(), F.struct("secs", F.lit(0).alias("nanos")))).alias("mtime"), "link_raw", display(F.col("link_raw")).alias("link_target"),
        F.when(device, F.coalesce(_number("dev_major"), _number("devmajor"))).alias("dev_major"), F.when(device, F.coalesce(_number("dev_minor"), _number("devminor"))).alias("dev_minor"), _number("ino").alias("ino"), _number("nlink").alias("nlink"),
        ff.uint_le(head, 10, 2).cast("int").alias("method"), (ff.uint_le(head, 8, 2).bitwiseAND(F.lit(1)) == 1).alias("encrypted"), ff.uint_le(head, 16, 4).alias("crc"), _field("local").cast("string").cast("long").alias("local_offset"),
        F.when(F.size("numbers") > 1, extents).alias("sparse"), records.alias("extensions"), _field("thin").isNotNull().alias("external"), *more,
    )


def entries(archives: DataFrame, strict: bool = False, **options) -> DataFrame:
    """The entries of archives, without payloads (ZIP payloads are not even decoded)."""
    return _decoded(raw_records(archives, False, **options), strict=strict)


def payloads(archives: DataFrame, strict: bool = False, **options) -> DataFrame:
    """Entries with payloads: one row per chunk (chunk_index, payload). ZIP members are checked against their CRC."""
    made = _decoded(raw_records(archives, True, **options), "chunk_index", "payload", strict=strict)
    wrong = (F.col("format") == "zip") & (F.length("payload") == F.col("size")) & (F.crc32("payload") != F.col("crc"))
    return made.withColumn("payload", F.when(wrong, F.raise_error(F.concat(F.lit("Integrity: zip: CRC of "), F.col("path"))).cast("binary")).otherwise(F.col("payload")))


def errors(archives: DataFrame, payloads: bool = False, **options) -> DataFrame:
    """One row per archive that could not be read to its end: what was wrong, and behind how many entries."""
    return raw_records(archives, payloads, **options).where("error_kind IS NOT NULL").select("archive_id", F.col("entry_index").alias("entries_before"), "error_kind", "error")


def archive_table(archives: DataFrame) -> DataFrame:
    """One row per archive: bytes, digest of what is stored, outer codec and container by magic, all without Python."""
    c = F.col("content")
    return archives.select("archive_id", F.length(c).alias("bytes"), ff.digest(c).alias("digest"), ff.filter_of_magic(c).alias("filter"), F.when(ff.filter_of_magic(c).isNull(), ff.format_of_magic(c)).alias("format"))


def layer_digests(archives: DataFrame, depth: int = FILTER_DEPTH, total: int = DECODED_TOTAL) -> DataFrame:
    """Digest of what is stored and of what is within its compression (digest, diff_id, filters)."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            rows = []
            for i, content in zip(batch["archive_id"], batch["content"], strict=True):
                inner, codecs = decode(bytes(content), depth, total)
                rows.append((i, hashlib.sha256(content).hexdigest(), hashlib.sha256(inner).hexdigest(), codecs))
            yield pd.DataFrame(rows, columns=["archive_id", "digest", "diff_id", "filters"])

    return archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content").mapInPandas(one, "archive_id string, digest string, diff_id string, filters array<string>")


def decompress(archives: DataFrame, depth: int = FILTER_DEPTH, total: int = DECODED_TOTAL) -> DataFrame:
    """What is within the outer compression: archive_id, content, filters (outermost first)."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *decode(bytes(c or b""), depth, total)) for i, c in zip(b["archive_id"], b["content"], strict=True)], columns=["archive_id", "content", "filters"])

    return archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content").mapInPandas(one, "archive_id string, content binary, filters array<string>")

"""Entries to archives. Entries are encoded where they are; only joining an archive's pieces needs them together.

An archive is one value (below 2 GB) or one file in the end, so its pieces meet in one task; their encoding and
compression of members do not.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from stowage.functions import fields as ff
from stowage.functions.paths import create_name
from stowage.operators.tables import small_batches
from stowage.sources.codecs import ArchiveError, Encoder, encode

FORMATS = ("tar", "cpio", "ar", "zip")
TAR_FLAGS = {"file": b"0", "hardlink": b"1", "symlink": b"2", "char": b"3", "block": b"4", "dir": b"5", "fifo": b"6"}
MODE_BITS = {"dir": 0o040000, "symlink": 0o120000, "char": 0o020000, "block": 0o060000, "fifo": 0o010000, "socket": 0o140000}


def _pax_record(key: str, value: bytes) -> bytes:
    body = b" " + key.encode() + b"=" + value + b"\n"
    n = len(body)
    while len(str(n)) + len(body) != n:
        n = len(str(n)) + len(body)
    return str(n).encode() + body


def _tar_header(name: bytes, mode: int, uid: int, gid: int, size: int, mtime: int, flag: bytes, link: bytes) -> bytes:
    def octal(v: int, n: int) -> bytes:
        return b"%0*o\0" % (n - 1, v) if 0 <= v < 8 ** (n - 1) else b"\x80" + v.to_bytes(n - 1, "big", signed=v < 0)

    head = name.ljust(100, b"\0") + octal(mode, 8) + octal(uid, 8) + octal(gid, 8) + octal(size, 12) + octal(max(mtime, 0), 12) + b" " * 8 + flag
    head = (head + link.ljust(100, b"\0") + b"ustar\x0000").ljust(512, b"\0")
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def tar_piece(r) -> bytes:
    name, link, data = r.path, r.link or b"", r.payload or b""
    if r.kind == "dir" and not name.endswith(b"/"):
        name += b"/"
    more = b""
    if len(name) > 100:
        more, name = more + _pax_record("path", name), name[:100]
    if len(link) > 100:
        more, link = more + _pax_record("linkpath", link), link[:100]
    if r.nanos or r.secs < 0:
        whole, nanos = (r.secs, r.nanos) if r.secs >= 0 or not r.nanos else (r.secs + 1, 1_000_000_000 - r.nanos)
        more += _pax_record("mtime", b"%s%d.%09d" % (b"-" if r.secs < 0 else b"", abs(whole), nanos))
    if r.kind not in TAR_FLAGS:
        raise ArchiveError("Unsupported", f"tar: {r.kind}")
    data = data if r.kind == "file" else b""
    head = _tar_header(name, r.mode, r.uid, r.gid, len(data), r.secs, TAR_FLAGS[r.kind], link)
    before = _tar_header(b"pax", 0o644, 0, 0, len(more), 0, b"x", b"") + more + bytes(-len(more) % 512) if more else b""
    return before + head + data + bytes(-len(data) % 512)


def cpio_piece(r) -> bytes:
    data = (r.link or b"") if r.kind == "symlink" else (r.payload or b"") if r.kind == "file" else b""
    mode = MODE_BITS.get(r.kind, 0o100000) | r.mode
    values = (r.entry_index + 1, mode, r.uid, r.gid, 1, max(r.secs, 0), len(data), 0, 0, 0, 0, len(r.path) + 1, 0)
    head = b"070701" + b"".join(b"%08X" % v for v in values) + r.path + b"\0"
    return head + bytes(-len(head) % 4) + data + bytes(-len(data) % 4)


def ar_piece(r) -> bytes:
    if r.kind != "file":
        raise ArchiveError("Unsupported", f"ar: {r.kind}")
    data, name = r.payload or b"", r.path + b"/"
    if len(name) > 16 or b" " in name:  # the BSD way: the name goes before the data
        name, data = b"#1/%d" % len(r.path), r.path + data
    head = b"%-16s%-12d%-6d%-6d%-8o%-10d`\n" % (name, max(r.secs, 0), r.uid, r.gid, r.mode, len(data))
    return head + data + b"\n" * (len(data) % 2)


def zip_piece(r) -> bytes:
    """Local header and data, then the central record without its offset, then both lengths."""
    name = r.path + b"/" if r.kind == "dir" and not r.path.endswith(b"/") else r.path
    data = (r.link or b"") if r.kind == "symlink" else (r.payload or b"") if r.kind == "file" else b""
    method, body = 0, data
    if r.kind == "file" and data:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = z.compress(data) + z.flush()
        if len(packed) < len(data):
            method, body = 8, packed
    common = struct.pack("<HHHHHIIIH", 20, 0x800, method, r.dos_time, r.dos_date, zlib.crc32(data), len(body), len(data), len(name))
    extra = struct.pack("<HHBi", 0x5455, 5, 1, r.secs) if -(1 << 31) <= r.secs < 1 << 31 else b""
    local = b"PK\3\4" + common + struct.pack("<H", len(extra)) + name + extra + body
    external = (MODE_BITS.get(r.kind, 0o100000) | r.mode) << 16 | (16 if r.kind == "dir" else 0)
    central = b"PK\1\2" + struct.pack("<H", 0x314) + common + struct.pack("<HHHHI", len(extra), 0, 0, 0, external) + b"\0\0\0\0" + name + extra
    return local + central + struct.pack("<QQ", len(local), len(central))


PIECES = {"tar": tar_piece, "cpio": cpio_piece, "ar": ar_piece, "zip": zip_piece}


class Joiner:
    """Joins pieces as they come; what is compressed is not kept, so only what has been made so far is held, once for each codec."""

    def __init__(self, fmt: str, codecs: tuple[str | None, ...]) -> None:
        self.fmt, self.encoders = fmt, [Encoder(c) for c in codecs]
        self.at, self.n, self.directory = 0, 0, bytearray()
        if fmt == "ar":
            self._put(b"!<arch>\n")

    def _put(self, data: bytes | memoryview) -> None:
        for e in self.encoders:
            e.add(data)

    def add(self, piece: bytes) -> None:
        self.n += 1
        if self.fmt != "zip":
            self._put(piece)
            return
        a, b = struct.unpack("<QQ", piece[-16:])
        self._put(memoryview(piece)[:a])
        self.directory += piece[a : a + 42] + struct.pack("<I", min(self.at, 0xFFFFFFFF)) + piece[a + 46 : a + b]
        self.at += a

    def end(self) -> list[bytes]:
        if self.fmt == "tar":
            self._put(bytes(1024))
        elif self.fmt == "cpio":
            self._put(b"070701" + b"00000000" * 4 + b"00000001" + b"00000000" * 6 + b"0000000B" + b"00000000" + b"TRAILER!!!\0" + bytes(3))
        elif self.fmt == "zip":
            size = len(self.directory)
            if self.at + size > 0xFFFFFFFE or self.n > 0xFFFE:
                raise ArchiveError("SizeRequired", "zip: too large without ZIP64")
            self._put(bytes(self.directory) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, self.n, self.n, size, self.at, 0))
        return [e.end() for e in self.encoders]


def pack(entries: DataFrame, fmt: str, codec: str | None = None) -> DataFrame:
    """Archives (archive_id, content) from entries: archive_id, entry_index, path, kind, payload; optionally mode, uid,
    gid, secs, nanos, link_target. Members keep the order of entry_index; equal input gives equal bytes.
    """
    return packs(entries, fmt, (codec,)).select("archive_id", "content")


def packs(entries: DataFrame, fmt: str, codecs: tuple[str | None, ...]) -> DataFrame:
    """As :func:`pack`, each archive once for each codec (archive_id, codec, content), from pieces made and shuffled once.

    Pieces come sorted and in batches of bounded size; Python holds the archives that it is making and one batch.
    """
    if fmt not in FORMATS:
        raise ArchiveError("Unsupported", fmt)
    has = set(entries.columns)

    def of(name: str, otherwise) -> F.Column:
        return F.coalesce(F.col(name), otherwise) if name in has else otherwise

    kind = F.col("kind")
    date, time = ff.dos_date_time(of("secs", F.lit(0)))
    rows = entries.select(
        F.col("archive_id").cast("string").alias("archive_id"), F.col("entry_index").cast("long").alias("entry_index"), F.col("path").cast("binary").alias("path"), "kind",
        (F.col("payload").cast("binary") if "payload" in has else F.lit(None).cast("binary")).alias("payload"), (F.col("link_target").cast("binary") if "link_target" in has else F.lit(None).cast("binary")).alias("link"),
        of("mode", ff.default_mode(kind)).cast("int").alias("mode"), of("uid", F.lit(0)).cast("long").alias("uid"), of("gid", F.lit(0)).cast("long").alias("gid"),
        of("secs", F.lit(0)).cast("long").alias("secs"), of("nanos", F.lit(0)).cast("int").alias("nanos"), date.cast("int").alias("dos_date"), time.cast("int").alias("dos_time"),
    )
    encode_one = PIECES[fmt]

    small_batches(entries.sparkSession)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"archive_id": b["archive_id"], "entry_index": b["entry_index"], "piece": [encode_one(r) for r in b.itertuples()]})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> Iterator[pa.RecordBatch]:
            for name, content in zip(codecs, own.end(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([name], pa.string()), pa.array([content], pa.binary())], ["archive_id", "codec", "content"])

        at, own = None, None
        for b in batches:
            for archive_id, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if own is None or archive_id != at:
                    if own is not None:
                        yield from ended()
                    at, own = archive_id, Joiner(fmt, codecs)
                own.add(piece.as_py())
        if own is not None:
            yield from ended()

    pieces = rows.mapInPandas(encoded, "archive_id string, entry_index long, piece binary")
    pieces = pieces.repartition("archive_id").sortWithinPartitions("archive_id", "entry_index", "piece")
    return pieces.select("archive_id", "piece").mapInArrow(joined, "archive_id string, codec string, content binary")


def build_layers(entries: DataFrame, codec: str | None = "gzip") -> DataFrame:
    """Image layers: archive_id, content, digest (of what is stored) and diff_id (of the tar within), as descriptors."""
    plain = pack(entries, "tar").select("archive_id", ff.descriptor(ff.digest(F.col("content"))).alias("diff_id"), "content")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[encode(bytes(c), codec) for c in b["content"]])

    out = plain.mapInPandas(packed, "archive_id string, diff_id string, content binary")
    return out.select("archive_id", "content", ff.descriptor(ff.digest(F.col("content"))).alias("digest"), "diff_id")


def from_files(spark: SparkSession, folder: str, archive_id: str) -> DataFrame:
    """Entries of an archive of all files below a folder: names relative to it, in their order; unsafe names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = create_name(F.element_at(F.split("path", f"/{folder.strip('/').rpartition('/')[2]}/", 2), -1))
    rows = files.select(F.lit(archive_id).alias("archive_id"), name.alias("path"), F.lit("file").alias("kind"), F.col("content").alias("payload"), F.unix_timestamp("modificationTime").alias("secs"))
    nth = F.row_number().over(Window.partitionBy("archive_id").orderBy("path"))
    return rows.where("path IS NOT NULL").withColumn("entry_index", nth.cast("long"))


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class _ArchiveFiles(DataSourceWriter):
    """Each task writes beside the target; commit moves all files into place, abort leaves nothing."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.folder, self.suffix = folder, suffix

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        files = []
        try:
            for row in rows:
                name = os.path.join(self.folder, row.archive_id.replace("/", "_") + self.suffix)
                hidden = os.path.join(self.folder, f".{uuid.uuid4().hex}")
                files.append((hidden, name))
                with open(hidden, "wb") as f:
                    f.write(row.content)
        except BaseException:
            for hidden, _ in files:
                if os.path.exists(hidden):
                    os.remove(hidden)
            raise
        return _Written(files)

    def commit(self, messages: list) -> None:
        for m in messages:
            for hidden, name in m.files:
                os.replace(hidden, name)

    def abort(self, messages: list) -> None:
        for m in messages:
            for hidden, _ in m.files if m else []:
                if os.path.exists(hidden):
                    os.remove(hidden)


class ArchiveSink(DataSource):
    """``df.write.format("archives").mode("append").save(folder)`` for archives (archive_id, content).

    The folder has to be mounted on driver and executors alike. Option ``suffix``: ending of the file names.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ArchiveFiles(self.options["path"], self.options.get("suffix", ""))

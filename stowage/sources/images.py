"""Walkers for ISO 9660, CAB and XAR, and the headers of RPM and signed APK. See :mod:`stowage.sources.walkers`."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import fields as ff
from stowage.operators.packages import deb_role
from stowage.sources.codecs import ArchiveError, detect

Raw = tuple[dict[str, bytes], dict[str, bytes], int, "memoryview | bytes"]
SECTOR, DESCRIPTORS = 2048, 64


def _susp(record: bytes, name_end: int) -> Iterator[tuple[bytes, bytes]]:
    """System use entries of a directory record."""
    at = name_end + name_end % 2  # names are padded to even positions
    while at + 4 <= len(record):
        n = record[at + 2]
        if n < 4 or at + n > len(record):
            return
        yield record[at : at + 2], record[at + 4 : at + n]
        at += n


def _rock_ridge(record: bytes, name_end: int) -> dict[str, bytes]:
    out: dict[str, bytes] = {}
    name, link = b"", []
    for kind, body in _susp(record, name_end):
        if kind == b"PX" and len(body) >= 32:
            mode, _, _, _, uid, _, gid = struct.unpack_from("<7I", body)
            out |= {"mode": b"%d" % mode, "uid": b"%d" % uid, "gid": b"%d" % gid}
        elif kind == b"NM":
            name += body[1:]
        elif kind == b"RE":
            out["relocated"] = b"1"
        elif kind == b"SL":
            at = 1
            while at + 2 <= len(body):
                flags, n = body[at], body[at + 1]
                link.append(b"." if flags & 2 else b".." if flags & 4 else b"" if flags & 8 else body[at + 2 : at + 2 + n])
                at += 2 + n
    if name:
        out["name"] = name
    if link:
        out["link"] = b"/".join(link)
    return out


def iso(data: memoryview, budget: int) -> Iterator[Raw]:
    """Rock Ridge names if there are any, else Joliet's, else the primary ones. Directories are taken last in first out."""
    primary = joliet = None
    for i in range(DESCRIPTORS):
        d = bytes(data[(16 + i) * SECTOR : (17 + i) * SECTOR])
        if len(d) < SECTOR or d[1:6] != b"CD001":
            raise ArchiveError("Malformed", "iso: volume descriptor")
        if d[0] == 255:
            break
        if d[0] == 1 and primary is None:
            primary = d
        if d[0] == 2 and d[88:91] in (b"%/@", b"%/C", b"%/E"):
            joliet = d
    else:
        raise ArchiveError("Malformed", "iso: no terminator")
    if primary is None or struct.unpack_from("<H", primary, 128)[0] != SECTOR:
        raise ArchiveError("Malformed", "iso: block size")

    def records(extent: int, size: int) -> Iterator[bytes]:
        if size > budget or extent * SECTOR + size > len(data):
            raise ArchiveError("Malformed", "iso: directory beyond the end")
        area, at = bytes(data[extent * SECTOR : extent * SECTOR + size]), 0
        while at < size:
            n = area[at]
            if not n:  # on to the next sector
                at = (at // SECTOR + 1) * SECTOR
                continue
            if n < 34 or at + n > size:
                raise ArchiveError("Malformed", "iso: directory record")
            yield area[at : at + n]
            at += n

    def place(record: bytes) -> tuple[int, int]:
        return struct.unpack_from("<I", record, 2)[0], struct.unpack_from("<I", record, 10)[0]

    root = primary[156:190]
    first = next(records(*place(root)), b"")
    rocky = any(kind == b"SP" for kind, _ in _susp(first, 33 + first[32])) if first else False
    wide = joliet is not None and not rocky
    stack, seen = [(b"", *place(joliet[156:190] if wide else root))], set()
    while stack:
        prefix, extent, size = stack.pop()
        if extent in seen:
            continue
        seen.add(extent)
        for r in records(extent, size):
            end = 33 + r[32]
            name = r[33:end]
            if name in (b"\0", b"\1"):
                continue
            extra = _rock_ridge(r, end) if rocky else {}
            if "relocated" in extra:
                continue
            if r[25] & 0x80:
                raise ArchiveError("Unsupported", "iso: file of several extents")
            text = extra.get("name") or (name.decode("utf-16-be", "replace").encode() if wide else name)
            text = text.rpartition(b";")[0] or text
            path, (at, length) = prefix + text, place(r)
            folder = bool(r[25] & 2)
            fields = extra | {"name": path + b"/" * folder, "kind": b"dir" if folder else b"symlink" if "link" in extra else b"file", "time7": r[18:25]}
            if folder:
                stack.append((path + b"/", at, length))
            if at * SECTOR + length > len(data):
                raise ArchiveError("Malformed", "iso: file beyond the end")
            yield fields, {}, 0 if folder else length, b"" if folder else data[at * SECTOR : at * SECTOR + length]


def cab(data: memoryview, budget: int) -> Iterator[Raw]:
    """Stored and MSZIP folders; other methods list and fail only when a payload is due (fields then say so)."""
    if len(data) < 36:
        raise ArchiveError("Malformed", "cab: header ends early")
    (files_at,) = struct.unpack_from("<I", data, 16)
    n_folders, n_files, flags = struct.unpack_from("<HHH", data, 26)
    at, folder_extra, block_extra = 36, 0, 0
    if flags & 4:
        header_extra, folder_extra, block_extra = struct.unpack_from("<HBB", data, at)
        at += 4 + header_extra
    if flags & 3:
        raise ArchiveError("Unsupported", "cab: spans several files")
    folders = []
    for _ in range(n_folders):
        folders.append(struct.unpack_from("<IHH", data, at))
        at += 8 + folder_extra
    done: dict[int, bytes] = {}

    def content(k: int) -> bytes:
        start, blocks, method = folders[k]
        if k not in done:
            out, window = [], b""
            for _ in range(blocks):
                n, real = struct.unpack_from("<HH", data, start + 4)
                body = bytes(data[start + 8 + block_extra : start + 8 + block_extra + n])
                start += 8 + block_extra + n
                if not real:
                    raise ArchiveError("Unsupported", "cab: block goes on elsewhere")
                if method & 15 == 1:
                    if body[:2] != b"CK":
                        raise ArchiveError("Malformed", "cab: MSZIP block")
                    try:
                        body = zlib.decompressobj(-15, zdict=window).decompress(body[2:], 32769)
                    except zlib.error as e:
                        raise ArchiveError("Malformed", f"cab: {e}") from None
                if len(body) != real or real > 32768:
                    raise ArchiveError("Malformed", "cab: block size")
                window = (window + body)[-32768:]
                out.append(body)
                if sum(map(len, out)) > budget:
                    raise ArchiveError("Limit", "cab: folder size")
            done.clear()  # one folder at a time
            done[k] = b"".join(out)
        return done[k]

    at = files_at
    for _ in range(n_files):
        size, offset, folder, date, time, _ = struct.unpack_from("<IIHHHH", data, at)
        end = bytes(data[at + 16 : at + 272]).find(b"\0")
        if end < 0 or folder >= len(folders):
            raise ArchiveError("Malformed", "cab: file record")
        name = bytes(data[at + 16 : at + 16 + end]).replace(b"\\", b"/")
        at += 17 + end
        method = folders[folder][2] & 15
        if method > 1:
            raise ArchiveError("Unsupported", f"cab: method {method}")
        body = content(folder)[offset : offset + size]
        if len(body) != size:
            raise ArchiveError("Malformed", "cab: file beyond its folder")
        yield {"name": name, "kind": b"file", "dos_date": b"%d" % date, "dos_time": b"%d" % time}, {}, size, body


def xar(data: memoryview, budget: int) -> Iterator[Raw]:
    """Stored and zlib members; parents before children; names that are no single component are malformed."""
    size, _, packed, real = struct.unpack_from(">HHQQ", data, 4)
    if real > budget:
        raise ArchiveError("Limit", "xar: table of contents")
    try:
        toc = zlib.decompressobj().decompress(bytes(data[size : size + packed]), real + 1)
        if b"<!DOCTYPE" in toc or b"<!ENTITY" in toc:
            raise ArchiveError("Unsupported", "xar: document type in the table of contents")
        tree = ElementTree.fromstring(toc)
    except (zlib.error, ElementTree.ParseError) as e:
        raise ArchiveError("Malformed", f"xar: {e}") from None
    heap = size + packed
    stack = [(b"", f) for f in reversed(tree.findall("toc/file"))]
    while stack:
        prefix, f = stack.pop()
        text = lambda tag, f=f: (f.findtext(tag) or "").strip().encode()
        name = (f.findtext("name") or "").encode()
        if name in (b"", b".", b"..") or b"/" in name:
            raise ArchiveError("Malformed", "xar: name")
        kind = text("type") if text("type") in (b"directory", b"symlink") else b"file"
        path = prefix + name
        stack += [(path + b"/", g) for g in reversed(f.findall("file"))]
        fields = {"name": path, "kind": b"dir" if kind == b"directory" else kind, "iso8601": text("mtime")}
        fields |= {k: v for k in ("uid", "gid") if (v := text(k))} | ({"mode": b"%d" % int(text("mode"), 8)} if text("mode") else {}) | ({"link": text("link")} if text("link") else {})
        body: memoryview | bytes = b""
        if kind == b"file" and f.find("data") is not None:
            offset, length, n = (int(f.findtext(f"data/{k}") or 0) for k in ("offset", "length", "size"))
            encoding = f.find("data/encoding")
            style = "application/octet-stream" if encoding is None else encoding.get("style", "")
            body = data[heap + offset : heap + offset + length]
            if n > budget:
                raise ArchiveError("Limit", "xar: member size")
            if style == "application/x-gzip":
                try:
                    body = zlib.decompressobj().decompress(bytes(body), n + 1)
                except zlib.error as e:
                    raise ArchiveError("Malformed", f"xar: {e}") from None
            elif style != "application/octet-stream":
                raise ArchiveError("Unsupported", f"xar: {style}")
            if len(body) != n:
                raise ArchiveError("Malformed", "xar: member size")
        yield fields, {}, len(body), body


def _rpm_header(data: bytes, at: int) -> tuple[dict[int, bytes], int]:
    """String tags of a header, and where it ends."""
    if data[at : at + 4] != b"\x8e\xad\xe8\x01":
        raise ArchiveError("Malformed", "rpm: header magic")
    n, size = struct.unpack_from(">II", data, at + 8)
    store = at + 16 + 16 * n
    if store + size > len(data):
        raise ArchiveError("Malformed", "rpm: header ends early")
    tags = {}
    for i in range(n):
        tag, kind, offset, _ = struct.unpack_from(">IIII", data, at + 16 + 16 * i)
        if kind == 6 and offset < size:
            tags[tag] = data[store + offset : store + size].split(b"\0")[0]
    return tags, store + size


def rpm_table(archives: DataFrame) -> DataFrame:
    """One row per RPM: what :func:`stowage.operators.packages.rpm_findings` asks for, and the payload as content."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, data in zip(batch["archive_id"], batch["content"], strict=True):
                data, tags, end = bytes(data or b""), None, 0
                lead = data[:4] == b"\xed\xab\xee\xdb" and len(data) >= 96
                if lead:
                    try:
                        _, end = _rpm_header(data, 96)
                        tags, end = _rpm_header(data, end + -end % 8)
                    except ArchiveError:
                        tags = None
                body = data[end:] if tags is not None else None
                # Tags of the payload's format and compressor.
                word = lambda t, tags=tags: tags[t].decode("ascii", "replace") if tags and t in tags else None
                rows.append((i, lead, tags is not None, word(1124), word(1125), detect(body) if body else None, body))
            yield pd.DataFrame(rows, columns=["archive_id", "lead_ok", "header_ok", "payload_format", "compressor", "detected", "content"])

    schema = "archive_id string, lead_ok boolean, header_ok boolean, payload_format string, compressor string, detected string, content binary"
    return archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content").mapInPandas(one, schema)


def signing_ids(archives: DataFrame) -> DataFrame:
    """archive_id and the ids in the signing block before a ZIP's central directory (null without a block).

    Offsets come from the end record, ids from length-prefixed pairs; a block whose lengths do not fit has no ids.
    """

    def ids(data: bytes) -> list[int] | None:
        end = data.rfind(b"PK\5\6", max(0, len(data) - 65557))
        if end < 0 or end + 20 > len(data):
            return None
        (central,) = struct.unpack_from("<I", data, end + 16)
        if central < 32 or data[central - 16 : central] != b"APK Sig Block 42":
            return None
        (size,) = struct.unpack_from("<Q", data, central - 24)
        at, stop, out = central - size, central - 24, []
        if at < 8 or struct.unpack_from("<Q", data, at - 8)[0] != size:
            return []
        while at + 12 <= stop:
            n, kind = struct.unpack_from("<QI", data, at)
            if n < 4 or at + 8 + n > stop:
                return []
            out.append(kind)
            at += 8 + n
        return out

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"archive_id": b["archive_id"], "signing_ids": [ids(bytes(c or b"")) for c in b["content"]]})

    return archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content").mapInPandas(one, "archive_id string, signing_ids array<long>")


def deb_nested(members: DataFrame) -> DataFrame:
    """Entries of the control and data archives inside Debian packages: archive_id, member, entry_index, path.

    members: entries with payload of the outer archives, as rows of one chunk each.
    """
    from stowage.sources.archives import entries

    inner = members.where(deb_role(F.col("path")).isin(1, 2)).select(F.concat_ws("\0", "archive_id", "path").alias("archive_id"), F.col("payload").alias("content"))
    return entries(inner).select(F.substring_index("archive_id", "\0", 1).alias("archive_id"), F.substring_index("archive_id", "\0", -1).alias("member"), "entry_index", "path")


WALKERS = {"iso9660": iso, "cab": cab, "xar": xar}


def detect_image(data: memoryview) -> str | None:
    if bytes(data[:4]) == b"MSCF":
        return "cab"
    if bytes(data[:4]) == b"xar!":
        return "xar"
    return "iso9660" if bytes(data[32769:32774]) == b"CD001" else None


def seconds(kind: str) -> F.Column:
    """Seconds since 1970 from the raw time fields of these formats."""
    field = lambda k: F.try_element_at("fields", F.lit(k))
    if kind == "iso9660":
        return ff.iso_short_time(field("time7"))
    if kind == "cab":
        return ff.dos_seconds(field("dos_date").cast("string").cast("int"), field("dos_time").cast("string").cast("int"))
    return F.unix_timestamp(F.try_to_timestamp(field("iso8601").cast("string")))

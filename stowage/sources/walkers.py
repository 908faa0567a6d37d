"""Where the records of a container are. A walker cuts out raw fields and payload; columns make sense of them.

Each yields (fields, records, size, payload): raw header fields by name, extended records by key, and the payload's
bytes (a memoryview, not yet copied).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from stowage.sources.codecs import ArchiveError

Raw = tuple[dict[str, bytes], dict[str, bytes], int, "memoryview | bytes"]

ZEROS = bytes(512)
#: Where tar header fields lie: fixed values.
TAR_FIELDS = {
    "name": (0, 100), "mode": (100, 8), "uid": (108, 8), "gid": (116, 8), "mtime": (136, 12), "flag": (156, 1), "link": (157, 100), "magic": (257, 6),
    "user": (265, 32), "group": (297, 32), "devmajor": (329, 8), "devminor": (337, 8), "prefix": (345, 155),
}


def _number(field: bytes) -> int:
    if field[0] == 0xFF:
        return int.from_bytes(field, "big", signed=True)
    if field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    text = field.replace(b"\0", b" ").strip()
    try:
        return int(text, 8) if text else 0
    except ValueError:
        raise ArchiveError("Malformed", "tar: bad number") from None


def _checked(header: bytes) -> None:
    rest = header[:148] + b" " * 8 + header[156:]
    total = sum(rest)
    if _number(header[148:156]) not in (total, total - 256 * sum(b > 127 for b in rest)):
        raise ArchiveError("Malformed", "tar: header checksum")


def _pax(body: bytes) -> dict[str, bytes]:
    out: dict[str, bytes] = {}
    pairs: list[bytes] = []
    at = 0
    while at < len(body) and body[at : at + 1] != b"\0":
        space = body.find(b" ", at)
        try:
            n = int(body[at:space])
        except ValueError:
            raise ArchiveError("Malformed", "tar: pax record length") from None
        record = body[space + 1 : at + n]
        if space < 0 or n <= 0 or at + n > len(body) or record[-1:] != b"\n" or b"=" not in record:
            raise ArchiveError("Malformed", "tar: pax record")
        key, _, value = record[:-1].partition(b"=")
        name = key.decode("utf-8", "replace")
        if name in ("GNU.sparse.offset", "GNU.sparse.numbytes"):
            pairs.append(value)
        out[name] = value
        at += n
    if pairs and "GNU.sparse.map" not in out:
        out["GNU.sparse.map"] = b",".join(pairs)
    return out


def _filled(extents: list[tuple[int, int]], real: int, stored: memoryview, budget: int) -> bytes:
    """Payload with zeros in its holes."""
    if real > budget:
        raise ArchiveError("Limit", "tar: logical size")
    out, at, end = bytearray(real), 0, 0
    for offset, n in extents:
        if offset < end or offset + n > real or at + n > len(stored):
            raise ArchiveError("Malformed", "tar: sparse extents")
        out[offset : offset + n] = stored[at : at + n]
        at, end = at + n, offset + n
    if at != len(stored):
        raise ArchiveError("Malformed", "tar: sparse extents do not cover what is stored")
    return bytes(out)


def tar(data: memoryview, budget: int) -> Iterator[Raw]:
    at, everywhere, pending, long = 0, {}, {}, {}
    while at + 512 <= len(data):
        header = bytes(data[at : at + 512])
        at += 512
        if header == ZEROS:
            if bytes(data[at:]).strip(b"\0"):
                raise ArchiveError("Malformed", "tar: data after the end")
            return
        _checked(header)
        fields = {k: header[a : a + n] for k, (a, n) in TAR_FIELDS.items()}
        fields |= {k: b"%d" % _number(fields[k]) for k in ("mode", "uid", "gid", "devmajor", "devminor")}
        try:
            fields["mtime"] = b"%d" % _number(fields["mtime"])
        except ArchiveError:
            del fields["mtime"]
        size, flag = _number(header[124:136]), fields["flag"]
        own = flag in (b"x", b"X", b"g", b"L", b"K")
        records = {} if own else {**everywhere, **pending}
        if "size" in records:
            try:
                size = int(records["size"])
            except ValueError:
                raise ArchiveError("Malformed", "tar: pax size") from None
        extents, real = [], 0
        if flag == b"S":
            real = _number(header[483:495])
            part, more = header[386:482], header[482]
            while True:
                extents += [(_number(part[i : i + 12]), _number(part[i + 12 : i + 24])) for i in range(0, len(part), 24) if part[i] or part[i + 12]]
                if not more:
                    break
                if at + 512 > len(data):
                    raise ArchiveError("Malformed", "tar: sparse headers end early")
                part, more = bytes(data[at : at + 504]), data[at + 504]
                at += 512
        if flag in (b"1", b"2", b"3", b"4", b"5", b"6"):
            size = 0 if flag != b"1" or "size" not in records else size
        if at + size > len(data):
            raise ArchiveError("Malformed", "tar: payload ends early")
        body = data[at : at + size]
        at += -(-size // 512) * 512
        if flag in (b"x", b"X"):
            pending = {**pending, **_pax(bytes(body))}
        elif flag == b"g":
            everywhere = {**everywhere, **_pax(bytes(body))}
        elif own:
            long["long_name" if flag == b"L" else "long_link"] = bytes(body).split(b"\0")[0]
        else:
            payload: memoryview | bytes = body
            if "GNU.sparse.map" in records:
                numbers = [int(x) for x in records["GNU.sparse.map"].split(b",")]
                extents = list(zip(numbers[::2], numbers[1::2], strict=False))
                real = int(records.get("GNU.sparse.size", records.get("GNU.sparse.realsize", b"0")))
            if extents or flag == b"S":
                payload, size = _filled(extents, real, body, budget), real
                records = {**records, "sparse": b",".join(b"%d,%d" % e for e in extents)}
            yield {**fields, **long}, records, size, payload
            pending, long = {}, {}


def cpio(data: memoryview, budget: int) -> Iterator[Raw]:
    # Where the fields of each dialect lie.
    newc = ["ino", "mode", "uid", "gid", "nlink", "mtime", "size", "dev_major", "dev_minor", "rdev_major", "rdev_minor", "name", "check"]
    odc = {"dev_minor": (6, 6), "ino": (12, 6), "mode": (18, 6), "uid": (24, 6), "gid": (30, 6), "nlink": (36, 6), "rdev_minor": (42, 6), "mtime": (48, 11), "name": (59, 6), "size": (65, 11)}
    at = 0
    while True:
        magic = bytes(data[at : at + 6])
        if magic in (b"070701", b"070702"):
            fixed, base, align = 110, b"16", 4
            fields = {k: bytes(data[at + 6 + 8 * i : at + 14 + 8 * i]) for i, k in enumerate(newc)}
        elif magic == b"070707":
            fixed, base, align = 76, b"8", 1
            fields = {k: bytes(data[at + a : at + a + n]) for k, (a, n) in odc.items()} | {"dev_major": b"0", "rdev_major": b"0"}
        elif magic[:2] in (b"\xc7\x71", b"\x71\xc7"):
            fixed, base, align = 26, b"8", 2
            if at + 26 > len(data):
                raise ArchiveError("Malformed", "cpio: header ends early")
            w = struct.unpack_from(("<" if magic[:2] == b"\xc7\x71" else ">") + "13H", data, at)
            values = {"dev_minor": w[1], "ino": w[2], "mode": w[3], "uid": w[4], "gid": w[5], "nlink": w[6], "rdev_minor": w[7], "mtime": w[8] << 16 | w[9], "name": w[10], "size": w[11] << 16 | w[12]}
            fields = {k: b"%o" % v for k, v in values.items()} | {"dev_major": b"0", "rdev_major": b"0"}
        else:
            raise ArchiveError("Malformed", "cpio: magic" if len(data) - at >= 6 else "cpio: trailer missing")
        try:
            fields = {k: int(v, int(base)) for k, v in fields.items()}
        except ValueError:
            raise ArchiveError("Malformed", "cpio: bad number") from None
        n_name, size = fields["name"], fields["size"]
        name = bytes(data[at + fixed : at + fixed + n_name])
        if len(name) < n_name or n_name < 2 or name[-1]:
            raise ArchiveError("Malformed", "cpio: path")
        start = at + -(-(fixed + n_name) // align) * align
        if name == b"TRAILER!!!\0":
            if bytes(data[start:]).strip(b"\0"):
                raise ArchiveError("Malformed", "cpio: data after the trailer")
            return
        body = data[start : start + size]
        if len(body) < size:
            raise ArchiveError("Malformed", "cpio: payload ends early")
        if magic == b"070702" and sum(body) & 0xFFFFFFFF != fields["check"]:
            raise ArchiveError("Integrity", "cpio: checksum")
        at = start + -(-size // align) * align
        yield {k: b"%d" % v for k, v in fields.items()} | {"name": name[:-1]}, {}, size, body


def ar(data: memoryview, budget: int) -> Iterator[Raw]:
    thin, at, names = bytes(data[:8]) == b"!<thin>\n", 8, b""
    while at < len(data):
        header = bytes(data[at : at + 60])
        at += 60
        if len(header) < 60 or header[58:] != b"`\n":
            raise ArchiveError("Malformed", "ar: header")
        fields = {"name": header[:16].rstrip(b" "), "mtime": header[16:28], "uid": header[28:34], "gid": header[34:40], "mode": header[40:48]}
        try:
            size = int(header[48:58])
            for k, base in (("mtime", 10), ("uid", 10), ("gid", 10), ("mode", 8)):
                fields[k] = b"%d" % int(fields[k].strip() or b"0", base)
        except ValueError:
            raise ArchiveError("Malformed", "ar: bad number") from None
        name = fields["name"]
        table = name in (b"/", b"//", b"/SYM64/")
        stored = 0 if thin and not table else size
        body = data[at : at + stored]
        if len(body) < stored:
            raise ArchiveError("Malformed", "ar: payload ends early")
        at += stored + stored % 2
        if name == b"//":
            names = bytes(body)
        if table:
            continue
        if name.startswith(b"#1/"):
            n = int(name[3:])
            fields["name"], body, size = bytes(body[:n]).rstrip(b"\0"), body[n:], size - n
        elif name[:1] == b"/" and name[1:].isdigit():
            start = int(name[1:])
            end = names.find(b"\n", start)
            if start >= len(names) or end < 0:
                raise ArchiveError("Malformed", "ar: long name")
            fields["name"] = names[start:end].removesuffix(b"/")
        else:
            fields["name"] = name.removesuffix(b"/")
        yield fields | ({"thin": b"1"} if thin else {}), {}, size, body


def zip_entries(data: memoryview, budget: int) -> Iterator[Raw]:
    """Central directory records (without payloads; see :func:`zip_payload`)."""
    tail = bytes(data[max(0, len(data) - 65557) :])
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ArchiveError("Malformed", "zip: no end of central directory")
    base = len(data) - len(tail)
    n, size, offset = struct.unpack_from("<HII", tail, end + 10)
    if base + end >= 20 and bytes(data[base + end - 20 : base + end - 16]) == b"PK\6\7":
        (at64,) = struct.unpack_from("<Q", data, base + end - 12)
        if bytes(data[at64 : at64 + 4]) != b"PK\6\6":
            raise ArchiveError("Malformed", "zip: ZIP64 end record")
        n, size, offset = struct.unpack_from("<QQQ", data, at64 + 32)
    at = offset
    for _ in range(n):
        head = bytes(data[at : at + 46])
        if len(head) < 46 or head[:4] != b"PK\1\2":
            raise ArchiveError("Malformed", "zip: central directory")
        stored, real, a, b, c = struct.unpack_from("<IIHHH", head, 20)
        (local,) = struct.unpack_from("<I", head, 42)
        name, extra, comment = (bytes(data[at + 46 + i : at + 46 + j]) for i, j in ((0, a), (a, a + b), (a + b, a + b + c)))
        at += 46 + a + b + c
        extras: dict[str, bytes] = {}
        i = 0
        while i + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, i)
            if i + 4 + length > len(extra):
                raise ArchiveError("Malformed", "zip: extra field")
            extras.setdefault(f"{kind:04x}", extra[i + 4 : i + 4 + length])
            i += 4 + length
        wide = extras.get("0001", b"")
        values = [real, stored, local]
        for k, v in enumerate(values):
            if v == 0xFFFFFFFF:
                if len(wide) < 8:
                    raise ArchiveError("Malformed", "zip: ZIP64 value")
                values[k], wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
        fields = {"head": head, "name": name, "comment": comment, "stored": b"%d" % values[1], "local": b"%d" % values[2]}
        yield fields, extras, values[0], b""


def zip_payload(data: memoryview, method: int, flags: int, local: int, stored: int, size: int, budget: int) -> bytes:
    import bz2
    import lzma
    import zlib

    if flags & 1:
        raise ArchiveError("Unsupported", "zip: encrypted")
    if size > budget:
        raise ArchiveError("Limit", "zip: entry size")
    if bytes(data[local : local + 4]) != b"PK\3\4":
        raise ArchiveError("Malformed", "zip: local header")
    a, b = struct.unpack_from("<HH", data, local + 26)
    raw = bytes(data[local + 30 + a + b : local + 30 + a + b + stored])
    try:
        if method == 0:
            out = raw
        elif method == 8:
            out = zlib.decompressobj(-15).decompress(raw, size + 1)
        elif method == 12:
            out = bz2.BZ2Decompressor().decompress(raw, size + 1)
        elif method == 14:
            (n,) = struct.unpack_from("<H", raw, 2)
            props = lzma._decode_filter_properties(lzma.FILTER_LZMA1, raw[4 : 4 + n])
            out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[props]).decompress(raw[4 + n :], size + 1)
        elif method == 93:
            import zstandard

            out = zstandard.ZstdDecompressor().decompress(raw, max_output_size=size + 1)
        else:
            raise ArchiveError("Unsupported", f"zip: method {method}")
    except (zlib.error, OSError, lzma.LZMAError) as e:
        raise ArchiveError("Malformed", f"zip: {e}") from None
    if len(out) != size:
        raise ArchiveError("Integrity", "zip: size")
    return out


WALKERS = {"tar": tar, "cpio": cpio, "ar": ar, "zip": zip_entries}


def detect(data: bytes | memoryview) -> str | None:
    """Container by magic; tar last, by its first header's checksum. Two empty blocks are an empty tar."""
    start = bytes(data[:512])
    if start[:4] in (b"PK\3\4", b"PK\5\6"):
        return "zip"
    if start[:6] in (b"070701", b"070702", b"070707") or start[:2] in (b"\xc7\x71", b"\x71\xc7"):
        return "cpio"
    if start[:8] in (b"!<arch>\n", b"!<thin>\n"):
        return "ar"
    if len(start) == 512:
        try:
            if start == ZEROS:
                return "tar"
            _checked(start)
            return "tar"
        except ArchiveError:
            return None
    return None

"""Outer compression, undone within budgets. Each step produces at most what the budget still allows."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

FILTER_DEPTH, DECODED_TOTAL = 4, 4 << 30


class ArchiveError(Exception):
    """An archive that cannot be read further; kind is Malformed, Unsupported, Limit, Integrity or Capability."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def detect(data: bytes) -> str | None:
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if data[:6] == b"\xfd7zXZ\0":
        return "xz"
    if data[:4] == b"\x04\x22\x4d\x18":
        return "lz4"
    if data[:3] == b"BZh" and data[3:4] in (b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"):
        return "bzip2"
    return None


def _member(codec: str, budget: int, data: bytes) -> tuple[bytes, bytes]:
    """Decode one member: what it holds, and the bytes after it."""
    try:
        if codec == "gzip":
            d = zlib.decompressobj(31)
            out = d.decompress(data, budget + 1)
            end, rest = d.eof, d.unused_data
        elif codec == "bzip2":
            b = bz2.BZ2Decompressor()
            out = b.decompress(data, budget + 1)
            end, rest = b.eof, b.unused_data
        elif codec == "xz":
            x = lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=64 << 20)
            out = x.decompress(data, budget + 1)
            end, rest = x.eof, x.unused_data
        elif codec == "zstd":
            try:
                import zstandard
            except ImportError:
                raise ArchiveError("Capability", "zstd needs the package zstandard") from None
            z = zstandard.ZstdDecompressor(max_window_size=64 << 20).decompressobj()
            made, at = bytearray(), 0
            while at < len(data) and not z.eof and len(made) <= budget:
                made += z.decompress(data[at : at + (1 << 16)])
                at += 1 << 16
            out = bytes(made)
            del made
            end, rest = z.eof, z.unused_data + data[at:] if z.eof else b""
        else:
            return lz4_frame(data, budget)
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError) as e:
        raise ArchiveError("Limit" if "memory usage limit" in str(e).lower() else "Malformed", f"{codec}: {e}") from None
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            raise ArchiveError("Malformed", f"zstd: {e}") from None
        raise
    if len(out) > budget:
        raise ArchiveError("Limit", f"{codec}: more decoded bytes than the budget allows")
    if not end:
        raise ArchiveError("Malformed", f"{codec}: data end early")
    return out, rest


def lz4_block(src: bytes, window: bytes, budget: int) -> bytes:
    """One LZ4 block; window: up to 64 KiB decoded before it."""
    out, base, i, n = bytearray(window), len(window), 0, len(src)
    try:
        while i < n:
            token = src[i]
            i += 1
            length = token >> 4
            if length == 15:
                while True:
                    length += src[i]
                    i += 1
                    if src[i - 1] != 255:
                        break
            if i + length > n:
                raise IndexError
            out += src[i : i + length]
            i += length
            if i >= n:
                break
            offset = src[i] | src[i + 1] << 8
            i += 2
            length = (token & 15) + 4
            if length == 19:
                while True:
                    length += src[i]
                    i += 1
                    if src[i - 1] != 255:
                        break
            start = len(out) - offset
            if not offset or start < 0:
                raise ArchiveError("Malformed", "lz4: match before the start")
            while length > 0:  # a match may overlap what it makes
                piece = out[start : start + min(length, offset)]
                out += piece
                start += len(piece)
                length -= len(piece)
            if len(out) - base > budget:
                raise ArchiveError("Limit", "lz4: more decoded bytes than the budget allows")
    except IndexError:
        raise ArchiveError("Malformed", "lz4: block ends early") from None
    return bytes(out[base:])


def lz4_frame(data: bytes, budget: int) -> tuple[bytes, bytes]:
    if len(data) < 7 or data[4] >> 6 != 1:
        raise ArchiveError("Malformed", "lz4: bad frame header")
    flags = data[4]
    at = 6 + (8 if flags & 8 else 0) + (4 if flags & 1 else 0) + 1
    out = bytearray()
    while True:
        if at + 4 > len(data):
            raise ArchiveError("Malformed", "lz4: frame ends early")
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        if not size:
            break
        body = data[at : at + (size & 0x7FFFFFFF)]
        if len(body) < size & 0x7FFFFFFF:
            raise ArchiveError("Malformed", "lz4: frame ends early")
        window = b"" if flags & 32 else bytes(out[-65536:])
        out += body if size >> 31 else lz4_block(body, window, budget - len(out))
        if len(out) > budget:
            raise ArchiveError("Limit", "lz4: more decoded bytes than the budget allows")
        at += len(body) + (4 if flags & 16 else 0)
    at += 4 if flags & 4 else 0
    return bytes(out), data[at:]


def decode(data: bytes, depth: int = FILTER_DEPTH, total: int = DECODED_TOTAL) -> tuple[bytes, list[str]]:
    """Undo all outer compression: the bytes within and the codecs, outermost first.

    Members of one codec may follow each other (after xz also zeros, by fours); anything else behind a member is
    malformed. Deeper nesting than ``depth`` and more bytes than ``total`` break a budget.
    """
    codecs: list[str] = []
    while codec := detect(data):
        if len(codecs) == depth:
            raise ArchiveError("Limit", "compression is nested too deeply")
        codecs.append(codec)
        out, rest = _member(codec, total, data)
        parts, n = [out], len(out)
        while rest:
            if codec == "xz" and not rest.strip(b"\0"):
                if len(rest) % 4:
                    raise ArchiveError("Malformed", "xz: padding is no multiple of four")
                break
            if codec == "xz":
                zeros = len(rest) - len(rest.lstrip(b"\0"))
                if zeros % 4:
                    raise ArchiveError("Malformed", "xz: padding is no multiple of four")
                rest = rest[zeros:]
            if detect(rest) != codec:
                raise ArchiveError("Malformed", f"{codec}: other data after a member")
            out, rest = _member(codec, total - n, rest)
            parts.append(out)
            n += len(out)
        data = b"".join(parts)
    return data, codecs


class Encoder:
    """Compresses what is added, piece by piece; the same input gives the same bytes, however it is cut."""

    def __init__(self, codec: str | None) -> None:
        self.codec, self.out, self.rest = codec, bytearray(), bytearray()
        if codec == "gzip":
            self.c = zlib.compressobj(6, zlib.DEFLATED, 31)
        elif codec == "bzip2":
            self.c = bz2.BZ2Compressor()
        elif codec == "xz":
            self.c = lzma.LZMACompressor()
        elif codec == "zstd":
            try:
                import zstandard
            except ImportError:
                raise ArchiveError("Capability", "zstd needs the package zstandard") from None
            self.c = zstandard.ZstdCompressor().compressobj()
        elif codec == "lz4":  # stored blocks: valid frames, without compression
            self.c = None
            self.out += b"\x04\x22\x4d\x18\x60\x70\x73"
        elif codec is not None:
            raise ArchiveError("Unsupported", codec)

    def _block(self, size: int) -> None:
        self.out += struct.pack("<I", size | 1 << 31) + self.rest[:size]
        del self.rest[:size]

    def add(self, data: bytes | memoryview) -> None:
        if self.codec is None:
            self.out += data
        elif self.codec == "lz4":
            self.rest += data
            while len(self.rest) >= 4 << 20:
                self._block(4 << 20)
        else:
            self.out += self.c.compress(data)

    def end(self) -> bytes:
        if self.codec == "lz4":
            if self.rest:
                self._block(len(self.rest))
            self.out += b"\0\0\0\0"
        elif self.codec is not None:
            self.out += self.c.flush()
        made = bytes(self.out)
        self.out = bytearray()
        return made


def encode(data: bytes, codec: str | None) -> bytes:
    """Compress; the same input gives the same bytes."""
    if codec is None:
        return data
    e = Encoder(codec)
    e.add(data)
    return e.end()

"""Header fields as column expressions: numbers, kinds, modes, times, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of entries by tar type flag and by the type bits of a Unix mode.
TAR_KINDS = {"5": "dir", "1": "hardlink", "2": "symlink", "3": "char", "4": "block", "6": "fifo"}
MODE_KINDS = {0o040000: "dir", 0o120000: "symlink", 0o020000: "char", 0o060000: "block", 0o010000: "fifo", 0o140000: "socket"}
KIND_LETTERS = {"dir": "d", "symlink": "l", "char": "c", "block": "b", "fifo": "p", "socket": "s"}


def _case(value: Column, table: dict, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(value == F.lit(k), F.lit(v)).otherwise(out)
    return out


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def digest(raw: Column) -> Column:
    return F.sha2(raw, 256)


def descriptor(hex_digest: Column) -> Column:
    return F.concat(F.lit("sha256:"), hex_digest)


def parse_descriptor(text: Column) -> Column:
    """Digits of ``sha256:`` and 64 lower-case hex digits; null for anything else."""
    return F.when(text.rlike("^sha256:[0-9a-f]{64}$"), F.substring(text, 8, 64))


def uint_le(raw: Column, at: Column | int, size: int) -> Column:
    """Little-endian unsigned number of up to 7 bytes at a byte position counted from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.concat(*(F.lpad(F.hex(F.substring(raw, at + i + 1, F.lit(1))), 2, "0") for i in reversed(range(size))))
    return F.conv(digits, 16, 10).cast("long")


def octal(raw: Column) -> Column:
    """A tar number: octal digits between spaces and NULs, or base 256 if the first byte's top bit is set.

    Empty means 0. Null if it is neither or does not fit 63 bits.
    """
    first = F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int")
    text = F.trim(F.replace(F.decode(raw, "ISO-8859-1"), F.lit("\0"), F.lit(" ")))
    plain = F.when(text == "", F.lit(0)).when(text.rlike("^[0-7]{1,20}$"), F.conv(text, 8, 10).cast("long"))
    tail = F.hex(F.substring(raw, 2, 100))
    wide = F.when(F.ltrim(tail, F.lit("0")).rlike("^([0-9A-F]{0,15}|[0-7][0-9A-F]{15})$") & (first == 128), F.conv(tail, 16, 10).cast("long"))
    negative = F.when((first == 255) & (F.length(raw) >= 8), F.conv(F.substring(F.hex(raw), -16, 16), 16, -10).cast("long"))
    return F.when(first == 128, wide).when(first == 255, negative).otherwise(plain)


def radix(text: Column, base: int) -> Column:
    """Digits of a base as a number; null for anything else."""
    digits = "0-7" if base == 8 else "0-9" if base == 10 else "0-9A-Fa-f"
    return F.when(text.rlike(f"^[{digits}]+$"), F.conv(text, base, 10).cast("long"))


def kind_of_tar(flag: Column) -> Column:
    return _case(flag, TAR_KINDS, "file")


def kind_of_mode(mode: Column) -> Column:
    return _case(mode.bitwiseAND(F.lit(0o170000)), MODE_KINDS, "file")


def default_mode(kind: Column) -> Column:
    return F.when(kind == "dir", 0o755).when(kind == "symlink", 0o777).when(kind.isin("file", "hardlink"), 0o644).otherwise(0o600)


def mode_string(kind: Column, mode: Column) -> Column:
    """``drwxr-xr-x``; set-id and sticky bits are not shown."""
    parts = [_case(kind, KIND_LETTERS, "-")]
    for shift in (6, 3, 0):
        for bit, letter in ((4, "r"), (2, "w"), (1, "x")):
            parts.append(F.when(mode.bitwiseAND(F.lit(bit << shift)) != 0, letter).otherwise("-"))
    return F.concat(*parts)


def minute_text(seconds: Column) -> Column:
    """Seconds since 1970 as ``YYYY-MM-DD HH:MM`` in UTC, rounded down before the epoch too."""
    days = F.floor(seconds / F.lit(86400)).cast("int")
    rest = F.pmod(seconds, F.lit(86400)).cast("int")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
    return F.format_string("%s %02d:%02d", day, (rest / 3600).cast("int"), (rest % 3600 / 60).cast("int"))


def long_listing(kind: Column, mode: Column, uid: Column, gid: Column, size: Column, seconds: Column, path: Column, target: Column) -> Column:
    zero = F.lit(0).cast("long")
    line = F.format_string(
        "%s %d/%d %10d %s %s", mode_string(kind, F.coalesce(mode, F.lit(0))), F.coalesce(uid, zero), F.coalesce(gid, zero), F.coalesce(size, zero),
        F.coalesce(minute_text(seconds), F.lit("1970-01-01 00:00")), path,
    )
    return F.when((kind == "symlink") & target.isNotNull(), F.concat(line, F.lit(" -> "), target)).otherwise(line)


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    return F.unix_date(F.make_date(year, month, day))


def dos_seconds(date: Column, time: Column) -> Column:
    """Seconds since 1970 of a DOS date and time (two-second steps from 1980); null if no such day or time."""
    year, month, day = F.shiftright(date, 9) + 1980, F.shiftright(date, 5).bitwiseAND(F.lit(15)), date.bitwiseAND(F.lit(31))
    hour, minute, second = F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(F.lit(63)), time.bitwiseAND(F.lit(31)) * 2
    real = month.between(1, 12) & (day >= 1) & (hour < 24) & (minute < 60) & (second < 60)
    first = F.when(real, F.make_date(year, month, F.lit(1)))
    real = real & (day <= F.dayofmonth(F.last_day(first)))
    return F.when(real, (F.unix_date(first) + day - 1).cast("long") * 86400 + hour * 3600 + minute * 60 + second)


def dos_date_time(seconds: Column) -> tuple[Column, Column]:
    """DOS date and time; before 1980 the first, after 2107 the last that there is."""
    held = F.least(F.greatest(seconds, F.lit(315532800)), F.lit(4354819198))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(held / 86400).cast("int"))
    rest = F.pmod(held, F.lit(86400)).cast("int")
    date = F.shiftleft(F.year(day) - 1980, 9) + F.shiftleft(F.month(day), 5) + F.dayofmonth(day)
    time = F.shiftleft(F.floor(rest / 3600).cast("int"), 11) + F.shiftleft(F.floor(rest % 3600 / 60).cast("int"), 5) + F.floor(rest % 60 / 2).cast("int")
    return date, time


def filetime(ticks: Column) -> Column:
    """Windows ticks of 100 ns since 1601 as (secs, nanos) since 1970."""
    ticks = ticks.cast("decimal(20,0)")
    secs = F.floor(ticks / F.lit(10_000_000)).cast("long")
    return F.struct((secs - F.lit(11_644_473_600)).alias("secs"), ((ticks - secs.cast("decimal(20,0)") * 10_000_000) * 100).cast("int").alias("nanos"))


def pax_time(text: Column) -> Column:
    """Decimal seconds with up to nine places as (secs, nanos); nanos is never negative. Null if it is no number."""
    shape = r"^(-?)([0-9]+)(?:\.([0-9]{1,9})[0-9]*)?$"
    secs = F.regexp_extract(text, shape, 2).cast("decimal(30,0)").cast("long")
    nanos = F.rpad(F.regexp_extract(text, shape, 3), 9, "0").cast("int")
    minus = F.regexp_extract(text, shape, 1) == "-"
    whole = F.when(minus & (nanos > 0), -secs - 1).when(minus, -secs).otherwise(secs)
    part = F.when(minus & (nanos > 0), F.lit(1_000_000_000) - nanos).otherwise(nanos)
    return F.when(text.rlike(shape), F.struct(whole.alias("secs"), part.alias("nanos")))


def iso_short_time(raw: Column) -> Column:
    """Seven bytes of ISO 9660: years from 1900, month, day, hour, minute, second, quarter hours east of UTC."""
    b = [F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("int") for i in range(7)]
    east = F.when(b[6] > 127, b[6] - 256).otherwise(b[6])
    real = b[1].between(1, 12) & b[2].between(1, 31) & (b[3] < 24) & (b[4] < 60) & (b[5] < 60)
    day = F.when(real, F.make_date(b[0] + 1900, b[1], F.lit(1)))
    return F.when(real & (b[2] <= F.dayofmonth(F.last_day(day))), (F.unix_date(day) + b[2] - 1).cast("long") * 86400 + b[3] * 3600 + b[4] * 60 + b[5] - east * 900)


def iso_long_time(text: Column, east: Column) -> Column:
    """Sixteen digits (the last two are hundredths) and quarter hours east of UTC."""
    at = F.try_to_timestamp(F.substring(text, 1, 14), F.lit("yyyyMMddHHmmss"))
    return F.when(text.rlike("^[0-9]{16}$"), F.unix_timestamp(at) - east * 900)


def xml_unescape(text: Column) -> Column:
    for mark, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def filter_of_name(path: Column) -> Column:
    """Compression that a file name's ending promises; null for none."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for names, codec in ((("gz", "tgz"), "gzip"), (("bz2", "tbz", "tbz2"), "bzip2"), (("zst",), "zstd"), (("xz",), "xz"), (("lz4",), "lz4")):
        out = F.when(ending.isin(*names), codec).otherwise(out)
    return out


def filter_of_magic(raw: Column) -> Column:
    """Outer compression by the first bytes; null for none. bzip2 needs its level digit."""

    def starts(*magic: int) -> Column:
        return F.substring(raw, 1, len(magic)) == F.lit(bytes(magic))

    return (
        F.when(starts(0x1F, 0x8B), "gzip").when(starts(0x28, 0xB5, 0x2F, 0xFD), "zstd").when(starts(0xFD, 0x37, 0x7A, 0x58, 0x5A, 0), "xz")
        .when(starts(0x04, 0x22, 0x4D, 0x18), "lz4").when(starts(0x42, 0x5A, 0x68) & F.hex(F.substring(raw, 4, 1)).rlike("^3[1-9]$"), "bzip2")
    )


#: Where ISO 9660 has its magic, and how long the start is in which the other containers have theirs: fixed values.
ISO_AT, START = 32769, 512


def format_of_magic(raw: Column) -> Column:
    """Container by its magic; tar last, by the checksum of its first header; null for none."""
    return format_of_parts(F.substring(raw, 1, START), F.substring(raw, ISO_AT + 1, 5))


def format_of_parts(start: Column, iso: Column) -> Column:
    """As :func:`format_of_magic`, from the first 512 bytes and the five at 32769, all that it looks at."""

    def at(position: int, magic: bytes) -> Column:
        return F.substring(start, position + 1, len(magic)) == F.lit(magic)

    return (
        F.when(at(0, b"PK\3\4") | at(0, b"PK\5\6"), "zip").when(at(0, b"7z\xbc\xaf\x27\x1c"), "7z").when(at(0, b"MSCF"), "cab").when(at(0, b"xar!"), "xar")
        .when(at(0, b"070701") | at(0, b"070702") | at(0, b"070707") | at(0, b"\xc7\x71") | at(0, b"\x71\xc7"), "cpio").when(at(0, b"!<arch>\n") | at(0, b"!<thin>\n"), "ar")
        .when(iso == F.lit(b"CD001"), "iso9660").when(tar_checksum_valid(start), "tar")
    )


def byte_sum(raw: Column) -> Column:
    """Sum of all bytes, unsigned: how often each hexadecimal digit stands in front and behind, not byte by byte."""
    digits = F.hex(raw)
    front, behind = F.regexp_replace(digits, "(.).", "$1"), F.regexp_replace(digits, ".(.)", "$1")

    def total(text: Column) -> Column:
        return sum((F.lit(v) * (F.length(text) - F.length(F.replace(text, F.lit(f"{v:X}"), F.lit("")))) for v in range(1, 16)), F.lit(0)).cast("long")

    sums = F.transform(F.array(front, behind), total)
    return F.get(sums, F.lit(0)) * 16 + F.get(sums, F.lit(1))


def tar_checksum_valid(header: Column) -> Column:
    """Whether a 512-byte header's checksum holds, counted with unsigned or with signed bytes."""
    field = F.substring(header, 149, 8)
    # Bytes are summed only where the field can be a number: octal digits between spaces and NULs, or base 256.
    number = (F.length(header) == START) & F.hex(field).rlike("^(([02]0)*(3[0-7])*([02]0)*|(80|FF).{14})$")
    stored = octal(field)
    rest = F.concat(F.substring(header, 1, 148), F.lit(b" " * 8), F.substring(header, 157, 356))
    unsigned = byte_sum(rest)
    high = F.length(F.regexp_replace(F.decode(rest, "ISO-8859-1"), "[\\x00-\\x7F]", ""))
    return F.when(number, (unsigned == stored) | (unsigned - 256 * high == stored)).otherwise(F.lit(False))

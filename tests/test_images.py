"""CAB, XAR, ISO 9660, RPM and APK from bytes built by hand."""

import struct
import zlib

from pyspark.sql import functions as F

from stowage.operators import packages as op
from stowage.sources import archives as sa
from stowage.sources import images
from stowage.sources.writers import pack


def frame(spark, *contents):
    return spark.createDataFrame([(f"a{i}", bytearray(c)) for i, c in enumerate(contents)], "archive_id string, content binary")


def cab_bytes(files, mszip, method=None):
    raw, blocks, window = b"".join(d for _, d in files), b"", b""
    parts = [raw[i : i + 32768] for i in range(0, len(raw), 32768)]
    for p in parts:
        z = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=window) if window else zlib.compressobj(9, zlib.DEFLATED, -15)
        body = b"CK" + z.compress(p) + z.flush() if mszip else p
        window = (window + p)[-32768:]
        blocks += struct.pack("<IHH", 0, len(body), len(p)) + body
    table, at = b"", 0
    for name, d in files:
        table += struct.pack("<IIHHHH", len(d), at, 0, 0x2A21, 0x0800, 32) + name + b"\0"
        at += len(d)
    start = 36 + 8 + len(table)
    head = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, start + len(blocks), 0, 44, 0, 3, 1, 1, len(files), 0, 0, 0)
    return head + struct.pack("<IHH", start, len(parts), (1 if mszip else 0) if method is None else method) + table + blocks


def test_cab(spark):
    files = [(b"d\\a.txt", b"hello" * 10_000), (b"b", b"x")]
    got = sa.payloads(frame(spark, cab_bytes(files, False), cab_bytes(files, True))).select("archive_id", "path", "payload", "mtime.secs").collect()
    for k in ("a0", "a1"):
        assert {r.path: bytes(r.payload) for r in got if r.archive_id == k} == {"d/a.txt": files[0][1], "b": b"x"}
    assert {r.secs for r in got} == {978_310_800}
    assert sa.errors(frame(spark, cab_bytes(files, False, 3))).first().error_kind == "Unsupported"


def xar_bytes(toc, heap):
    packed = zlib.compress(toc)
    return struct.pack(">4sHHQQI", b"xar!", 28, 1, len(packed), len(toc), 0) + packed + heap


def test_xar(spark):
    body = zlib.compress(b"hello")
    toc = f"""<xar><toc><file id="1"><name>d</name><type>directory</type><mode>0755</mode>
      <file id="2"><name>f &amp; g</name><type>file</type><uid>5</uid><mtime>1970-01-02T00:00:00Z</mtime>
        <data><offset>0</offset><length>{len(body)}</length><size>5</size><encoding style="application/x-gzip"/></data></file>
      <file id="3"><name>l</name><type>symlink</type><link type="file">f</link></file></file></toc></xar>""".encode()
    got = sa.payloads(frame(spark, xar_bytes(toc, body))).orderBy("entry_index").collect()
    assert [(r.path, r.kind) for r in got] == [("d", "dir"), ("d/f & g", "file"), ("d/l", "symlink")]
    assert bytes(got[1].payload) == b"hello" and got[1].uid == 5 and got[1].mtime.secs == 86400 and got[0]["mode"] == 0o755 and got[2].link_target == "f"
    assert sa.errors(frame(spark, xar_bytes(toc.replace(b"<name>d<", b"<name>..<"), body))).first().error_kind == "Malformed"


def record(name, extent, size, folder=False, system=b""):
    body = struct.pack("<I", extent) + struct.pack(">I", extent) + struct.pack("<I", size) + struct.pack(">I", size) + bytes([70, 1, 1, 0, 0, 0, 0]) + bytes([2 if folder else 0, 0, 0]) + b"\1\0\0\1" + bytes([len(name)]) + name
    body += b"\0" * ((len(body) + 2) % 2) + system
    body += b"\0" * (len(body) % 2)
    return bytes([len(body) + 2, 0]) + body


def iso_bytes(rock):
    sp = b"SP\7\1\xbe\xef\0" if rock else b""
    px = b"PX\x24\1" + b"".join(struct.pack("<I", v) + struct.pack(">I", v) for v in (0o100640, 1, 7, 8)) if rock else b""
    nm = b"NM\x0e\1\0long-name" if rock else b""
    root = record(b"\0", 20, 2048, True, sp) + record(b"\1", 20, 2048, True) + record(b"A.TXT;1", 22, 5, False, px + nm) + record(b"D", 21, 2048, True)
    sub = record(b"\0", 21, 2048, True) + record(b"\1", 20, 2048, True) + record(b"B;1", 23, 3)
    pvd = b"\1CD001\1".ljust(128, b"\0") + struct.pack("<H", 2048) + bytes(26) + record(b"\0", 20, 2048, True)
    sectors = [bytes(2048)] * 16 + [pvd, b"\xffCD001\1", b"", b"", root, sub, b"hello", b"xyz"]
    return b"".join(s.ljust(2048, b"\0") for s in sectors)


def test_iso(spark):
    got = sa.payloads(frame(spark, iso_bytes(False), iso_bytes(True))).orderBy("archive_id", "entry_index").collect()
    assert [(r.path, r.kind, r["size"], bytes(r.payload)) for r in got if r.archive_id == "a0"] == [("A.TXT", "file", 5, b"hello"), ("D/", "dir", 0, b""), ("D/B", "file", 3, b"xyz")]
    rock = [r for r in got if r.archive_id == "a1"][0]
    assert (rock.path, rock["mode"], rock.uid, rock.gid, rock.mtime.secs) == ("long-name", 0o640, 7, 8, 0)
    broken = bytearray(iso_bytes(False))
    broken[16 * 2048 + 128] = 1
    assert sa.errors(frame(spark, broken)).first().error_kind == "Malformed"


def rpm_header(tags):
    store, index = b"", b""
    for tag, text in tags.items():
        index += struct.pack(">IIII", tag, 6, len(store), 1)
        store += text + b"\0"
    return b"\x8e\xad\xe8\x01\0\0\0\0" + struct.pack(">II", len(tags), len(store)) + index + store


def test_rpm(spark):
    made = spark.createDataFrame([("p", 1, "f", "file", b"data")], "archive_id string, entry_index long, path string, kind string, payload binary")
    payload = bytes(pack(made, "cpio", "gzip").first().content)
    lead = b"\xed\xab\xee\xdb".ljust(96, b"\0")
    sig = rpm_header({1000: b"abc"})
    whole = lead + sig + bytes(-len(lead + sig) % 8)
    good, odd = whole + rpm_header({1124: b"cpio", 1125: b"gzip"}) + payload, whole + rpm_header({1124: b"drpm", 1125: b"xz"}) + payload
    table = images.rpm_table(frame(spark, good, odd, b"nothing", lead + b"x"))
    found = sorted((r.archive_id, r.code) for r in op.rpm_findings(table).collect())
    assert found == [("a1", "compressor-mismatch"), ("a1", "payload-format-mismatch"), ("a2", "invalid-lead"), ("a3", "invalid-header")]
    inner = sa.payloads(table.where("archive_id = 'a0'").select("archive_id", "content"))
    assert [(r.path, bytes(r.payload)) for r in inner.collect()] == [("f", b"data")]


def test_apk_signing_block(spark):
    made = spark.createDataFrame([("p", 1, "AndroidManifest.xml", "file", b"m")], "archive_id string, entry_index long, path string, kind string, payload binary")
    plain = bytes(pack(made, "zip").first().content)
    end = plain.rindex(b"PK\5\6")
    (central,) = struct.unpack_from("<I", plain, end + 16)
    pair = struct.pack("<QI", 8, 0x7109871A) + b"abcd"
    size = len(pair) + 24
    block = struct.pack("<Q", size) + pair + struct.pack("<Q", size) + b"APK Sig Block 42"
    signed = bytearray(plain[:central] + block + plain[central:])
    struct.pack_into("<I", signed, end + len(block) + 16, central + len(block))
    ids = images.signing_ids(frame(spark, plain, signed))
    assert {r.archive_id: r.signing_ids for r in ids.collect()} == {"a0": None, "a1": [0x7109871A]}
    rows = sa.entries(frame(spark, plain, signed)).withColumn("head", F.lit(None).cast("binary"))
    found = {r.archive_id: (r.code, r.detail) for r in op.zip_findings(rows, ids, "apk").collect()}
    assert found == {"a0": ("unsigned-package", None), "a1": ("signing-scheme-detected", "v2")}


def test_deb(spark):
    def tar(*names):
        rows = [("t", i, n, "file", b"") for i, n in enumerate(names)]
        made = spark.createDataFrame(rows, "archive_id string, entry_index long, path string, kind string, payload binary")
        return bytes(pack(made, "tar", "xz").first().content)

    members = [("d", 0, "debian-binary", "file", b"2.0\n"), ("d", 1, "control.tar.xz", "file", tar("./control")), ("d", 2, "data.tar.xz", "file", tar("usr/x", "usr/x", "../y"))]
    outer = pack(spark.createDataFrame(members, "archive_id string, entry_index long, path string, kind string, payload binary"), "ar")
    got = sa.payloads(outer)
    findings = op.deb_findings(got, outer.select("archive_id"), images.deb_nested(got))
    assert sorted(r.code for r in findings.collect()) == ["duplicate-entry-path", "unsafe-entry-path"]

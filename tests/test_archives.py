"""Readers and writers against Python's own archive modules, and the rules of each format."""

import bz2
import gzip
import hashlib
import io
import lzma
import struct
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage.sources import archives as sa
from stowage.sources import walkers
from stowage.sources.codecs import ArchiveError, decode, encode, lz4_frame
from stowage.sources.writers import ArchiveSink, pack


def frame(spark, *contents):
    return spark.createDataFrame([(f"a{i}", bytearray(c)) for i, c in enumerate(contents)], "archive_id string, content binary")


def tar_bytes(members, fmt=tarfile.PAX_FORMAT, pax=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt, pax_headers=pax or {}) as t:
        for name, data, more in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            for k, v in more.items():
                setattr(info, k, v)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("archive_id", "entry_index").select(*columns).collect()]


def test_tar_entries(spark):
    long = "d/" * 80 + "name"
    members = [
        ("a.txt", b"hello", {"mode": 0o640, "uid": 5, "gid": 6, "mtime": 1.25, "uname": "u"}),
        ("dir", b"", {"type": tarfile.DIRTYPE}),
        ("link", b"", {"type": tarfile.SYMTYPE, "linkname": "a.txt"}),
        ("hard", b"", {"type": tarfile.LNKTYPE, "linkname": "a.txt"}),
        (long, b"x" * 600, {"uid": 1 << 40}),
        ("dev", b"", {"type": tarfile.CHRTYPE, "devmajor": 3, "devminor": 4}),
    ]
    for fmt in (tarfile.PAX_FORMAT, tarfile.GNU_FORMAT):
        found = sa.entries(frame(spark, tar_bytes(members, fmt)))
        got = rows(found, "path", "kind", "size", "mode", "uid", "link_target", "dev_major", "dev_minor")
        assert [g[0].rstrip("/") for g in got] == ["a.txt", "dir", "link", "hard", long, "dev"]
        assert [g[1] for g in got] == ["file", "dir", "symlink", "hardlink", "file", "char"]
        assert got[0][2:5] == (5, 0o640, 5) and got[4][2] == 600 and got[4][4] == 1 << 40
        assert got[2][5] == got[3][5] == "a.txt" and got[5][6:] == (3, 4)
    times = rows(sa.entries(frame(spark, tar_bytes(members))), "mtime.secs", "mtime.nanos")
    assert times[0] == (1, 250_000_000)


def test_tar_rules(spark):
    good = tar_bytes([("a", b"1", {})])
    bad_sum = bytearray(good)
    bad_sum[0] ^= 1
    found = sa.errors(frame(spark, good, bad_sum[:1024], good[:700], good[:1024] + bytes(512) + b"x" * 512, good[:1024]))
    # An end without zero blocks, or with less than a block left, is no error.
    assert {r.archive_id: (r.error_kind, r.entries_before) for r in found.collect()} == {"a1": ("Unsupported", 0), "a3": ("Malformed", 1)}
    assert rows(sa.entries(frame(spark, bytes(1024))), "path") == []


def test_global_pax_applies_until_overridden(spark):
    data = tar_bytes([("a", b"", {}), ("b", b"", {"pax_headers": {"uid": "9"}})], pax={"uid": "7"})
    assert rows(sa.entries(frame(spark, data)), "path", "uid") == [("a", 7), ("b", 9)]


def test_sparse(spark):
    pax = {"GNU.sparse.size": "20", "GNU.sparse.map": "2,3,10,2"}
    data = tar_bytes([("s", b"abcde", {"pax_headers": pax})])
    got = sa.payloads(frame(spark, data)).select("size", "payload", "sparse").first()
    assert got.size == 20 and bytes(got.payload) == b"\0\0abc\0\0\0\0\0de" + bytes(8)
    assert [tuple(e) for e in got.sparse] == [(2, 3), (10, 2)]
    bad = tar_bytes([("s", b"abcde", {"pax_headers": pax | {"GNU.sparse.map": "2,3,4,2"}})])
    assert sa.errors(frame(spark, bad)).first().error_kind == "Malformed"


def test_cpio_dialects():
    name, data = b"f\0", b"hello"
    odc = b"070707" + b"".join((b"000001", b"000002", b"100644", b"000003", b"000004", b"000001", b"000000", b"00000000005", b"000002", b"00000000005")) + name + data
    odc_end = b"070707" + b"000000" * 7 + b"0" * 11 + b"000013" + b"0" * 11 + b"TRAILER!!!\0"
    got = list(walkers.cpio(memoryview(odc + odc_end), 1 << 20))
    assert got[0][0]["name"] == b"f" and bytes(got[0][3]) == data and got[0][0]["uid"] == b"3"
    for order in "<>":
        head = struct.pack(order + "13H", 0o070707, 1, 2, 0o100644, 3, 4, 1, 0, 0, 5, 2, 0, 5)
        end = struct.pack(order + "13H", 0o070707, 0, 0, 0, 0, 0, 1, 0, 0, 0, 11, 0, 0)
        got = list(walkers.cpio(memoryview(head + name + data + b"\0" + end + b"TRAILER!!!\0"), 1 << 20))
        assert got[0][0]["uid"] == b"3" and bytes(got[0][3]) == data
    crc = b"070702" + b"".join(b"%08X" % v for v in (1, 0o100644, 0, 0, 1, 0, 5, 0, 0, 0, 0, 2, sum(data) + 1)) + name + data + bytes(3)
    with pytest.raises(ArchiveError, match="Integrity"):
        list(walkers.cpio(memoryview(crc), 1 << 20))


def test_ar_names(spark):
    def member(name, data, size=None):
        return b"%-16s%-12d%-6d%-6d%-8o%-10d`\n" % (name, 7, 1, 2, 0o100644, len(data) if size is None else size) + data + b"\n" * (len(data) % 2)

    gnu = b"!<arch>\n" + member(b"//", b"a-very-long-member-name.o/\n") + member(b"/0", b"abc") + member(b"s.o/", b"xy")
    bsd = b"!<arch>\n" + member(b"#1/4", b"n a\0abc")
    thin = b"!<thin>\n" + member(b"x.o/", b"", 99)
    found = sa.payloads(frame(spark, gnu, bsd, thin))
    got = {(r.archive_id, r.path): (r.size, bytes(r.payload), r.external) for r in found.collect()}
    assert got["a0", "a-very-long-member-name.o"] == (3, b"abc", False) and got["a0", "s.o"] == (2, b"xy", False)
    assert got["a1", "n a"] == (3, b"abc", False) and got["a2", "x.o"] == (99, b"", True)


def test_zip(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored.txt", b"abc", zipfile.ZIP_STORED)
        z.writestr("deflated.txt", b"abc" * 100, zipfile.ZIP_DEFLATED)
        z.writestr("bz.txt", b"abc" * 100, zipfile.ZIP_BZIP2)
        z.writestr("lz.txt", b"abc" * 100, zipfile.ZIP_LZMA)
        z.writestr("d/", b"")
        z.writestr("é.txt", b"x")
    data = out.getvalue()
    got = {r.path: (r.kind, r.size, r.method, bytes(r.payload)) for r in sa.payloads(frame(spark, data)).collect()}
    assert got["stored.txt"] == ("file", 3, 0, b"abc") and got["deflated.txt"] == ("file", 300, 8, b"abc" * 100)
    assert got["bz.txt"][2:] == (12, b"abc" * 100) and got["lz.txt"][2:] == (14, b"abc" * 100)
    assert got["d/"][0] == "dir" and got["é.txt"][3] == b"x"
    broken = bytearray(data)
    broken[data.index(b"abc")] ^= 1
    with pytest.raises(Exception, match="CRC of stored.txt"):
        sa.payloads(frame(spark, broken)).select("payload").collect()


def test_written_archives_open_elsewhere(spark):
    made = spark.createDataFrame(
        [("x", 1, "a.txt", "file", b"hello", None), ("x", 2, "d", "dir", None, None), ("x", 3, "l", "symlink", None, "a.txt"), ("x", 4, "n" * 150, "file", b"", None)],
        "archive_id string, entry_index long, path string, kind string, payload binary, link_target string",
    )
    tar = pack(made, "tar", "gzip").first().content
    with tarfile.open(fileobj=io.BytesIO(bytes(tar))) as t:
        assert [m.name for m in t.getmembers()] == ["a.txt", "d", "l", "n" * 150]
        assert t.extractfile("a.txt").read() == b"hello" and t.getmember("l").linkname == "a.txt"
    with zipfile.ZipFile(io.BytesIO(bytes(pack(made, "zip").first().content))) as z:
        assert z.testzip() is None and z.namelist() == ["a.txt", "d/", "l", "n" * 150] and z.read("a.txt") == b"hello"
    assert pack(made, "tar").first() == pack(made, "tar").first()
    assert rows(sa.entries(pack(made, "cpio")), "path", "kind") == [("a.txt", "file"), ("d", "dir"), ("l", "symlink"), ("n" * 150, "file")]


@pytest.mark.parametrize("codec", ["gzip", "bzip2", "xz", "zstd", "lz4"])
def test_codecs(codec):
    data = b"payload " * 5000
    packed = encode(data, codec)
    assert decode(packed) == (data, [codec])
    assert decode(packed + packed) == (data * 2, [codec])
    for broken in (packed[:-3], packed + b"junk"):
        with pytest.raises(ArchiveError, match="Malformed"):
            decode(broken)
    with pytest.raises(ArchiveError, match="Limit"):
        decode(packed, total=len(data) - 1)
    assert decode(packed, total=len(data))[0] == data


def test_codec_rules():
    data = b"x" * 10
    nested = gzip.compress(bz2.compress(lzma.compress(data)))
    assert decode(nested) == (data, ["gzip", "bzip2", "xz"])
    with pytest.raises(ArchiveError, match="Limit"):
        decode(nested, depth=2)
    assert decode(lzma.compress(data) + bytes(8))[0] == data
    with pytest.raises(ArchiveError, match="multiple of four"):
        decode(lzma.compress(data) + bytes(5))
    block = bytes([0x35]) + b"abc" + struct.pack("<H", 3) + bytes([0x10]) + b"z"
    frame = b"\x04\x22\x4d\x18\x60\x70\x73" + struct.pack("<I", len(block)) + block + b"\0\0\0\0"
    assert lz4_frame(frame, 100) == (b"abcabcabcabcz", b"")
    with pytest.raises(ArchiveError, match="Limit"):
        lz4_frame(frame, 5)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_readers_fail_only_in_typed_ways(data):
    for kind in (None, *walkers.WALKERS):
        try:
            if kind is None:
                decode(data, total=1 << 20)
            else:
                list(walkers.WALKERS[kind](memoryview(data), 1 << 20))
        except ArchiveError:
            pass
        except (struct.error, ValueError):
            assert kind == "zip" or kind == "ar"


def test_permissive_prefix(spark):
    whole = tar_bytes([("a", b"1", {}), ("b", b"2" * 2000, {})])
    cut = whole[:2000]
    assert rows(sa.entries(frame(spark, cut)), "path") == [("a",)]
    assert sa.errors(frame(spark, cut, whole)).select("archive_id", "entries_before", "error_kind").collect() == [("a0", 1, "Malformed")]


def test_archive_table_and_digests(spark):
    tar = tar_bytes([("a", b"1", {})]) + bytes(1024)
    packed = gzip.compress(tar)
    got = {r.archive_id: r for r in sa.archive_table(frame(spark, tar, packed)).collect()}
    assert got["a0"].format == "tar" and got["a1"].filter == "gzip"
    d = sa.layer_digests(frame(spark, packed)).first()
    assert d.digest == hashlib.sha256(packed).hexdigest() and d.diff_id == hashlib.sha256(tar).hexdigest()  # padding counts


def test_sink_and_landing(spark, tmp_path):
    from stowage.streaming.landing import ingest

    spark.dataSource.register(ArchiveSink)
    made = pack(spark.createDataFrame([("x", 1, "a", "file", b"1"), ("y", 1, "b", "file", b"22")], "archive_id string, entry_index long, path string, kind string, payload binary"), "tar")
    folder = str(tmp_path / "in")
    made.write.format("archives").option("suffix", ".tar").mode("append").save(folder)
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["x.tar", "y.tar"]
    (tmp_path / "in" / "bad.tar").write_bytes(b"nothing")
    ingest(spark, folder, str(tmp_path / "out")).awaitTermination()
    assert {r.path for r in spark.read.parquet(str(tmp_path / "out/entries")).collect()} == {"a", "b"}
    done = spark.read.parquet(str(tmp_path / "out/archives"))
    assert sorted(r.complete for r in done.collect()) == [False, True, True]
    assert sa.blobs(spark, folder).where(F.endswith("archive_id", F.lit(".tar"))).count() == 3


def test_own_formats_go_first(spark):
    def walk(data, budget):
        for line in bytes(data[4:]).split(b"\n"):
            yield {"name": line, "uid": b"3"}, {}, len(line), line

    own = {"lines": (lambda d: bytes(d[:4]) == b"LNS\n", walk)}
    data = gzip.compress(b"LNS\na\nbc")
    assert rows(sa.payloads(frame(spark, data), providers=own), "path", "size", "uid", "format") == [("a", 1, 3, "lines"), ("bc", 2, 3, "lines")]
    twice = own | {"again": own["lines"]}
    assert sa.errors(frame(spark, data), providers=twice).first().error_kind == "Protocol"


def test_layers_files_and_decompression(spark, tmp_path):
    from stowage.sources.writers import build_layers, from_files

    folder = tmp_path / "top"
    (folder / "d").mkdir(parents=True)
    (folder / "d" / "x").write_bytes(b"1")
    (folder / "a").write_bytes(b"22")
    made = from_files(spark, str(folder), "z")
    assert [(r.entry_index, r.path, bytes(r.payload)) for r in made.orderBy("entry_index").collect()] == [(1, "a", b"22"), (2, "d/x", b"1")]
    layer = build_layers(made).first()
    inner = gzip.decompress(bytes(layer.content))
    assert layer.digest == "sha256:" + hashlib.sha256(layer.content).hexdigest() and layer.diff_id == "sha256:" + hashlib.sha256(inner).hexdigest()
    out = sa.decompress(frame(spark, gzip.compress(bz2.compress(b"q")), b"plain")).orderBy("archive_id").collect()
    assert [(bytes(r.content), r.filters) for r in out] == [(b"q", ["gzip", "bzip2"]), (b"plain", [])]


def test_hot_source_is_many_archives(spark, monkeypatch, tmp_path):
    from stowage.plans import queries, registry
    from stowage.sources import archives, codecs, writers

    rows = [(i, f"text {i}", "en", s, 0) for i, s in enumerate(["hot"] * 300 + ["cold", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "BLOCK_MEMBERS", 20)
    packed = writers.pack(queries._blocked(spark, str(tmp_path)), "tar", "gzip")
    assert packed.count() > 10 and codecs.DECODED_TOTAL == 4 << 30
    want = {(s, f"en/{i}.txt", hashlib.sha256(t.encode()).hexdigest()) for i, t, _, s, _ in rows}
    for name in ("round_trip_tar_gzip", "round_trip_zip"):
        got = registry.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == len(want) and {(r.archive_id, r.path, r.sha256) for r in got} == want
    report = {r.archive_id: r.entry_count for r in registry.QUERIES["inspect_archives"](spark, str(tmp_path)).collect()}
    assert report == {"hot": 300, "cold": 1, None: 1}
    layers = registry.QUERIES["layer_digests"](spark, str(tmp_path)).collect()
    assert len(layers) == 3 and all(r.same_diff_id for r in layers)
    with pytest.raises(Exception, match="Limit|budget|archive"):
        archives.payloads(packed, strict=True, total=100).collect()


def test_pieces_are_joined_as_they_come(spark):
    from stowage.sources import codecs, writers

    members = [(a, i, f"{a}/{i}", "file", bytes([i % 251]) * (i % 7 * 300)) for i in range(60) for a in ("x", "y")]
    made = spark.createDataFrame(members, "archive_id string, entry_index long, path string, kind string, payload binary")
    names = (None, "gzip", "bzip2", "xz", "lz4")
    rows = writers.packs(made.repartition(5), "tar", names).collect()
    by = {(r.archive_id, r.codec): bytes(r.content) for r in rows}
    assert len(rows) == len(by) == 10
    for a in ("x", "y"):
        for c in names:
            assert codecs.decode(by[a, c]) == (by[a, None], [c] if c else []) and codecs.encode(by[a, None], c) == by[a, c]
        with tarfile.open(fileobj=io.BytesIO(by[a, None])) as t:
            assert [(m.name, t.extractfile(m).read()) for m in t] == [(p, d) for z, _, p, _, d in members if z == a]
    plan = writers.pack(made, "tar", "zstd")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan  # a group is never whole in Python before it is joined

"""Plans, layers, fields and packages against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stowage.functions import fields as ff
from stowage.functions import paths as fp
from stowage.operators import entries as oe
from stowage.operators import layers as ol
from stowage.operators import packages as op
from stowage.operators.plan import Policy, cpio_link_targets, plan

ENTRY = "archive_id string, entry_index long, path string, kind string, link_target string"


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("path", "safe"), [("a/./b//c/", "a/b/c"), ("/a", None), ("a/../b", None), ("", None), (".", None), ("./", None), ("a\0b", None), ("a..b", "a..b")])
def test_sanitise(spark, path, safe):
    assert value(spark, path, fp.sanitise) == safe


def test_header_numbers_beyond_eleven_octal_digits(spark, tmp_path):
    import datetime

    from stowage.plans import field_queries

    ids = [1, (8**11 - 100) // 7919, 8**11 // 7919 + 2, 5_999_999, 6_000_000, 10**12]
    events = [(i, datetime.datetime(2024, 1, 1), 1, "click", 1.5, "{}") for i in ids]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    for r in field_queries.header_numbers(spark, str(tmp_path)).collect():
        n = r.entry_index * 7919 + 150
        assert tuple(r)[1:] == (n, n, -n, n, n, n if r.entry_index % 3 == 0 else None)


def test_fields(spark):
    assert spark.range(1).select(ff.octal(F.lit(b"0000644\0"))).first()[0] == 0o644
    assert spark.range(1).select(ff.octal(F.lit(b"\x80\0\0\0\0\0\0\0\0\0\1\0"))).first()[0] == 256
    assert spark.range(1).select(ff.octal(F.lit(b"12x"))).first()[0] is None
    for raw in (b"", b"\0", bytes(range(256)) * 2, b"\xf0\x0f\xa1"):
        assert spark.range(1).select(ff.byte_sum(F.lit(raw))).first()[0] == sum(raw)
    assert tuple(value(spark, "-1.5", ff.pax_time)) == (-2, 500_000_000)
    assert tuple(value(spark, "12.000000001", ff.pax_time)) == (12, 1)
    assert value(spark, "x", ff.pax_time) is None
    assert spark.range(1).select(ff.minute_text(F.lit(-1))).first()[0] == "1969-12-31 23:59"
    assert spark.range(1).select(ff.mode_string(F.lit("dir"), F.lit(0o4755))).first()[0] == "drwxr-xr-x"
    assert tuple(spark.range(1).select(ff.filetime(F.lit(116444736000000001))).first()[0]) == (0, 100)
    assert spark.range(1).select(ff.iso_short_time(F.lit(bytes([70, 1, 1, 1, 0, 0, 4])))).first()[0] == 0
    assert value(spark, "a.TBZ2", ff.filter_of_name) == "bzip2" and value(spark, "a.b/c", ff.filter_of_name) is None
    assert value(spark, "sha256:" + "A" * 64, ff.parse_descriptor) is None


def fold(rows, policy):
    """The plan of one archive, entry by entry."""
    committed, out = set(), {}

    def safe(p):
        if p is None or p.startswith("/") or "\0" in p or ".." in p.split("/"):
            return None
        return "/".join(c for c in p.split("/") if c not in ("", ".")) or None

    for _, i, path, kind, link in rows:
        p = safe(path)
        if kind == "dir" and path in (".", "./"):
            out[i] = "skip"
        elif p is None:
            out[i] = "reject:UnsafePath"
        elif kind in ("file", "dir"):
            out[i] = "materialize"
            if kind == "file":
                committed.add(p)
        elif kind == "symlink" and policy.symlinks:
            out[i] = "materialize" if safe(link) else "reject:UnsafeLinkTarget"
        elif kind == "hardlink" and policy.hardlinks:
            out[i] = "materialize" if safe(link) in committed else "reject:UnsafeLinkTarget"
            if safe(link) in committed:
                committed.add(p)
        else:
            out[i] = "reject:EntryKind"
    return out


def test_plan_is_the_fold(spark):
    chain = [("c", i, f"f{i}", "hardlink" if i else "file", f"f{i - 1}" if i else None) for i in range(5)]
    rnd = random.Random(3)
    names = ["a", "b", "c/d", "./a", "../x", "/y", "e", "."]
    mixed = [("m", i, rnd.choice(names), rnd.choice(["file", "hardlink", "hardlink", "symlink", "dir", "fifo"]), rnd.choice(names)) for i in range(80)]
    policy = Policy(symlinks=True, hardlinks=True)
    got = {(r.archive_id, r.entry_index): r.outcome for r in plan(spark.createDataFrame(chain + mixed, ENTRY), policy).collect()}
    for rows in (chain, mixed):
        assert {i: got[rows[0][0], i] for _, i, *_ in rows} == fold(rows, policy)
    # Mostly hardlinks: chains of links, paths that several links make, links that come before their target.
    names = [f"p{i}" for i in range(25)]
    many = [(f"k{k}", i, rnd.choice(names), rnd.choice(["file"] + ["hardlink"] * 14), rnd.choice(names)) for k in range(12) for i in range(60)]
    got = {(r.archive_id, r.entry_index): r.outcome for r in plan(spark.createDataFrame(many, ENTRY), policy).collect()}
    for k in range(12):
        rows = [r for r in many if r[0] == f"k{k}"]
        assert {i: got[rows[0][0], i] for _, i, *_ in rows} == fold(rows, policy)
    assert set(fold(chain, policy).values()) == {"materialize"}
    assert plan(spark.createDataFrame([], ENTRY), policy).count() == 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """10,000 links one after the other, and as many that begin with nothing."""
    from stowage.operators import plan as module

    made = []
    store = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: made.append(name) or store(df, name))
    n = 10_000
    rows = [("c", i, f"f{i}", "hardlink" if i else "file", f"f{i - 1}" if i else None) for i in range(n)] + [("d", i, f"f{i}", "hardlink", f"f{i - 1}") for i in range(n)]
    got = plan(spark.createDataFrame(rows, ENTRY), Policy(hardlinks=True)).groupBy("archive_id", "outcome").count().collect()
    assert {(r.archive_id, r.outcome): r["count"] for r in got} == {("c", "materialize"): n, ("d", "reject:UnsafeLinkTarget"): n}
    assert made.count("pointers") <= 20 and made.count("open") == 0


def test_running_by_blocks(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(k, i, rnd.choice([None, rnd.randrange(100)])) for k in ("a", "b") for i in rnd.sample(range(200), 60)]
    made = spark.createDataFrame(rows, "archive_id string, entry_index long, v long")
    for block in (1, 7, 65_536):
        monkeypatch.setattr(oe, "BLOCK", block)
        for how, plain in ((F.sum, sum), (F.max, max)):
            for r in oe.running(made, "v", "before", how).collect():
                known = [v for k, i, v in rows if k == r.archive_id and i < r.entry_index and v is not None]
                assert r.before == (plain(known) if known else None)


def test_layers_bound_their_depth(spark):
    deep = "d/" * 70 + "x"
    made = spark.createDataFrame([("a", 0, deep, "symlink", "t"), ("a", 1, f"{deep}/y", "file", None), ("a", 2, "b", "file", None), ("a", 3, "d/" * 70 + ".wh.q", "file", None)], ENTRY)
    got = {r.entry_index: r.operation for r in ol.layer_plan(made).collect()}
    assert got == {0: "reject:Limit", 1: "reject:Limit", 2: "materialize", 3: "reject:Limit"}


def layer_fold(rows, policy):
    claimed, files, links, out = set(), set(), set(), {}

    def safe(p):
        if p is None or p.startswith("/") or ".." in p.split("/"):
            return None
        return "/".join(c for c in p.split("/") if c not in ("", ".")) or None

    def escapes(p):
        parts = p.split("/")
        return any("/".join(parts[:k]) in links for k in range(1, len(parts)))

    for _, i, path, kind, link in rows:
        trimmed = path[:-1] if path.endswith("/") else path
        up, _, name = trimmed.rpartition("/")
        if kind == "dir" and path in (".", "./"):
            continue
        if name == ".wh.":
            out[i] = "reject:UnsafePath"
        elif name.startswith(".wh."):
            opaque = name == ".wh..wh..opq"
            raw = up if opaque else (f"{up}/{name[4:]}" if up else name[4:])
            at = "" if opaque and not raw else safe(raw)
            out[i] = "reject:UnsafePath" if at is None else "reject:SymlinkEscape" if escapes(at) else "opaque" if opaque else "whiteout"
        else:
            p = safe(path)
            if p is None:
                out[i] = "reject:UnsafePath"
            elif escapes(p):
                out[i] = "reject:SymlinkEscape"
            elif p in claimed:
                out[i] = "reject:Duplicate"
            else:
                claimed.add(p)
                if kind == "symlink":
                    out[i] = "materialize" if safe(link) else "reject:UnsafeLinkTarget"
                    if safe(link):
                        links.add(p)
                elif kind == "hardlink":
                    out[i] = "materialize" if safe(link) in files else "reject:UnsafeLinkTarget"
                    if safe(link) in files:
                        files.add(p)
                elif kind in ("file", "dir"):
                    out[i] = "materialize"
                    if kind == "file":
                        files.add(p)
                else:
                    out[i] = "reject:UnsupportedKind"
    return out


def test_layer_plan_is_the_fold(spark):
    rnd = random.Random(11)
    names = ["a", "a/b", "a/b/c", "d", "d/e", "a/.wh.b", ".wh.d", "d/.wh..wh..opq", ".wh..wh..opq", ".wh.", "../x", "./a/", "d/e/f", "."]
    rows = [(f"l{k}", i, rnd.choice(names), rnd.choice(["file", "symlink", "hardlink", "dir", "fifo"]), rnd.choice(names)) for k in range(6) for i in range(25)]
    policy = Policy(True, True)
    got = {(r.archive_id, r.entry_index): r.operation for r in ol.layer_plan(spark.createDataFrame(rows, ENTRY), policy).collect()}
    want = {(k, i): o for k in {r[0] for r in rows} for i, o in layer_fold([r for r in rows if r[0] == k], policy).items()}
    assert got == want


def test_overlay(spark):
    rows = [
        ("i", 0, 1, "etc/a"), ("i", 0, 2, "etc/b"), ("i", 0, 3, "usr/x/y"), ("i", 1, 1, "etc/.wh.a"), ("i", 1, 2, "etc/b"), ("i", 1, 3, "usr/.wh..wh..opq"), ("i", 1, 4, "usr/new"), ("i", 0, 4, "usr"),
    ]
    got = ol.overlay(spark.createDataFrame(rows, "image_id string, layer int, entry_index long, path string"))
    assert sorted((r.layer, r.destination) for r in got.collect()) == [(0, "usr"), (1, "etc/b"), (1, "usr/new")]
    rows += [("i", 2, 1, ".wh..wh..opq"), ("i", 2, 2, "etc/c"), ("j", 0, 1, "kept")]
    got = ol.overlay(spark.createDataFrame(rows, "image_id string, layer int, entry_index long, path string"))
    assert sorted((r.image_id, r.layer, r.destination) for r in got.collect()) == [("i", 2, "etc/c"), ("j", 0, "kept")]


def test_cpio_groups(spark):
    rows = [("a", 0, "x", "file", 0, 2, 1, 1, 9), ("a", 1, "y", "file", 5, 2, 1, 1, 9), ("a", 2, "z", "file", 0, 2, 1, 1, 8), ("a", 3, "w", "file", 0, 2, 1, 1, 8)]
    made = spark.createDataFrame(rows, "archive_id string, entry_index long, path string, kind string, size long, nlink long, dev_major long, dev_minor long, ino long")
    assert {r.path: r.link_target for r in cpio_link_targets(made).collect()} == {"x": "y", "y": None, "z": None, "w": "z"}


def test_members(spark):
    made = spark.createDataFrame([("a", 0, "d/e", "file", None), ("a", 1, "d_e", "file", None), ("a", 2, "d", "dir", None)], ENTRY)
    members = spark.createDataFrame([("d/",), ("zz",)], "member string")
    assert {r.path for r in oe.select_members(made, members).collect()} == {"d/e", "d"}
    assert [r.member for r in oe.unmatched_members(made, members).collect()] == ["zz"]
    assert oe.select_members(made, members.where("false")).count() == 3


def test_limits_on_both_sides(spark):
    made = spark.createDataFrame([("a", 0, "abc", "file", None, 5), ("a", 1, "abcd", "file", None, 6)], ENTRY + ", size long")
    for limits, broken in (({"entries": 2}, 0), ({"entries": 1}, 1), ({"path_bytes": 4}, 0), ({"path_bytes": 3}, 1), ({"decoded_total": 11}, 0), ({"decoded_total": 10}, 1)):
        assert oe.over_limits(made, limits).count() == broken
    assert oe.running_budget(made, 10).first()["entry_index"] == 1 and oe.running_budget(made, 11).count() == 0
    assert value(spark, "a/./b//c", lambda c: fp.nesting(c)) == 3 and value(spark, "a\\b", lambda c: fp.nesting(c, both=False)) == 1
    records = [r.record for r in oe.inspect_records(made).orderBy("seq").collect()]
    assert len(records) == 3 and "complete" in records[-1]


def test_sparse(spark):
    rows = [("a", 0, 10, [(0, 2), (4, 6)]), ("a", 1, 10, [(0, 5), (4, 1)]), ("a", 2, 10, [(8, 3)])]
    made = spark.createDataFrame(rows, "archive_id string, entry_index long, size long, sparse array<struct<offset:bigint,length:bigint>>")
    assert {r.entry_index: (r.valid, r.stored) for r in oe.sparse_errors(made).collect()} == {0: (True, 8), 1: (False, 6), 2: (False, 3)}


ZIP = "archive_id string, entry_index long, path string, method int, encrypted boolean, size long, local_offset long, head binary"


def codes(df):
    return sorted(r.code for r in df.collect())


def test_epub_and_others(spark):
    good = [("e", 0, "mimetype", 0, False, 20, 0, b"application/epub+zip"), ("e", 1, "META-INF/container.xml", 8, False, 5, 90, None)]
    all_of = spark.createDataFrame([("e", None)], "archive_id string, signing_ids array<long>")
    assert codes(op.zip_findings(spark.createDataFrame(good, ZIP), all_of, "epub")) == []
    bad = [("e", 0, "x", 8, False, 1, 0, None), ("e", 1, "mimetype", 8, False, 20, 50, None)]
    assert codes(op.zip_findings(spark.createDataFrame(bad, ZIP), all_of, "epub")) == ["mimetype-not-first", "mimetype-not-stored", "missing-required-member"]
    wrong = [("e", 0, "mimetype", 0, False, 20, 0, b"text/plain")]
    assert "mimetype-invalid-content" in codes(op.zip_findings(spark.createDataFrame(wrong, ZIP), all_of, "epub"))
    apk = spark.createDataFrame([("e", 0, "AndroidManifest.xml", 8, False, 1, 0, None), ("e", 1, "META-INF/A.SF", 8, False, 1, 0, None), ("e", 2, "META-INF/A.RSA", 8, False, 1, 0, None)], ZIP)
    found = op.zip_findings(apk, all_of, "apk")
    assert [(r.code, r.detail) for r in found.collect()] == [("signing-scheme-detected", "v1")]
    assert op.verdicts(found, all_of).first().profile_valid
    plain = op.zip_findings(apk.where("entry_index = 0"), all_of, "apk")
    assert codes(plain) == ["unsigned-package"] and op.verdicts(plain, all_of).first().profile_valid
    assert codes(op.zip_findings(apk, all_of, "msix"))[:3] == ["missing-required-member"] * 3
    ipa = spark.createDataFrame([("e", 0, "Payload/A.app/Info.plist", 8, False, 1, 0, None)], ZIP)
    assert codes(op.zip_findings(ipa, all_of, "ipa")) == []


def test_deb_and_rpm(spark):
    def members(*rows):
        return spark.createDataFrame([("d", i, p, b) for i, (p, b) in enumerate(rows)], "archive_id string, entry_index long, path string, payload binary")

    all_of = spark.createDataFrame([("d",)], "archive_id string")
    good = [("debian-binary", b"2.0\n"), ("control.tar.gz", b""), ("data.tar.xz", b"")]
    assert codes(op.deb_findings(members(*good), all_of)) == []
    assert codes(op.deb_findings(members(good[0], good[2], good[1]), all_of)) == ["unexpected-member-order"]
    assert codes(op.deb_findings(members(("debian-binary", b"3\n"), *good[1:], ("x", b""), good[2]), all_of)) == ["duplicate-member", "invalid-version-stamp", "unknown-member"]
    assert codes(op.deb_findings(members(good[1]), all_of)) == ["missing-debian-binary", "missing-required-member"]
    nested = spark.createDataFrame([("d", "data", 0, "../x"), ("d", "data", 1, "a"), ("d", "data", 2, "./a")], "archive_id string, member string, entry_index long, path string")
    assert codes(op.deb_findings(members(*good), all_of, nested)) == ["duplicate-entry-path", "unsafe-entry-path"]
    rpm = spark.createDataFrame([("r", True, True, "cpio", "xz", "gzip")], "archive_id string, lead_ok boolean, header_ok boolean, payload_format string, compressor string, detected string")
    assert codes(op.rpm_findings(rpm)) == ["compressor-mismatch"]
    assert codes(op.rpm_findings(rpm.withColumn("payload_format", F.lit(None).cast("string")))) == ["compressor-mismatch", "payload-format-mismatch"]
    assert codes(op.rpm_findings(rpm.withColumn("header_ok", F.lit(False)))) == ["invalid-header"]


def test_plan_report(spark):
    from stowage.operators.plan import has_rejections, plan_report

    made = plan(spark.createDataFrame([("a", 0, "x", "file", None), ("a", 1, "../y", "file", None), ("b", 0, ".", "dir", None)], ENTRY))
    assert {r.archive_id: r.report for r in plan_report(made).collect()}["a"] == '{"type":"plan","reusable":false,"outcomes":{"materialize":1,"reject:UnsafePath":1}}'
    assert {r.archive_id: r.has_rejections for r in has_rejections(made).collect()} == {"a": True, "b": False}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1000


@pytest.mark.parametrize("name", ["apk_kit_findings", "apk_kit_verdicts", "apk_signing_schemes", "ipa_kit_findings", "msix_kit_findings", "nuget_kit_verdicts", "wheel_kit_verdicts"])
def test_kits_broadcast_nothing(spark, tmp_path, name):
    from stowage.plans import package_queries, registry  # noqa: F401

    spark.range(20).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    found = registry.QUERIES[name](spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_magic_probes_repeat_no_texts(spark, tmp_path):
    from stowage.plans import field_queries

    def tar(text):
        head = text.encode().ljust(148, b"a") + b" " * 8 + b"b" * 356
        return (head[:148] + b"%06o\0 " % sum(head) + head[156:]).decode()

    texts = [None, "", "x" * 600, *("y" * (32769 - n) + "CD001 and more" for n in (0, 2, 4, 8)), tar("t") + "more", "PK\3\4"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = field_queries.magic_probes(spark, str(tmp_path))
    got = {(r.doc_id, r.probe): r for r in made.collect()}
    assert len(got) == len(texts) * len(field_queries._MAGIC)
    for d, text in enumerate(texts):
        for p, (magic, at, form, codec) in enumerate(field_queries._MAGIC):
            content = bytes(at) + magic + (text or "").encode()
            if form is None:
                form = "iso9660" if content[32769:32774] == b"CD001" else "tar" if not magic and d == 7 else "zip" if content[:4] == b"PK\3\4" else None
            r = got[d, p]
            assert (r.format, r.filter, r.chars) == (form, codec, len(text or "")), (d, p)
    assert "AS text#" not in made._jdf.queryExecution().optimizedPlan().toString()  # heads alone go through the explode

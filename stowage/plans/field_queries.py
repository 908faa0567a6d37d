"""Registered queries of header fields, names, links, costs and orders, over entries made from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import fields as ff
from stowage.functions import paths as fp
from stowage.operators import entries as oe
from stowage.operators import layers as ol
from stowage.operators import plan as opl
from stowage.plans.queries import _sql, derived
from stowage.plans.registry import query

_NUMBER = "CAST(entry_index * 7919 + size AS BIGINT)"


@query(_sql(f"SELECT entry_index, {_NUMBER} AS from_octal, {_NUMBER} AS from_base256, -{_NUMBER} AS from_negative, {_NUMBER} AS from_decimal, {_NUMBER} AS from_hex, CASE WHEN entry_index % 3 = 0 THEN {_NUMBER} END AS from_mixed FROM e"))
def header_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as tar, cpio and ar headers write them, and read back; broken digits give nulls."""
    n = F.col("entry_index") * 7919 + F.col("size")
    rows = derived(spark, sf_dir).select("entry_index", n.alias("n"))
    digits = F.conv(F.col("n"), 10, 8)
    digits = F.when(F.length(digits) < 11, F.lpad(digits, 11, "0")).otherwise(digits)
    wide = F.concat(F.lit(b"\x80"), F.unhex(F.lpad(F.hex("n"), 22, "0")))
    negative = F.concat(F.lit(b"\xff\xff\xff\xff"), F.unhex(F.hex(-F.col("n"))))
    # As tar writes it: what is longer than the field's eleven digits is in base 256.
    field = F.when(F.length(digits) <= 11, F.concat(digits, F.lit("\0")).cast("binary")).otherwise(wide)
    mixed = F.concat(digits, F.when(F.col("entry_index") % 3 == 0, F.lit(" ")).otherwise(F.lit("9")))
    return rows.select(
        "entry_index", ff.octal(field).alias("from_octal"), ff.octal(wide).alias("from_base256"), ff.octal(negative).alias("from_negative"),
        ff.radix(F.col("n").cast("string"), 10).alias("from_decimal"), ff.radix(F.lower(F.hex("n")), 16).alias("from_hex"), ff.octal(mixed.cast("binary")).alias("from_mixed"),
    )


_TYPES = ["0", "1", "2", "3", "4", "5", "6", "7", "x"]
_BITS = [0o100000, 0o040000, 0o120000, 0o020000, 0o060000, 0o010000, 0o140000, 0]


@query(_sql("""SELECT entry_index, ['file', 'hardlink', 'symlink', 'char', 'block', 'dir', 'fifo', 'file', 'file'][CAST(entry_index % 9 + 1 AS INT)] AS by_flag,
    ['file', 'dir', 'symlink', 'char', 'block', 'fifo', 'socket', 'file'][CAST(entry_index % 8 + 1 AS INT)] AS by_mode,
    CASE kind WHEN 'dir' THEN 493 WHEN 'symlink' THEN 511 WHEN 'fifo' THEN 384 ELSE 420 END AS default_mode FROM e"""))
def entry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.element_at(F.array(*(F.lit(t) for t in _TYPES)), (F.col("entry_index") % 9 + 1).cast("int"))
    bits = F.element_at(F.array(*(F.lit(b) for b in _BITS)), (F.col("entry_index") % 8 + 1).cast("int"))
    return derived(spark, sf_dir).select("entry_index", ff.kind_of_tar(flag).alias("by_flag"), ff.kind_of_mode(bits.bitwiseOR(F.col("mode"))).alias("by_mode"), ff.default_mode(F.col("kind")).alias("default_mode"))


@query(_sql("SELECT entry_index, CAST(floor(epoch(ts)) AS BIGINT) - (entry_index % 97 - 48) * 900 AS short_secs, CAST(floor(epoch(ts)) AS BIGINT) - (entry_index % 97 - 48) * 900 AS long_secs, CAST(NULL AS BIGINT) AS no_day FROM e"))
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO 9660's two forms of a time, made from a timestamp and read back; the 31st of February is none."""
    east = (F.col("entry_index") % 97 - 48).cast("int")
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    byte = lambda c: F.unhex(F.substring(F.hex((c + 512).cast("long")), -2, 2))
    raw = F.concat(byte(F.year(ts) - 1900), byte(F.month(ts)), byte(F.dayofmonth(ts)), byte(F.hour(ts)), byte(F.minute(ts)), byte(F.second(ts)), byte(east))
    broken = F.concat(byte(F.year(ts) - 1900), F.lit(b"\x02\x1f\0\0\0\0"))
    text = F.concat(F.date_format(ts, "yyyyMMddHHmmss"), F.lit("00"))
    return derived(spark, sf_dir).select("entry_index", ff.iso_short_time(raw).alias("short_secs"), ff.iso_long_time(text, east).alias("long_secs"), ff.iso_short_time(broken).alias("no_day"))


_NAMES = [
    "a.tar.gz", "a.TGZ", "b.tbz2", "c.zst", "d.xz", "e.lz4", "f.tar", "g.gz/h", ".gz", "META-INF/A.SF", "META-INF/s/A.SF", "META-INF/", "Payload/A.app/Info.plist", "Payload/.app/Info.plist",
    "Payload/A.app/B/Info.plist", "x.nuspec", "l/x.nuspec", "/r/./n", "../u", ".", "./", "a//b/", "d/" * 70 + "e", "n" * 70_000,
]
_NAME_SQL = "list_value(" + ", ".join(f"'{n}'" for n in _NAMES[:-2]) + ", repeat('d/', 70) || 'e', repeat('n', 70000))"


@query(_sql(f"""SELECT entry_index, length(name) AS chars,
      CASE WHEN NOT regexp_matches(name, '\\.[^./]+$') THEN NULL WHEN lower(regexp_extract(name, '\\.([^./]+)$', 1)) IN ('gz', 'tgz') THEN 'gzip' WHEN lower(name) LIKE '%.tbz2' THEN 'bzip2'
        WHEN name LIKE '%.zst' THEN 'zstd' WHEN name LIKE '%.xz' THEN 'xz' WHEN name LIKE '%.lz4' THEN 'lz4' END AS codec,
      regexp_full_match(name, 'META-INF/[^/]+') AS meta_inf, name = 'Payload/A.app/Info.plist' AS info_plist, regexp_full_match(name, '[^/]*\\.nuspec') AS nuspec,
      CASE WHEN list_contains(parts, '..') OR len(parts) = 0 THEN NULL ELSE array_to_string(parts, '/') END AS stored_name,
      CASE WHEN name IN ('.', './') THEN NULL WHEN name LIKE '/%' OR list_contains(parts, '..') OR len(parts) = 0 THEN 'unsafe'
        WHEN octet_length(encode(name)) > 65536 THEN 'path_bytes' WHEN len(parts) > 64 THEN 'nesting' END AS create_error
    FROM (SELECT *, list_filter(string_split(name, '/'), lambda c: c NOT IN ('', '.')) AS parts FROM (SELECT entry_index, {_NAME_SQL}[CAST(entry_index % {len(_NAMES)} + 1 AS INT)] AS name FROM e))"""))
def name_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("entry_index") % len(_NAMES) + 1).cast("int"))
    rows = derived(spark, sf_dir).select("entry_index", name.alias("name"))
    name = F.col("name")
    return rows.select(
        "entry_index", F.length(name).cast("long").alias("chars"), ff.filter_of_name(name).alias("codec"), fp.is_meta_inf_child(name).alias("meta_inf"), fp.is_ipa_info_plist(name).alias("info_plist"),
        fp.is_root_nuspec(name).alias("nuspec"), fp.create_name(name).alias("stored_name"), fp.create_error(name).alias("create_error"),
    )


@query(_sql("SELECT entry_index, '<a href=\"x\">' || path || '''s & co</a>' AS plain, path || chr(233) AS utf16, CAST(NULL AS VARCHAR) AS odd, path || chr(65533) AS shown, length(path) + 1 AS bytes FROM e"))
def text_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML entities, UTF-16 names, names that are no UTF-8."""
    path = F.col("path")
    xml = F.concat(F.lit("&lt;a href=&quot;x&quot;&gt;"), path, F.lit("&apos;s &amp; co&lt;/a&gt;"))
    raw = F.concat(F.encode(path, "UTF-8"), F.lit(b"\xff"))
    wide = F.encode(F.concat(path, F.lit("\u00e9")), "UTF-16LE")
    return derived(spark, sf_dir).select(
        "entry_index", ff.xml_unescape(xml).alias("plain"), fp.utf16_text(wide).alias("utf16"), fp.utf16_text(F.substring(wide, 1, 3)).alias("odd"), fp.display(raw).alias("shown"),
        F.length(fp.byte_text(raw)).cast("long").alias("bytes"),
    )


_COST = """octet_length(encode(path)) + coalesce(octet_length(encode(link_target)), 0) + CASE WHEN entry_index % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN entry_index % 13 = 0 THEN 11 ELSE 0 END
    + CASE WHEN entry_index % 17 = 0 THEN 3 ELSE 0 END + CASE WHEN entry_index % 23 = 0 THEN 32 ELSE 0 END + CASE WHEN entry_index % 5 = 0 THEN 6 ELSE 0 END"""


@query(_sql(f"SELECT archive_id, CAST(sum({_COST}) AS BIGINT) AS metadata_bytes FROM e GROUP BY 1"))
def metadata_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("entry_index")
    extent = F.struct(F.lit(0).alias("offset"), F.lit(5).alias("length"))
    extension = F.struct(F.lit("ns").alias("namespace"), F.lit("k").alias("key"), F.lit(b"\0\1\2").alias("value"))
    rows = derived(spark, sf_dir).withColumns({
        "user": F.when(i % 3 == 0, "root"), "xattrs": F.when(i % 13 == 0, F.create_map(F.lit("user.name"), F.lit(b"ab"))), "acl": F.when(i % 17 == 0, F.array(F.lit(b"x"), F.lit(b"yy"))),
        "sparse": F.when(i % 23 == 0, F.array(extent, extent)), "extensions": F.when(i % 5 == 0, F.array(extension)),
    })
    return oe.metadata_cost(rows)


_HEXED = "lower(hex(encode({})))"
_LINKED = f"""coalesce(',"link_target":"' || link_target || '","link_target_raw_hex":"' || {_HEXED.format("link_target")} || '"', '')"""
_RECORD = f"""'{{"type":"entry","path":"' || path || '","path_raw_hex":"' || {_HEXED.format("path")} || '","kind":"' || kind || '","size":' || size || {_LINKED} || '}}'"""


@query(_sql(f"""SELECT archive_id, entry_index AS seq, {_RECORD} AS record FROM e UNION ALL SELECT archive_id, 9223372036854775807, '{{"type":"complete","entry_count":' || count(*) || '}}' FROM e GROUP BY 1"""))
def inspect_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.inspect_records(derived(spark, sf_dir))


_OUTCOME = "CASE WHEN external THEN 'reject:ExternalReference' WHEN safe IS NULL THEN 'reject:UnsafePath' WHEN kind IN ('file', 'dir') THEN 'materialize' {} ELSE 'reject:EntryKind' END"


@query(_sql(f"""SELECT archive_id, '{{"type":"plan","reusable":false,"outcomes":{{' || string_agg('"' || outcome || '":' || n, ',' ORDER BY outcome) || '}}}}' AS report
    FROM (SELECT archive_id, {_OUTCOME.format("")} AS outcome, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1"""))
def plan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opl.plan_report(opl.plan(derived(spark, sf_dir)))


@query(_sql(f"SELECT archive_id, entry_index, path, kind, {_OUTCOME.format("WHEN kind = 'fifo' THEN 'materialize'")} AS outcome FROM s"))
def special_files_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opl.plan(derived(spark, sf_dir), opl.Policy(special_files=True))


_THERE = "t AS (SELECT DISTINCT archive_id, safe AS path, CASE WHEN entry_index % 2 = 0 THEN 'file' ELSE 'dir' END AS kind FROM s WHERE safe IS NOT NULL AND entry_index % 9 IN (0, 5)), u AS (SELECT archive_id, path, bool_and(kind = 'file') AS plain FROM t GROUP BY 1, 2)"


def _conflicts(overwrite: bool) -> str:
    free = "AND NOT (u.path = s.safe AND s.kind = 'file' AND u.plain)" if overwrite else ""
    met = f"EXISTS (SELECT 1 FROM u WHERE u.archive_id = s.archive_id AND (u.path = s.safe OR starts_with(s.safe, u.path || '/')) {free})"
    outcome = _OUTCOME.format("").replace("'materialize'", f"CASE WHEN {met} THEN 'reject:DestinationExists' ELSE 'materialize' END")
    return _sql(f"SELECT archive_id, entry_index, path, kind, {outcome} AS outcome FROM s", _THERE)


def _held(spark: SparkSession, sf_dir: str, overwrite: bool) -> DataFrame:
    rows = derived(spark, sf_dir)
    there = rows.where("entry_index % 9 IN (0, 5)").select("archive_id", fp.sanitise(F.col("path")).alias("path"), F.when(F.col("entry_index") % 2 == 0, "file").otherwise("dir").alias("kind")).where("path IS NOT NULL")
    return opl.destination_conflicts(opl.plan(rows), there.union(there), opl.Policy(overwrite=overwrite))


@query(_conflicts(False))
def destination_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, False)


@query(_conflicts(True))
def destination_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, True)


@query(_sql(
    "SELECT archive_id, entry_index, path, depth, CAST((SELECT count(*) FROM d b WHERE b.archive_id = d.archive_id AND b.depth > d.depth) AS BIGINT) AS deeper FROM d",
    "d AS (SELECT archive_id, entry_index, path, CAST(len(string_split(safe, '/')) AS INT) AS depth FROM s WHERE kind = 'dir' AND safe IS NOT NULL)",
))
def directory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opl.directory_order(derived(spark, sf_dir))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as cpio has them: inodes with up to three links, some with a payload."""
    i = F.col("entry_index")
    return derived(spark, sf_dir).withColumns({
        "kind": F.lit("file"), "nlink": F.when(i % 41 == 0, 2).when(i % 4 == 0, 1).otherwise(3), "dev_major": F.lit(8), "dev_minor": (i % 2).cast("int"), "ino": i % 30,
        "size": F.when(i % 6 == 0, F.col("size") + 1).otherwise(F.lit(0)),
    })


_CPIO = """l AS (SELECT archive_id, entry_index, path, CASE WHEN entry_index % 41 = 0 THEN 2 WHEN entry_index % 4 = 0 THEN 1 ELSE 3 END AS nlink, entry_index % 2 AS minor, entry_index % 30 AS ino, entry_index % 6 = 0 AS full_ FROM e),
    g AS (SELECT archive_id, minor, ino, min(nlink) AS least, max(nlink) AS most, count(*) AS members, count(*) FILTER (full_) AS payloads, coalesce(min(entry_index) FILTER (full_), min(entry_index)) AS target FROM l WHERE nlink > 1 GROUP BY ALL)"""


@query(_sql("SELECT l.archive_id, l.entry_index, l.path, CASE WHEN g.target <> l.entry_index THEN t.path END AS link_target, g.members FROM l JOIN g ON l.archive_id = g.archive_id AND l.minor = g.minor AND l.ino = g.ino JOIN l t ON t.archive_id = l.archive_id AND t.entry_index = g.target WHERE l.nlink > 1", _CPIO))
def cpio_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opl.cpio_link_targets(_linked(spark, sf_dir))


@query(_sql("SELECT archive_id, 8 AS dev_major, CAST(minor AS INT) AS dev_minor, ino, error, members FROM (SELECT *, CASE WHEN least <> most THEN 'link-counts-differ' WHEN members > most THEN 'too-many-records' WHEN payloads > 1 THEN 'several-payloads' END AS error FROM g) WHERE error IS NOT NULL", _CPIO))
def cpio_group_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opl.cpio_group_errors(_linked(spark, sf_dir))


@query(_sql("SELECT archive_id, entry_index, entry_index % 5 IN (0, 3) AS valid, CAST(7 AS BIGINT) AS stored FROM e WHERE entry_index % 5 <> 4"))
def sparse_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents in order, overlapping, beyond the size, beside each other."""
    extents = lambda *pairs: F.array(*(F.struct(F.lit(a).cast("long").alias("offset"), F.lit(b).cast("long").alias("length")) for a, b in pairs))
    i = F.col("entry_index") % 5
    made = F.when(i == 0, extents((0, 3), (6, 4))).when(i == 1, extents((0, 4), (3, 3))).when(i == 2, extents((0, 3), (8, 4))).when(i == 3, extents((2, 4), (6, 3)))
    return oe.sparse_errors(derived(spark, sf_dir).withColumn("size", F.lit(10).cast("long")).withColumn("sparse", made))


@query(_sql("SELECT archive_id, entry_index, CASE WHEN entry_index % 4 IN (1, 3) THEN 'compressed' WHEN entry_index % 4 = 2 THEN 'diff-id' END AS mismatch FROM e"))
def digest_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("entry_index")
    own = ff.descriptor(ff.digest(i.cast("string").cast("binary")))
    rows = derived(spark, sf_dir).select("archive_id", "entry_index", own.alias("computed_digest"), own.alias("computed_diff_id"))
    rows = rows.withColumn("expected_digest", F.when(i % 2 == 1, "sha256:0").otherwise(F.col("computed_digest"))).withColumn("expected_diff_id", F.when(i % 4 >= 2, "sha256:1").otherwise(F.col("computed_diff_id")))
    return ol.check_digests(rows).select("archive_id", "entry_index", "mismatch")


#: First bytes, where in the content they are, and what they tell: container, or compression.
_MAGIC = [
    (b"PK\3\4", 0, "zip", None), (b"PK\5\6", 0, "zip", None), (b"PK\1\2", 0, None, None), (b"7z\xbc\xaf\x27\x1c", 0, "7z", None), (b"MSCF", 0, "cab", None), (b"xar!", 0, "xar", None), (b"070701", 0, "cpio", None),
    (b"070707", 0, "cpio", None), (b"\xc7\x71", 0, "cpio", None), (b"!<arch>\n", 0, "ar", None), (b"!<thin>\n", 0, "ar", None), (b"CD001", 32769, "iso9660", None), (b"CD001", 0, None, None), (b"\x1f\x8b", 0, None, "gzip"),
    (b"\x28\xb5\x2f\xfd", 0, None, "zstd"), (b"\xfd7zXZ\0", 0, None, "xz"), (b"\x04\x22\x4d\x18", 0, None, "lz4"), (b"BZh9", 0, None, "bzip2"), (b"BZh0", 0, None, None), (b"", 0, None, None),
]
_LONGEST = max(len(magic) for magic, at, _, _ in _MAGIC if not at)
_PROBES = ", ".join(f"({i}, {'NULL' if f is None else repr(f)}, {'NULL' if c is None else repr(c)})" for i, (_, _, f, c) in enumerate(_MAGIC))


@query(f"SELECT doc_id, probe, format, filter, length(coalesce(text, '')) AS chars FROM documents, (VALUES {_PROBES}) AS v(probe, format, filter)")
def magic_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text behind the first bytes of every container and codec."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.length(text).cast("long").alias("chars"), text.cast("binary").alias("raw"))
    # What the tests look at: the first 512 bytes, and five at 32769 behind a magic of up to eight; only these are repeated.
    first, later = F.substring("raw", 1, ff.START), ff.ISO_AT - _LONGEST
    docs = docs.select("doc_id", "chars", first.alias("first"), F.substring(F.col("raw"), later + 1, _LONGEST + 5).alias("later"))
    heads = F.array(*(F.struct(F.lit(i).alias("probe"), F.lit(at).alias("at"), F.lit(magic).alias("magic")) for i, (magic, at, _, _) in enumerate(_MAGIC)))
    rows = docs.select("doc_id", "chars", "first", "later", F.explode(heads).alias("m")).select("doc_id", "chars", "first", "later", "m.*")
    front = F.when(F.col("at") == 0, F.concat("magic", "first")).otherwise(F.lit(bytes(ff.START)))
    iso = F.when(F.col("at") == 0, F.substring(F.col("later"), F.lit(_LONGEST + 1) - F.length("magic"), F.lit(5))).otherwise(F.col("magic"))
    rows = rows.select("doc_id", "probe", "chars", F.substring(front, 1, ff.START).alias("start"), iso.alias("iso"))
    return rows.select("doc_id", "probe", ff.format_of_parts(F.col("start"), F.col("iso")).alias("format"), ff.filter_of_magic(F.col("start")).alias("filter"), "chars")

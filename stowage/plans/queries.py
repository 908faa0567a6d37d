"""Registered queries of the archive engine and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import fields as ff
from stowage.functions import paths as fp
from stowage.operators import entries as oe
from stowage.operators import layers as ol
from stowage.operators import packages as op
from stowage.operators.plan import Policy, hardlink_one_step, plan
from stowage.plans.registry import query as _query
from stowage.sources import archives as sa
from stowage.sources.writers import pack, packs

#: Entries made from the events table: an archive for each user, an entry for each event.
DERIVED = """
    SELECT user_id AS archive_id, event_id AS entry_index,
      CASE WHEN event_id % 10 = 0 THEN 'dir' WHEN event_id % 10 = 1 THEN 'symlink'
           WHEN event_id % 10 = 2 THEN 'hardlink' WHEN event_id % 10 = 3 THEN 'fifo' ELSE 'file' END AS kind,
      CASE WHEN event_id % 97 = 0 THEN concat('/', event_type, '/', CAST(event_id % 50 AS {text}))
           WHEN event_id % 89 = 0 THEN concat('../', event_type)
           ELSE concat(event_type, '/./', CAST(event_id % 50 AS {text})) END AS path,
      CASE WHEN event_id % 10 IN (1, 2) THEN concat(event_type, '/', CAST((event_id + 3) % 50 AS {text})) END AS link_target,
      CAST(floor(value * 100) AS BIGINT) AS size, CAST(event_id % 512 AS INT) AS mode, user_id % 7 AS uid, user_id % 5 AS gid,
      event_id % 16 = 7 AS external, CAST(event_id % 3 AS INT) AS layer, ts
    FROM events"""

_SAFE = "CASE WHEN {p} LIKE '/%' OR list_contains(string_split({p}, '/'), '..') OR len(list_filter(string_split({p}, '/'), lambda c: c NOT IN ('', '.'))) = 0 THEN NULL ELSE array_to_string(list_filter(string_split({p}, '/'), lambda c: c NOT IN ('', '.')), '/') END"


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("_events")
    return spark.sql(DERIVED.format(text="STRING").replace("FROM events", "FROM _events"))


def _sql(body: str, *more: str) -> str:
    """SQL over the derived entries e, with s adding the safe path and the safe target."""
    e = DERIVED.format(text="VARCHAR")
    s = f"SELECT *, {_SAFE.format(p='path')} AS safe, {_SAFE.format(p='link_target')} AS target FROM e"
    return f"WITH {'RECURSIVE ' if 'UNION' in ''.join(more) else ''}e AS ({e}), s AS ({s}){''.join(', ' + m for m in more)} {body}"


# --- paths, fields ---------------------------------------------------------------------------------------------


@_query(_sql("SELECT archive_id, entry_index, path, safe, safe IS NULL AS unsafe FROM s"))
def path_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = fp.sanitise(F.col("path"))
    return derived(spark, sf_dir).select("archive_id", "entry_index", "path", safe.alias("safe"), safe.isNull().alias("unsafe"))


@_query(_sql("SELECT entry_index, string_split(rtrim(path, '/'), '/')[-1] AS leaf, array_to_string(string_split(path, '/')[:-2], '/') AS parent, CAST(len(list_filter(string_split(path, '/'), lambda c: c NOT IN ('', '.'))) AS INT) AS nesting FROM e"))
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return derived(spark, sf_dir).select("entry_index", fp.leaf(path).alias("leaf"), fp.parent(path).alias("parent"), fp.nesting(path).alias("nesting"))


_BITS = " || ".join(f"CASE WHEN (mode & {bit << shift}) <> 0 THEN '{letter}' ELSE '-' END" for shift in (6, 3, 0) for bit, letter in ((4, "r"), (2, "w"), (1, "x")))
_MODE = f"CASE kind WHEN 'dir' THEN 'd' WHEN 'symlink' THEN 'l' WHEN 'fifo' THEN 'p' ELSE '-' END || {_BITS}"
_WHEN = "strftime(ts, '%Y-%m-%d %H:%M')"


@_query(_sql(f"SELECT entry_index, {_MODE} || ' ' || uid || '/' || gid || ' ' || lpad(CAST(size AS VARCHAR), CAST(greatest(10, length(CAST(size AS VARCHAR))) AS INT), ' ') || ' ' || {_WHEN} || ' ' || path || CASE WHEN kind = 'symlink' THEN ' -> ' || link_target ELSE '' END AS line FROM e"))
def long_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {n: F.col(n) for n in ("kind", "mode", "uid", "gid", "size", "path", "link_target")}
    line = ff.long_listing(c["kind"], c["mode"], c["uid"], c["gid"], c["size"], F.unix_timestamp(F.col("ts").cast("timestamp")), c["path"], c["link_target"])
    return derived(spark, sf_dir).select("entry_index", line.alias("line"))


@_query("""
    WITH t AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events)
    SELECT event_id, secs - secs % 2 AS dos_seconds, secs AS ntfs_seconds, -secs - 1 AS pax_seconds, 750000000 AS pax_nanos, strftime(to_timestamp(secs) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS minute FROM t""")
def time_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOS, Windows and pax times: written and read back."""
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", secs.alias("secs"))
    date, time = ff.dos_date_time(F.col("secs"))
    rows = rows.withColumn("d", date).withColumn("t", time)
    ticks = (F.col("secs").cast("decimal(20,0)") + F.lit(11_644_473_600)) * 10_000_000
    pax = ff.pax_time(F.concat(F.lit("-"), F.col("secs").cast("string"), F.lit(".25")))
    return rows.select("event_id", ff.dos_seconds(F.col("d"), F.col("t")).alias("dos_seconds"), ff.filetime(ticks)["secs"].alias("ntfs_seconds"), pax["secs"].alias("pax_seconds"), pax["nanos"].alias("pax_nanos"), ff.minute_text(F.col("secs")).alias("minute"))


@_query("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS descriptor, octet_length(encode(coalesce(text, ''))) AS bytes, true AS parsed FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", ff.descriptor(ff.digest(raw)).alias("descriptor"), F.length(raw).cast("long").alias("bytes"))
    return docs.withColumn("parsed", ff.parse_descriptor(F.col("descriptor")).isNotNull())


# --- entries ---------------------------------------------------------------------------------------------------


@_query(_sql("SELECT archive_id, kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest FROM e GROUP BY ALL"))
def entries_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.by_kind(derived(spark, sf_dir))


@_query(_sql("SELECT archive_id, count(*) AS entry_count, CAST(coalesce(sum(size) FILTER (kind = 'file'), 0) AS BIGINT) AS payload_bytes FROM e GROUP BY 1"))
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.verify_report(derived(spark, sf_dir))


@_query(_sql("SELECT archive_id, min(entry_index) AS entry_index, CAST(min_by(total, entry_index) AS BIGINT) AS total FROM r WHERE total > 50000 GROUP BY 1", "r AS (SELECT *, sum(size) OVER (PARTITION BY archive_id ORDER BY entry_index) AS total FROM e)"))
def decoded_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.running_budget(derived(spark, sf_dir), 50_000)


@_query(_sql("SELECT archive_id, entry_index, path, first_index FROM (SELECT *, min(entry_index) OVER (PARTITION BY archive_id, safe) AS first_index FROM s WHERE safe IS NOT NULL) WHERE entry_index > first_index"))
def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.duplicate_paths(derived(spark, sf_dir))


@_query(_sql("SELECT archive_id, entry_index, path, rank, before FROM (SELECT *, max(rank) OVER (PARTITION BY archive_id ORDER BY entry_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, CASE kind WHEN 'dir' THEN 0 WHEN 'symlink' THEN 1 WHEN 'file' THEN 2 END AS rank FROM e) WHERE rank IS NOT NULL) WHERE rank < before"))
def member_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    return oe.order_violations(derived(spark, sf_dir), F.when(kind == "dir", 0).when(kind == "symlink", 1).when(kind == "file", 2))


_MEMBERS = ["click", "view/./7", "purchase/.", "nothing/", "/error/47"]


def _members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in _MEMBERS], "member string")


_HIT = "path = rtrim(member, '/') OR starts_with(path, rtrim(member, '/') || '/')"
_VALUES = "m AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in _MEMBERS) + "]) AS member)"


@_query(_sql(f"SELECT archive_id, entry_index, path FROM e WHERE EXISTS (SELECT 1 FROM m WHERE {_HIT})", _VALUES))
def select_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.select_members(derived(spark, sf_dir), _members(spark)).select("archive_id", "entry_index", "path")


@_query(_sql(f"SELECT member FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE {_HIT})", _VALUES))
def unmatched_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.unmatched_members(derived(spark, sf_dir), _members(spark))


@_query(_sql("SELECT archive_id, 'entries' AS \"limit\", count(*) AS value, CAST(80 AS BIGINT) AS most FROM e GROUP BY 1 HAVING count(*) > 80 UNION ALL SELECT archive_id, 'entry_bytes', max(size), 20000 FROM e GROUP BY 1 HAVING max(size) > 20000 UNION ALL SELECT archive_id, 'path_bytes', max(octet_length(encode(path))), 12 FROM e GROUP BY 1 HAVING max(octet_length(encode(path))) > 12"))
def over_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.over_limits(derived(spark, sf_dir), {"entries": 80, "entry_bytes": 20_000, "path_bytes": 12})


# --- plans -----------------------------------------------------------------------------------------------------


@_query(_sql("SELECT l.archive_id, l.entry_index, l.target, coalesce(f.since < l.entry_index, false) AS accepted FROM s l LEFT JOIN (SELECT archive_id, safe, min(entry_index) AS since FROM s WHERE kind = 'file' AND safe IS NOT NULL GROUP BY 1, 2) f ON l.archive_id = f.archive_id AND l.target = f.safe WHERE l.kind = 'hardlink'"))
def hardlink_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardlink_one_step(derived(spark, sf_dir))


_COMMITTED = """c AS (
    SELECT archive_id, entry_index, safe FROM s WHERE kind = 'file' AND safe IS NOT NULL AND NOT external
    UNION SELECT l.archive_id, l.entry_index, l.safe FROM s l JOIN c ON l.archive_id = c.archive_id AND l.target = c.safe AND c.entry_index < l.entry_index
    WHERE l.kind = 'hardlink' AND l.safe IS NOT NULL AND NOT l.external)"""


@_query(_sql("""SELECT archive_id, entry_index, path, kind,
    CASE WHEN external THEN 'reject:ExternalReference' WHEN safe IS NULL THEN 'reject:UnsafePath' WHEN kind IN ('file', 'dir') THEN 'materialize'
         WHEN kind = 'symlink' THEN CASE WHEN target IS NULL THEN 'reject:UnsafeLinkTarget' ELSE 'materialize' END
         WHEN kind = 'hardlink' THEN CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.archive_id = s.archive_id AND c.entry_index = s.entry_index) THEN 'materialize' ELSE 'reject:UnsafeLinkTarget' END
         ELSE 'reject:EntryKind' END AS outcome FROM s""", _COMMITTED))
def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(derived(spark, sf_dir), Policy(symlinks=True, hardlinks=True))


@_query(_sql("SELECT archive_id, bool_or(safe IS NULL OR external OR kind NOT IN ('file', 'dir')) AS has_rejections FROM s GROUP BY 1"))
def plan_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.operators.plan import has_rejections

    return has_rejections(plan(derived(spark, sf_dir)))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir).withColumn("image_id", F.col("archive_id"))
    marker = F.when(F.col("entry_index") % 31 == 0, F.concat(fp.parent(F.col("path")), F.lit("/.wh."), fp.leaf(F.col("path")))).when(F.col("entry_index") % 149 == 0, F.concat(F.regexp_extract("path", "^/?([^/]*)", 1), F.lit("/.wh..wh..opq")))
    return rows.withColumn("path", F.coalesce(marker, F.col("path")))


_IMAGE = """i AS (SELECT archive_id AS image_id, layer, entry_index,
      CASE WHEN entry_index % 31 = 0 THEN regexp_replace(path, '/[^/]*$', '') || '/.wh.' || string_split(path, '/')[-1]
           WHEN entry_index % 149 = 0 THEN regexp_extract(path, '^/?([^/]*)', 1) || '/.wh..wh..opq' ELSE path END AS p FROM e),
    j AS (SELECT *, string_split(p, '/')[-1] AS leaf, regexp_replace(p, '/[^/]*$', '') AS up FROM i),
    k AS (SELECT *, CASE WHEN leaf = '.wh..wh..opq' THEN up WHEN starts_with(leaf, '.wh.') THEN up || '/' || leaf[5:] ELSE p END AS q,
                 CASE WHEN leaf = '.wh..wh..opq' THEN 'opaque' WHEN starts_with(leaf, '.wh.') THEN 'whiteout' ELSE 'regular' END AS marker FROM j),
    n AS (SELECT *, """ + _SAFE.format(p="q") + " AS destination FROM k)"


@_query(_sql("""SELECT image_id, layer, entry_index, destination FROM n a WHERE marker = 'regular' AND destination IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM n b WHERE b.image_id = a.image_id AND b.layer > a.layer AND b.marker = 'regular' AND b.destination = a.destination)
    AND NOT EXISTS (SELECT 1 FROM n b WHERE b.image_id = a.image_id AND b.layer > a.layer AND b.marker <> 'regular' AND (starts_with(a.destination, b.destination || '/') OR b.marker = 'whiteout' AND b.destination = a.destination))""", _IMAGE))
def layer_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ol.overlay(_layers(spark, sf_dir)).select("image_id", "layer", "entry_index", "destination")


_DEPTH = 4  # paths of the derived layers are no deeper
_BELOW = "EXISTS (SELECT 1 FROM y{k} b WHERE b.archive_id = a.archive_id AND starts_with(a.destination, b.at || '/') AND b.since < a.entry_index)"
_LAYERED = (
    _IMAGE
    + """,
    o AS (SELECT n.image_id AS archive_id, n.entry_index, n.p AS path, n.marker, n.destination, t.kind, t.external, t.target, len(string_split(n.destination, '/')) AS depth
          FROM n JOIN s t ON n.image_id = t.archive_id AND n.entry_index = t.entry_index),
    r AS (SELECT * FROM o WHERE marker = 'regular' AND destination IS NOT NULL AND NOT external),
    y0 AS (SELECT archive_id, destination AS at, entry_index AS since FROM r WHERE false)"""
    # Whether a symlink counts depends on symlinks nearer the root alone.
    + "".join(
        f""",
    g{k} AS (SELECT * FROM r a WHERE depth = {k} AND NOT {_BELOW.format(k=k - 1)}),
    y{k} AS (SELECT * FROM y{k - 1} UNION ALL SELECT archive_id, destination, entry_index FROM g{k} a WHERE kind = 'symlink' AND target IS NOT NULL
      AND entry_index = (SELECT min(entry_index) FROM g{k} c WHERE c.archive_id = a.archive_id AND c.destination = a.destination))"""
        for k in range(1, _DEPTH + 1)
    )
    + f""",
    v AS (SELECT *, destination IS NOT NULL AND NOT external AND {_BELOW.format(k=_DEPTH)} AS escapes FROM o a),
    m AS (SELECT *, min(CASE WHEN marker = 'regular' AND destination IS NOT NULL AND NOT external AND NOT escapes THEN entry_index END) OVER (PARTITION BY archive_id, destination) AS claimed FROM v),
    w AS (SELECT *, CASE WHEN marker <> 'regular' AND destination IS NULL THEN 'reject:UnsafePath' WHEN marker <> 'regular' AND escapes THEN 'reject:SymlinkEscape' WHEN marker <> 'regular' THEN marker
        WHEN external THEN 'reject:UnsupportedKind' WHEN destination IS NULL THEN 'reject:UnsafePath' WHEN escapes THEN 'reject:SymlinkEscape' WHEN claimed < entry_index THEN 'reject:Duplicate'
        WHEN kind = 'symlink' THEN CASE WHEN target IS NULL THEN 'reject:UnsafeLinkTarget' ELSE 'materialize' END
        WHEN kind = 'hardlink' THEN 'link' WHEN kind IN ('file', 'dir') THEN 'materialize' ELSE 'reject:UnsupportedKind' END AS op FROM m),
    c AS (SELECT archive_id, entry_index, destination FROM w WHERE kind = 'file' AND op = 'materialize'
      UNION SELECT l.archive_id, l.entry_index, l.destination FROM w l JOIN c ON l.archive_id = c.archive_id AND l.target = c.destination AND c.entry_index < l.entry_index WHERE l.op = 'link')"""
)
_OPERATION = """CASE WHEN op <> 'link' THEN op WHEN EXISTS (SELECT 1 FROM c WHERE c.archive_id = w.archive_id AND c.entry_index = w.entry_index) THEN 'materialize' ELSE 'reject:UnsafeLinkTarget' END"""


@_query(_sql(f"SELECT archive_id, entry_index, path, {_OPERATION} AS operation, destination FROM w", _LAYERED))
def layer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ol.layer_plan(_layers(spark, sf_dir))


@_query(_sql(f"SELECT archive_id, count(*) FILTER (q = 'materialize') AS materialized, count(*) FILTER (q = 'whiteout') AS removed, count(*) FILTER (q = 'opaque') AS cleared, count(*) FILTER (q LIKE 'reject:%') AS rejected FROM (SELECT archive_id, {_OPERATION} AS q FROM w) GROUP BY 1", _LAYERED))
def layer_apply_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ol.apply_counts(ol.layer_plan(_layers(spark, sf_dir)))


@_query(_sql("SELECT entry_index, CASE uid WHEN 1 THEN 100001 WHEN 3 THEN 100003 ELSE uid END AS new_uid, CASE gid WHEN 2 THEN 200002 ELSE gid END AS new_gid FROM e"))
def remap_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    uids = spark.createDataFrame([(1, 100001), (3, 100003)], "`from` long, `to` long")
    gids = spark.createDataFrame([(2, 200002)], "`from` long, `to` long")
    return ol.remap_owners(derived(spark, sf_dir), uids, gids).select("entry_index", "new_uid", "new_gid")


def _restorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries some of which ask for more than others: times, names, attributes, ACLs, flags, holes."""
    i = F.col("entry_index")
    return derived(spark, sf_dir).withColumns({
        "mode": F.when(i % 3 != 0, F.col("mode")), "uid": F.when(i % 4 != 0, F.col("uid")), "gid": F.lit(None).cast("long"), "user": F.when(i % 8 == 0, "u"),
        "mtime": F.when(i % 5 != 0, F.col("ts")), "atime": F.when(i % 7 == 0, F.col("ts")), "btime": F.when(i % 11 == 0, F.col("ts")),
        "xattrs": F.when(i % 13 == 0, F.create_map(F.lit("user.b"), F.lit(b"1"), F.lit("user.a"), F.lit(b"22"))), "acl": F.when(i % 17 == 0, F.array(F.lit(b"x"), F.lit(b"yy"))),
        "flags": (i % 19 == 0).cast("int"), "sparse": F.when(i % 23 == 0, F.array(F.struct(F.lit(0).alias("offset"), F.lit(5).alias("length")))),
    })


_ASKED = """a AS (SELECT archive_id, entry_index, unnest(list_filter(list_concat([
      'entry', CASE WHEN kind = 'file' THEN 'atomic_commit' END, CASE WHEN entry_index % 3 <> 0 THEN 'mode' END, CASE WHEN entry_index % 4 <> 0 OR entry_index % 8 = 0 THEN 'ownership' END,
      CASE WHEN entry_index % 5 <> 0 THEN 'modification_time' END, CASE WHEN entry_index % 7 = 0 THEN 'access_time' END, CASE WHEN entry_index % 11 = 0 THEN 'creation_time' END,
      CASE WHEN entry_index % 19 = 0 THEN 'file_flags' END, CASE WHEN entry_index % 23 = 0 THEN 'sparse' END],
      CASE WHEN entry_index % 13 = 0 THEN ['xattr:user.a', 'xattr:user.b'] ELSE [] END, CASE WHEN entry_index % 17 = 0 THEN ['acl:0', 'acl:1'] ELSE [] END), lambda x: x IS NOT NULL)) AS operation FROM e)"""


@_query(_sql("SELECT archive_id, entry_index, operation FROM a", _ASKED))
def requested_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ol.requested_operations(_restorable(spark, sf_dir))


@_query(_sql("SELECT archive_id, entry_index, operation, 'unsupported' AS finding FROM a WHERE string_split(operation, ':')[1] NOT IN ('entry', 'atomic_commit', 'mode', 'modification_time', 'xattr')", _ASKED))
def unsupported_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    can = spark.createDataFrame([(c,) for c in ("entry", "atomic_commit", "mode", "modification_time", "xattr")], "operation string")
    return ol.unsupported_operations(ol.requested_operations(_restorable(spark, sf_dir)), can)


@_query(_sql("""SELECT archive_id, entry_index, operation, CASE WHEN operation IN ('entry', 'mode') AND entry_index % 6 <> 0 THEN 'applied' WHEN operation = 'ownership' THEN 'refused' ELSE 'partial' END AS finding FROM a
    UNION ALL SELECT archive_id, entry_index, 'remove_path', 'os_error' FROM e WHERE entry_index % 31 = 0""", _ASKED))
def reported_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an adapter said about each request, and what it left out."""
    asked = ol.requested_operations(_restorable(spark, sf_dir))
    done = asked.where("operation IN ('entry', 'mode') AND entry_index % 6 <> 0").withColumn("finding", F.lit("applied"))
    refused = asked.where("operation = 'ownership'").withColumn("finding", F.lit("refused"))
    more = derived(spark, sf_dir).where("entry_index % 31 = 0").select("archive_id", "entry_index", F.lit("remove_path").alias("operation"), F.lit("os_error").alias("finding"))
    return ol.with_missing_findings(asked, done.union(refused).union(more))


# --- packages --------------------------------------------------------------------------------------------------


def _zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir).withColumn("method", F.when(F.col("entry_index") % 11 == 0, 12).otherwise(8)).withColumn("encrypted", F.col("entry_index") % 13 == 0)
    name = F.when(F.col("entry_index") % 53 == 0, "META-INF/MANIFEST.MF").when(F.col("entry_index") % 59 == 0, F.concat(F.col("entry_index").cast("string"), F.lit(".nuspec"))).when(F.col("entry_index") % 61 == 0, "[Content_Types].xml")
    return rows.withColumn("path", F.coalesce(name, F.col("path"))).withColumn("local_offset", F.col("entry_index")).withColumn("head", F.lit(None).cast("binary"))


_ZIP = """z AS (SELECT archive_id, entry_index, size, CASE WHEN entry_index % 11 = 0 THEN 12 ELSE 8 END AS method, entry_index % 13 = 0 AS encrypted,
      CASE WHEN entry_index % 53 = 0 THEN 'META-INF/MANIFEST.MF' WHEN entry_index % 59 = 0 THEN CAST(entry_index AS VARCHAR) || '.nuspec' WHEN entry_index % 61 = 0 THEN '[Content_Types].xml' ELSE path END AS p FROM e),
    y AS (SELECT *, """ + _SAFE.format(p="p") + """ AS safe2 FROM z),
    x AS (SELECT *, row_number() OVER (PARTITION BY archive_id, safe2 ORDER BY entry_index) AS nth, sum(size) OVER (PARTITION BY archive_id ORDER BY entry_index) AS total FROM y),
    f AS (SELECT archive_id, 'unsafe-entry-path' AS code, p AS path FROM x WHERE safe2 IS NULL
      UNION ALL SELECT archive_id, 'duplicate-entry-path', p FROM x WHERE safe2 IS NOT NULL AND nth > 1
      UNION ALL SELECT archive_id, 'unexpected-encryption', p FROM x WHERE encrypted
      UNION ALL SELECT archive_id, 'unsupported-compression', p FROM x WHERE NOT encrypted AND method = 12
      UNION ALL SELECT archive_id, 'decompression-bomb', NULL FROM x WHERE total > 100000 AND total - size <= 100000"""


@_query(_sql("SELECT archive_id, code, path, CASE code WHEN 'unsupported-compression' THEN 'warning' ELSE 'error' END AS severity FROM f", _ZIP + " UNION ALL SELECT archive_id, 'missing-required-member', NULL FROM x GROUP BY 1 HAVING NOT bool_or(p = 'META-INF/MANIFEST.MF'))"))
def jar_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _zip_rows(spark, sf_dir)
    return op.zip_findings(rows, rows.select("archive_id").distinct(), "jar", 100_000).select("archive_id", "code", "path", "severity")


@_query(_sql("SELECT archive_id, true AS container_readable, false AS profile_valid, count(*) AS findings FROM f GROUP BY 1", _ZIP + """
      UNION ALL SELECT archive_id, 'missing-required-member', NULL FROM x GROUP BY 1 HAVING NOT bool_or(p = '[Content_Types].xml')
      UNION ALL SELECT archive_id, 'missing-required-member', NULL FROM x GROUP BY 1 HAVING NOT bool_or(p LIKE '%.nuspec')
      UNION ALL SELECT archive_id, 'duplicate-member', NULL FROM x GROUP BY 1 HAVING count(*) FILTER (p LIKE '%.nuspec') > 1)"""))
def nuget_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _zip_rows(spark, sf_dir)
    all_of = rows.select("archive_id").distinct()
    return op.verdicts(op.zip_findings(rows, all_of, "nuget", 100_000), all_of)


# --- round trips: documents packed into archives and read back ---------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("archive_id"), F.col("doc_id").alias("entry_index"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.lit("file").alias("kind"), F.col("text").alias("payload"), F.lit(0o640).alias("mode"), F.lit(1_700_000_000).cast("long").alias("secs"))


_TRIP = "SELECT source AS archive_id, lang || '/' || doc_id || '.txt' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256, 416 AS mode, CAST(1700000000 AS BIGINT) AS secs FROM documents"


#: Mean bytes and members of a block. A source of more is packed as several archives, far below the limits of a value and of ZIP.
BLOCK_BYTES, BLOCK_MEMBERS = 32 << 20, 8_192


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an archive_id for each source and block; the number of blocks comes from sums for each source."""
    rows = _documents(spark, sf_dir)
    sums = rows.groupBy("archive_id").agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes"), F.count("*").alias("members"))
    blocks = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("members") / BLOCK_MEMBERS), F.lit(1))
    sums = sums.select(F.col("archive_id").alias("__source"), blocks.alias("__blocks"))
    joined = rows.join(sums, F.col("archive_id").eqNullSafe(F.col("__source")))
    block = F.pmod(F.xxhash64("entry_index", "payload"), F.col("__blocks"))
    return joined.withColumn("archive_id", F.to_json(F.struct(F.col("__source").alias("source"), block.alias("block")))).drop("__source", "__blocks")


def _source() -> Column:
    return F.get_json_object("archive_id", "$.source")


def _trip(spark: SparkSession, sf_dir: str, fmt: str, codec: str | None) -> DataFrame:
    packed = pack(_blocked(spark, sf_dir), fmt, codec)
    chunks = sa.payloads(packed, strict=True)
    return chunks.select(_source().alias("archive_id"), "path", "size", ff.digest(F.col("payload")).alias("sha256"), "mode", F.col("mtime.secs").alias("secs"))


def _round_trip(name: str, fmt: str, codec: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _trip(spark, sf_dir, fmt, codec)

    query.__name__ = name
    _query(_TRIP)(query)


for _fmt, _codec in (("tar", None), ("tar", "gzip"), ("tar", "bzip2"), ("tar", "xz"), ("tar", "zstd"), ("tar", "lz4"), ("cpio", "gzip"), ("ar", None), ("zip", None)):
    _round_trip(f"round_trip_{_fmt}{'_' + _codec if _codec else ''}", _fmt, _codec)


@_query("SELECT source AS archive_id, count(*) AS entry_count, CAST(sum(octet_length(encode(text))) AS BIGINT) AS payload_bytes FROM documents GROUP BY 1")
def inspect_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List archives without touching payloads, and sum up."""
    each = oe.verify_report(sa.entries(pack(_blocked(spark, sf_dir), "zip"), strict=True))
    return each.groupBy(_source().alias("archive_id")).agg(F.sum("entry_count").alias("entry_count"), F.sum("payload_bytes").alias("payload_bytes"))


@_query("SELECT source AS archive_id, 'gzip' AS filter, true AS same_diff_id FROM documents GROUP BY 1")
def layer_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of compressed layers and of what is in them; the latter equals that of the plain layer."""
    plain = pack(_blocked(spark, sf_dir), "tar").select(F.col("archive_id").alias("a"), ff.digest(F.col("content")).alias("plain"))
    packed = sa.layer_digests(pack(_blocked(spark, sf_dir), "tar", "gzip"))
    each = packed.join(plain, F.col("archive_id") == F.col("a"), "left").select(_source().alias("archive_id"), F.get("filters", F.lit(0)).alias("filter"), F.coalesce(F.col("diff_id") == F.col("plain"), F.lit(False)).alias("same"))
    return each.groupBy("archive_id", "filter").agg(F.bool_and("same").alias("same_diff_id"))


@_query("SELECT source AS archive_id, format, filter FROM (SELECT DISTINCT source FROM documents), (VALUES ('tar', NULL), ('cpio', NULL), ('ar', NULL), ('zip', NULL), (NULL, 'gzip'), (NULL, 'bzip2'), (NULL, 'xz'), (NULL, 'lz4')) AS v(format, filter)")
def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and codecs told by their magic, in columns, over archives of all documents."""
    whole = _blocked(spark, sf_dir)
    out = None
    for fmt, codecs in (("tar", (None, "gzip", "bzip2", "xz", "lz4")), ("cpio", (None,)), ("ar", (None,)), ("zip", (None,))):
        found = sa.archive_table(packs(whole, fmt, codecs)).select(_source().alias("archive_id"), "format", "filter")
        out = found if out is None else out.union(found)
    return out.distinct()

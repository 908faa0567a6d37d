"""Registered queries of the package profiles, over kits of members made from the customers table.

A kit is one package of each profile and customer; which members it has, in which order and how they are stored depends on
the customer's number, so that some packages are valid and others lack, repeat or misplace something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators import packages as op
from stowage.plans.queries import _SAFE
from stowage.plans.registry import query

#: Members by profile. A member is left out where (7 x customer + 3 x its number) % 8 is 0.
MEMBERS = {
    "wheel": ["p-1.dist-info/METADATA", "p-1.dist-info/RECORD", "p-1.dist-info/WHEEL", "p/__init__.py", "p/./__init__.py"],
    "epub": ["mimetype", "META-INF/container.xml", "text/one.html"],
    "apk": ["AndroidManifest.xml", "META-INF/A.SF", "META-INF/A.RSA", "META-INF/sub/B.SF", "classes.dex"],
    "ipa": ["Payload/A.app/Info.plist", "Payload/A.app/x/Info.plist", "Payload/B", "iTunes"],
    "msix": ["AppxManifest.xml", "[Content_Types].xml", "AppxBlockMap.xml", "AppxSignature.p7x"],
    "nuget": ["[Content_Types].xml", "a.nuspec", "lib/b.nuspec", "c.nuspec"],
    "jar": ["META-INF/MANIFEST.MF", "A.class"],
}
_BUDGET = 380


def kits(spark: SparkSession, sf_dir: str, profile: str) -> tuple[DataFrame, DataFrame]:
    """Members of all kits of a profile, and the kits themselves (archive_id, signing_ids)."""
    k, i = F.col("c_custkey"), F.col("i")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    members = F.explode(F.array(*(F.struct(F.lit(n).alias("i"), F.lit(p).alias("path")) for n, p in enumerate(MEMBERS[profile])))).alias("m")
    rows = customers.select(k, members).select("c_custkey", "m.i", "m.path").where((7 * k + 3 * i) % 8 != 0)
    rows = rows.select(
        k.cast("long").alias("archive_id"), i.cast("long").alias("entry_index"),
        F.when((k % 29 == 0) & (i == 2), "../out").otherwise(F.col("path")).alias("path"),
        F.when((i == 0) & (k % 5 != 0), 0).when((k % 13 == 0) & (i == 1), 12).otherwise(8).alias("method"),
        ((k % 17 == 0) & (i == 1)).alias("encrypted"), (100 + k % 7 * i).cast("long").alias("size"),
        F.when((i == 0) & (k % 3 == 0), 900).otherwise(i * 100).cast("long").alias("local_offset"),
        F.when((i == 0) & (k % 4 != 0), F.lit(b"application/epub+zip")).alias("head"),
    )
    ids = F.when(k % 3 == 0, F.array(F.lit(0x7109871A).cast("long"))).when(k % 3 == 1, F.array(F.lit(0xF05368C0).cast("long"), F.lit(5).cast("long")))
    return rows, customers.select(k.cast("long").alias("archive_id"), ids.alias("signing_ids"))


def _kit_sql(profile: str, more: str, body: str) -> str:
    values = ", ".join(f"({i}, '{p}')" for i, p in enumerate(MEMBERS[profile]))
    return f"""WITH k AS (SELECT CAST(c_custkey AS BIGINT) AS archive_id FROM customer),
    z AS (SELECT archive_id, CAST(i AS BIGINT) AS entry_index, CASE WHEN archive_id % 29 = 0 AND i = 2 THEN '../out' ELSE p END AS path,
        CASE WHEN i = 0 AND archive_id % 5 <> 0 THEN 0 WHEN archive_id % 13 = 0 AND i = 1 THEN 12 ELSE 8 END AS method, archive_id % 17 = 0 AND i = 1 AS encrypted,
        100 + archive_id % 7 * i AS size, CASE WHEN i = 0 AND archive_id % 3 = 0 THEN 900 ELSE i * 100 END AS local_offset
      FROM k, (VALUES {values}) AS t(i, p) WHERE (7 * archive_id + 3 * i) % 8 <> 0),
    y AS (SELECT *, {_SAFE.format(p="path")} AS safe FROM z),
    x AS (SELECT *, row_number() OVER (PARTITION BY archive_id, safe ORDER BY entry_index) AS nth, sum(size) OVER (PARTITION BY archive_id ORDER BY entry_index) AS total FROM y),
    h AS (SELECT archive_id, coalesce(list(z.path) FILTER (z.path IS NOT NULL), []) AS paths FROM k LEFT JOIN z USING (archive_id) GROUP BY 1),
    f AS (SELECT archive_id, 'unsafe-entry-path' AS code, path, 'error' AS severity FROM x WHERE safe IS NULL
      UNION ALL SELECT archive_id, 'duplicate-entry-path', path, 'error' FROM x WHERE safe IS NOT NULL AND nth > 1
      UNION ALL SELECT archive_id, 'unexpected-encryption', path, 'error' FROM x WHERE encrypted
      UNION ALL SELECT archive_id, 'unsupported-compression', path, 'warning' FROM x WHERE NOT encrypted AND method = 12
      UNION ALL SELECT archive_id, 'decompression-bomb', NULL, 'error' FROM x WHERE total > {_BUDGET} AND total - size <= {_BUDGET}
      {more}) {body}"""


def _missing(test: str) -> str:
    return f"UNION ALL SELECT archive_id, 'missing-required-member', NULL, 'error' FROM h WHERE len(list_filter(paths, lambda p: {test})) = 0 "


def _lacks(*names: str) -> str:
    return "".join(_missing(f"p = '{n}'") for n in names)


_MIME = "(SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY entry_index) AS n, (SELECT min(local_offset) FROM z b WHERE b.archive_id = a.archive_id) AS least FROM z a WHERE path = 'mimetype')"
_V1 = "len(list_filter(paths, lambda p: regexp_full_match(p, 'META-INF/[^/]+\\.SF'))) > 0 AND len(list_filter(paths, lambda p: regexp_full_match(p, 'META-INF/[^/]+\\.(RSA|DSA|EC)'))) > 0"
_SIGNED = "len(list_filter(paths, lambda p: p = 'AppxSignature.p7x')) > 0"
#: What each profile asks beyond what all share, in SQL.
_OWN = {
    "wheel": "".join(_missing(f"p LIKE '%.dist-info/{n}'") for n in ("METADATA", "RECORD", "WHEEL")),
    "epub": _lacks("mimetype", "META-INF/container.xml")
    + f"""UNION ALL SELECT archive_id, 'mimetype-not-first', path, 'error' FROM {_MIME} WHERE n = 1 AND local_offset > least
      UNION ALL SELECT archive_id, 'mimetype-not-stored', path, 'error' FROM {_MIME} WHERE n = 1 AND method <> 0
      UNION ALL SELECT archive_id, 'mimetype-invalid-content', path, 'error' FROM {_MIME} WHERE n = 1 AND method = 0 AND archive_id % 4 = 0""",
    "apk": _lacks("AndroidManifest.xml")
    + f"""UNION ALL SELECT archive_id, 'signing-scheme-detected', NULL, 'info' FROM h WHERE {_V1} OR archive_id % 3 IN (0, 1)
      UNION ALL SELECT archive_id, 'unsigned-package', NULL, 'info' FROM h WHERE NOT ({_V1}) AND archive_id % 3 = 2""",
    "ipa": _missing("regexp_full_match(p, 'Payload/[^/]+\\.app/Info\\.plist')"),
    "msix": _lacks("AppxManifest.xml", "[Content_Types].xml", "AppxBlockMap.xml")
    + f"""UNION ALL SELECT archive_id, 'signing-scheme-detected', NULL, 'info' FROM h WHERE {_SIGNED}
      UNION ALL SELECT archive_id, 'unsigned-package', NULL, 'info' FROM h WHERE NOT ({_SIGNED})""",
    "nuget": _lacks("[Content_Types].xml")
    + _missing("regexp_full_match(p, '[^/]*\\.nuspec')")
    + """UNION ALL SELECT archive_id, 'duplicate-member', path, 'error'
        FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY entry_index) AS n FROM z WHERE regexp_full_match(path, '[^/]*\\.nuspec')) WHERE n = 2""",
    "jar": _lacks("META-INF/MANIFEST.MF"),
}
_VERDICT = "SELECT k.archive_id, true AS container_readable, coalesce(bool_and(severity = 'info'), true) AS profile_valid, count(code) AS findings FROM k LEFT JOIN f ON k.archive_id = f.archive_id GROUP BY 1"


def _register(profile: str) -> None:
    def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, archives = kits(spark, sf_dir, profile)
        return op.zip_findings(rows, archives, profile, _BUDGET).select("archive_id", "code", "path", "severity")

    def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, archives = kits(spark, sf_dir, profile)
        return op.verdicts(op.zip_findings(rows, archives, profile, _BUDGET), archives)

    findings.__name__, verdict.__name__ = f"{profile}_kit_findings", f"{profile}_kit_verdicts"
    query(_kit_sql(profile, _OWN[profile], "SELECT archive_id, code, path, severity FROM f"))(findings)
    query(_kit_sql(profile, _OWN[profile], _VERDICT))(verdict)


for _profile in MEMBERS:
    _register(_profile)

_SCHEMES = f"[CASE WHEN {_V1} THEN 'v1' END, CASE WHEN archive_id % 3 = 0 THEN 'v2' END, CASE WHEN archive_id % 3 = 1 THEN 'v3' END]"


@query(_kit_sql("apk", "", f"SELECT archive_id, array_to_string(list_filter({_SCHEMES}, lambda x: x IS NOT NULL), ', ') AS schemes FROM h WHERE {_V1} OR archive_id % 3 IN (0, 1)"))
def apk_signing_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, archives = kits(spark, sf_dir, "apk")
    found = op.zip_findings(rows, archives, "apk", _BUDGET).where("code = 'signing-scheme-detected'")
    return found.select("archive_id", F.col("detail").alias("schemes"))


# --- Debian packages: members of the outer ar, and entries of the nested tar archives ------------------------------

_DEB = ["debian-binary", "control.tar.gz", "data.tar.xz", "extra", "data.tar", "/bad"]
#: Which of the members a package has, as bits, by customer % 8.
_HAVE = [0b000111, 0b000111, 0b000110, 0b000101, 0b001111, 0b010111, 0b100111, 0b000011]


def _debs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, i = F.col("c_custkey"), F.col("i")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    have: Column = F.element_at(F.array(*(F.lit(h) for h in _HAVE)), (k % 8 + 1).cast("int"))
    members = F.explode(F.array(*(F.struct(F.lit(n).alias("i"), F.lit(p).alias("path")) for n, p in enumerate(_DEB)))).alias("m")
    rows = customers.select(k, have.alias("have"), members).select("c_custkey", "have", "m.i", "m.path").where(F.expr("(shiftright(have, i) & 1) = 1"))
    # Three orders: as listed, by threes, by fives.
    place = (i + 1) * F.element_at(F.array(F.lit(1), F.lit(1), F.lit(3), F.lit(5)), (k % 4 + 1).cast("int")) % 7
    stamp = F.when(i == 0, F.when(k % 9 == 0, F.lit(b"3.0\n")).when(k % 11 == 0, F.lit(b"2.0")).otherwise(F.lit(b"2.0\n")))
    rows = rows.select(k.cast("long").alias("archive_id"), place.cast("long").alias("entry_index"), "path", stamp.alias("payload"))
    names = F.explode(F.array(*(F.struct(F.lit(n).alias("entry_index"), F.lit(p).alias("path")) for n, p in enumerate(["./", "usr/a", "../up", "usr/./a"])))).alias("m")
    inner = customers.where("c_custkey % 10 < 3").select(k.cast("long").alias("archive_id"), names).select("archive_id", F.lit("data.tar.xz").alias("member"), "m.*")
    return rows, customers.select(k.cast("long").alias("archive_id")), inner.where("entry_index < 2 OR archive_id % 10 = entry_index - 1")


_DEB_SQL = f"""WITH k AS (SELECT CAST(c_custkey AS BIGINT) AS archive_id FROM customer),
    z AS (SELECT archive_id, i, p AS path, (i + 1) * [1, 1, 3, 5][CAST(archive_id % 4 + 1 AS INT)] % 7 AS place,
        CASE i WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 2 END AS role
      FROM k, (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(_DEB))}) AS t(i, p) WHERE ({_HAVE}[CAST(archive_id % 8 + 1 AS INT)] >> i) & 1 = 1),
    y AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY place) AS n, row_number() OVER (PARTITION BY archive_id, role ORDER BY place) AS nth,
        max(role) OVER (PARTITION BY archive_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM z),
    h AS (SELECT archive_id, coalesce(bool_or(role = 0), false) AS r0, coalesce(bool_or(role = 1), false) AS r1, coalesce(bool_or(role = 2), false) AS r2, coalesce(bool_or(n = 1 AND i <> 5 AND coalesce(role, 9) <> 0), false) AS told FROM y GROUP BY 1),
    f AS (SELECT archive_id, 'unsafe-member-name' AS code, path FROM y WHERE i = 5
      UNION ALL SELECT archive_id, 'missing-debian-binary', path FROM y WHERE n = 1 AND i <> 5 AND coalesce(role, 9) <> 0
      UNION ALL SELECT archive_id, 'duplicate-member', path FROM y WHERE role IS NOT NULL AND nth > 1
      UNION ALL SELECT archive_id, 'unexpected-member-order', path FROM y WHERE role < top
      UNION ALL SELECT archive_id, 'unknown-member', path FROM y WHERE i = 3
      UNION ALL SELECT archive_id, 'invalid-version-stamp', path FROM y WHERE i = 0 AND (archive_id % 9 = 0 OR archive_id % 11 = 0)
      UNION ALL SELECT archive_id, 'missing-debian-binary', NULL FROM h WHERE NOT r0 AND NOT told
      UNION ALL SELECT archive_id, 'missing-required-member', NULL FROM h WHERE NOT r1
      UNION ALL SELECT archive_id, 'missing-required-member', NULL FROM h WHERE NOT r2
      UNION ALL SELECT archive_id, 'unsafe-entry-path', '../up' FROM k WHERE archive_id % 10 = 1
      UNION ALL SELECT archive_id, 'duplicate-entry-path', 'usr/./a' FROM k WHERE archive_id % 10 = 2)"""


@query(f"{_DEB_SQL} SELECT archive_id, code, path, CASE code WHEN 'unknown-member' THEN 'warning' ELSE 'error' END AS severity FROM f")
def deb_kit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.deb_findings(*_debs(spark, sf_dir)).select("archive_id", "code", "path", "severity")


@query(f"{_DEB_SQL} SELECT k.archive_id, true AS container_readable, count(code) = 0 AS profile_valid, count(code) AS findings FROM k LEFT JOIN f ON k.archive_id = f.archive_id GROUP BY 1")
def deb_kit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, archives, inner = _debs(spark, sf_dir)
    return op.verdicts(op.deb_findings(members, archives, inner), archives)


# --- RPM packages: what their headers say ---------------------------------------------------------------------------


def _rpms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.cast("long").alias("archive_id"), (k % 11 != 0).alias("lead_ok"), (k % 7 != 0).alias("header_ok"), F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "drpm").otherwise("cpio").alias("payload_format"),
        F.when(k % 3 == 0, "zstd").when(k % 3 == 1, "none").otherwise("xz").alias("compressor"), F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "zstd").otherwise("xz").alias("detected"),
    )


_RPM_SQL = """WITH k AS (SELECT CAST(c_custkey AS BIGINT) AS archive_id, c_custkey AS n FROM customer),
    f AS (SELECT archive_id, 'invalid-lead' AS code FROM k WHERE n % 11 = 0
      UNION ALL SELECT archive_id, 'invalid-header' FROM k WHERE n % 11 <> 0 AND n % 7 = 0
      UNION ALL SELECT archive_id, 'payload-format-mismatch' FROM k WHERE n % 11 <> 0 AND n % 7 <> 0 AND n % 5 IN (0, 1)
      UNION ALL SELECT archive_id, 'compressor-mismatch' FROM k WHERE n % 11 <> 0 AND n % 7 <> 0 AND (n % 3 = 0 AND n % 4 <> 1 OR n % 3 = 2 AND n % 4 IN (0, 1)))"""


@query(f"{_RPM_SQL} SELECT archive_id, code, CASE code WHEN 'compressor-mismatch' THEN 'warning' ELSE 'error' END AS severity FROM f")
def rpm_kit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rpm_findings(_rpms(spark, sf_dir))


@query(f"{_RPM_SQL} SELECT k.archive_id, n % 11 <> 0 AND n % 7 <> 0 AS container_readable, count(code) = 0 AS profile_valid, count(code) AS findings FROM k LEFT JOIN f ON k.archive_id = f.archive_id GROUP BY 1, 2")
def rpm_kit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rpms(spark, sf_dir)
    return op.verdicts(op.rpm_findings(rows), rows.select("archive_id", (F.col("lead_ok") & F.col("header_ok")).alias("readable")))

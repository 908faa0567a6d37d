"""Package profiles: findings and verdicts over the entries of many packages at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.paths import is_ipa_info_plist, is_meta_inf_child, is_root_nuspec, sanitise
from stowage.operators.entries import running

#: Codes of findings that are not errors.
SEVERITY = {"unknown-member": "warning", "unsupported-compression": "warning", "compressor-mismatch": "warning", "unsigned-package": "info", "signing-scheme-detected": "info"}

STORE, DEFLATE = 0, 8


def severity(code: Column) -> Column:
    out = F.lit("error")
    for k, v in SEVERITY.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def _finding(rows: DataFrame, code: str, path: Column | None = None, detail: Column | None = None) -> DataFrame:
    path = F.lit(None).cast("string") if path is None else path
    return rows.select("archive_id", F.lit(code).alias("code"), path.cast("string").alias("path"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("severity", severity(F.col("code")))


def zip_common(entries: DataFrame, budget: int = 4 << 30) -> DataFrame:
    """Findings that all ZIP profiles share: unsafe and repeated paths, encryption, methods, declared size.

    entries: archive_id, entry_index, path, method, encrypted, size. Windows are by archive and path, and by archive and
    block; an encrypted member's method is not reported; the budget once for each archive.
    """
    rows = entries.withColumn("safe", sanitise(F.col("path")))
    repeated = Window.partitionBy("archive_id", "safe").orderBy("entry_index")
    rows = running(rows.withColumn("nth", F.row_number().over(repeated)).withColumn("wide", F.col("size").cast("decimal(38,0)")), "wide", "before")
    before = F.coalesce("before", F.lit(0))
    crossed = (before + F.coalesce("wide", F.lit(0)) > F.lit(budget)) & (before <= F.lit(budget))
    checks = F.array_compact(
        F.array(
            F.when(F.col("safe").isNull(), F.lit("unsafe-entry-path")),
            F.when(F.col("safe").isNotNull() & (F.col("nth") > 1), F.lit("duplicate-entry-path")),
            F.when(F.col("encrypted"), F.lit("unexpected-encryption")).when(~F.col("method").isin(STORE, DEFLATE), F.lit("unsupported-compression")),
            F.when(crossed, F.lit("decompression-bomb")),
        )
    )
    found = rows.select("archive_id", "path", F.explode(checks).alias("code"))
    return found.select("archive_id", "code", F.when(F.col("code") != "decompression-bomb", F.col("path")).alias("path"), F.lit(None).cast("string").alias("detail"), severity(F.col("code")).alias("severity"))


def _required(name: str) -> tuple[str, Column]:
    return name, F.col("path") == name


#: Members each profile cannot do without, as tests of a path.
REQUIRED: dict[str, Callable[[], list[tuple[str, Column]]]] = {
    "jar": lambda: [_required("META-INF/MANIFEST.MF")],
    "nuget": lambda: [_required("[Content_Types].xml"), ("*.nuspec", is_root_nuspec(F.col("path")))],
    "wheel": lambda: [(f"*.dist-info/{n}", F.endswith(F.col("path"), F.lit(f".dist-info/{n}"))) for n in ("METADATA", "RECORD", "WHEEL")],
    "epub": lambda: [_required("mimetype"), _required("META-INF/container.xml")],
    "apk": lambda: [_required("AndroidManifest.xml")],
    "ipa": lambda: [("Payload/<name>.app/Info.plist", is_ipa_info_plist(F.col("path")))],
    "msix": lambda: [_required("AppxManifest.xml"), _required("[Content_Types].xml"), _required("AppxBlockMap.xml")],
}


def _by_archive(entries: DataFrame, archives: DataFrame, tests: dict[str, Column], own: dict[str, Column] | None = None) -> DataFrame:
    """One row for each of ``archives``: whether a test holds for any of its entries, and booleans of the archive itself.

    Both tables go into one aggregation, not a join: nothing is collected for a broadcast, and all tests share one shuffle.
    """
    own = own or {}
    no = F.lit(None).cast("boolean")
    rows = entries.select("archive_id", F.lit(False).alias("_is"), *(t.alias(n) for n, t in tests.items()), *(no.alias(n) for n in own))
    rows = rows.union(archives.select("archive_id", F.lit(True).alias("_is"), *(no.alias(n) for n in tests), *(c.alias(n) for n, c in own.items())))
    each = rows.groupBy("archive_id").agg(F.bool_or("_is").alias("_is"), *(F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in (*tests, *own)))
    return each.where("_is").drop("_is")


def _missing(each: DataFrame, names: list[str]) -> DataFrame:
    lacking = F.array_compact(F.array(*(F.when(~F.col(f"h{i}"), F.lit(name)) for i, name in enumerate(names))))
    return _finding(each.select("archive_id", F.explode(lacking).alias("name")), "missing-required-member", detail=F.col("name"))


def missing_members(entries: DataFrame, archives: DataFrame, profile: str) -> DataFrame:
    """One finding for each required member that an archive (archive_id of ``archives``) lacks."""
    tests = REQUIRED[profile]()
    return _missing(_by_archive(entries, archives, {f"h{i}": test for i, (_, test) in enumerate(tests)}), [name for name, _ in tests])


def _apk_v1() -> dict[str, Column]:
    child, path = is_meta_inf_child(F.col("path")), F.col("path")
    return {"sf": child & F.endswith(path, F.lit(".SF")), "key": child & path.rlike(r"\.(RSA|DSA|EC)$")}


def zip_findings(entries: DataFrame, archives: DataFrame, profile: str, budget: int = 4 << 30) -> DataFrame:
    """All findings of a ZIP profile: archive_id, code, path, detail, severity.

    entries as for :func:`zip_common`, with local_offset and head (first bytes of stored members) for epub; archives
    has archive_id and for apk signing_ids (array of numbers from the signing block, null without one).
    """
    required = REQUIRED[profile]()
    tests, own = {f"h{i}": test for i, (_, test) in enumerate(required)}, {}
    if profile == "apk":
        tests |= _apk_v1()
        # Ids of the second and third signing scheme.
        own = {"v2": F.array_contains("signing_ids", 0x7109871A), "v3": F.array_contains("signing_ids", 0xF05368C0), "ids": F.col("signing_ids").isNotNull()}
    if profile == "msix":
        tests |= {"signed": F.col("path") == "AppxSignature.p7x"}
    each = _by_archive(entries, archives, tests, own)
    parts = [_missing(each, [name for name, _ in required])]
    if profile == "nuget":
        nth = F.row_number().over(Window.partitionBy("archive_id").orderBy("entry_index"))
        extra = entries.where(is_root_nuspec(F.col("path"))).withColumn("n", nth).where("n = 2")
        parts.append(_finding(extra, "duplicate-member", F.col("path")))
    if profile == "epub":
        first = entries.groupBy(F.col("archive_id").alias("a")).agg(F.min("local_offset").alias("least"))
        nth = F.row_number().over(Window.partitionBy("archive_id").orderBy("entry_index"))
        own = entries.where("path = 'mimetype'").withColumn("n", nth).where("n = 1").join(first.hint("merge"), F.col("archive_id") == F.col("a"))
        parts.append(_finding(own.where("local_offset > least"), "mimetype-not-first", F.col("path")))
        parts.append(_finding(own.where(F.col("method") != STORE), "mimetype-not-stored", F.col("path")))
        wrong = (F.col("method") == STORE) & (F.coalesce(F.col("head"), F.lit(b"")) != F.lit(b"application/epub+zip"))
        parts.append(_finding(own.where(wrong), "mimetype-invalid-content", F.col("path")))
    if profile == "apk":
        schemes = F.array_compact(F.array(F.when(F.col("sf") & F.col("key"), F.lit("v1")), F.when(F.col("v2"), F.lit("v2")), F.when(F.col("v3"), F.lit("v3"))))
        signed = each.withColumn("schemes", schemes).withColumn("any", (F.size("schemes") > 0) | F.col("ids"))
        parts += [_finding(signed.where("any"), "signing-scheme-detected", detail=F.array_join("schemes", ", ")), _finding(signed.where("NOT any"), "unsigned-package")]
    if profile == "msix":
        parts += [_finding(each.where("signed"), "signing-scheme-detected"), _finding(each.where("NOT signed"), "unsigned-package")]
    return _union(parts).unionByName(zip_common(entries, budget))


def verdicts(findings: DataFrame, archives: DataFrame) -> DataFrame:
    """container_readable and profile_valid of each archive: valid if readable and nothing is a warning or worse."""
    readable = F.col("readable") if "readable" in archives.columns else F.lit(True)
    # One aggregation of both tables, as in _by_archive.
    rows = findings.select("archive_id", F.lit(None).cast("boolean").alias("readable"), (F.col("severity") != "info").alias("blocking"), F.lit(1).cast("long").alias("n"))
    rows = rows.union(archives.select("archive_id", readable.alias("readable"), F.lit(False).alias("blocking"), F.lit(0).cast("long").alias("n")))
    out = rows.groupBy("archive_id").agg(F.bool_or("readable").alias("container_readable"), F.bool_or("blocking").alias("blocking"), F.sum("n").alias("findings"), F.bool_or(F.col("n") == 0).alias("_is"))
    return out.where("_is").select("archive_id", "container_readable", (F.col("container_readable") & ~F.col("blocking")).alias("profile_valid"), "findings")


def deb_role(path: Column) -> Column:
    """Rank of a member of a Debian package: 0 debian-binary, 1 control, 2 data, null for others."""
    return F.when(path == "debian-binary", 0).when(path.rlike(r"^control\.tar(\.[a-z0-9]+)?$"), 1).when(path.rlike(r"^data\.tar(\.[a-z0-9]+)?$"), 2)


def deb_findings(members: DataFrame, archives: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """Findings of Debian packages. members: archive_id, entry_index, path, payload of the outer ar; nested: the entries
    of the control and data archives (archive_id, member, entry_index, path), from which unsafe and repeated paths come.
    """
    rows = members.withColumn("safe", sanitise(F.col("path"))).withColumn("role", F.when(F.col("safe").isNotNull(), deb_role(F.col("path"))))
    # The outer archive has three members or so; its windows are small.
    before = Window.partitionBy("archive_id").orderBy("entry_index").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("archive_id", "role").orderBy("entry_index")
    rows = rows.withColumn("top", F.max("role").over(before)).withColumn("nth", F.row_number().over(same)).withColumn("n", F.row_number().over(Window.partitionBy("archive_id").orderBy("entry_index")))
    body = F.decode(F.col("payload"), "ISO-8859-1")
    stamp_ok = F.startswith(body, F.lit("2.")) & F.contains(body, F.lit("\n"))
    first_wrong = (F.col("n") == 1) & F.col("safe").isNotNull() & ~F.coalesce(F.col("role") == 0, F.lit(False))
    checks = F.array_compact(
        F.array(
            F.when(F.col("safe").isNull(), F.lit("unsafe-member-name")),
            F.when(first_wrong, F.lit("missing-debian-binary")),
            F.when(F.col("role").isNotNull() & (F.col("nth") > 1), F.lit("duplicate-member")),
            F.when(F.col("role") < F.col("top"), F.lit("unexpected-member-order")),
            F.when(F.col("safe").isNotNull() & F.col("role").isNull(), F.lit("unknown-member")),
            F.when((F.col("role") == 0) & ~F.coalesce(stamp_ok, F.lit(False)), F.lit("invalid-version-stamp")),
        )
    )
    parts = [rows.select("archive_id", F.explode(checks).alias("code"), "path", F.lit(None).cast("string").alias("detail"))]
    all_of = _by_archive(rows, archives, {f"r{i}": F.col("role") == i for i in range(3)} | {"told": first_wrong})
    no = [~F.col(f"r{i}") for i in range(3)]
    parts.append(_finding(all_of.where(no[0] & ~F.col("told")), "missing-debian-binary"))
    parts += [_finding(all_of.where(no[1]), "missing-required-member", detail=F.lit("control.tar")), _finding(all_of.where(no[2]), "missing-required-member", detail=F.lit("data.tar"))]
    if nested is not None:
        inner = nested.withColumn("safe", sanitise(F.col("path"))).where(~F.col("path").isin(".", "./"))
        nth = F.row_number().over(Window.partitionBy("archive_id", "member", "safe").orderBy("entry_index"))
        inner = inner.withColumn("nth", nth)
        parts += [_finding(inner.where("safe IS NULL"), "unsafe-entry-path", F.col("path")), _finding(inner.where("safe IS NOT NULL AND nth > 1"), "duplicate-entry-path", F.col("path"))]
    return _union(parts)


def rpm_findings(packages: DataFrame) -> DataFrame:
    """Findings of RPM packages from their decoded headers.

    packages: archive_id, lead_ok, header_ok, payload_format, compressor (as declared), detected (by magic). Without a
    sound lead and header nothing else is looked at, and the container counts as unreadable (column readable of the
    archives given to :func:`verdicts`).
    """
    sound = F.col("lead_ok") & F.col("header_ok")
    # Names that RPM headers use for compressors.
    known = F.col("compressor").isin("gzip", "bzip2", "xz", "zstd", "lz4")
    checks = F.array_compact(
        F.array(
            F.when(~F.col("lead_ok"), F.lit("invalid-lead")),
            F.when(F.col("lead_ok") & ~F.col("header_ok"), F.lit("invalid-header")),
            F.when(sound & (F.coalesce("payload_format", F.lit("")) != "cpio"), F.lit("payload-format-mismatch")),
            F.when(sound & known & (F.col("compressor") != F.coalesce("detected", F.lit("none"))), F.lit("compressor-mismatch")),
        )
    )
    return packages.select("archive_id", F.explode(checks).alias("code")).withColumn("severity", severity(F.col("code")))

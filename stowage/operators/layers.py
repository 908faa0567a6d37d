"""Image layers: plans with whiteouts, and what a stack of layers shows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.paths import ancestors, leaf, nesting, parent, sanitise
from stowage.operators.entries import LIMITS
from stowage.operators.plan import SPECIAL, Policy, plan
from stowage.operators.tables import materialise

WHITEOUT, OPAQUE = ".wh.", ".wh..wh..opq"


def _marked(entries: DataFrame) -> DataFrame:
    """entries with marker and destination, step by step: each text is worked out once.

    marker: ``opaque``, ``whiteout``, ``unsafe`` (a whiteout of nothing) or ``regular``. destination: the safe path of a
    regular entry, the sibling that a whiteout is about, the directory of an opaque marker; null if that is unsafe.
    """
    rows = entries.withColumn("_leaf", leaf(F.col("path"))).withColumn("_up", parent(F.col("path")))
    name, up = F.col("_leaf"), F.col("_up")
    kind = F.when(name == OPAQUE, "opaque").when(name == WHITEOUT, "unsafe").when(F.startswith(name, F.lit(WHITEOUT)), "whiteout").otherwise("regular")
    rows = rows.withColumn("marker", kind)
    sibling = F.concat(F.when(up == "", "").otherwise(F.concat(up, F.lit("/"))), F.substring(name, 5, 1 << 30))
    about = F.when(F.col("marker") == "regular", F.col("path")).when(F.col("marker") == "opaque", up).when(F.col("marker") == "whiteout", sibling)
    rows = rows.withColumn("_about", about)
    root = (F.col("marker") == "opaque") & (up == "")
    return rows.withColumn("destination", F.when(root, "").otherwise(sanitise(F.col("_about")))).drop("_leaf", "_up", "_about")


def _escaping(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Keys of rows below a symlink (archive_id, at, since) that was accepted before them."""
    up = rows.select("archive_id", "entry_index", F.explode(ancestors(F.col("destination"), itself=False)).alias("at"))
    return up.join(links, ["archive_id", "at"]).where("since < entry_index").select("archive_id", "entry_index").distinct()


def _claims(rows: DataFrame) -> DataFrame:
    """Rows with the first place that claims their destination."""
    first = rows.groupBy("archive_id", "destination").agg(F.min("entry_index").alias("claimed"))
    return rows.join(first, ["archive_id", "destination"])


def layer_plan(entries: DataFrame, policy: Policy = Policy(True, True, False), most_nesting: int = LIMITS["nesting"]) -> DataFrame:
    """(archive_id, entry_index, path, operation, destination): materialize, whiteout, opaque or reject and the reason.

    Paths of more than ``most_nesting`` components are rejected before anything else (``reject:Limit``), so the rounds
    below are bounded. Checks in order: reference to the outside, unsafe path, below a symlink accepted earlier, path claimed before, link
    target, kind. A path is claimed before its link and kind are checked. Whether a symlink is accepted depends only
    on symlinks nearer the root, so these are settled by depth (few rounds, over paths with symlinks alone); all the
    rest are joins on archive and path.
    """
    if "external" not in entries.columns:
        entries = entries.withColumn("external", F.lit(False))
    rows = _marked(entries.select("archive_id", "entry_index", "path", "kind", "link_target", "external"))
    rows = rows.where(~((F.col("kind") == "dir") & F.col("path").isin(".", "./")))
    rows = rows.withColumn("deep", nesting(F.col("path")) > most_nesting).withColumn("destination", F.when(~F.col("deep"), F.col("destination")))
    rows = materialise(rows.withColumn("depth", F.size(F.split("destination", "/"))), "layer")
    regular = rows.where("marker = 'regular' AND destination IS NOT NULL AND NOT external")
    link_ok = sanitise(F.col("link_target")).isNotNull()
    links = regular.where("false").select("archive_id", F.col("destination").alias("at"), F.col("entry_index").alias("since"))
    if policy.symlinks:
        spots = regular.where("kind = 'symlink'").select("archive_id", "destination").distinct()
        near = materialise(regular.join(spots, ["archive_id", "destination"], "left_semi"), "spots")
        for depth in [r[0] for r in near.select("depth").distinct().orderBy("depth").collect()]:  # at most the nesting budget
            level = near.where(F.col("depth") == depth)
            level = level.join(_escaping(level, links), ["archive_id", "entry_index"], "left_anti")
            won = _claims(level).where((F.col("kind") == "symlink") & (F.col("claimed") == F.col("entry_index")) & link_ok)
            links = materialise(links.union(won.select("archive_id", F.col("destination").alias("at"), F.col("entry_index").alias("since"))), "symlinks")
    below = materialise(_escaping(rows.where("destination IS NOT NULL AND marker <> 'unsafe' AND NOT external"), links).withColumn("escapes", F.lit(True)), "escapes")
    rows = rows.join(below, ["archive_id", "entry_index"], "left").withColumn("escapes", F.coalesce("escapes", F.lit(False)))
    claim = F.when((F.col("marker") == "regular") & F.col("destination").isNotNull() & ~F.col("external") & ~F.col("escapes"), F.col("entry_index"))
    first = rows.withColumn("claim", claim).where("claim IS NOT NULL").groupBy("archive_id", "destination").agg(F.min("claim").alias("claimed"))
    rows = rows.join(first, ["archive_id", "destination"], "left")
    kind = F.col("kind")
    rows = rows.withColumn(
        "operation",
        F.when(F.col("deep"), "reject:Limit")
        .when((F.col("marker") == "unsafe") | (F.col("marker") != "regular") & F.col("destination").isNull(), "reject:UnsafePath")
        .when((F.col("marker") != "regular") & F.col("escapes"), "reject:SymlinkEscape")
        .when(F.col("marker") != "regular", F.col("marker"))
        .when(F.col("external"), "reject:UnsupportedKind")
        .when(F.col("destination").isNull(), "reject:UnsafePath")
        .when(F.col("escapes"), "reject:SymlinkEscape")
        .when(F.col("claimed") < F.col("entry_index"), "reject:Duplicate")
        .when(kind == "symlink", F.when(F.lit(not policy.symlinks), "reject:UnsupportedKind").when(link_ok, "materialize").otherwise("reject:UnsafeLinkTarget"))
        .when(kind == "hardlink", F.when(F.lit(not policy.hardlinks), "reject:UnsupportedKind").otherwise("link"))
        .when(kind.isin("file", "dir") | kind.isin(*SPECIAL) & F.lit(policy.special_files), "materialize")
        .otherwise("reject:UnsupportedKind"),
    )
    rows = materialise(rows, "operations")
    settled = plan(rows.where("kind = 'file' AND operation = 'materialize' OR operation = 'link'").select("archive_id", "entry_index", "path", "kind", "link_target"), Policy(hardlinks=True))
    settled = settled.select("archive_id", "entry_index", "outcome")
    rows = rows.join(settled, ["archive_id", "entry_index"], "left")
    return rows.select("archive_id", "entry_index", "path", F.when(F.col("operation") == "link", F.col("outcome")).otherwise(F.col("operation")).alias("operation"), "destination")


def overlay(entries: DataFrame) -> DataFrame:
    """What a stack of layers shows: entries with image_id, layer, path (safe) that no later layer hides.

    A whiteout in a later layer hides its target and all below it, an opaque marker all below its directory, and an
    entry of a later layer the entry of the same path. Lower entries meet the markers by an equality join on their
    ancestors; of all markers on a path only the last layer's counts.
    """
    made = materialise(_marked(entries), "overlay").where("destination IS NOT NULL")
    marks = made.where("marker <> 'regular'").select("image_id", "layer", "marker", F.col("destination").alias("at"))
    hidden = marks.groupBy("image_id", "at").agg(F.max(F.when(F.col("marker") == "whiteout", F.col("layer"))).alias("white"), F.max(F.when(F.col("marker") == "opaque", F.col("layer"))).alias("opaque"))
    rows = made.where("marker = 'regular'").drop("marker")
    last = rows.groupBy("image_id", "destination").agg(F.max("layer").alias("layer"))
    rows = rows.join(last, ["image_id", "destination", "layer"], "left_semi")
    # What is about the root is told by image alone, so that not every entry looks for it.
    root = hidden.where("at = ''").select(F.col("image_id").alias("_image"), F.col("opaque").alias("_root"))
    rows = rows.join(root, F.col("image_id") == F.col("_image"), "left").where(~F.coalesce(F.col("_root") > F.col("layer"), F.lit(False))).drop("_image", "_root")
    up = rows.select("image_id", "layer", "entry_index", "destination", F.explode(ancestors(F.col("destination"))).alias("at"))
    gone = up.join(hidden.where("at <> ''"), ["image_id", "at"]).where((F.col("white") > F.col("layer")) | (F.col("opaque") > F.col("layer")) & (F.col("at") != F.col("destination")))
    return rows.join(gone.select("image_id", "layer", "entry_index").distinct(), ["image_id", "layer", "entry_index"], "left_anti")


def remap_owners(entries: DataFrame, uids: DataFrame, gids: DataFrame) -> DataFrame:
    """uid and gid looked up each for itself (columns from, to); what is not listed stays."""
    u = uids.select(F.col("from").alias("_u"), F.col("to").alias("_uid")).dropDuplicates(["_u"])
    g = gids.select(F.col("from").alias("_g"), F.col("to").alias("_gid")).dropDuplicates(["_g"])
    out = entries.join(u, F.col("uid") == F.col("_u"), "left").join(g, F.col("gid") == F.col("_g"), "left")
    return out.withColumn("new_uid", F.coalesce("_uid", "uid")).withColumn("new_gid", F.coalesce("_gid", "gid")).drop("_u", "_uid", "_g", "_gid")


def check_digests(layers: DataFrame) -> DataFrame:
    """First mismatch of expected and computed digests: compressed before decoded (columns expected_*, computed_*)."""
    wrong = F.when(F.col("expected_digest") != F.col("computed_digest"), "compressed").when(F.col("expected_diff_id") != F.col("computed_diff_id"), "diff-id")
    return layers.withColumn("mismatch", wrong)


def apply_counts(planned: DataFrame) -> DataFrame:
    """What applying a layer plan comes to for each archive: entries written, paths removed, directories cleared, entries rejected."""
    is_ = lambda op: F.count_if(F.col("operation") == op)
    rejected = F.count_if(F.startswith("operation", F.lit("reject:")))
    return planned.groupBy("archive_id").agg(is_("materialize").alias("materialized"), is_("whiteout").alias("removed"), is_("opaque").alias("cleared"), rejected.alias("rejected"))


def requested_operations(entries: DataFrame) -> DataFrame:
    """(archive_id, entry_index, operation): what restoring an entry and its metadata asks for.

    Columns that ``entries`` lacks ask for nothing: mode, uid, gid, user, group, atime, mtime, ctime, btime, sparse, xattrs
    (map), acl (array), flags. Each extended attribute and each ACL is an operation of its own (``xattr:`` and its name,
    ``acl:`` and its number).
    """
    has = set(entries.columns)

    def when(operation: str, *names: str) -> Column:
        known = [F.col(n).isNotNull() for n in names if n in has]
        return F.when(functools.reduce(lambda a, b: a | b, known), operation) if known else F.lit(None).cast("string")

    asked = F.array(
        F.lit("entry"), F.when(F.col("kind") == "file", "atomic_commit"), when("mode", "mode"), when("ownership", "uid", "gid", "user", "group"), when("access_time", "atime"),
        when("modification_time", "mtime"), when("change_time", "ctime"), when("creation_time", "btime"), F.when(F.size("sparse") > 0, "sparse") if "sparse" in has else F.lit(None).cast("string"),
    )
    if "xattrs" in has:
        names = F.transform(F.array_sort(F.map_keys("xattrs")), lambda k: F.concat(F.lit("xattr:"), k.cast("string")))
        asked = F.concat(asked, F.coalesce(names, F.array().cast("array<string>")))
    if "acl" in has:
        asked = F.concat(asked, F.coalesce(F.transform("acl", lambda x, i: F.concat(F.lit("acl:"), i.cast("string"))), F.array().cast("array<string>")))
    if "flags" in has:
        asked = F.concat(asked, F.array(F.when(F.col("flags") != 0, "file_flags")))
    return entries.select("archive_id", "entry_index", F.explode(F.array_compact(asked)).alias("operation"))


def unsupported_operations(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Requests that no capability (column operation: what stands before a colon) covers, as findings."""
    can = capabilities.select(F.col("operation").alias("_can"))
    return requests.join(can, F.substring_index("operation", ":", 1) == F.col("_can"), "left_anti").withColumn("finding", F.lit("unsupported"))


def with_missing_findings(requests: DataFrame, reported: DataFrame, finding: str = "partial") -> DataFrame:
    """(archive_id, entry_index, operation, finding): all that an adapter reported, and ``finding`` (``partial``, or ``refused``
    for entries that were not made) for each request it said nothing about."""
    keys = ["archive_id", "entry_index", "operation"]
    silent = requests.select(*keys).join(reported.select(*keys), keys, "left_anti")
    return reported.select(*keys, "finding").unionByName(silent.withColumn("finding", F.lit(finding)))

"""Extraction plans: what may be written, and why not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.paths import ancestors, nesting, sanitise
from stowage.operators.tables import materialise


@dataclass(frozen=True)
class Policy:
    """What extraction may do beyond files and directories; nothing by default."""

    symlinks: bool = False
    hardlinks: bool = False
    special_files: bool = False
    #: Only what :func:`destination_conflicts` looks at.
    overwrite: bool = False


SPECIAL = ("char", "block", "fifo", "socket")


def _stateless(policy: Policy) -> Column:
    """Outcome of an entry as far as it does not depend on others; null for hardlinks still to be settled."""
    kind, link = F.col("kind"), sanitise(F.col("link_target"))
    return (
        F.when(F.col("external"), "reject:ExternalReference")
        .when((kind == "dir") & F.col("path").isin(".", "./"), "skip")
        .when(F.col("safe").isNull(), "reject:UnsafePath")
        .when(kind.isin("file", "dir"), "materialize")
        .when(kind == "symlink", F.when(F.lit(not policy.symlinks), "reject:EntryKind").when(link.isNull(), "reject:UnsafeLinkTarget").otherwise("materialize"))
        .when(kind == "hardlink", F.when(F.lit(not policy.hardlinks), "reject:EntryKind").when(link.isNull(), "reject:UnsafeLinkTarget"))
        .when(kind.isin(*SPECIAL) & F.lit(policy.special_files), "materialize")
        .otherwise("reject:EntryKind")
    )


def plan(entries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(archive_id, entry_index, path, kind, outcome) for entries with path, kind, link_target, optionally external.

    outcome: ``materialize``, ``skip`` or ``reject:`` and the reason. A hardlink needs its target to have been
    committed earlier in its archive, by a file or by a hardlink that was itself accepted (see :func:`accepted_links`).
    All joins are keyed by archive and path or place, so one huge archive is spread over all tasks like many small ones.
    """
    if "external" not in entries.columns:
        entries = entries.withColumn("external", F.lit(False))
    rows = entries.select("archive_id", "entry_index", "path", "kind", "link_target", F.coalesce("external", F.lit(False)).alias("external"), sanitise(F.col("path")).alias("safe"))
    rows = rows.withColumn("outcome", _stateless(policy)).withColumn("target", F.when(F.col("kind") == "hardlink", sanitise(F.col("link_target"))))
    if not policy.hardlinks:
        return rows.select("archive_id", "entry_index", "path", "kind", "outcome")
    rows = materialise(rows, "plan")
    files = rows.where("kind = 'file' AND outcome = 'materialize'").groupBy("archive_id", "safe").agg(F.min("entry_index").alias("since"))
    won = accepted_links(files, rows.where("outcome IS NULL").select("archive_id", "entry_index", "safe", "target"))
    won = won.select(F.col("archive_id").alias("a"), F.col("entry_index").alias("i"), F.lit("materialize").alias("won"))
    rows = rows.join(won, (F.col("archive_id") == F.col("a")) & (F.col("entry_index") == F.col("i")), "left").withColumn("outcome", F.coalesce("outcome", "won"))
    return rows.select("archive_id", "entry_index", "path", "kind", F.coalesce("outcome", F.lit("reject:UnsafeLinkTarget")).alias("outcome"))


_LINK = ["archive_id", "entry_index", "safe", "target"]


def accepted_links(files: DataFrame, links: DataFrame) -> DataFrame:
    """The hardlinks (archive_id, entry_index, safe, target) whose target was committed before them.

    files: archive_id, safe and since, the first place of a file at a path. A link whose target is one file or one
    other link stands or falls with that, so chains of such links are followed by pointer doubling: as many rounds as
    the logarithm of the longest chain. Only where several links make the same path does it matter which of them
    is the first to be accepted; these take a round for each such path on the longest way, each with all the links
    that hang on them.
    """
    made = links.groupBy("archive_id", "safe").agg(F.count("*").alias("links"), F.min("entry_index").alias("first"))
    on_path = (F.col("archive_id") == F.col("a")) & (F.col("target") == F.col("t"))
    rows = links.join(files.select(F.col("archive_id").alias("a"), F.col("safe").alias("t"), "since"), on_path, "left").select(*_LINK, "since")
    rows = rows.join(made.select(F.col("archive_id").alias("a"), F.col("safe").alias("t"), "links", "first"), on_path, "left")
    state = F.when(F.col("since") < F.col("entry_index"), "accepted").when(F.coalesce(F.col("first") >= F.col("entry_index"), F.lit(True)), "rejected").when(F.col("links") == 1, "follows").otherwise("open")
    rows = materialise(rows.select(*_LINK, state.alias("state"), F.col("first").alias("to")), "links")
    # A link that follows points to a link before it; the end of its way is a link that does not follow.
    waiting = rows.where("state = 'follows'").select("archive_id", "entry_index", "to")
    ends = rows.where("state <> 'follows'").select(F.col("archive_id").alias("a"), F.col("entry_index").alias("i"))
    follows = waiting.where("false")
    while not waiting.isEmpty():
        at = (F.col("archive_id") == F.col("a")) & (F.col("to") == F.col("i"))
        there = materialise(waiting.join(ends.withColumn("end", F.lit(True)), at, "left").select("archive_id", "entry_index", "to", F.col("end").isNotNull().alias("end")), "pointers")
        known = follows.union(there.drop("end")).select(F.col("archive_id").alias("a"), F.col("entry_index").alias("i"), F.col("to").alias("next"))
        follows = follows.union(there.where("end").drop("end"))
        waiting = there.where("NOT end").join(known, at).select("archive_id", "entry_index", F.col("next").alias("to"))
    follows = follows.join(rows.select("archive_id", "entry_index", "safe"), ["archive_id", "entry_index"]).select("archive_id", "entry_index", "safe", F.col("to").alias("_to"))
    follows = materialise(follows, "follows")

    def with_followers(new: DataFrame) -> DataFrame:
        own = new.select(F.col("archive_id").alias("a"), F.col("entry_index").alias("i"))
        behind = follows.join(own, (F.col("archive_id") == F.col("a")) & (F.col("_to") == F.col("i")), "left_semi")
        return materialise(new.select("archive_id", "entry_index", "safe").union(behind.select("archive_id", "entry_index", "safe")), "accepted")

    new = with_followers(rows.where("state = 'accepted'"))
    accepted = new
    still = rows.where("state = 'open'").select(*_LINK)
    while not still.isEmpty():
        since = new.groupBy(F.col("archive_id").alias("a"), F.col("safe").alias("t")).agg(F.min("entry_index").alias("since"))
        found = materialise(still.join(since, on_path & (F.col("since") < F.col("entry_index")), "left").select(*_LINK, F.col("since").isNotNull().alias("ok")), "open")
        won, still = found.where("ok").select(*_LINK), found.where("NOT ok").select(*_LINK)
        if won.isEmpty():
            break
        new = with_followers(won)
        accepted = accepted.union(new)
    return accepted.select("archive_id", "entry_index")


def destination_conflicts(planned: DataFrame, existing: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A plan held against what is at its destination already (archive_id, path (safe), kind).

    What would be written at a path that is there, or below one that is there and was not made by this extraction,
    is rejected; with ``overwrite`` a file may take the place of a file. Rows as those of :func:`plan`.
    """
    rows = planned.withColumn("_safe", F.when(F.col("outcome") == "materialize", sanitise(F.col("path"))))
    there = existing.groupBy("archive_id", "path").agg(F.bool_and(F.col("kind") == "file").alias("plain")).select(F.col("archive_id").alias("_a"), F.col("path").alias("_p"), "plain")
    up = rows.where("_safe IS NOT NULL").select("archive_id", "entry_index", "kind", "_safe", F.explode(ancestors(F.col("_safe"))).alias("_at"))
    replaced = (F.col("_at") == F.col("_safe")) & (F.col("kind") == "file") & F.col("plain") & F.lit(policy.overwrite)
    met = up.join(there, (F.col("archive_id") == F.col("_a")) & (F.col("_at") == F.col("_p"))).where(~replaced)
    met = met.select(F.col("archive_id").alias("_a"), F.col("entry_index").alias("_i"), F.lit("reject:DestinationExists").alias("_met")).distinct()
    rows = rows.join(met, (F.col("archive_id") == F.col("_a")) & (F.col("entry_index") == F.col("_i")), "left")
    return rows.select("archive_id", "entry_index", "path", "kind", F.coalesce("_met", "outcome").alias("outcome"))


def directory_order(entries: DataFrame) -> DataFrame:
    """Directories with their depth and how many of their archive lie deeper: those get their metadata before them."""
    rows = entries.where("kind = 'dir'").select("archive_id", "entry_index", "path", sanitise(F.col("path")).alias("safe")).where("safe IS NOT NULL")
    rows = rows.withColumn("depth", nesting(F.col("safe"))).drop("safe")
    counts = rows.groupBy("archive_id", "depth").agg(F.count("*").alias("n"))
    deeper = F.coalesce(F.sum("n").over(Window.partitionBy("archive_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select("archive_id", "depth", deeper.alias("deeper")), ["archive_id", "depth"]).select("archive_id", "entry_index", "path", "depth", "deeper")


def hardlink_one_step(entries: DataFrame) -> DataFrame:
    """Hardlinks and whether a *file* at their target came earlier: narrower than :func:`plan`, and one join."""
    rows = entries.select("archive_id", "entry_index", "kind", sanitise(F.col("path")).alias("safe"), sanitise(F.col("link_target")).alias("target"))
    first = rows.where("kind = 'file' AND safe IS NOT NULL").groupBy(F.col("archive_id").alias("a"), F.col("safe").alias("t")).agg(F.min("entry_index").alias("since"))
    links = rows.where("kind = 'hardlink'")
    joined = links.join(first, (F.col("archive_id") == F.col("a")) & (F.col("target") == F.col("t")), "left")
    return joined.select("archive_id", "entry_index", "target", F.coalesce(F.col("since") < F.col("entry_index"), F.lit(False)).alias("accepted"))


def has_rejections(plan: DataFrame) -> DataFrame:
    return plan.groupBy("archive_id").agg(F.bool_or(F.startswith("outcome", F.lit("reject:"))).alias("has_rejections"))


def cpio_link_targets(entries: DataFrame) -> DataFrame:
    """Hardlink groups of cpio: entries of one device and inode with more than one link.

    The first member with a payload is the target of all others; without one it is the first member. Members are
    never gathered: two minima for each group, joined back.
    """
    rows = entries.where("nlink > 1 AND kind = 'file'")
    by = ["archive_id", "dev_major", "dev_minor", "ino"]
    targets = rows.groupBy(*by).agg(
        F.min(F.when(F.col("size") > 0, F.struct("entry_index", "path"))).alias("full"), F.min(F.struct("entry_index", "path")).alias("any"), F.count("*").alias("members")
    )
    targets = targets.select(*by, F.coalesce("full", "any").alias("target"), "members")
    joined = rows.join(targets, by)
    return joined.select("archive_id", "entry_index", "path", F.when(F.col("target.entry_index") != F.col("entry_index"), F.col("target.path")).alias("link_target"), "members")


def cpio_group_errors(entries: DataFrame) -> DataFrame:
    """Hardlink groups of cpio that are malformed, with what is wrong first: link counts that differ, more records than links, several payloads."""
    rows = entries.where("nlink > 1 AND kind = 'file'")
    groups = rows.groupBy("archive_id", "dev_major", "dev_minor", "ino").agg(
        F.min("nlink").alias("least"), F.max("nlink").alias("most"), F.count("*").alias("members"), F.count_if(F.col("size") > 0).alias("payloads")
    )
    wrong = F.when(F.col("least") != F.col("most"), "link-counts-differ")
    wrong = wrong.when(F.col("members") > F.col("most"), "too-many-records").when(F.col("payloads") > 1, "several-payloads")
    return groups.select("archive_id", "dev_major", "dev_minor", "ino", wrong.alias("error"), "members").where("error IS NOT NULL")


def plan_report(plan: DataFrame) -> DataFrame:
    """One JSON report for each archive: counts by outcome, for reading only (a plan is worked out anew when applied)."""
    counts = plan.groupBy("archive_id", "outcome").agg(F.count("*").alias("n"))
    by_outcome = counts.groupBy("archive_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    return by_outcome.select("archive_id", F.to_json(F.struct(F.lit("plan").alias("type"), F.lit(False).alias("reusable"), "outcomes")).alias("report"))

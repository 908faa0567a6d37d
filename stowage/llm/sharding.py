"""Sharding by a minimax contiguous partition.

Documents with equal texts form an atomic group. Groups are put in the order of their digests, and the ordered list
is cut into shards so that the largest shard is as small as can be. The smallest feasible capacity is found by
binary search with a greedy check. The check runs on the driver over a summary of bounded size: some of the group
ends (running sums of the sizes), first one for each bucket of digests. Where a cut falls between two known ends, a
job fetches finer ends of just that stretch, until the answer is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.operators.tables import materialise

#: Buckets of digests whose totals are summed up in one task, and finer ends fetched at once for each cut.
BUCKETS, FINER = 4096, 256
#: Parts of a shard within which rows are numbered, and repeats of a row numbered at a time.
PARTS, REPEATS = 1024, 4_096


def _walk(ends: list[int], capacity: int, shards: int, bold: bool) -> list[int]:
    """Greedy cuts: each shard takes all it can. ``bold`` takes every number to be a group end."""
    cuts, at = [], 0
    for _ in range(shards):
        if at >= ends[-1]:
            break
        at = min(at + capacity, ends[-1]) if bold else ends[max(0, bisect_right(ends, at + capacity) - 1)]
        cuts.append(at)
    return cuts


def _optimistic(ends: list[int], gaps: set[int], capacity: int, shards: int) -> list[int]:
    """Cuts no real walk can get beyond: a target inside an unexplored gap is reached, else the end before it."""
    cuts, at = [], 0
    for _ in range(shards):
        if at >= ends[-1]:
            break
        i = bisect_right(ends, at + capacity) - 1
        at = min(at + capacity, ends[-1]) if i + 1 < len(ends) and ends[i] in gaps else ends[max(0, i)]
        cuts.append(at)
    return cuts


def _balanced(ends: list[int], gaps: set[int], capacity: int, shards: int, finer: Callable) -> list[int]:
    """Cuts that keep to the capacity and lie as near to equal parts as they can."""
    total = ends[-1]
    ideal = [total * k // shards for k in range(1, shards)]
    asked = sorted({(ends[i - 1], ends[i]) for x in ideal if 0 < (i := bisect_right(ends, x)) < len(ends) and ends[i - 1] in gaps})
    if asked:
        ends = sorted({*ends, *(e for found, _ in finer(asked) for e in found)})
    back = [total]
    while len(back) < shards:
        back.append(ends[bisect_left(ends, max(0, back[-1] - capacity))])
    cuts, at = [], 0
    for x, least in zip(ideal, back[::-1], strict=False):
        most = bisect_right(ends, at + capacity) - 1
        first = bisect_left(ends, max(least, at))
        i = min(max(bisect_left(ends, x), first), most)
        if i > first and x - ends[i - 1] < ends[i] - x:
            i -= 1
        at = ends[i]
        cuts.append(at)
    return [*cuts, total]


def least_capacity(ends: list[int], closed: bool, shards: int, largest: int, finer: Callable[[list[tuple[int, int]]], list[tuple[list[int], bool]]]) -> tuple[int, list[int]]:
    """Smallest capacity with which the greedy walk needs at most ``shards`` shards, and cuts that keep to it.

    ends: known group ends in order, from 0 to the total. closed: there are no others. finer: gets gaps (two
    neighbouring known ends), returns for each some of the ends within, and whether these are all.
    """
    total = ends[-1]
    gaps = set() if closed else set(ends[:-1])
    low, high = max(largest, -(-total // shards)) - 1, total
    while True:

        def least(walk: Callable[[int], list[int]], a: int, b: int) -> int:
            while b - a > 1:
                mid = (a + b) // 2
                cuts = walk(mid)
                a, b = (a, mid) if cuts and cuts[-1] >= total else (mid, b)
            return b

        high = least(lambda c: _walk(ends, c, shards, False), low, high)
        low = least(lambda c: _optimistic(ends, gaps, c, shards), low, high) - 1
        open_gaps = set()
        # For each shard the real cut lies between the cautious cut at the least and the hopeful cut at the most capacity.
        for a, b in zip(_walk(ends, low + 1, shards, False), _optimistic(ends, gaps, high, shards), strict=False):
            i, j = bisect_right(ends, a) - 1, bisect_right(ends, b)
            open_gaps |= {(ends[k], ends[k + 1]) for k in range(max(0, i - 1), min(j + 1, len(ends) - 1)) if ends[k] in gaps}
        if low + 1 == high or not open_gaps:
            return high, _balanced(ends, gaps, high, shards, finer)
        asked = sorted(open_gaps, key=lambda g: g[0] - g[1])[: 4 * shards]
        for (a, b), (found, whole) in zip(asked, finer(asked), strict=True):
            ends = sorted({*ends, *found})
            gaps.discard(a)
            if not whole:
                gaps |= set(ends[bisect_right(ends, a) - 1 : bisect_right(ends, b) - 1])


def _finer(groups: DataFrame) -> Callable[[list[tuple[int, int]]], list[tuple[list[int], bool]]]:
    def fetch(gaps: list[tuple[int, int]]) -> list[tuple[list[int], bool]]:
        # As text: an expression of that many parts takes longer to build than to run.
        inside = [f"(`end` > {a} AND `end` < {b})" for a, b in gaps]
        gap = F.expr("CASE " + " ".join(f"WHEN {x} THEN {i}" for i, x in enumerate(inside)) + " END")
        cell = F.expr("CASE " + " ".join(f"WHEN {x} THEN (`end` - {a}) DIV {max(1, (b - a) // FINER)}" for x, (a, b) in zip(inside, gaps, strict=True)) + " END")
        near = groups.where(" OR ".join(inside)).groupBy(gap.alias("gap"), cell.alias("cell"))
        rows = near.agg(F.max("end").alias("e"), F.count(F.lit(1)).alias("n")).collect()
        return [(sorted(r.e for r in rows if r.gap == i), all(r.n == 1 for r in rows if r.gap == i)) for i in range(len(gaps))]

    return fetch


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text (null: none) plus 8. Rows with equal texts share a shard (null and empty count
    as equal). slot numbers the rows of a shard from 0 without gaps, repeated rows each for itself. Both depend on the
    rows alone, not on how they are stored. With fewer groups than shards some shards stay empty; ties between cuts go
    to the earlier one. Other columns play no part; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    # Rows equal in all of these are one row with a count until the end, so that none is too many for a task.
    rows = rows.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialise(rows, "sizes")
    # The first bits of the digest, so that buckets are in the order of the digests.
    bucket = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"), 16 - BUCKETS.bit_length() + 1)
    sums = rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")).withColumn("bucket", bucket)
    sums = materialise(sums, "groups")
    totals = sums.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")).orderBy("bucket").collect()
    if not totals:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    starts, ends = [], [0]
    for t in totals:
        starts.append((t.bucket, ends[-1]))
        ends.append(ends[-1] + t.bytes)
    # At most BUCKETS rows, whatever the input.
    base = F.broadcast(docs.sparkSession.createDataFrame(starts, "bucket int, base long"))
    within = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    # Dealt by ranges of buckets, the ends lie in order in each file, so that a stretch of them is few row groups.
    groups = sums.repartitionByRange("bucket").join(base, "bucket").select("digest", (F.col("base") + F.sum("bytes").over(within)).alias("end"))
    groups = materialise(groups, "ends")
    capacity, cuts = least_capacity(ends, False, shards, max(t.largest for t in totals), _finer(groups))
    number = F.expr(" + ".join(["0", *(f"IF(`end` > {c}, 1, 0)" for c in cuts)]))
    placed = groups.select(F.col("digest").alias("_d"), number.cast("int").alias("shard"))
    part = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(PARTS)).cast("int").alias("part")
    dealt = rows.join(placed, rows.digest == placed._d).select("doc_id", "size", "text_crc32", "digest", "copies", "shard", part)
    dealt = materialise(dealt, "dealt")
    # shards x PARTS rows at most.
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "part").agg(F.sum("copies").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    upto = F.sum("copies").over(Window.partitionBy("shard", "part").orderBy("doc_id", "digest").rowsBetween(Window.unboundedPreceding, 0))
    numbered = dealt.withColumn("upto", upto).join(F.broadcast(offsets), ["shard", "part"]).withColumn("end", F.col("offset") + F.col("upto"))
    some = F.sequence(F.col("end") - F.col("copies"), F.col("end") - 1, F.lit(REPEATS).cast("long"))
    numbered = numbered.select("doc_id", "size", "text_crc32", "shard", "end", F.explode(some).alias("least"))
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.col("least"), F.least(F.col("least") + REPEATS, "end") - 1)).alias("slot"))

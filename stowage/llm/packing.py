"""Best-fit packing with conflicts.

Rows are dealt into packing groups of bounded size by a hash of what they hold. Within a group pieces are
placed longest first. Open bins are ordered by what room they have left and carry bitmaps of their sources and
duplicate clusters; two pieces of one source or one cluster never share a bin. The search starts at the tightest
room that fits and goes on to the next until a bin without a conflict is found; a tree over the rooms holds what
all bins below a node have in common, so that stretches without a compatible bin are passed over.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import WHITE, bound_batches
from stowage.operators.tables import materialise

#: Words of a bin, one for the end of each piece included.
CAPACITY = 2048
#: Rows of a packing group, about.
GROUP_ROWS = 20_000
#: Repeats of a row that are numbered at a time.
REPEATS = 4_096
#: Clusters with more rows than this in a group take part in the tree.
LARGE_CLUSTER = 32

_WORD = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins by room left. A mask has a bit for each source and each large cluster, a second one for small clusters."""

    def __init__(self, capacity: int) -> None:
        self.width = 1
        while self.width <= capacity:
            self.width *= 2
        self.capacity = capacity
        #: -1, all bits, where no bin is: nothing is compatible with it.
        self.common = [-1] * (2 * self.width)
        self.rooms: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(capacity + 1)]
        self.made = 0

    def _update(self, room: int) -> None:
        both = -1
        for mask in self.rooms[room]:
            both &= mask
            if not both:
                break
        i = room + self.width
        self.common[i] = both
        i //= 2
        while i:
            new = self.common[2 * i] & self.common[2 * i + 1]
            if self.common[i] == new:
                break
            self.common[i] = new
            i //= 2

    def _next(self, room: int, need: int) -> int:
        """The least room from ``room`` on that may hold a compatible bin, or -1."""
        if room > self.capacity:
            return -1
        common, i = self.common, room + self.width
        while True:
            if not common[i] & need:
                if i >= self.width:
                    return i - self.width
                i *= 2  # look into this node, its left half first
                continue
            while i & 1:  # a right half: what follows is beside its parent
                i //= 2
            if not i:
                return -1
            i += 1

    def place(self, size: int, need: int, small: int) -> tuple[int, int]:
        """Number of the bin and its room before; opens one if no open bin is compatible."""
        room = self._next(size, need)
        while room >= 0:
            for mask, bins in self.rooms[room].items():
                if mask & need:
                    continue
                for k, (number, clusters) in enumerate(bins):
                    if not clusters & small:
                        bins[k] = bins[-1]
                        bins.pop()
                        if not bins:
                            del self.rooms[room][mask]
                            self._update(room)
                        self._put(room - size, mask | need, number, clusters | small)
                        return number, room
            room = self._next(room + 1, need)
        number = self.made
        self.made += 1
        self._put(self.capacity - size, need, number, small)
        return number, self.capacity

    def _put(self, room: int, mask: int, number: int, clusters: int) -> None:
        if not room:
            return  # full
        if mask in self.rooms[room]:
            self.rooms[room][mask].append((number, clusters))
        else:
            self.rooms[room][mask] = [(number, clusters)]
            self._update(room)


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Place the rows of one group (doc_id, source, cluster, n_words, and order, nth that tell ties apart)."""
    rows = rows.sort_values(["n_words", "order", "nth"], ascending=[False, True, True], kind="stable")
    copies = Counter(rows["cluster"])
    bits: dict[object, int] = {}
    small_bits: dict[object, int] = {}
    pieces = []
    body = capacity - 1
    for i, (n, source, cluster) in enumerate(zip(rows["n_words"].tolist(), rows["source"].tolist(), rows["cluster"].tolist(), strict=True)):
        need = 1 << bits.setdefault(("source", source), len(bits))
        small = 0
        if copies[cluster] > LARGE_CLUSTER:
            need |= 1 << bits.setdefault(("cluster", cluster), len(bits))
        elif copies[cluster] > 1:
            small = 1 << small_bits.setdefault(cluster, len(small_bits))
        for k in range(max(1, -(-n // body))):
            pieces.append((min(body, n - k * body) + 1, i, k, need, small))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    bins = Bins(capacity)
    out = []
    for size, i, k, need, small in pieces:
        number, room = bins.place(size, need, small)
        out.append((i, k, k * body, size - 1, number, capacity - room))
    at = pd.DataFrame(out, columns=["i", "piece", "first_word", "n_words", "bin", "bin_offset"])
    ids = rows["doc_id"].reset_index(drop=True)
    at["doc_id"] = at["i"].map(ids) if len(ids) else None
    return at


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    n_words: Column | None = None,
    cluster: Column | None = None,
    clusters: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, bin_id, bin_offset.

    A row longer than ``capacity`` - 1 words is cut into pieces of that many; each piece costs a word more, for its
    end. bin_offset is where in its bin a piece starts. Rows without words (null, empty, blank) give one piece of no
    words. Null sources count as one source. ``n_words``: the length of a row, words of the text by default.

    A row's duplicate cluster is by default a hash of the text with white space made even, so that equal texts are one
    cluster; or an expression ``cluster``; or what ``clusters`` says (doc_id, cluster), as it comes from a
    deduplication: ``near_duplicates(docs).select("doc_id", F.col("component_id").alias("cluster"))``. There rows of one
    doc_id have one cluster, and those without one count as their own.

    Bins depend on the rows alone (id, source, cluster, length), not on where these are stored or in which order.
    Rows equal in all of these are told apart by a number, so repeated rows are packed each for itself. Other columns
    play no part. An empty table gives an empty result.
    """
    if capacity < 2:
        raise ValueError("capacity must be at least 2")
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        (F.xxhash64(F.regexp_replace(text, WHITE, " ")) if cluster is None else cluster).cast("string").alias("cluster"),
        (F.regexp_count(text, F.lit(_WORD)) if n_words is None else n_words).cast("long").alias("n_words"),
    )
    if clusters is not None:
        own = clusters.groupBy(F.col("doc_id").alias("_id")).agg(F.min("cluster").cast("string").alias("_c"))
        rows = rows.join(own, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "source", F.coalesce("_c", F.concat(F.lit("="), "cluster")).alias("cluster"), "n_words")
    rows = rows.withColumn("order", F.xxhash64("doc_id", "source", "cluster", "n_words"))
    # A row that is there many times arrives here as few rows, and is numbered some thousand at a time.
    counted = materialise(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "lengths")
    total = counted.agg(F.sum("copies")).first()[0] or 0
    groups = max(1, -(-total // group_rows))
    block = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("copies") - 1).cast("long"), F.lit(REPEATS).cast("long"))).alias("least")
    numbered = counted.select(*rows.columns, "copies", block)
    numbered = numbered.select(*rows.columns, F.explode(F.sequence(F.col("least"), F.least(F.col("least") + REPEATS, "copies") - 1)).alias("nth"))
    dealt = numbered.withColumn("part", F.pmod(F.xxhash64("order", "nth"), F.lit(groups)).cast("int"))
    kind = dict(rows.dtypes)["doc_id"]

    def one(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        at = pack_group(batch, capacity)
        at["bin_id"] = (int(key[0]) << 32) + at["bin"].astype("int64")
        return at[["doc_id", "piece", "first_word", "n_words", "bin_id", "bin_offset"]]

    return dealt.groupBy("part").applyInPandas(one, f"doc_id {kind}, piece int, first_word long, n_words int, bin_id long, bin_offset int")

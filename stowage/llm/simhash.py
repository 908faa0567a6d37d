"""Near duplicates by SimHash, with meet-in-the-middle ball hashing.

Fingerprints at 3 or fewer differing bits are linked. Half of that radius is one flipped bit. Two passes, both of
which shuffle on variants and none of which lists the pairs of a bucket:

1. Every distinct fingerprint emits itself and its 64 one-bit variants. Two that share a variant differ in at
   most 2 bits, so all of a bucket is linked to its least member. This finds every link of 1 or 2 bits.
2. For links of exactly 3 bits one of three blocks of bits is blanked and the variants of the rest are emitted.
   A block with exactly one differing bit leaves 2, which variants of one flip bring together. Only buckets that
   hold more than one class so far are looked at again; there a further key with one bit of the blanked block
   left out makes sure that the block differs in at most that bit. The case left, 3 bits in one block and none
   outside, is settled among rows with equal bits outside: variants of up to two flips meet those of one flip.

Each link that comes out is a real pair and is checked by counting its differing bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import bound_batches, with_locator, without_rows
from stowage.llm.components import components
from stowage.operators.tables import materialise, temporary

RADIUS = 3
SEED = 42
#: First and last bit (exclusive) of the blocks of which one is blanked.
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: A long text is worked through in pieces of about so many bytes.
PIECE = 1 << 20

_WHITE_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            found = _WHITE_BYTE.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the hashes of its word shingles."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, n, tail = np.zeros(64, dtype=np.int64), 0, []
    words: list[bytes] = []
    for piece in _pieces(data):
        words = tail + piece
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(bits)
        tail = words[max(0, len(words) - width + 1) :]
    if not n:
        if not tail:
            return 0
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(tail), SEED), "big")
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint_column(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([_signed(fingerprint(t, width)) for t in s], dtype="int64")

    return of(text)


def _star(rows: DataFrame, key: list[str]) -> DataFrame:
    """Link each row's class to the least class that shares its key: (fp, c, hub_fp, hub)."""
    least = F.min(F.struct("c", "fp")).over(Window.partitionBy(*key))
    return rows.select("fp", "c", least.alias("h")).select("fp", "c", F.col("h.fp").alias("hub_fp"), F.col("h.c").alias("hub")).where("c <> hub")


def _links(stars: DataFrame) -> DataFrame:
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) <= RADIUS
    return stars.where(near).select(F.col("c").alias("u"), F.col("hub").alias("v")).distinct()


def _near_links(distinct: DataFrame) -> DataFrame:
    """Links of at most 2 bits between distinct fingerprints.

    A variant travels with the number of its flipped bit alone (0: none), from which the fingerprint follows.
    """
    balls = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    balls = balls.select(F.col("fp").bitwiseXOR(_bit(F.col("i"))).alias("key"), F.col("i").cast("byte").alias("i"))
    rows = balls.repartition("key").select("key", F.col("key").bitwiseXOR(_bit(F.col("i"))).alias("fp"))
    return _links(_star(rows.select("key", "fp", F.col("fp").alias("c")), ["key"]))


def _bit(i: Column) -> Column:
    """The number with bit i - 1 alone; 0 for 0."""
    return F.when(i > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int") - 1)).otherwise(F.lit(0).cast("long"))


def _by_block(values: list[int], kind: str = "long") -> Column:
    """One of three numbers, by the number k of a block."""
    return F.element_at(F.array(*(F.lit(_signed(v)).cast(kind) for v in values)), F.col("k").cast("int") + 1)


def _far_links(classes: DataFrame) -> DataFrame:
    """Links of 3 bits between fingerprints of different classes; ``classes`` is (fp, c).

    A variant travels with one int: the blanked bits, which block that is (from bit 22), the flipped bit (from 24).
    """
    all_bits = (1 << 64) - 1
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in BLOCKS]
    low, high, block, keep = _by_block([lo for lo, _ in BLOCKS], "int"), _by_block([hi for _, hi in BLOCKS], "int"), _by_block(masks), _by_block([all_bits ^ m for m in masks])
    codes = F.array(*(F.lit(k << 22 | i << 24) for k, (lo, hi) in enumerate(BLOCKS) for i in [0, *(i + 1 for i in range(64) if not lo <= i < hi)]))
    number, flipped = F.shiftright("code", 22).bitwiseAND(F.lit(3)), F.shiftright("code", 24)
    balls = classes.select("fp", F.explode(codes).alias("code")).select("fp", "code", number.alias("k"))
    blanked = F.call_function("shiftrightunsigned", F.col("fp").bitwiseAND(block), low).cast("int")
    balls = balls.select(F.col("fp").bitwiseAND(keep).bitwiseXOR(_bit(flipped)).alias("key"), F.col("code").bitwiseOR(blanked).alias("code")).repartition("key")
    rows = balls.select("key", flipped.alias("i"), number.alias("k"), F.col("code").bitwiseAND(F.lit((1 << 22) - 1)).cast("long").alias("low"))
    fp = F.col("key").bitwiseXOR(_bit(F.col("i"))).bitwiseOR(F.expr("shiftleft(low, 21 * k)"))
    rows = rows.select("key", F.col("k").cast("byte").alias("k"), (F.col("i") == 0).alias("own"), fp.alias("fp"))
    # A key and a block leave 21 or 22 bits open, so a bucket has at most some 4 million rows of 20 bytes.
    bucket = Window.partitionBy("key", "k")
    several = rows.select("*", F.min("fp").over(bucket).alias("lo"), F.max("fp").over(bucket).alias("hi")).where("lo <> hi").drop("lo", "hi")
    several = materialise(several, "several")
    if several.isEmpty():
        return several.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    several = several.join(classes, "fp")
    mixed = several.select("*", F.min("c").over(bucket).alias("lo"), F.max("c").over(bucket).alias("hi")).where("lo <> hi").drop("lo", "hi")
    mixed = materialise(mixed, "mixed")
    if mixed.isEmpty():
        return mixed.select(F.col("c").alias("u"), F.col("c").alias("v"))
    # One bit of the block left out: j.
    one = mixed.select("fp", "c", "k", "key", F.explode(F.sequence(low, high - 1)).alias("j"))
    one = one.withColumn("left", block.bitwiseXOR(_bit(F.col("j") + 1)))
    links = _links(_star(one.withColumn("rest", F.col("fp").bitwiseAND(F.col("left"))), ["k", "key", "left", "rest"]))
    # Rows equal outside the block: each emits its variants of up to two flips j and i within it (none: from high on). All
    # of a bucket is at most 3 bits from its least row of at most one flip. Only where rows of several classes meet.
    same = mixed.where("own").select("*", F.min("c").over(bucket).alias("lo"), F.max("c").over(bucket).alias("hi")).where("lo <> hi")
    balls = same.select("fp", "c", "k", F.explode(F.sequence(low, high)).alias("j"))
    balls = balls.select("fp", "c", "k", "j", F.explode(F.sequence(F.col("j") + 1, F.when(F.col("j") < high, high).otherwise(high + 1))).alias("i"))
    flips = [F.when(F.col(x) < high, _bit(F.col(x) + 1)).otherwise(F.lit(0).cast("long")) for x in "ji"]
    points = balls.select("fp", "c", "k", F.col("fp").bitwiseXOR(flips[0]).bitwiseXOR(flips[1]).alias("point"), F.when(F.col("i") >= high, F.struct("c", "fp")).alias("near"))
    least = points.select("fp", "c", F.min("near").over(Window.partitionBy("k", "point")).alias("h")).where("h IS NOT NULL AND c <> h.c")
    return links.union(_links(least.select("fp", "c", F.col("h.fp").alias("hub_fp"), F.col("h.c").alias("hub"))))


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """(fp, root) for distinct fingerprints (column fp, long): the least fingerprint that links lead to."""
    first = components(_near_links(distinct))
    joined = distinct.join(first, distinct.fp == first.node, "left").select("fp", F.coalesce("root", "fp").alias("c"))
    classes = materialise(joined, "classes")
    second = components(_far_links(classes))
    return classes.join(second, classes.c == second.node, "left").select("fp", F.coalesce("root", "c").alias("root"))


def _classify(src: DataFrame, width: int) -> DataFrame:
    bound_batches(src.sparkSession)
    prints = src.select("doc_id", _fingerprint_column(F.col("text"), width).alias("fp"), "__file", "__row")
    prints = materialise(prints, "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row")).alias("first")
    with temporary(src.sparkSession) as keep:
        distinct = materialise(prints.groupBy("fp").agg(first), "distinct")
        roots = link_fingerprints(distinct.select("fp"))
        classes = distinct.join(roots, "fp")
        best = classes.groupBy("root").agg(F.min("first").alias("best"))
        by_print = keep(materialise(classes.join(best, "root").select(F.col("fp").alias("_fp"), "best"), "by_print"))
    out = prints.join(by_print, prints.fp == by_print._fp)
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"),
        ((F.col("best.__file") == F.col("__file")) & (F.col("best.__row") == F.col("__row"))).alias("representative"),
        "__file",
        "__row",
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, representative.

    Words are runs of anything but ASCII white space after lower-casing A-Z; shingles are ``width`` words. A text
    with fewer words is one shingle; null, empty and blank texts have the fingerprint zero, which links like any
    other. component_id is the least id of the component (null ids count last). Of the rows of a component
    exactly one has representative true: that with the least id, and among repeats of it the first stored.
    Other columns of ``docs`` play no part. An empty table gives an empty result.
    """
    located = with_locator(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return _classify(located.select("doc.doc_id", "doc.text", "__file", "__row"), width).drop("__file", "__row")


def drop_near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component left (see :func:`near_duplicates`), all columns as they were, whatever their names.

    Null and empty texts are one component; of repeated rows one stays; no rows give no rows.
    """
    located = with_locator(docs)
    found = _classify(located.select("doc.doc_id", "doc.text", "__file", "__row"), width)
    return without_rows(located, found.where("NOT representative").select("__file", "__row"))

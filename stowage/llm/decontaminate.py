"""Benchmark decontamination: windows of benchmark words, looked up in a broadcast hash set.

Texts are scanned as arrays of bytes: words, the hashes of words and of windows come from running sums, a bitmap and
a sorted set of hashes pick candidates, and each candidate's bytes are compared with the window before it counts.

A benchmark beyond SMALL_WORDS words stays a table of windows, made and kept by Spark. Only the set of its hashes is
broadcast then, as a bitmap of bounded size; what it picks in the one scan of the texts is joined with the windows by
hash and bytes. Results are the same.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import bound_batches, mix, power_table, with_locator, without_rows
from stowage.operators.tables import materialise

WIDTH = 13
#: Words of benchmark text up to which the windows themselves are broadcast.
SMALL_WORDS = 400_000
#: The bitmap of a larger benchmark has 2 to these powers bits: at least, and at most (128 MB), 16 to 32 for each window
#: in between. With more than 60 million windows it lets more than 1 in 18 windows of the texts through to the join.
LEAST_BITS, MOST_BITS = 20, 30
#: Bytes of text worked on at once.
CHUNK = 1 << 18

_P, _Q = 0x100000001B3, 0x9E3779B97F4A7C15
_P_INV, _Q_INV = pow(_P, -1, 1 << 64), pow(_Q, -1, 1 << 64)
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Letters, digits and everything beyond ASCII make words (of text already lower-cased).
_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: A byte between words.
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_BITS = 20


@functools.lru_cache(maxsize=4)
def _powers(which: int, n: int) -> np.ndarray:
    return power_table((_P, _P_INV, _Q, _Q_INV)[which], n)


def _upto(which: int, n: int) -> np.ndarray:
    return _powers(which, 1 << max(16, n.bit_length()))[:n]


class Scan:
    """The words of some texts: where they start and end, their hashes, and which text they are in.

    Bytes are worked through in blocks that end between words, so that a very long text takes memory for its words only.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.joined = b"\0".join([*texts, b""])
        starts, ends, hashes = [], [], []
        at, n = 0, len(self.joined)
        while at < n:
            stop = at + CHUNK
            if stop < n:
                found = _GAP.search(self.joined, stop)
                stop = found.start() if found else n
            else:
                stop = n
            low = _LOWER[np.frombuffer(self.joined, dtype=np.uint8, count=stop - at, offset=at)]
            step = np.diff(np.concatenate(([0], _WORD[low].view(np.int8), [0])))
            start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            sums = np.zeros(len(low) + 1, dtype=np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _upto(0, len(low)), out=sums[1:])
            hashes.append(mix((sums[end] - sums[start]) * _upto(1, len(low) + 1)[start]))
            starts.append(start + at)
            ends.append(end + at)
            at = stop
        self.start, self.end, self.hash = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, ends, hashes))
        self.at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        self.first = np.searchsorted(self.start, self.at)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.raw: bytes | None = None

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``width`` words within a text."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * _upto(2, n), out=sums[1:])
        hashes = mix((sums[width:] - sums[: n - width + 1]) * _upto(3, n)[: n - width + 1])
        own = np.flatnonzero(self.text[: n - width + 1] == self.text[width - 1 :])
        return own, hashes[own]

    def words(self, first: int, width: int) -> bytes:
        if self.raw is None:
            self.raw = self.joined.lower()  # A-Z alone
        return b" ".join(self.raw[a:b] for a, b in zip(self.start[first : first + width], self.end[first : first + width], strict=True))


def benchmark_block(items: list[tuple[str, str | None]]) -> dict[int, tuple[np.ndarray, dict[bytes, set[str]]]]:
    """By width of the window: sorted hashes, and the items of each window."""
    found: dict[int, dict[bytes, set[str]]] = {}
    hashes: dict[int, list[np.ndarray]] = {}
    for item, text in items:
        scan = Scan([(text or "").encode("utf-8", "surrogatepass")])
        width = min(WIDTH, len(scan.hash))
        if width:
            firsts, h = scan.windows(width)
            hashes.setdefault(width, []).append(h)
            for i in firsts.tolist():
                found.setdefault(width, {}).setdefault(scan.words(i, width), set()).add(item)
    return {w: (np.unique(np.concatenate(hashes[w])), found[w]) for w in found}


def _bitmaps(block: dict) -> dict[int, np.ndarray]:
    out = {}
    for w, (hashes, _) in block.items():
        out[w] = np.zeros(1 << _BITS, dtype=bool)
        out[w][hashes >> np.uint64(64 - _BITS)] = True
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_texts(texts: list[str | None], block: dict, bitmaps: dict[int, np.ndarray]) -> Iterator[tuple[int, list[int], list[int], list[str]]]:
    """For each text: number of words; word spans and byte spans that are hit (flat lists of from, to); items."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    i = 0
    while i < len(data):
        j, n = i, 0
        while j < len(data) and (j == i or n + len(data[j]) <= CHUNK):
            n += len(data[j]) + 1
            j += 1
        scan = Scan(data[i:j])
        hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for width, (hashes, items) in block.items():
            firsts, h = scan.windows(width)
            near = np.flatnonzero(bitmaps[width][h >> np.uint64(64 - _BITS)])
            if len(near):
                near = near[np.isin(h[near], hashes)]
            for first in firsts[near].tolist():
                if whose := items.get(scan.words(first, width)):
                    spans, names = hits.setdefault(int(scan.text[first]), ([], set()))
                    spans.append((first, first + width))
                    names |= whose
        for k in range(j - i):
            spans, names = hits.get(k, ([], set()))
            merged = _merge(spans)
            base, at = int(scan.first[k]), int(scan.at[k])
            words = [x - base for s in merged for x in s]
            places = [int(x) - at for a, b in merged for x in (scan.start[a], scan.end[b - 1])]
            yield int(scan.first[k + 1]) - base, words, places, sorted(names)
        i = j


_HITS = "n_words long, spans array<int>, places array<int>, items array<string>"


def _hits(df: DataFrame, block: dict, text: Column) -> Column:
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf(_HITS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bitmaps = _bitmaps(shared.value)
        for s in batches:
            yield pd.DataFrame(list(scan_texts(s.tolist(), shared.value, bitmaps)), columns=["n_words", "spans", "places", "items"])

    return of(text)


def _keyed(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for a window and its width."""
    return mix(hashes + np.uint64(width))


def _window_table(benchmark: DataFrame) -> DataFrame:
    """(hash, window, item) of all windows; benchmark has item, text."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"], strict=True):
                scan = Scan([(text or "").encode("utf-8", "surrogatepass")])
                width = min(WIDTH, len(scan.hash))
                if width:
                    firsts, h = scan.windows(width)
                    yield pd.DataFrame({"hash": _keyed(h, width).view(np.int64), "window": [scan.words(i, width) for i in firsts.tolist()], "item": item})

    return materialise(benchmark.mapInPandas(of, "hash long, window binary, item string").distinct(), "windows")


_CANDIDATES = "n_words long, candidates array<struct<first: int, width: int, start: int, stop: int, hash: bigint, window: binary>>"


def _candidates(df: DataFrame, windows: DataFrame, text: Column) -> Column:
    """Number of words of a text, and its windows whose hash is in the bitmap of ``windows``."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * windows.count()).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits) + 1  # counted from 1
    rows = windows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    whole = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():  # a fixed number of 4 KB rows
        whole[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bitmap, dtype=np.uint8)
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(whole)

    def of_text(text: str | None) -> tuple[int, list[tuple]]:
        scan = Scan([(text or "").encode("utf-8", "surrogatepass")])
        found = []
        for width in range(1, WIDTH + 1):
            firsts, h = scan.windows(width)
            h = _keyed(h, width)
            at = h >> np.uint64(64 - bits)
            near = np.flatnonzero(shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            for k, i in zip(near.tolist(), firsts[near].tolist(), strict=True):
                found.append((i, width, int(scan.start[i]), int(scan.end[i + width - 1]), int(h[k].view(np.int64)), scan.words(i, width)))
        return len(scan.hash), found

    @F.pandas_udf(_CANDIDATES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([of_text(t) for t in s], columns=["n_words", "candidates"])

    return of(text)


def _merged(hits: pd.Series) -> pd.DataFrame:
    """Spans and places out of hits (first, width, start, stop) of each text."""
    spans, places = [], []
    for row in hits:
        row = sorted((h["first"], h["first"] + h["width"], h["start"], h["stop"]) for h in row)
        own: list[list[int]] = []
        for a, b, start, stop in row:
            if own and a <= own[-1][1]:
                if b > own[-1][1]:
                    own[-1][1], own[-1][3] = b, stop
            else:
                own.append([a, b, start, stop])
        spans.append([x for a, b, _, _ in own for x in (a, b)])
        places.append([x for _, _, a, b in own for x in (a, b)])
    return pd.DataFrame({"spans": spans, "places": places})


def _joined(located: DataFrame, benchmark: DataFrame, text_col: str) -> DataFrame:
    """(doc_id, __file, __row, hits) of a large benchmark; only candidates are shuffled, never texts."""
    windows = _window_table(benchmark)
    rows = located.select("doc.doc_id", "__file", "__row", _candidates(located, windows, F.col("doc").getField(text_col)).alias("c"))
    rows = materialise(rows.select("doc_id", "__file", "__row", "c.n_words", "c.candidates"), "candidates")
    each = rows.where(F.size("candidates") > 0).select(F.col("__file").alias("f"), F.col("__row").alias("r"), F.explode("candidates").alias("x")).select("f", "r", "x.*")
    real = each.join(windows, ["hash", "window"]).groupBy("f", "r")
    real = real.agg(F.collect_set(F.struct("first", "width", "start", "stop")).alias("h"), F.array_sort(F.collect_set("item")).alias("items"))
    real = real.select("f", "r", "items", F.pandas_udf(_merged, "spans array<int>, places array<int>")("h").alias("m"))
    found = rows.drop("candidates").join(real, (F.col("__file") == F.col("f")) & (F.col("__row") == F.col("r")), "left")
    none = F.array().cast("array<int>")
    hits = F.struct("n_words", F.coalesce("m.spans", none).alias("spans"), F.coalesce("m.places", none).alias("places"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return found.select("doc_id", "__file", "__row", hits.alias("hits"))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict | None]:
    """(item, text), and all windows if these are few enough; a null id counts as empty text."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    # A word and what parts it from the next take two characters at least; an item without text still takes a place.
    words = items.agg(F.sum(F.length(F.coalesce("text", F.lit(""))) / 2 + 1)).first()[0] or 0
    return items, benchmark_block([tuple(r) for r in items.collect()]) if words <= SMALL_WORDS else None


def _measures(hits: str) -> dict[str, Column]:
    spans = F.col(f"{hits}.spans")
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size(spans)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, F.element_at(spans, i)).otherwise(-F.element_at(spans, i)))
    n_hit = F.when(F.size(spans) == 0, F.lit(0)).otherwise(n_hit).cast("long")
    words = F.col(f"{hits}.n_words")
    return {"n_words": words, "n_hit": n_hit, "contaminated": (n_hit > 0) & (F.lit(20) * n_hit >= words)}


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is 13 consecutive words of an item, or all of an item that has fewer; items without words (null,
    empty) have none. A document word within any occurrence of a window is hit. contaminated: at least one word
    and a twentieth of the words are hit. Null texts have no words; texts are read whole. Repeated rows are judged each
    for itself, items with equal windows all count, other columns play no part; no rows give no rows, no items no hits.
    """
    docs = docs.select("doc_id", "text")
    items, block = _items(benchmark, "item_id", "text")
    if block is None:
        found = _joined(with_locator(docs), items, "text")
    else:
        found = docs.select("doc_id", _hits(docs, block, F.col("text")).alias("hits"))
    m = _measures("hits")
    own = F.col("hits.items")
    return found.select(
        "doc_id", m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"), F.size(own).cast("long").alias("n_items"), F.sha2(F.array_join(own, ","), 256).alias("items_sha256"), m["contaminated"].alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows (see :func:`decontaminate`), all columns as they were, whatever their names.

    Python sees the texts alone: rows are dropped by place. Null and empty texts stay; no rows give no rows.
    """
    located = with_locator(docs)
    items, block = _items(benchmark, "item_id", "text")
    if block is None:
        found = _joined(located, items, "text")
    else:
        found = located.select("__file", "__row", _hits(located, block, F.col("doc.text")).alias("hits"))
    return without_rows(located, found.where(_measures("hits")["contaminated"]).select("__file", "__row"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every hit passage cut out of the text (from the first letter of its first word to the last of its last).

    Texts without a hit stay byte for byte, null texts null; all other columns stay as they were, whatever their
    names. ``docs`` has doc_id. With a large benchmark, hits and texts are joined by place.
    """
    items, block = _items(benchmark, "item_id", "text")
    if block is None:
        located = with_locator(docs)
        hits = _joined(located, items, text_col).select(F.col("__file").alias("f"), F.col("__row").alias("r"), "hits")
        found = located.join(hits, (F.col("__file") == F.col("f")) & (F.col("__row") == F.col("r"))).select("doc", "hits")
    else:
        found = docs.select(F.struct("*").alias("doc"), _hits(docs, block, F.col(text_col)).alias("hits"))
    text, places = F.col("doc").getField(text_col), F.col("hits.places")
    # The parts to keep: from the end of one passage (or the start) to the start of the next (or the end).
    edges = F.concat(F.array(F.lit(0)), places, F.array(F.octet_length(text)))
    kept = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1, F.lit(2)), lambda i: F.substring(text.cast("binary"), F.element_at(edges, i) + 1, F.element_at(edges, i + 1) - F.element_at(edges, i)).cast("string")
    )
    cut = F.when(F.size(places) > 0, F.array_join(kept, "")).otherwise(text)
    return found.select(*(cut.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))

"""Quality by importance resampling.

Two generative models over hashed word 1- and 2-grams are fitted, one to texts of the target and one to all raw
texts. A text's importance is the ratio of its probabilities; Gumbel top-k on the log ratio samples, without
replacement, with probability in proportion to importance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import bound_batches, sampled, with_locator
from stowage.llm.decontaminate import CHUNK, Scan
from stowage.operators.tables import materialise

DIM = 1 << 14
#: About so many target rows, chosen by a hash of the id, make the target model; the raw model takes all rows.
TARGET_ROWS = 20_000
FRACTION, SEED = 0.5, 17
#: Cells of a histogram, and keys fetched at once, when the k-th largest key is looked for.
CELLS, FETCH = 1024, 5_000


def _scans(texts: list[str | None]) -> Iterator[Scan]:
    some: list[bytes] = []
    n = 0
    for t in texts:
        some.append((t or "").encode("utf-8", "surrogatepass"))
        n += len(some[-1])
        if n >= CHUNK:
            yield Scan(some)
            some, n = [], 0
    if some:
        yield Scan(some)


def _buckets(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words; first words and buckets of the pairs of words."""
    shift = np.uint64(64 - DIM.bit_length() + 1)
    firsts, pairs = scan.windows(2)
    return (scan.hash >> shift).astype(np.int64), firsts, (pairs >> shift).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(DIM, dtype=np.int64)
    for batch in batches:
        for scan in _scans(batch["text"].tolist()):
            ones, _, twos = _buckets(scan)
            total += np.bincount(ones, minlength=DIM) + np.bincount(twos, minlength=DIM)
    full = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": full, "n": total[full]})


def model(texts: DataFrame) -> np.ndarray:
    """Log probabilities of the buckets, by the counts of all rows of ``texts`` (column text) and one more each."""
    sums = texts.select("text").where("text IS NOT NULL").mapInPandas(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.ones(DIM)
    for r in sums.collect():  # DIM rows at most
        counts[r.bucket] += r.n
    return np.log(counts / counts.sum())


def _log_ratio(df: DataFrame, weights: np.ndarray, text: Column) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("log_ratio double, n_words long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            ratios, words = [], []
            for scan in _scans(s.tolist()):
                ones, firsts, twos = _buckets(scan)
                docs = len(scan.at) - 1
                ratios.append(np.bincount(scan.text, shared.value[ones], docs) + np.bincount(scan.text[firsts], shared.value[twos], docs))
                words.append(np.diff(scan.first))
            yield pd.DataFrame({"log_ratio": np.concatenate(ratios), "n_words": np.concatenate(words)})

    return of(text)


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column without nulls, by narrowing histograms; None if there are fewer."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    above = 0
    while low < high:
        width = (high - low) / CELLS
        if low + width <= low or not width < math.inf:
            # Too few numbers lie between to make cells, or too far apart: halves, down to a single value.
            middle = low / 2 + high / 2
            cell = F.when(F.col(column) > F.lit(middle), 1).otherwise(0) if low < middle < high else F.when(F.col(column) == F.lit(high), 1).otherwise(0)
        else:
            cell = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(CELLS - 1)).cast("int")
        inside = df.where(F.col(column).between(low, high)).groupBy(cell.alias("cell"))
        cells = inside.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for c in sorted(cells, key=lambda c: -c.cell):
            if above + c.n >= k:
                low, high, n = c.low, c.high, c.n
                break
            above += c.n
        if n <= FETCH:
            values = df.where(F.col(column).between(low, high)).select(column).orderBy(F.desc(column)).collect()  # n rows
            return values[k - above - 1][0]
    return low


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float = FRACTION, seed: int = SEED, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, log_ratio, key, selected.

    target_ids: column doc_id. The share ``fraction`` of the rows (rounded up) with the largest keys is selected;
    keys that tie with the last are selected too. Noise comes from seed, id, name of the file and place in it, so that
    a copy of the table elsewhere gives the same and repeated rows are drawn each for itself. Texts without
    words (null, empty) have log ratio 0; long texts count whole. Without target rows all log ratios only show how
    common words are. Other columns play no part; no rows give no rows.
    """
    bound_batches(docs.sparkSession)
    ids = target_ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
    share = min(1.0, target_rows / max(1, ids.count()))
    picked = ids.where(sampled("doc_id", share))
    # Distinct ids, about ``target_rows`` of them, so small enough to broadcast.
    target = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left_semi")
    weights = model(target) - model(docs)
    src = with_locator(docs.select("doc_id", "text"))
    name = F.substring_index("__file", "/", -1)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc.doc_id", name, "__row"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scored = src.select("doc.doc_id", _log_ratio(src, weights, F.col("doc.text")).alias("r"), (-F.log(-F.log(u))).alias("noise"))
    scored = materialise(scored.select("doc_id", "r.n_words", "r.log_ratio", (F.col("r.log_ratio") + F.col("noise")).alias("key")), "importance")
    rows = scored.count()
    last = kth_largest(scored, "key", min(rows, int(-(-rows * fraction // 1))))
    return scored.withColumn("selected", F.lit(False) if last is None else F.col("key") >= F.lit(last))

"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import bound_batches, sampled, with_locator, without_rows

UNKNOWN = "und"
#: What the only language is called where there is nothing to tell languages by.
LETTERS = "letters"
#: Buckets for n-grams of 1 to ORDERS characters.
DIM, ORDERS = 1 << 15, 3
#: About so many labelled rows of each language, chosen by a hash of the id, train the model; all of them if there are fewer.
TRAIN_ROWS = 10_000
#: Characters worked on at once.
CHUNK = 1 << 18
#: Languages of a model at most (DIM x 4 bytes each in its broadcast), the most frequent ones.
MOST_LANGUAGES = 500

#: Languages, log probabilities, log priors.
Model = tuple[list[str], np.ndarray, np.ndarray]

_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@functools.cache
def _folding() -> np.ndarray:
    """Code point to lower-case letter; a space for what is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


class Points:
    """The characters of some texts as n-gram material.

    Non-letters count as spaces and runs of them as one; a text has one space before and two behind it, so that none is
    too short. x: code points, text after text. at: where each piece begins. A text of more than CHUNK characters comes
    as several pieces; one that goes on (``later``) begins with the last characters of the one before, and only n-grams
    that end beyond these count, so that cutting a text changes nothing. owner: number of each piece's text.
    """

    def __init__(self, owner: list[int], x: np.ndarray, at: np.ndarray, later: list[bool], letters: np.ndarray) -> None:
        self.owner, self.x, self.at, self.later, self.letters = owner, x.astype(np.uint64), at, np.array(later, dtype=np.int64), letters

    def ngrams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: buckets of the n-grams, and where those of each piece begin (each has one at least)."""
        code = np.zeros(len(self.x), dtype=np.uint64)
        place = np.arange(len(self.x))
        for n in range(1, ORDERS + 1):
            code[: len(self.x) - n + 1] += (self.x * _FACTORS[n - 1])[n - 1 :]
            first, end = self.at[:-1] + self.later * (ORDERS - n), self.at[1:]
            own = (place >= np.repeat(first, np.diff(self.at))) & (place + n <= np.repeat(end, np.diff(self.at)))
            mixed = (code[own] + np.uint64(n)) * _FACTORS[0]
            yield (mixed >> np.uint64(64 - DIM.bit_length() + 1)).astype(np.int64), np.concatenate(([0], np.cumsum(end - first - n + 1)[:-1]))


def _folded(text: str) -> np.ndarray:
    return _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _together(owner: list[int], texts: list[str]) -> Points:
    points = _folded("".join(f" {t}  " for t in texts))
    ends = np.cumsum(np.fromiter((len(t) + 3 for t in texts), dtype=np.int64, count=len(texts)))
    starts = np.concatenate(([0], ends[:-1]))
    blank = points == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[starts] = keep[ends - 2] = keep[ends - 1] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    letters = np.concatenate(([0], np.cumsum(~blank)))
    return Points(owner, points[keep], at[np.append(starts, ends[-1])], [False] * len(texts), letters[ends] - letters[starts])


def _pieces(owner: int, text: str) -> Iterator[Points]:
    x, later, blank_before, letters = np.array([32], dtype=np.uint32), False, True, 0
    for start in range(0, len(text), CHUNK):
        points = _folded(text[start : start + CHUNK])
        blank = points == 32
        x = np.concatenate([x, points[~blank | ~np.concatenate(([blank_before], blank[:-1]))]])
        blank_before = bool(blank[-1])
        letters += int((~blank).sum())
        if start + CHUNK >= len(text):
            x = np.concatenate([x, np.full(2, 32, dtype=np.uint32)])
        if len(x) >= ORDERS:
            yield Points([owner], x, np.array([0, len(x)]), [later], np.array([letters]))
            x, later, letters = x[1 - ORDERS :], True, 0


def pieces(texts: list[str]) -> Iterator[Points]:
    """All texts, some short ones at a time, long ones piece by piece."""
    owner, some, n = [], [], 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            yield from _pieces(i, t)
            continue
        owner.append(i)
        some.append(t)
        n += len(t)
        if n >= CHUNK:
            yield _together(owner, some)
            owner, some, n = [], [], 0
    if some:
        yield _together(owner, some)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            docs[lang] = docs.get(lang, 0) + len(rows)
            total = counts.setdefault(lang, np.zeros(DIM, dtype=np.int64))
            for points in pieces(rows["text"].tolist()):
                for buckets, _ in points.ngrams():
                    total += np.bincount(buckets, minlength=DIM)
    for lang, total in counts.items():
        full = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": np.append(full, -1), "n": np.append(total[full], docs[lang])})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Languages, log probabilities (DIM x languages) and log priors, from rows with text and language.

    About ``rows`` rows of each language are used, chosen by a hash of their id; of a language with fewer, all. The
    priors come from all rows. Of more than MOST_LANGUAGES languages the most frequent are learnt. Without any such row
    there is no language, and every text is predicted ``und``.
    """
    bound_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    names = sorted(r.lang for r in sizes)
    n = {r.lang: r.n for r in sizes}
    if not names:
        return [], np.zeros((DIM, 0), dtype=np.float32), np.zeros(0)
    # MOST_LANGUAGES rows at most.
    shares = F.broadcast(docs.sparkSession.createDataFrame([(k, min(1.0, rows / n[k])) for k in names], "lang string, share double"))
    sample = known.join(shares, "lang").where(sampled("id", F.col("share")))
    counted = sample.select("lang", "text").mapInPandas(_count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most (DIM + 1) rows for each language
    counts = np.full((DIM, len(names)), 0.5)
    for j, name in enumerate(names):
        body = table[(table.lang == name) & (table.bucket >= 0)]
        counts[body.bucket.to_numpy(), j] += body.n.to_numpy()
    prior = np.array([n[k] for k in names], dtype=float) + 1
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum())


def score(texts: list[str | None], names: list[str], weights: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language of each text (``und`` if none was learnt or the text has no letter) and its probability."""
    total = np.tile(prior, (len(texts), 1))
    letters = np.zeros(len(texts), dtype=np.int64)
    for points in pieces([t or "" for t in texts]):
        np.add.at(letters, points.owner, points.letters)
        if names:
            for buckets, at in points.ngrams():
                np.add.at(total, points.owner, np.add.reduceat(weights[buckets], at, axis=0, dtype=np.float64))
    if not names or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total -= total.max(axis=1, keepdims=True)
    odds = np.exp(total)
    odds /= odds.sum(axis=1, keepdims=True)
    best = odds.argmax(axis=1)
    langs = [names[i] if n else UNKNOWN for i, n in zip(best, letters, strict=True)]
    return langs, np.where(letters > 0, odds[np.arange(len(texts)), best], 0.0)


def predict(df: DataFrame, model: Model, text: Column) -> Column:
    """A struct column (lang_pred, score) for a text column.

    ``und`` with score 0 for null texts and texts without a letter; ties go to the first language in order.
    """
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, weights, prior = shared.value
        for s in batches:
            langs, scores = score(s.tolist(), names, weights, prior)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return of(text)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text has remainder ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(parts) == F.lit(part)


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, learnt from the rows not held out.

    Null texts and texts without a letter (empty, digits, signs) are ``und`` with score 0, and so is every text if no
    row could be learnt from. Long texts are read whole, ties go to the first language in order, repeated rows get
    equal answers each, other columns play no part, no rows give no rows.
    """
    own = docs.select("doc_id", "lang", "text", held_out("doc_id", 4, 2).alias("held_out"))
    model = train(own.where("NOT held_out"))
    found = own.select("doc_id", "held_out", predict(own, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_languages(docs: DataFrame, languages: Collection[str] | None = None) -> DataFrame:
    """``docs`` without texts in no language (null, or no letter) or predicted to be in none of ``languages``.

    None: any language that was learnt will do. Where none could be learnt (no labelled row) or none of ``languages``
    was, the model has no say and every text with a letter stays. All columns stay as they were, whatever their names;
    repeated rows are judged each for itself; no rows give no rows. Python sees the texts alone: rows are dropped by place.
    """
    located = with_locator(docs)
    own = located.select("doc.doc_id", "doc.lang", "doc.text", "__file", "__row")
    model = train(own.where(~held_out("doc_id", 4, 2)))
    if languages is not None and not set(languages) & set(model[0]) or not model[0]:
        languages, model = [LETTERS], ([LETTERS], np.zeros((DIM, 1), dtype=np.float32), np.zeros(1))
    wanted = F.col("lang") != UNKNOWN if languages is None else F.col("lang").isin(*languages)
    found = own.select("__file", "__row", predict(own, model, F.col("text"))["lang_pred"].alias("lang"))
    return without_rows(located, found.where(~wanted).select("__file", "__row"))

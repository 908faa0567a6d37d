"""Toxicity by a misspelling-tolerant lexicon and the context of its hits.

The lexicon is learnt: words and stems that labelled toxic texts have far more often than clean ones. Its trie is
intersected with Levenshtein automata of one edit: the product is walked letter by letter over each word, its states
made as they are first reached, and most words leave it within a few letters. Each hit is then seen in its window of
words: quotation marks and words of reporting speak for quotation, address and repetition for abuse. A logistic
regression over sums of these gives the score.

What bounds the work bounds what is seen: a word with letters and signs mixed is looked at within 30 characters for a letter
and a sign, with 60 letters at most between signs; quotation marks count within 60 characters on either side of a hit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import bound_batches, sampled
from stowage.operators.tables import materialise

#: About so many labelled rows, chosen by a hash of the id, are learnt from; all of them if there are fewer.
TRAIN_ROWS = 20_000
#: Letters of a stem; words of at least FUZZY letters may be one edit away.
SHORTEST, LONGEST, FUZZY = 4, 10, 5
#: Stems and words of a lexicon at most, best first, out of four times as many candidates.
TERMS = 1_000
#: Words of clean texts close to a term that are remembered as no misspelling of it, most frequent first.
KNOWN = 10_000
#: Log of how many times more often toxic texts have a telling term.
TELLING = 2.0
WINDOW = 8
#: Words, and states of the automaton, remembered by each task.
CACHE = 200_000
STATES = 50_000

#: Quotation marks, words that report speech, words that address someone.
QUOTES = "\"'«»“”„‘’`"
REPORTING = frozenset("said says say wrote quoted quote called word term dit disait écrit mot terme sagte schrieb wort begriff dijo escribió palabra término".split())
ADDRESS = frozenset("you your youre ur tu te toi vous votre du dich dir ihr euch sie tú ti usted vosotros su".split())

FEATURES = ("exact", "near", "best", "density", "distinct", "quoted", "reported", "addressed", "crowded", "length")

_TOKEN = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("013457@$", "oieastas")
#: A word with letters and signs mixed; what is looked ahead is bounded, so that long runs without spaces cost no more.
_MASKED = re.compile(r"(?<![^\W\d_])(?=\S{0,30}[^\W\d_])(?=\S{0,30}[013457@$])[^\W_@$]{0,60}(?:[013457@$][^\W_@$]{0,60})+")


class Automaton:
    """Trie of terms, each with a weight, and one allowed edit for terms of FUZZY letters or more.

    A term ending in ``$`` matches a whole word, any other the start of one. One ending in ``=`` allows no edit, and a
    whole word of weight 0 is known to be no misspelling.
    """

    def __init__(self, terms: dict[str, float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.weight: list[float] = [0.0]
        self.fuzzy: list[bool] = [False]
        #: Whether a fuzzy term is at a node or below; only those are worth an edit.
        self.leads: list[bool] = [False]
        self.known: set[int] = set()
        self.names: dict[int, str] = {}
        for name, weight in terms.items():
            term = name.rstrip("=")
            node, far = 0, weight > 0 and name == term and len(term.rstrip("$")) >= FUZZY
            self.leads[0] |= far
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.weight.append(0.0)
                    self.fuzzy.append(False)
                    self.leads.append(False)
                node = self.children[node][c]
                self.leads[node] |= far
            self.weight[node] = max(self.weight[node], weight)
            self.fuzzy[node] = far
            if far:
                self.names[node] = term
            if not weight:
                self.known.add(node)
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        #: Best hit in a state: weight and whether it is exact.
        self.hits: list[tuple[float, bool] | None] = []
        self.start = self._state(frozenset({(0, 0)}))

    def _state(self, nodes: frozenset) -> int:
        if nodes not in self.states:
            self.states[nodes] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            found = [(self.weight[n], e == 0) for n, e in nodes if self.weight[n] and (e == 0 or self.fuzzy[n])]
            self.hits.append(max(found, key=lambda h: (h[1], h[0])) if found else None)
        return self.states[nodes]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits < out.get(node, 2) and (not edits or self.leads[node]):
                out[node] = edits

        for node, edits in self.sets[state]:
            own = self.children[node]
            if c in own:
                put(own[c], edits)
            if not edits:
                if c != "$":
                    put(node, 1)
                for letter, child in own.items():
                    if c != "$" and letter != "$":  # the end of a word is no letter
                        put(child, 1)
                    if c in self.children[child]:
                        put(self.children[child][c], 1)
        nxt = self._state(frozenset(out.items()))
        self.steps[state][c] = nxt
        return nxt

    def match(self, word: str) -> tuple[float, bool] | None:
        """Weight of the best term and whether it matches without an edit."""
        if len(self.sets) > STATES:
            self._forget()
        state, best = self.start, None
        for c in f"{word}$":
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            hit = self.hits[state]
            if hit:
                if hit[1]:
                    return hit
                best = max(best, hit) if best else hit
            elif not self.sets[state]:
                break
        if best and any(n in self.known for n, e in self.sets[state] if not e):
            return None
        return best

    def near(self, word: str) -> set[str]:
        """Terms that the word matches with an edit."""
        state, out = self.start, set()
        for c in f"{word}$":
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            out |= {self.names[n] for n, e in self.sets[state] if e and n in self.names}
        return out


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their places; letters disguised as digits or signs are read as letters."""
    low = text.lower()
    found = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(low)]
    if re.search(r"[^\W\d_][013457@$]+[^\W\d_]|(?<!\S)[013457@$][^\W\d_]{2}", low):
        found += [(m[0].translate(_LEET), m.start(), m.end()) for m in _MASKED.finditer(low)]
        found.sort(key=lambda w: w[1])
    return found


def features(text: str | None, automaton: Automaton, cache: dict[str, tuple[float, bool] | None]) -> list[float]:
    text = text or ""
    words = words_of(text)
    hits = []
    for i, (w, a, b) in enumerate(words):
        if w in cache:
            hit = cache[w]
        else:
            hit = automaton.match(w)
            if len(cache) < CACHE:
                cache[w] = hit
        if hit:
            hits.append((i, w, a, b, *hit))
    n = len(words)
    if not hits:
        return [0.0] * (len(FEATURES) - 1) + [math.log1p(n)]
    exact = sum(h[4] for h in hits if h[5])
    near = sum(h[4] for h in hits if not h[5])
    quoted = reported = addressed = crowded = 0
    places = [h[0] for h in hits]
    for k, (i, _, a, b, _, _) in enumerate(hits):
        around = {w for w, _, _ in words[max(0, i - WINDOW) : i + WINDOW + 1]}
        before, after = text[max(0, a - 60) : a], text[b : b + 60]
        quoted += any(q in before and q in after for q in QUOTES) or ("«" in before and "»" in after) or ("“" in before and "”" in after) or ("„" in before and "“" in after)
        reported += bool(around & REPORTING)
        addressed += bool(around & ADDRESS)
        crowded += k > 0 and i - places[k - 1] <= WINDOW
    m = len(hits)
    return [
        math.log1p(exact), math.log1p(near), max(h[4] * (1.0 if h[5] else 0.5) for h in hits), 100.0 * m / n, math.log1p(len({h[1] for h in hits})),
        quoted / m, reported / m, addressed / m, crowded / m, math.log1p(n),
    ]


def _stems(text: str | None) -> set[str]:
    out: set[str] = set()
    for w in {w for w, _, _ in words_of(text or "")}:
        if len(w) >= SHORTEST:
            out.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
        if len(w) >= 3:
            out.add(f"{w}$")
    return out


def _count_stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, int] = {}
    for batch in batches:
        for t in batch["text"]:
            for s in _stems(t):
                counts[s] = counts.get(s, 0) + 1
    yield pd.DataFrame({"term": list(counts), "n": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))})


def _g2(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """How surprising it is that a of na and b of nb have the term (log-likelihood ratio)."""
    share = (a + b) / (na + nb)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log(x / e), 0.0) for x, e in ((a, na * share), (na - a, na * (1 - share)), (b, nb * share), (nb - b, nb * (1 - share)))]
    return 2 * sum(parts)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms and weights from a bounded sample (text, toxic)."""
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    na, nb = counts.get(1, 0), counts.get(0, 0)
    if not na or not nb:
        return {}
    bad = sample.where("toxic = 1").select("text").mapInPandas(_count_stems, "term string, n long").groupBy("term").agg(F.sum("n").alias("a")).where(F.col("a") >= 3)
    terms = bad.toPandas()  # of at most TRAIN_ROWS texts
    known = sample.sparkSession.sparkContext.broadcast(frozenset(terms["term"]))

    def count_known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for batch in batches:
            for t in batch["text"]:
                for s in _stems(t) & known.value:
                    counts[s] = counts.get(s, 0) + 1
        yield pd.DataFrame({"term": list(counts), "n": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))})

    good = sample.where("toxic = 0").select("text").mapInPandas(count_known, "term string, n long").groupBy("term").agg(F.sum("n").alias("b")).toPandas()
    terms = terms.merge(good, on="term", how="left").fillna({"b": 0})
    a, b = terms["a"].to_numpy(float), terms["b"].to_numpy(float)
    terms["weight"] = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
    terms["g2"] = _g2(a, b, na, nb)
    terms = terms[(terms.weight > TELLING) & (terms.g2 > 2 * math.log(max(100, len(terms))))]
    return _calibrated(sample, _chosen(terms), na, nb)


def _calibrated(sample: DataFrame, lexicon: dict[str, float], na: int, nb: int) -> dict[str, float]:
    """The lexicon without edits that clean texts speak against.

    A word that several clean texts have is itself, no misspelling. What single clean texts have tells how often an
    edited term is met by chance; a term of which that makes no telling one allows no edit.
    """
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, seen = Automaton(shared.value), {}
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            for t, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for w in {w for w, _, _ in words_of(t or "")}:
                    if w not in seen:
                        hit = automaton.match(w)
                        seen[w] = hit is not None and not hit[1]
                    if seen[w]:
                        counts[w, toxic] = counts.get((w, toxic), 0) + 1
        yield pd.DataFrame([(w, toxic, n) for (w, toxic), n in counts.items()], columns=["word", "toxic", "n"])

    met = sample.select("text", "toxic").mapInPandas(near, "word string, toxic int, n long").groupBy("word")
    met = met.agg(F.sum(F.expr("IF(toxic = 1, n, 0)")).alias("a"), F.sum(F.expr("IF(toxic = 0, n, 0)")).alias("b")).toPandas()  # words close to a term, of at most TRAIN_ROWS texts

    def tells(a, b):
        return np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1)) > TELLING

    clean = met[(met.b >= 2) & ~tells(met.a, met.b)].sort_values(["b", "word"], ascending=[False, True])
    automaton = Automaton(lexicon)
    a, b = dict.fromkeys(lexicon, 0), dict.fromkeys(lexicon, 0)
    for r in met[~met.word.isin(clean.word)].itertuples():
        for t in automaton.near(r.word):
            a[t] += r.a
            b[t] += r.b
    chance = {t for t in lexicon if b[t] >= 2 and not tells(a[t], b[t])}
    out = {f"{t}=" if t in chance else t: w for t, w in lexicon.items()}
    automaton = Automaton(out)
    return out | {f"{w}$": 0.0 for w in clean.word.head(KNOWN) if automaton.match(w)}


def _chosen(terms: pd.DataFrame) -> dict[str, float]:
    """The lexicon out of telling terms (term, a, weight, g2).

    Whole words of FUZZY letters or more come in each for itself, and so does the longest stem of what the same texts
    have: these match with an edit. Short stems are added for what else begins with them.
    """
    terms = terms.sort_values(["g2", "term"], ascending=[False, True]).head(4 * TERMS)
    weight, texts = dict(zip(terms["term"], terms["weight"], strict=True)), dict(zip(terms["term"], terms["a"], strict=True))
    # Stems that go on, by any letter, with nearly all of their texts.
    goes_on = {t[:-1] for t in texts if t[-1] != "$" and texts[t] >= 0.9 * texts.get(t[:-1], math.inf)}
    kept = {t for t in weight if len(t.rstrip("$")) >= FUZZY and (t[-1] == "$" or t not in goes_on)}
    # The shortest stem of a family first: it speaks for all that begins with it.
    stems: set[str] = set()
    for t in sorted(weight, key=lambda t: (len(t.rstrip("$")), t)):
        plain = t.rstrip("$")
        if not any(plain[:k] in stems and weight[plain[:k]] >= weight[t] - 1 for k in range(SHORTEST, len(plain) + 1)):
            stems.add(t)
    return {t: float(w) for t, w in list((t, w) for t, w in weight.items() if t in kept or t in stems)[:TERMS]}


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: means, scales, weights (the last is the constant)."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _misspelt(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with exact hits come once more as if each hit had an edit: labels with few misspellings do not tell what one means."""
    exact, near, best = (FEATURES.index(k) for k in ("exact", "near", "best"))
    has = x[:, exact] > 0
    more = x[has].copy()
    more[:, near] = np.log1p(np.expm1(more[:, exact]) + np.expm1(more[:, near]))
    more[:, exact] = 0
    more[:, best] /= 2
    return np.concatenate([x, more]), np.concatenate([y, y[has]])


def _scored(df: DataFrame, lexicon: dict[str, float], text: Column, kind: str, finish) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, cache = Automaton(shared.value), {}
        for s in batches:
            yield finish(np.array([features(t, automaton, cache) for t in s], dtype=float).reshape(-1, len(FEATURES)))

    return of(text)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[str, float], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lexicon and regression from labelled rows (toxic 0 or 1; other labels are left out).

    About ``rows`` labelled ids are used, chosen by a hash; only they are sent to the texts. An id that is labelled
    both ways counts once for each, repeated rows count once. Without any row the model gives 0.5.
    """
    known = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    share = min(1.0, rows / max(1, known.count()))
    picked = known.where(sampled("doc_id", share))
    # Distinct ids and labels, about ``rows`` of them, so small enough to broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "toxic"])
    sample = materialise(sample, "labelled")
    lexicon = learn_lexicon(sample)
    got = sample.select("toxic", _scored(sample, lexicon, F.col("text"), "array<double>", lambda x: pd.Series(list(x))).alias("x")).toPandas()
    if not len(got):
        return lexicon, (np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1))
    x, y = _misspelt(np.array(got["x"].tolist(), dtype=float), got["toxic"].to_numpy(float))
    return lexicon, _fit(x, y)


def score_column(df: DataFrame, model: tuple, text: Column) -> Column:
    """Score of a text column: 0 to 1; null and empty texts get what a text without any hit of no words gets."""
    lexicon, (mean, scale, w) = model

    def finish(x: np.ndarray) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30))))

    return _scored(df, lexicon, text, "double", finish)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only rows with ``held_out`` false and a label are learnt from. Null and empty texts get the score of a text without a
    hit; long texts are read whole; repeated rows are scored each for itself; a score of 0.5 predicts 1. Without a
    labelled row every score is 0.5. Other columns play no part; no rows give no rows.
    """
    bound_batches(docs.sparkSession)
    own = docs.select("doc_id", "text", held_out.alias("held_out"))
    model = train(own.where("NOT held_out"), labels)
    scored = own.select("doc_id", "held_out", score_column(own, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

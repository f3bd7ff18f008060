"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: NFKD without marks, lower case, homoglyphs of Latin letters to those letters, digits and signs that stand for
letters where they touch a letter, everything else to single spaces. Terms are whole words
or beginnings of words, so that forms of a word share one entry. All terms and all exception phrases go into one
automaton that runs over the whole text and takes the longest match; an exception phrase is a match that counts
nothing and so hides the term inside of it. The sum of the weights, divided by the number of words (and some more, for
short texts), goes through a logistic curve.

The lexicon is learned from labelled texts: of all word beginnings and words of the training rows, those stay whose
log-likelihood ratio is beyond what the best of so many random ones would reach. Exception phrases are pairs of words
around a term that occur in clean rows alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspan.llm.common import cut, text_slices, tidy

#: Characters that look like Latin letters, each before that letter, and signs that stand for letters.
HOMOGLYPHS = {pair[0]: pair[1:] for pair in "аa вb еe кk мm нh оo рp сc тt уy хx ѕs іi јj һh ԁd ԛq ԝw αa βb εe ηn ιi κk νv οo ρp τt υu χx ωw ıi łl øo đd ßss".split()}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

#: Bound of the fit: about so many labelled rows are read for it, chosen by a hash of their ids.
MAX_TRAIN = 12_000
#: Words that every text has besides its own where weights are divided by length: one term makes no short text toxic.
SMOOTH = 100
STEMS = range(4, 9)
MIN_ROWS = 4
_HOMOGLYPHS = str.maketrans(HOMOGLYPHS)
_DIGITS = str.maketrans(DIGITS)
_MASK = re.compile(r"[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]+")
_SPACE = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """The folded text with one space before, between and after words."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_HOMOGLYPHS)
    text = _MASK.sub(lambda m: m[0].translate(_DIGITS), text)
    return f" {_SPACE.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Terms with weights: ' word ' for a whole word, ' stem' for a beginning; phrases that excuse a term; the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    offset: float = -2.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matches(found: ahocorasick.Automaton | None, folded: str) -> list[tuple[int, float]]:
    """(start, weight) of the leftmost longest matches in a folded text; the space after a word is left to the next."""
    if found is None:
        return []
    best: dict[int, tuple[int, float]] = {}
    for end, (size, weight) in found.iter(folded):
        start = end + 1 - size
        if start not in best or best[start][0] < size:
            best[start] = (size, weight)
    out, free = [], 0
    for start in sorted(best):
        size, weight = best[start]
        if start >= free:
            free = start + size - (folded[start + size - 1] == " ")
            out.append((start, weight))
    return out


def burden(found: ahocorasick.Automaton | None, text: str) -> tuple[float, int]:
    """The sum of the weights by length (as if of SMOOTH words, that many added), and the number of terms, of a text."""
    folded = fold(text)
    hits = [w for _, w in matches(found, folded) if w]
    return sum(hits) * SMOOTH / (SMOOTH + len(folded.split())), len(hits)


def candidates(text: str) -> set[str]:
    """The terms that a text could give to a lexicon."""
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEMS if n <= len(w))
    return out


def likelihood_ratio(t: Column, c: Column, n_t: int, n_c: int) -> Column:
    """G-squared of t of n_t toxic and c of n_c clean rows."""
    rows, hits = n_t + n_c, t + c
    cells = [(t, n_t, hits), (c, n_c, hits), (n_t - t, n_t, rows - hits), (n_c - c, n_c, rows - hits)]
    return sum((F.when(seen > 0, 2 * seen * F.log(seen * rows / (n * of))).otherwise(0.0) for seen, n, of in cells), F.lit(0.0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, text, y) of labelled rows for a fit: crc32(id as text) mod 5 not 0, about `most` of them by a hash of the id."""
    keyed = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0))
    keyed = keyed.groupBy("id").agg(F.min("y").alias("y"))
    total = keyed.count()
    if total > most:
        keyed = keyed.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(most / total * (1 << 20)))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(keyed), "id")


def logistic(x: np.ndarray, y: np.ndarray, weight: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps with a small ridge."""
    if not len(x):
        return 1.0, -2.0
    b = np.zeros(2)
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (p - y) + weight * len(x) * np.array([b[0] * 0.01, 0])
        hess = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + weight * len(x) * np.diag([0.01, 1e-9])
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> Lexicon:
    """A lexicon from labelled rows (1: toxic). Without labels, or with one class alone, it is empty.

    Term counts are combined in each task and then summed; what comes to the driver is the terms that pass the test, of
    which the training rows bound the number, and a number a training row (about `most`).
    """
    rows, _ = cut(docs.sparkSession, training_rows(docs, labels, label, id_col, text_col, most).repartition(24, "id"), "toxic-rows")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    if not n_t or not n_c:
        return Lexicon()

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for term in candidates(text):
                    seen.setdefault(term, [0, 0])[y] += 1
        terms = list(seen)
        yield pa.record_batch([pa.array(terms, pa.string()), pa.array([seen[t][1] for t in terms], pa.int64()), pa.array([seen[t][0] for t in terms], pa.int64())], names=["term", "t", "c"])

    counts = rows.select("text", "y").mapInArrow(tidy(count), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # As many distinct terms as a sample of this size has, on the safe side, are what chance may choose from.
    floor = 2 * math.log(50 * (n_t + n_c)) + 6
    strong = counts.where((F.col("t") >= MIN_ROWS) & (F.col("t") * n_c > 4 * F.col("c") * n_t) & (likelihood_ratio(F.col("t"), F.col("c"), n_t, n_c) > floor))
    odds = {r["term"]: math.log((r["t"] + 0.5) / (n_t + 1)) - math.log((r["c"] + 0.5) / (n_c + 1)) for r in strong.collect()}
    weights: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t), t)):
        heads = [term[:n] for n in range(5, len(term)) if term[:n] in weights]
        if not heads or odds[term] > max(weights[h] for h in heads) + 1.0:
            weights[term] = odds[term]
    lexicon = Lexicon(weights)
    lexicon.exceptions = _exceptions(rows, lexicon)
    sums = rows.select("text", "y").mapInArrow(tidy(_burdens(lexicon)), "x double, y int").toPandas()
    lexicon.slope, lexicon.offset = logistic(sums["x"].to_numpy(), sums["y"].to_numpy(float))
    lexicon.slope = max(lexicon.slope, 0.0)
    return lexicon


def _burdens(lexicon: Lexicon):
    def run(batches):
        found = lexicon.automaton()
        for batch in batches:
            yield pa.record_batch([pa.array([burden(found, t)[0] for t in batch.column("text").to_pylist()], pa.float64()), batch.column("y")], names=["x", "y"])

    return run


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Pairs of words, one of them a term, that occur in three clean rows or more and in no toxic one."""
    def run(batches):
        found = lexicon.automaton()
        seen: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                folded = fold(text)
                hits = matches(found, folded)
                words = folded.split() if hits else []
                for start, _ in hits:
                    k = folded.count(" ", 0, start)
                    seen.update((f"{words[i]} {words[i + 1]}", y) for i in (k - 1, k) if 0 <= i < len(words) - 1)
        pairs = list(seen)
        yield pa.record_batch([pa.array([p for p, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.int32()), pa.array([seen[p] for p in pairs], pa.int64())], names=["pair", "y", "n"])

    found = rows.select("text", "y").mapInArrow(tidy(run), "pair string, y int, n long").groupBy("pair").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    return sorted(r["pair"] for r in found.where((F.col("t") == 0) & (F.col("c") >= 3)).collect())


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_terms) of every row: the score of the whole text in 0..1, and how many terms matched.

    Null or empty texts match nothing and get the score of the curve at zero. Repeated rows get equal scores, null ids
    stay null, an empty table gives no rows. One narrow pass; the automaton is built once a task.
    """

    def run(batches):
        found = lexicon.automaton()
        for keys, texts in text_slices(batches):
            made = [burden(found, t) for t in texts]
            z = np.clip(lexicon.slope * np.array([m[0] for m in made]) + lexicon.offset, -500, 500)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(1 / (1 + np.exp(-z))), pa.array([m[1] for m in made], pa.int64())], names=["doc_id", "score", "n_terms"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "doc_id long, score double, n_terms long")


def clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is under the threshold, all columns as they are."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        found = _kept(lexicon)
        z = np.clip(lexicon.slope * np.array([burden(found, t or "")[0] for t in texts.to_pylist()]) + lexicon.offset, -500, 500)
        return pa.array(1 / (1 + np.exp(-z)))

    return docs.where(of(F.col(text_col).cast("string")) < threshold)


_AUTOMATA: dict[int, tuple] = {}


def _kept(lexicon: Lexicon):
    """The automaton of the lexicon of this task, made once."""
    key = id(lexicon)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = (lexicon, lexicon.automaton())
    return _AUTOMATA[key][1]

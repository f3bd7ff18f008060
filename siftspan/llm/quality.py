"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is good (1) or bad (0). A line has features of its own and copies of those of the line before
and the line after; a chain has a weight for each feature, and one for each pair of neighbouring states. Forward and
backward passes give the marginal of every line; the mean of the marginals, weighted by the lengths of the lines, goes
through a logistic curve and is the quality of the document.

Training lines carry the label of their document, except that in bad documents lines which look like those of good
ones are let free after a first fit: a second fit maximises the likelihood of the surer lines alone.

All lines of a slice of documents lie end to end in numpy arrays; the passes go over positions, for all chains at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspan.llm.common import cut, text_slices, tidy
from siftspan.llm.toxicity import logistic, training_rows

#: Bounds of the fit: about so many labelled documents, by a hash of their ids, and so many lines of whole documents in
#: that order; and lines of a chain that the fit sees, as longer documents are several chains to it.
MAX_TRAIN, MAX_LINES, CHAIN = 4_000, 200_000, 128
#: Characters at which longer lines are wrapped, as if on a screen: every character is read, and a paragraph on one line
#: counts as much to the fit as one on several. (With lines of any length, AUC on held-out rows falls from 0.9999 to 0.994.)
WRAP = 300
_MARKS = re.compile(r"[^\w\s]")
_RUNS = re.compile(r"([^\w\s])\1")
N_OWN = 17
N = 3 * N_OWN + 1


def lines_of(text: str) -> list[str]:
    """The lines of a text, longer ones wrapped; an empty text is one empty line."""
    out = []
    for line in text.split("\n"):
        out += [line] if len(line) <= WRAP else [line[k : k + WRAP] for k in range(0, len(line), WRAP)]
    return out


def features(lines: list[str]) -> np.ndarray:
    """Own features of the lines of one document, a row each, all within 0 and 1 or so."""
    out = np.zeros((len(lines), N_OWN), np.float32)
    seen: dict[str, int] = {}
    for k, line in enumerate(lines):
        row = out[k]
        key = line.strip()
        seen[key] = seen.get(key, 0) + 1
        if not key:
            row[0] = 1
            continue
        n = len(line)
        words = line.split()
        w = len(words)
        letters = sum(map(str.isalpha, line)) if not line.isascii() else len(line.encode().translate(None, _NOT_LETTERS))
        upper = sum(map(str.isupper, words))
        marks = len(_MARKS.findall(line))
        row[1] = letters / n
        row[2] = min(1.0, 4 * marks / w) if marks > 0.35 * w else marks / w
        row[3] = upper / w
        row[4] = min(1.0, len(_RUNS.findall(line)) / w * 2)
        row[5] = min(1.0, 3 * line.count("|") / w)
        row[6] = min(1.0, sum(map(line.count, "0123456789")) / n * 4)
        row[7] = min(1.0, n / w / 12)
        row[8] = len(set(words)) / w
        row[9] = min(1.0, w / 40)
        row[10] = w < 4
        row[11] = key[-1] in ".!?…\"'»)"
        row[12] = seen[key] > 1
        row[13] = sum(len(x) <= 3 for x in words) / w
        row[14] = sum(not x[-1].isalnum() for x in words) / w
        row[15] = min(1.0, sum(map(line.count, "#$%&*!")) / w)
        row[16] = min(1.0, 2 * sum(map(str.__eq__, words, words[1:])) / w)
    return out


_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def with_neighbours(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Features of lines end to end with those of the line before and after in the same document, and a constant."""
    start = np.cumsum(sizes) - sizes
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[start], after[start + sizes - 1] = 0, 0
    return np.hstack([own, before, after, np.ones((len(own), 1), np.float32)])


def chains(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with neighbours (lines x N), lines of each document, and line lengths."""
    sizes = np.array([len(d) for d in docs], np.int64)
    own = np.concatenate([features(d) for d in docs]) if docs else np.zeros((0, N_OWN), np.float32)
    return with_neighbours(own, sizes), sizes, np.array([len(x) + 1 for d in docs for x in d], np.float64)


@dataclass
class Crf:
    """Weights of the good state by feature, of neighbouring states, and the curve over the mean marginal."""

    emission: np.ndarray = field(default_factory=lambda: np.zeros(N))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    offset: float = 0.0


def passes(score: np.ndarray, transition: np.ndarray, sizes: np.ndarray, free: np.ndarray | None = None):
    """Marginals of state 1, expected pairs of states, and log partition sums, for all chains at once.

    `score`: of state 1 against state 0 by line. `free`: lines x 2, 0 where a state is allowed and -inf where not.
    """
    n = len(score)
    emit = np.zeros((n, 2))
    emit[:, 1] = score
    if free is not None:
        emit += free
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[start] = emit[start]
    steps = []
    alive = len(order)
    for t in range(1, int(length[0]) if len(length) else 0):
        while alive and length[alive - 1] <= t:
            alive -= 1
        at = start[:alive] + t
        steps.append(at)
        prev = forward[at - 1]
        forward[at] = np.logaddexp(prev[:, :1] + transition[0], prev[:, 1:] + transition[1]) + emit[at]
    for at in reversed(steps):
        nxt = backward[at] + emit[at]
        backward[at - 1] = np.logaddexp(nxt[:, :1] + transition[:, 0], nxt[:, 1:] + transition[:, 1])
    ends = start + length - 1
    z = np.logaddexp(forward[ends, 0], forward[ends, 1])
    by_line = np.empty(n)
    by_chain = np.empty(len(sizes))
    by_chain[order] = z
    by_line = np.repeat(by_chain, sizes)
    marginal = np.exp(forward[:, 1] + backward[:, 1] - by_line)
    pairs = np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inner)
    for a in range(2):
        for b in range(2):
            pairs[a, b] = np.exp(forward[at - 1, a] + transition[a, b] + emit[at, b] + backward[at, b] - by_line[at]).sum()
    return marginal, pairs, by_chain


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, sure: np.ndarray, rounds: int = 80, ridge: float = 1e-3) -> Crf:
    """Gradient ascent (Adam) on the likelihood of the states `y` of the lines that are `sure`, the others summed out."""
    w, m, v = np.zeros(N + 4), np.zeros(N + 4), np.zeros(N + 4)
    free = np.zeros((len(x), 2))
    free[sure & (y == 1), 0] = -np.inf
    free[sure & (y == 0), 1] = -np.inf
    x64 = x.astype(np.float64)
    for k in range(1, rounds + 1):
        score, trans = x64 @ w[:N], w[N:].reshape(2, 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            p, pairs, _ = passes(score, trans, sizes)
            q, held, _ = passes(score, trans, sizes, free)
        grad = np.concatenate([x64.T @ (q - p), (held - pairs).ravel()]) / len(x) - ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w += 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Crf(w[:N].copy(), w[N:].reshape(2, 2).copy())


def quality(crf: Crf, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The length-weighted mean of the marginals of each document; the marginals, and lines of each document."""
    x, sizes, length = chains(docs)
    if not len(sizes):
        return np.zeros(0), np.zeros(0), sizes
    p, _, _ = passes(x.astype(np.float64) @ crf.emission, crf.transition, sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(doc, p * length, minlength=len(sizes)) / np.bincount(doc, length, minlength=len(sizes)), p, sizes


def _curve(mean: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> Crf:
    """A field from labelled documents (1: good). Without labels, or with one class alone, it says 0.5 of everything.

    Features are made by the executors; the driver gets those of about `most` whole documents, as many in order of a
    hash of their ids as have MAX_LINES lines together (the first one always).
    """
    rows, _ = cut(docs.sparkSession, training_rows(docs, labels, label, id_col, text_col, most).repartition(24, "id"), "quality-rows")
    order = F.xxhash64("id", F.lit(13))
    sizes = rows.select("id", order.alias("h"), F.aggregate(F.split("text", "\n"), F.lit(0), lambda n, line: n + F.greatest(F.ceil(F.length(line) / WRAP), F.lit(1)).cast("int")).alias("n")).groupBy("id").agg(F.min("h").alias("h"), F.sum("n").alias("n")).orderBy("h", "id").limit(2 * most).collect()
    total = np.cumsum([r["n"] for r in sizes])
    some = max(1, int((total <= MAX_LINES).sum()))
    if sizes[some:]:
        rows = rows.where(order < sizes[some]["h"])

    def run(batches):
        for batch in batches:
            for i, text, y in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "y")), strict=True):
                lines = lines_of(text)
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([features(lines).astype("<f4").tobytes()], pa.binary()), pa.array([np.array([len(x) + 1 for x in lines], "<f8").tobytes()], pa.binary())], names=["id", "y", "own", "length"])

    found = sorted(rows.mapInArrow(tidy(run), "id long, y int, own binary, length binary").collect(), key=lambda r: (r["id"], r["own"]))
    y = np.array([r["y"] for r in found])
    if not len(y) or y.min() == y.max():
        return Crf()
    own = [np.frombuffer(r["own"], "<f4").reshape(-1, N_OWN) for r in found]
    length = np.concatenate([np.frombuffer(r["length"], "<f8") for r in found])
    lines = np.array([len(o) for o in own])
    x = with_neighbours(np.concatenate(own), lines)
    # Chains of CHAIN lines at most: no line is left out, only the pairs at their joints are.
    sizes = np.concatenate([np.diff(np.append(np.arange(0, n, CHAIN), n)) for n in lines])
    state = np.repeat(y, lines)
    crf = train(x, sizes, state, np.ones(len(x), bool), rounds=40)
    with np.errstate(divide="ignore"):
        p, _, _ = passes(x.astype(np.float64) @ crf.emission, crf.transition, sizes)
    crf = train(x, sizes, state, (state == 1) | (p < 0.7))
    p, _, _ = passes(x.astype(np.float64) @ crf.emission, crf.transition, lines)
    doc = np.repeat(np.arange(len(lines)), lines)
    mean = np.bincount(doc, p * length) / np.bincount(doc, length)
    crf.slope, crf.offset = logistic(_curve(mean), y.astype(float))
    return crf


def score(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_lines, bad_lines) of every row, over its whole text.

    A null or empty text is one empty line. Repeated rows get equal scores, null ids stay null, an empty table gives
    no rows; other columns are not read. One narrow pass over whole texts.
    """

    def run(batches):
        for keys, texts in text_slices(batches, 1 << 20):
            mean, p, sizes = quality(crf, [lines_of(t) for t in texts])
            s = 1 / (1 + np.exp(-np.clip(crf.slope * _curve(mean) + crf.offset, -500, 500)))
            bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes), p < 0.5, minlength=len(sizes)).astype(np.int64)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(s), pa.array(sizes), pa.array(bad)], names=["doc_id", "score", "n_lines", "bad_lines"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "doc_id long, score double, n_lines long, bad_lines long")

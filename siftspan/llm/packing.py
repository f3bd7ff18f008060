"""Packing of token sequences into windows of at most `size` tokens, in order, by dynamic programming.

The documents of a partition form one stream of tokens. Windows end at cut points: ends of documents (free), ends of
sentences (a small penalty, as the document is truncated there), ends of clauses (a larger one) and, only where two
cut points lie more than a window apart, any place between them (a large penalty). With cost(i) the least cost of packing the stream up to cut point i,

    cost(i) = penalty(i) + min over cut points j with 0 < i - j <= size of cost(j) + size - (i - j),

and since the term in j is cost(j) + j alone, the minimum over the sliding window of cut points comes from a monotone
queue: every point enters and leaves once. The stream is cut into buffers; what the last window of
a buffer holds is carried into the next one, so only the last window of a partition is left short.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siftspan.llm import bpe
from siftspan.llm.common import SLICE_BYTES, text_slices, tidy

SENTENCE, CLAUSE, INSIDE = 8, 12, 256  # penalties in tokens of padding of cuts after a sentence, a clause, any token
BUFFER = 1 << 18  # tokens that are packed together, and up to twice as many; a longer document is packed in parts
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, doc_row long"


def boundaries(tokens: list[str]) -> np.ndarray:
    """By token id: 1 if it ends a sentence or a line (a newline is U+010A in byte symbols), 2 a clause, else 0."""
    last = [t.removesuffix("</w>")[-1:] for t in tokens]
    return np.array([1 if c in (".", "!", "?", "Ċ", "。") else 2 if c in (",", ";", ":") else 0 for c in last], np.int8)


def cut_points(ends: np.ndarray, sentences: np.ndarray, size: int, clauses: np.ndarray = np.zeros(0, np.int64)) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending, with penalties. `ends`: of documents; the others are inside of them."""
    places, first = np.unique(np.concatenate([ends, sentences, clauses]).astype(np.int64), return_index=True)
    penalty = np.repeat([0, SENTENCE, CLAUSE], [len(ends), len(sentences), len(clauses)])[first]
    before = np.concatenate([[0], places[:-1]])
    wide = np.flatnonzero(places - before > size)
    if len(wide):
        more = np.concatenate([np.arange(before[k] + 1, places[k]) for k in wide])
        places, penalty = np.concatenate([places, more]), np.concatenate([penalty, np.full(len(more), INSIDE)])
        order = np.argsort(places, kind="stable")
        places, penalty = places[order], penalty[order]
    return places, penalty


def windows(places: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """The ends of the windows that cost least; the last one is the end of the stream. Its padding isn't counted,
    as what follows may fill it."""
    where, pen = [0, *places.tolist()], [0, *penalty.tolist()]
    n = len(where)
    total = where[-1]
    cost, best = [0] * n, [0] * n
    queue = deque([0])  # cut points by ascending cost + place
    key = [0] * n
    for i in range(1, n):
        at = where[i]
        while where[queue[0]] < at - size:
            queue.popleft()
        j = queue[0]
        best[i] = j
        cost[i] = key[j] + pen[i] + (size - at if at != total else 0)
        key[i] = k = cost[i] + at
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(i)
    # the last window is free of padding, so the cheapest start within reach counts by cost alone
    i, out = n - 1, []
    if n > 1:
        reach = [j for j in range(n - 2, max(-1, n - 2 - size), -1) if where[j] >= total - size]
        best[i] = min(reach, key=lambda j: (cost[j], j))
    while i > 0:
        out.append(where[i])
        i = best[i]
    return out[::-1]


def pack_stream(docs, kinds: np.ndarray, size: int, first_id: int, buffer: int = BUFFER):
    """Lists of pieces (doc_id, start, length, crc32, doc_tokens, sequence_id, offset, row) of (id, row, ids) in order.

    Every id of every document lies in one piece; pieces of a sequence are in stream order without gaps.
    """
    held: list[tuple] = []  # (id, row, ids, start): what is not packed yet
    tokens, sequence = 0, first_id

    def flush(last: bool) -> list[tuple]:
        """Packs up to two buffers of what is held. But at the very end, the last window is left for what comes next."""
        nonlocal held, tokens, sequence
        want, flat, ends = min(tokens, 2 * buffer), [], []
        for _, _, ids, start in held:
            flat.append(ids[start : start + want - (ends[-1] if ends else 0)])
            ends.append((ends[-1] if ends else 0) + len(flat[-1]))
            if ends[-1] == want:
                break
        kind = kinds[np.concatenate(flat)[: want - 1]]
        cuts = windows(*cut_points(np.array(ends), np.flatnonzero(kind == 1) + 1, size, np.flatnonzero(kind == 2) + 1), size)
        rows, k, at = [], 0, 0
        for end in cuts if last and want == tokens or len(cuts) < 2 else cuts[:-1]:
            offset = 0
            while at < end:
                doc_id, row, ids, start = held[k]
                done = start + at - (ends[k] - len(flat[k]))
                take = min(end, ends[k]) - at
                rows.append((doc_id, done, take, bpe.crc32(ids[done : done + take]), len(ids), sequence, offset, row))
                at += take
                offset += take
                k += at == ends[k]
            sequence += 1
        rest, left = [], at
        for doc_id, row, ids, start in held:
            gone = min(left, len(ids) - start)
            left -= gone
            if start + gone < len(ids):
                rest.append((doc_id, row, ids, start + gone))
        held, tokens = rest, tokens - at
        return rows

    for doc_id, row, ids in docs:
        held.append((doc_id, row, ids, 0))
        tokens += len(ids)
        while tokens >= buffer:
            yield flush(False)
    while tokens:
        yield flush(True)


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", max_codes: int | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces of every document in sequences of at most `size` tokens, in the order in which the rows are read.

    A document is the ids of its whole text and then `end_id`, so that a null or empty text is one token. Rows with
    the same id or text are packed each for itself (doc_row tells them apart within a partition). The stream of a
    partition is packed by its task alone: no shuffle, memory for the ids of one document and a few buffers of BUFFER
    tokens, and sequence ids that start at 2^33 times the partition's number. An empty table gives no rows. `max_codes` bounds
    the encoder's dictionaries and `slice_bytes` the texts that are encoded together: less takes less memory and more time.
    """

    def run(batches):
        coder = bpe.load(path, max_codes)
        kinds = boundaries(coder.tokens)

        def stream():
            row = 0
            for keys, texts in text_slices(batches, slice_bytes):
                flat, counts = coder.encode_batch(texts)
                ends = np.cumsum(counts)
                for key, e, n in zip(keys, ends, counts, strict=True):
                    yield key, row, np.append(flat[e - n : e], np.int32(end_id))
                    row += 1

        for rows in pack_stream(stream(), kinds, size, TaskContext.get().partitionId() << 33):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), SCHEMA)

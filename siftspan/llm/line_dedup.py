"""Deduplication of lines across documents by pairwise alignment.

A document is cut into units that end to end are its text: lines, within a line sentences, and within a sentence of more
than 24 words pieces of four words or more, which end after a clause or a word that a hash picks. As the words alone
say where pieces end, a passage has the same ones wherever it stands, within other sentences too. Sentences of fewer
than four words that follow one another on a line are one unit. Units are compared by a hash of their words. Each
character of a script that is written without spaces (Chinese, Japanese, Thai and others) counts as a word.

What two documents may share is found through runs: the least run of units with `min_words` words or more from each
unit on, and up to each unit that ends a line. A run's hash is that of its units. Single lines can be frequent, runs of them are rare;
where a run is frequent all the same, no cap is needed, as it makes one pair for each later document: that document
and the first one in order of ids which holds the run. So pairs grow with the text, never with the square of a group.

Each pair is aligned by patience diff over its shared runs: runs that occur once in either document are anchors, and
their longest increasing sequence (patience sorting) is the alignment. What it leaves, passages that were moved or that
occur several times, is aligned again, by as few increasing sequences as cover it. Runs of one sequence that touch make
a block, and the later document loses its blocks. A block lies in one pair: it is a stretch of consecutive units of
the later document that stands in the earlier one as well, and it has `min_words` words or more. Nothing is put together
from several earlier documents, and since runs cover such a stretch (but for less than the words of a unit at its end,
where that is no end of a line), every one goes.

Units of fewer than four words neither make nor break a block: runs are taken among all units with words, and among
the longer ones alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftspan.llm.common import cut, text_slices, tidy

MIN_WORDS = 20
SHORT = 4
#: Words of a sentence that is cut into pieces, of a piece at most, and of how many words a hash picks one to end a piece.
LONG, MOST, PICK = 24, 32, 5
#: Bytes of deletions that are sent to every task instead of bringing all texts to them: above, the join shuffles.
SEND_BYTES = 32 << 20
_END = re.compile(r"[.!?] |[。！？｡]|\n")
#: Characters of scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_LETTER = re.compile(_UNSPACED.pattern + r"\s*|[^\s" + _UNSPACED.pattern[1:] + r"+\s*")
_WORD = re.compile(r"\S+\s*")
#: An odd number whose powers weigh the units of a run, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CLAUSE = ",;:，、；："


class _Ends(dict):
    """Whether a piece may end with a word, by word; as many are kept as a worker has room for."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 1 << 17:
            self.clear()
        ends = self[word] = word[-1] in _CLAUSE or crc32(word.encode("utf-8", "surrogatepass")) % PICK == 0
        return ends


_ENDS = _Ends()


def sizes_of(words: list[str]) -> list[int]:
    """Words of the pieces of a long sentence."""
    ends = _ENDS
    out, last = [], 0
    for stop in [k for k, word in enumerate(words, 1) if ends[word]]:
        while stop - last > MOST:
            out.append(MOST)
            last += MOST
        if stop - last >= SHORT:
            out.append(stop - last)
            last = stop
    while len(words) - last > MOST:
        out.append(MOST)
        last += MOST
    rest = len(words) - last
    if rest >= SHORT or not out:
        out.append(rest)
    else:  # a short rest belongs to the piece before
        out[-1] += rest
    return out


def cut_text(text: str) -> tuple[list[int], list[int], list[str]]:
    """Ends, numbers of words and words between single spaces of the units of a text, which are end to end the text."""
    unspaced = not text.isascii() and _UNSPACED.search(text) is not None
    ends: list[int] = []
    sizes: list[int] = []
    said: list[str] = []
    at, n = 0, 0
    held: list[str] = []  # the words of short sentences that are not out yet, n of them
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end == at:
            break
        part = text[at:end]
        words = part.split()
        size = len(_UNSPACED.sub(" x ", part).split()) if unspaced else len(words)
        if size < SHORT:
            n += size
            held += words
            if end == len(text) or text[end - 1] == "\n":
                ends.append(end)
                sizes.append(n)
                said.append(" ".join(held))
                n, held = 0, []
            at = end
            continue
        if at and (not ends or ends[-1] < at):
            ends.append(at)
            sizes.append(n)
            said.append(" ".join(held))
            n, held = 0, []
        whole = " ".join(words)
        if size <= LONG:
            ends.append(end)
            sizes.append(size)
            said.append(whole)
        elif not unspaced and whole == (bare := part.lstrip()).rstrip():  # words between single spaces: ends are sums of lengths
            stop, first = end - len(bare), 0
            for k in sizes_of(words):
                piece = " ".join(words[first : first + k])
                first += k
                stop += len(piece) + 1
                ends.append(stop)
                sizes.append(k)
                said.append(piece)
            ends[-1] = end
        else:
            found = list((_LETTER if unspaced else _WORD).finditer(part))
            begin = first = 0
            for k in sizes_of([m[0].rstrip() for m in found]):
                first += k
                stop = found[first - 1].end() if first < len(found) else len(part)
                ends.append(at + stop)
                sizes.append(k)
                said.append(" ".join(part[begin:stop].split()))
                begin = stop
        at = end
    return ends, sizes, said


def units_of(text: str) -> list[tuple[int, int, int]]:
    """(end, words, hash) of the units of a text."""
    ends, sizes, said = cut_text(text)
    return list(zip(ends, sizes, map(xxhash.xxh64_intdigest, said), strict=True))


def runs(doc: np.ndarray, words: np.ndarray, hashes: np.ndarray, last_ones: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, hash) of the least runs of `min_words` words or more from each unit on and up to each of `last_ones`.

    Units, all with words, lie end to end for many documents (`doc`, ascending); no run spans two of them.
    """
    m = len(doc)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    start, end = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
    a = np.arange(m)
    e = np.searchsorted(sums, sums[:-1] + min_words, "left")
    s = np.searchsorted(sums, sums[1:] - min_words, "right") - 1
    on, up = e <= end, (s >= start) & last_ones
    code = np.unique(np.concatenate([a[on] * (m + 1) + e[on], s[up] * (m + 1) + a[up] + 1]))
    first, last = np.divmod(code, m + 1)
    with np.errstate(over="ignore"):
        power, inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m, x, np.uint64)])) for x in (_BASE, _INVERSE))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.astype(np.uint64) * power[:-1], dtype=np.uint64)])
        h = (total[last] - total[first]) * inverse[first]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_BASE)
    return first, last, h ^ (h >> np.uint64(29))


def increasing(places: list[int]) -> list[int]:
    """Numbers of the elements of the longest increasing sequence, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int] = []
    for k, a in enumerate(places):
        pile = bisect_left(tops, a)
        back.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(a)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = a, k
    k, out = top_at[-1] if top_at else -1, []
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned(rows: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, int]]:
    """Blocks (begin, end) of a document that are aligned with one earlier document.

    `rows`: (begin, end, hash, begin in the earlier document, whether it occurs there once) of the runs that both hold.
    """
    rows = sorted(rows)
    times = Counter(r[2] for r in rows)
    anchors = [k for k, r in enumerate(rows) if r[4] and times[r[2]] == 1]
    chain = [anchors[k] for k in increasing([rows[k][3] for k in anchors])]
    sequences = [chain]
    # The rest in as few increasing sequences as it takes: each run goes to the one that ends nearest before it.
    ends: list[int] = []  # ascending, as what they say is negated
    rest: list[list[int]] = []
    for k in sorted(set(range(len(rows))) - set(chain)):
        at = bisect_left(ends, -rows[k][3] + 1)
        if at == len(ends):
            ends.append(-rows[k][3])
            rest.append([k])
        else:
            ends[at] = -rows[k][3]
            rest[at].append(k)
    out = []
    for sequence in sequences + rest:
        last = None
        for k in sequence:
            begin, end = rows[k][:2]
            if last is not None and begin <= last[1]:
                last[1] = max(last[1], end)
            else:
                last = [begin, end]
                out.append(last)
    return [(b, e) for b, e in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as few that do not touch."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def shared_blocks(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """(doc, th, begins array<int>, ends array<int>): the spans of characters that a document loses; tables to unpersist.

    Tables that are read again stay on the executors' disks. Files of the shared folder would cost a process that the
    JVM starts for each of them (two with its checksum), which holds the JVM's memory once more until it runs.

    `doc` is the id, or a hash of the text where the id is null; th is xxhash64 of the text. Rows of equal id are never
    held against one another; those of different texts are told apart by th. Repeated rows of equal id and text count
    once, as runs are gathered as sets. Null texts have no units.
    """
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")).where(F.col("text").isNotNull())

    def cut_up(batches):
        for batch in batches:
            doc, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "th"))
            at = 0
            for keys, texts in text_slices([pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text")], names=["doc", "text"])]):
                n, ends, words, hashes, edges = [], [], [], [], []
                for text in texts:
                    stops, sizes, said = cut_text(text)
                    n.append(len(stops))
                    ends += stops
                    words += sizes
                    hashes += map(xxhash.xxh64_intdigest, said)
                    edges += [text[e - 1] == "\n" for e in stops]
                n, end, words = (np.array(x, np.int64) for x in (n, ends, words))
                hashes, edge = np.array(hashes, np.uint64), np.array(edges, bool)
                edge[np.cumsum(n)[n > 0] - 1] = True  # units that end a line or a text
                which = np.repeat(np.arange(len(texts)), n)
                begin = np.concatenate([[0], end[:-1]])[: len(end)]
                begin[(np.cumsum(n) - n)[n > 0]] = 0
                whole = np.flatnonzero(words > 0)
                first, last, h = runs(which[whole], words[whole], hashes[whole], edge[whole], min_words)
                parts = [(whole[first], whole[last - 1], h)]
                long_ones = np.flatnonzero(words >= SHORT)
                if len(long_ones) < len(whole):
                    first, last, h = runs(which[long_ones], words[long_ones], hashes[long_ones], edge[long_ones], min_words)
                    place = np.searchsorted(whole, long_ones)
                    gaps = place[last - 1] - place[first] > last - 1 - first  # other runs were found among all units
                    parts.append((long_ones[first[gaps]], long_ones[last[gaps] - 1], h[gaps]))
                first, last, h = (np.concatenate(c) for c in zip(*parts, strict=True))
                key = which[first] + at
                yield pa.record_batch([pa.array(doc[key]), pa.array(th[key]), pa.array(h.view(np.int64)), pa.array(begin[first].astype(np.int32)), pa.array(end[last].astype(np.int32))], names=["doc", "th", "run", "begin", "end"])
                at += len(keys)

    made = keyed.mapInArrow(tidy(cut_up), "doc long, th long, run long, begin int, end int").persist(StorageLevel.DISK_ONLY)
    # Holders are counted as their least and greatest, combined before the shuffle.
    holders = made.groupBy("run").agg(F.min("doc").alias("holder"), F.max("doc").alias("other")).where(F.col("holder") != F.col("other")).select("run", "holder")
    # Tables on both sides of the joins, so that Spark can split the rows of a run that many documents hold.
    holders = holders.persist(StorageLevel.DISK_ONLY)
    # Each run is one row of `holders`, so hash tables of their partitions are even; the many rows of `made` need no sort.
    held = made.join(holders.hint("shuffle_hash"), "run").persist(StorageLevel.DISK_ONLY)
    there = held.where(F.col("doc") == F.col("holder")).groupBy("run").agg(F.min("begin").alias("at"), F.max("begin").alias("to"), F.min("th").alias("one"), F.max("th").alias("two"))
    there = there.select("run", "at", ((F.col("at") == F.col("to")) & (F.col("one") == F.col("two"))).alias("once")).persist(StorageLevel.DISK_ONLY)
    later = held.where(F.col("doc") != F.col("holder")).join(there, "run")
    fields = ("holder", "begin", "end", "run", "at", "once")
    by_doc = later.groupBy("doc", "th").agg(F.collect_set(F.struct(*fields)).alias("rows"))

    def align(batches):
        for batch in batches:
            lists = batch.column("rows")
            flat = lists.flatten()
            holder, *rest = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(len(fields)))
            stops = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            spans = []
            for at, to in zip([0, *stops[:-1]], stops, strict=True):
                pairs: dict[int, list] = {}
                for h, *row in zip(holder[at:to].tolist(), *(c[at:to].tolist() for c in rest), strict=True):
                    pairs.setdefault(h, []).append(tuple(row))
                spans.append(merged([b for rows in pairs.values() for b in aligned(rows)]))
            yield pa.record_batch([batch.column("doc"), batch.column("th"), *(pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1))], names=["doc", "th", "begins", "ends"])

    return by_doc.mapInArrow(tidy(align), "doc long, th long, begins array<int>, ends array<int>"), [made, holders, held, there]


@F.arrow_udf(StringType())
def without(texts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
    """Texts without spans, which are in order and do not touch; a null text or null spans give null."""
    out = []
    for text, gone, to in zip(texts.to_pylist(), begins.to_pylist(), ends.to_pylist(), strict=True):
        out.append(None if text is None or gone is None else "".join(text[a:b] for a, b in zip([0, *to], [*gone, len(text)], strict=True)))
    return pa.array(out, pa.string())


def dedup(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without their repeated blocks, and columns `dropped_blocks` and `dropped_chars` (0: as it was).

    A document that an earlier one holds whole is left with an empty text (or with its short units outside of blocks).
    Null texts stay null; a null id stands after or before others by a hash of the text; repeated rows of equal id and
    text are treated alike, and columns of `docs` keep their names and order (columns of `docs` called dropped_blocks
    or dropped_chars are replaced); an empty table gives no rows. The deletions meet the texts by key: where they are
    small (SEND_BYTES, checked) they are sent to the texts, otherwise both are shuffled.
    """
    blocks, held = shared_blocks(docs, min_words, id_col, text_col)
    found, _ = cut(spark, blocks, "lines-blocks")
    for table in held:
        table.unpersist()
    size = found.agg(F.coalesce(F.sum(F.size("begins") * 8 + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    found = found.select(F.struct("doc", "th").alias("key"), "begins", "ends")
    kept = [c for c in docs.columns if c not in ("dropped_blocks", "dropped_chars")]
    text = F.col(text_col).cast("string")
    # The columns of `docs` travel in one struct, so that none of their names can clash.
    keyed = docs.select(F.struct(*kept).alias("row"), F.struct(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("doc"), F.xxhash64(text).alias("th")).alias("own"), text.alias("whole"))
    joined = keyed.join(F.broadcast(found) if size <= SEND_BYTES else found, F.col("own") == F.col("key"), "left")
    # Only texts that lose something go through Python: the others are null to it.
    new = F.coalesce(without(F.when(F.col("begins").isNotNull(), F.col("whole")), F.col("begins"), F.col("ends")), F.col("row")[text_col])
    lost = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0), lambda n, x: n + x)
    return joined.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in kept], F.when(F.col("begins").isNull(), 0).otherwise(F.size("begins")).alias("dropped_blocks"), F.coalesce(lost, F.lit(0)).alias("dropped_chars"))

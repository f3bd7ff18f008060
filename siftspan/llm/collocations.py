"""Collocations by suffix sorting (Suffix-sigma): one shuffle of truncated suffixes counts phrases of all lengths.

Every word occurrence is the head of a suffix of its piece, cut off after `max_n` words. Tasks add equal suffixes of a
slice of texts up before they are dealt out by language and first word; partitions are sorted in reverse order, in
which the suffixes that a prefix begins lie together, and one stack of open prefixes counts all of them in a single
pass. First words that hold more than 1 / SHARE of all words are dealt by their second word too, pairs that do by
their third; their counts come in parts, one a partition, which are summed. Which ones those are comes from a pass of
its own over the texts; it decides where suffixes go, not what they count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspan.llm.common import cut, text_slices, tidy

#: Bytes of text whose suffixes are added up together, and the share of all words from which a phrase is dealt finer.
SLICE, SHARE = 4 << 20, 1024
#: Rows of a language are ranked in so many parts first.
RANK_PARTS = 64

#: What a byte is: 0 of a word, 1 between words, 2 between pieces; and its lower case.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of the word of each occurrence, and of the piece that it lies in."""
    whole = "\n".join(texts).encode("utf-8", "surrogatepass").translate(LOWER)
    kind = KIND[np.frombuffer(whole, np.uint8)]
    edge = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2)[start] if len(start) else start
    # Words and what lies between them, by turns, are one array over the bytes.
    bounds = np.empty(2 * len(start) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = start, end, len(whole)
    both = pa.Array.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(bounds), pa.py_buffer(whole)])
    found = both.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
    return found.dictionary.cast(pa.binary()), np.asarray(found.indices).astype(np.int64), piece


def by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(language, its texts) of slices of (language, text) batches; a null language is `und`."""
    for langs, texts in text_slices(batches, SLICE):
        rows: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts, strict=True):
            rows.setdefault("und" if lang is None else lang, []).append(text)
        yield from rows.items()


def heavy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n): words and pairs with at least 1 / SHARE of the words of a slice, and the number of words with a null phrase."""
    for lang, texts in by_language(batches):
        names, codes, piece = words_of(texts)
        if not len(codes):
            continue
        phrases, sizes = [None], [len(codes)]
        inner = piece[1:] == piece[:-1]
        for keys, joined in ((codes, False), ((codes[:-1] * len(names) + codes[1:])[inner], True)):
            found, n = np.unique(keys, return_counts=True)
            often = n * SHARE >= len(codes)
            for key, size in zip(found[often].tolist(), n[often].tolist(), strict=True):
                parts = divmod(key, len(names)) if joined else (key,)
                phrases.append(b" ".join(names[i].as_py() for i in parts))
                sizes.append(size)
        yield pa.record_batch([pa.array([lang] * len(sizes)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())], names=["lang", "phrase", "n"])


def suffixes(hot: dict[str, list[str]], max_n: int):
    """For mapInArrow: (suffix, n, depth) of slices; depth is the number of words by which a suffix is dealt out.

    A suffix is the quoted language, a line break, and up to `max_n` words with a space after each: with that, all
    suffixes that a prefix begins are neighbours in byte order.
    """

    def run(batches):
        for lang, texts in by_language(batches):
            names, codes, piece = words_of(texts)
            if not len(codes):
                continue
            size = len(names)
            place = {name: i for i, name in enumerate(names.to_pylist())} if hot.get(lang) else {}
            known = [[place.get(w.encode(), -1) for w in phrase.split(" ")] for phrase in hot.get(lang, [])]
            hot_words = np.array([k[0] for k in known if len(k) == 1 and k[0] >= 0], np.int64)
            hot_pairs = np.array([a * size + b for a, b in (k for k in known if len(k) == 2) if a >= 0 and b >= 0], np.int64)
            # The word at each step after the head, -1 past the end of the piece.
            at = np.full((max_n, len(codes)), -1, np.int64)
            at[0] = codes
            for k in range(1, max_n):
                at[k, :-k] = np.where(piece[k:] == piece[:-k], codes[k:], -1)
            keys, bound = codes, size
            for k in range(1, max_n):
                if bound > (1 << 62) // (size + 1):
                    seen, keys = np.unique(keys, return_inverse=True)
                    bound = len(seen)
                keys, bound = keys * (size + 1) + at[k] + 1, bound * (size + 1)
            _, first, n = np.unique(keys, return_index=True, return_counts=True)
            at = at[:, first]
            depth = np.ones(len(first), np.int32)
            depth[np.isin(at[0], hot_words)] = 2
            if max_n > 1 and len(hot_pairs):
                depth[(at[1] >= 0) & np.isin(at[0] * size + at[1], hot_pairs)] = 3
            spaced = pa.concat_arrays([pc.binary_join_element_wise(names, b"", b" "), pa.array([b""], pa.binary())])
            parts = [spaced.take(pa.array(np.where(row < 0, size, row))) for row in at]
            whole = pc.binary_join_element_wise(pa.scalar(quote(lang).encode() + b"\n", pa.binary()), *parts, b"")
            yield pa.record_batch([whole.cast(pa.string()), pa.array(n), pa.array(depth)], names=["suffix", "n", "depth"])

    return tidy(run)


def stack(max_n: int, least: int):
    """For mapInArrow over sorted (suffix, n, depth): (lang, k, phrase, f, part) of all prefixes.

    The stack holds the prefixes that the last suffix has open, and their counts; a batch is one numpy step: a
    prefix closes where the next suffix differs within it. Those that occur fewer than `least` times are left out,
    unless their suffixes are dealt over several partitions (`part`). k = 0 is the number of words, without a phrase.
    """

    def run(batches):
        last: list = [None] * max_n  # words of the last suffix
        open_: list = [0] * max_n  # counts of its prefixes
        deep = 0
        totals: dict[str, int] = {}

        def rows(levels, phrases, counts, parts):
            head = [p.split("\n", 1) for p in phrases]
            return pa.record_batch([pa.array([unquote(h[0]) for h in head], pa.string()), pa.array(levels, pa.int32()), pa.array([h[1] for h in head], pa.string()), pa.array(counts, pa.int64()), pa.array(parts, pa.bool_())], names=["lang", "k", "phrase", "f", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            n, depth = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            split = pc.split_pattern(batch.column(0), " ")
            flat, offset = split.flatten(), np.asarray(split.offsets).astype(np.int64)
            offset = offset - offset[0]
            size = np.diff(offset) - 1  # words; what is after the last space is empty
            changed = np.zeros(len(n), bool)
            out = []
            words = []
            for k in range(max_n):
                here = size > k
                w = flat.take(pa.array(np.where(here, offset[:-1] + k, 0), mask=~here))
                words.append(w)
                before = pa.concat_arrays([pa.array([last[k]], w.type), w.slice(0, len(w) - 1)])
                changed = changed | ~np.asarray(pc.fill_null(pc.equal(w, before), False))
                # Rows with fewer words have no prefix of this length; those of one prefix are neighbours.
                start = np.flatnonzero(changed)
                sums = np.add.reduceat(n, np.append(0, start[start > 0]))
                if not changed[0]:
                    sums[0] += open_[k]
                elif last[k] is not None and (open_[k] >= least or deep > k + 1):
                    out.append((k, [" ".join(last[: k + 1])], [open_[k]], [deep > k + 1]))
                begin = np.append(0, start[start > 0])
                closed = (here[begin]) & ((sums >= least) | (depth[begin] > k + 1))
                closed[-1] = False  # the last one is open
                chosen = begin[closed]
                if len(chosen):
                    phrases = pc.binary_join_element_wise(*[x.take(pa.array(chosen)) for x in words], " ").to_pylist()
                    out.append((k, phrases, sums[closed].tolist(), (depth[chosen] > k + 1).tolist()))
                open_[k] = int(sums[-1]) if here[-1] else 0
            head = words[0]
            lang = pc.list_element(pc.split_pattern(head, "\n"), 0).dictionary_encode()
            for name, total in zip(lang.dictionary.to_pylist(), np.bincount(np.asarray(lang.indices), n).astype(np.int64).tolist(), strict=True):
                totals[name] = totals.get(name, 0) + total
            last = [w[len(n) - 1].as_py() for w in words]
            deep = int(depth[-1])
            for k, phrases, counts, parts in out:
                yield rows([k + 1] * len(phrases), phrases, counts, parts)
        for k in range(max_n):
            if last[k] is not None and (open_[k] >= least or deep > k + 1):
                yield rows([k + 1], [" ".join(last[: k + 1])], [open_[k]], [deep > k + 1])
        yield rows([0] * len(totals), [f"{name}\n" for name in totals], list(totals.values()), [True] * len(totals))

    return tidy(run)


def frequencies(spark: SparkSession, docs: DataFrame, max_n: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, k, phrase, f): phrases of 1 to `max_n` words that occur `least` times or more; k = 0 has the number of words.

    Words are lower-cased in A-Z alone and lie in pieces between the marks of a sentence and line breaks, which no
    phrase crosses. A null language is `und`, a null text empty. Repeated rows count as often as they are there; other
    columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    seen = rows.mapInArrow(tidy(heavy), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    seen, _ = cut(spark, seen, "collocation-heavy")
    total = seen.where(F.col("phrase").isNull()).agg(F.sum("n")).first()[0] or 0
    # At most SHARE words and as many pairs can hold so much.
    hot: dict[str, list[str]] = {}
    for r in seen.where(F.col("phrase").isNotNull() & (F.col("n") * SHARE >= F.lit(total))).collect():
        hot.setdefault(r["lang"], []).append(r["phrase"])
    found = rows.mapInArrow(suffixes(hot, max_n), "suffix string, n long, depth int")
    dealt = found.repartition(F.expr("substring_index(suffix, ' ', depth)")).sortWithinPartitions(F.col("suffix").desc())
    counted, _ = cut(spark, dealt.mapInArrow(stack(max_n, least), "lang string, k int, phrase string, f long, part boolean"), "collocation-counts")
    parts = counted.where("part").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))
    return counted.where("not part").drop("part").unionByName(parts)


def score(counts: DataFrame, inside: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates in `counts`: phrases of two words or more.

    Of all cuts after k words, the one with the lowest floor(1000000 a a / (l r)) counts, ties to the smallest k;
    decimals of 38 digits hold the products exactly. Candidates whose words lie within a longer one that occurs at
    least `inside` percent as often are dropped.
    """
    words = F.split("phrase", " ")
    whole = counts.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))

    def part(a, b):
        return F.array_join(F.slice("w", a, b), " ")

    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("c"))
    known = counts.where("k > 0").select(F.col("lang").alias("of"), F.col("phrase").alias("named"), "f")
    left = cuts.select("lang", "phrase", "a", "c", part(F.lit(1), F.col("c")).alias("left"), part(F.col("c") + 1, F.size("w") - F.col("c")).alias("right"))
    left = left.join(known, (F.col("lang") == F.col("of")) & (F.col("left") == F.col("named"))).withColumnRenamed("f", "l").drop("of", "named")
    both = left.join(known, (F.col("lang") == F.col("of")) & (F.col("right") == F.col("named"))).withColumnRenamed("f", "r")
    exact = [F.col(x).cast("decimal(19,0)").alias(f"_{x}") for x in ("a", "l", "r")]
    ratio = F.expr("(cast(1000000 as decimal(7,0)) * cast(_a * _a as decimal(31,0))) div (_l * _r)")
    lowest = both.select("*", *exact).select("lang", "phrase", "a", F.struct(ratio.alias("score"), "c", "l", "r").alias("s")).groupBy("lang", "phrase", "a").agg(F.min("s").alias("s"))
    steps = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    longer = whole.where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(steps)).alias("phrase"), F.col("a").alias("above")).groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("above").isNull() | (F.col("above") * 100 < F.col("a") * inside))
    return kept.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("s.score").alias("score"))


def collocations(spark: SparkSession, docs: DataFrame, max_n: int = 3, least: int = 10, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` collocations of each language, by score, frequency and phrase.

    Ranks within RANK_PARTS parts of a language come first, so that no task ranks all phrases of one.
    """
    counts, _ = cut(spark, frequencies(spark, docs, max_n, least, lang_col, text_col), "collocation-frequencies")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    scored = score(counts).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    near = scored.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top).drop("_part", "_rank")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

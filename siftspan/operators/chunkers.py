"""Chunkers: documents (doc_id, text, ...) to chunks (chunk_id, doc_id, chunk_index, content, ...), one to many.

The fixed chunker is expressions alone. The recursive one folds over pieces, which expressions do with copies that grow
as the square of a text's chunks, and the structure-aware one walks lines in order: both work on offsets in Arrow
batches. The semantic chunker embeds groups of sentences by an expression or a pandas UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspan.functions.text import sentences, strip
from siftspan.functions.vector import cosine, embed

#: Separators in the order in which they are tried.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")


def _windows(size: int, overlap: int, length: Column) -> Column:
    stride = max(1, size - overlap)
    return F.filter(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(stride)), lambda s: (s == 0) | (s - stride + size < length))


def fixed_chars(docs: DataFrame, size: int = 512, overlap: int = 64, strip_text: bool = True) -> DataFrame:
    """Windows of characters over the stripped text; blank ones go, and the index counts the others."""
    text = strip(F.col("text")) if strip_text else F.col("text")
    rows = docs.select("doc_id", text.alias("t")).where(F.length("t") > 0)
    starts = _windows(size, overlap, F.length("t"))
    parts = F.transform(starts, lambda s: F.struct(s.alias("char_start"), F.least(s + size, F.length("t")).alias("char_end"), (strip(F.substring(F.col("t"), s + 1, F.lit(size))) if strip_text else F.substring(F.col("t"), s + 1, F.lit(size))).alias("content")))
    kept = F.filter(parts, lambda p: strip(p["content"]) != "")
    out = rows.select("doc_id", F.posexplode(kept).alias("chunk_index", "p"))
    return out.select(F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "p.content", "p.char_start", "p.char_end", F.lit("fixed").alias("chunking_strategy"))


def fixed_tokens(docs: DataFrame, size: int = 512, overlap: int = 64, encode: Callable[[str], list] | None = None, decode: Callable[[list], str] | None = None) -> DataFrame:
    """Windows of tokens. Without a tokenizer, tokens are words between white space, joined by single spaces."""
    if encode is None:
        rows = docs.select("doc_id", F.filter(F.split("text", r"\s+"), lambda t: t != "").alias("t")).where(F.size("t") > 0)
        parts = F.transform(_windows(size, overlap, F.size("t")), lambda s: F.struct(s.alias("token_start"), F.least(s + size, F.size("t")).alias("token_end"), F.array_join(F.slice("t", s + 1, size), " ").alias("content")))
        out = rows.select("doc_id", F.posexplode(parts).alias("chunk_index", "p")).select("doc_id", "chunk_index", "p.*")
    else:
        kind = docs.schema["doc_id"].dataType.simpleString()

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            stride = max(1, size - overlap)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    ids, k = encode(text or ""), 0
                    for s in range(0, len(ids), stride):
                        content = decode(ids[s : s + size]).strip()
                        if content:
                            rows.append((doc_id, k, s, min(s + size, len(ids)), content))
                            k += 1
                        if s + size >= len(ids):
                            break
                yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "token_start", "token_end", "content"])

        out = docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, chunk_index int, token_start int, token_end int, content string")
    return out.select(F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "content", "token_start", "token_end", F.lit("fixed").alias("chunking_strategy"))


def pieces_of(text: str, size: int, overlap: int, separators: tuple[str, ...], keep: bool = True) -> Iterator[tuple[int, int]]:
    """Spans of the pieces of a text that are not blank: cut at the first separator that they hold until they fit.

    What holds no separator is cut into windows; the one that reaches the end is the last. Kept separators end a piece.
    """
    todo = [(0, len(text), 0)]  # spans that lie ahead, the next one last, with the separators that were tried on them
    while todo:
        begin, end, level = todo.pop()
        if end - begin <= size:
            if text[begin:end].strip():
                yield begin, end
            continue
        while level < len(separators) and text.find(separators[level], begin, end) < 0:
            level += 1
        if level == len(separators):
            for at in range(begin, end, max(1, size - overlap)):
                if text[at : min(at + size, end)].strip():
                    yield at, min(at + size, end)
                if at + size >= end:
                    break
            continue
        mark, inner, at = separators[level], [], begin
        while (found := text.find(mark, at, end)) >= 0:
            inner.append((at, found + len(mark) if keep else found, level + 1))
            at = found + len(mark)
        todo += reversed([*inner, (at, end, level + 1)])


def merged_chunks(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, keep: bool = True) -> list[str]:
    """Pieces put together while they fit; the next chunk begins with the last `overlap` characters of the one before."""
    out: list[str] = []
    parts: list[str] = []
    length = 0
    for begin, end in pieces_of(text, size, overlap, separators, keep):
        if parts and length + end - begin > size:
            out.append("".join(parts))
            parts = [out[-1][-overlap:]] if overlap else []
            length = sum(map(len, parts))
        parts.append(text[begin:end])
        length += end - begin
    return [*out, "".join(parts)] if parts else out


def recursive(docs: DataFrame, size: int = 512, overlap: int = 64, separators: tuple[str, ...] = SEPARATORS, keep_separator: bool = True) -> DataFrame:
    """Pieces cut at the first separators until they fit, merged greedily, the last `overlap` characters carried over.

    A chunk can be longer than `size` by the characters carried over. Chunks are stripped; blank ones go, and the index
    counts them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[c.strip() for c in merged_chunks(t or "", size, overlap, separators, keep_separator)] for t in batch.column("text").to_pylist()]
            kept = [(row, k, c) for row, chunks in enumerate(made) for k, c in enumerate(chunks) if c]
            rows, index, content = zip(*kept, strict=True) if kept else ((), (), ())
            yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(content, pa.string())], names=["doc_id", "chunk_index", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, chunk_index int, content string")
    return out.select(F.concat_ws("_recchunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "content", F.lit("recursive").alias("chunking_strategy"))


def sentence_groups(docs: DataFrame, buffer: int = 1) -> DataFrame:
    """(doc_id, n, pos, sentence, grouped): sentences with their neighbours within `buffer`, joined by spaces."""
    rows = docs.select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("s")).where(F.size("s") > 0)
    group = F.transform(F.col("s"), lambda x, k: F.struct(k.alias("pos"), x.alias("sentence"), F.array_join(F.slice("s", F.greatest(k - buffer, F.lit(0)) + 1, F.least(k + buffer, F.size("s") - 1) - F.greatest(k - buffer, F.lit(0)) + 1), " ").alias("grouped")))
    return rows.select("doc_id", F.size("s").alias("n"), F.explode(group).alias("g")).select("doc_id", "n", "g.*")


def breakpoints(docs: DataFrame, percentile: float = 90.0, buffer: int = 1, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """(doc_id, n, pos, sentence, distance, threshold, segment): where consecutive groups are far apart, a segment ends."""
    by = W.partitionBy("doc_id").orderBy("pos")
    rows = sentence_groups(docs, buffer).withColumn("v", embedder(F.col("grouped")))
    # The last sentence has no distance, also where its group has no words (its vector is zero, to which all are at 1).
    rows = rows.withColumn("next", F.lead("v").over(by)).withColumn("distance", F.when(F.col("next").isNotNull(), F.round(1.0 - cosine(F.col("v"), F.col("next")), 6))).drop("v", "next")
    rows = rows.withColumn("threshold", F.expr(f"percentile(distance, {percentile / 100.0})").over(W.partitionBy("doc_id")))
    ends = F.coalesce((F.col("distance") >= F.col("threshold")).cast("int"), F.lit(0))
    return rows.withColumn("segment", F.coalesce(F.sum(ends).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int"))


def semantic(docs: DataFrame, percentile: float = 90.0, min_size: int = 50, max_size: int = 2000, buffer: int = 1, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """Segments of `breakpoints`; one shorter than `min_size` joins the one before, one longer than `max_size` is cut.

    A document of at most one sentence stays as it is, under its own id and without chunk columns.
    """
    seg = breakpoints(docs, percentile, buffer, embedder).where(F.col("n") > 1).groupBy("doc_id", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda p: p["sentence"]), " ").alias("content"), F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"))
    lists = seg.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("segment", "content", "s", "e"))).alias("segs"))
    kind = "array<struct<content:string,s:int,e:int>>"

    def fold(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        short = (F.length(p["content"]) < min_size) & (n > 0)
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, n - 1), F.array(F.struct(F.concat_ws(" ", last["content"], p["content"]).alias("content"), last["s"].alias("s"), last["e"].alias("e"))))
        size = F.length(p["content"])
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(max_size)), lambda k: F.struct(F.substring(p["content"], k + 1, F.lit(max_size)).alias("content"), p["s"].alias("s"), p["e"].alias("e")))
        return F.when(short, joined).otherwise(F.concat(acc, cuts))

    folded = lists.select("doc_id", F.posexplode(F.aggregate("segs", F.array().cast(kind), fold)).alias("chunk_index", "p"))
    many = folded.select(F.concat_ws("_semchunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "p.content", F.col("p.s").alias("sentence_start"), F.col("p.e").alias("sentence_end"), F.lit("semantic").alias("chunking_strategy"))
    one = docs.where(F.size(sentences(F.coalesce("text", F.lit("")))) <= 1).select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.lit(None).cast("int").alias("chunk_index"), F.col("text").alias("content"), F.lit(None).cast("int").alias("sentence_start"), F.lit(None).cast("int").alias("sentence_end"), F.lit(None).cast("string").alias("chunking_strategy"))
    return many.unionByName(one)


#: What opens a heading, a list item and a table row.
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_ITEM = re.compile(r"\s*[-*+]|\d+\.\s")
_ROW = re.compile(r"\|.*\|")


def _opens(line: str) -> str:
    """The kind of block that a line begins: code, heading, table, list, quote, or none for a paragraph or blank line."""
    if line.strip().startswith("```"):
        return "code"
    for kind, form in (("heading", _HEADING), ("table", _ROW), ("list", _ITEM)):
        if form.match(line):
            return kind
    return "quote" if line.startswith(">") else ""


def _goes_on(kind: str, line: str) -> bool:
    """Whether a line belongs to the block of that kind before it."""
    if kind == "code":
        return not line.strip().startswith("```")
    if kind == "table":
        return bool(_ROW.match(line))
    if kind == "list":
        return bool(_ITEM.match(line)) or (line.startswith("  ") and line.strip() != "")
    if kind == "quote":
        return line.strip() != ""
    return kind == "paragraph" and line.strip() != "" and not _opens(line)


def blocks_of(text: str) -> list[tuple[str, str, int, int, int]]:
    """(type, content, level, first line, last line) of the structural blocks of a text; blank lines belong to none.

    A fence reaches to the next one, which it includes, or to the end. An item begins with a mark, or in the first
    column with a number, a full stop and white space; two spaces continue it. A quote goes on to the next blank line.
    """
    lines = text.split("\n")
    found, k = [], 0
    while k < len(lines):
        kind = _opens(lines[k]) or ("paragraph" if lines[k].strip() else "")
        first, k = k, k + 1
        if not kind:
            continue
        while k < len(lines) and _goes_on(kind, lines[k]):
            k += 1
        if kind == "code":
            k = min(k + 1, len(lines))
        level = len(_HEADING.match(lines[first])[1]) if kind == "heading" else 0
        found.append((kind, "\n".join(lines[first:k]), level, first, k - 1))
    return found


def assemble(blocks: list[tuple[str, str, int, int, int]], size: int = 512, preserve: bool = True, headings: bool = True) -> list[str]:
    """Chunks of blocks: a heading opens one, and where the next block does not fit a new one begins with the last heading.

    Code and tables are never cut, and what holds one beyond the size is closed at once, without the heading for what
    follows. Blocks that aren't preserved count two characters more, for the blank line.
    """
    out: list[str] = []
    current: list[str] = []
    heading, used = "", 0
    for kind, content, *_ in blocks:
        whole = preserve and kind in ("code", "table")
        extra = len(content) + (0 if whole or kind == "heading" else 2)
        if current and (kind == "heading" or used + extra > size):
            out.append("\n\n".join(current))
            current = [heading] if heading and kind != "heading" else []
            used = sum(map(len, current))
        if kind == "heading" and headings:
            heading = content
        current.append(content)
        used += extra
        if whole and used > size:
            out.append("\n\n".join(current))
            current, used = [], 0
    return [*out, "\n\n".join(current)] if current else out


def structured(docs: DataFrame, size: int = 512, preserve: bool = True) -> DataFrame:
    """Structure-aware chunks of texts with headings, fences, tables, lists and quotes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, c.strip()) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for k, c in enumerate(assemble(blocks_of(t or ""), size, preserve)) if c.strip()]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content"])

    out = docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, chunk_index int, content string")
    return out.select(F.concat_ws("_dachunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "content", F.lit("document_aware").alias("chunking_strategy"))


def chunk(docs: DataFrame, strategy: str = "recursive", size: int = 512, overlap: int = 64) -> DataFrame:
    """By name: fixed, recursive, semantic (min max(50, size // 4), max size) or document_aware."""
    if strategy == "fixed":
        return fixed_chars(docs, size, overlap)
    if strategy == "recursive":
        return recursive(docs, size, overlap)
    if strategy == "semantic":
        return semantic(docs, min_size=max(50, size // 4), max_size=size)
    if strategy == "document_aware":
        return structured(docs, size)
    raise ValueError(f"no such chunker: {strategy}")

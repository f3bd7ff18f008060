"""Alignment of the tokens of two tokenizers over the same bytes, with counts of linked ids over the whole corpus.

Both tokenizers cut before a space that follows something else than white space, whatever comes before or after: no
piece of the second holds a space after another character, no match of the first's split pattern does. So a text falls
into units that are encoded and aligned by themselves, and each distinct unit is aligned once for all places where it
occurs. Over the units, all is relational: tokens by posexplode, running sums of their lengths as ends, the ends of
both sides matched on (unit, end), windows that carry a token back over the ends within it. Each distinct end closes
the one stretch that its A and its B token share, so the ends are the links, without any pairs of tokens being tried;
an end of both sides is a cut, and the cuts number the groups. Only the text of the groups is written out by batch.

A text is the sequence of its units. Slices of texts keep a dictionary of their units, and a unit's row says which
slices hold it and under what code; it travels to each of them, where texts add the rows of their units up. So that no
row grows with the corpus, a unit has a row of its own for every LOT input splits.
"""

from __future__ import annotations

from functools import cache, reduce
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.llm.common import cut, remove, setting, short_shuffles, text_slices, tidy

#: Bytes of text of a slice, and units that are encoded together.
SLICE, UNITS = 32 << 20, 20_000
#: Input splits whose slices one row of a unit names, as a power of two.
LOT = 10
#: Rows of units that are put together by slice before they travel.
PACK_ROWS = 1 << 19
#: Shares of the units, which are brought together and later joined one after the other, and of the slices, as they meet
#: their rows: what is shuffled at once is that share of all, and the shuffle's files go with the pass.
SHARES, SUMS = 4, 2
#: What a document's row adds up from its units.
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Pairs of ids that are sent to the links at once; more of them are joined by a shuffle.
SEND_PAIRS = 1 << 19
SPACE = "▁"
#: Ends in something that is surely not white space to either tokenizer.
SOLID = r"[\p{L}\p{N}\p{P}\p{S}\p{M}]$"
#: Characters that both tokenizers are known to keep; units with others are tried when texts are cut.
KNOWN = r"^[\t\n\r -~\x{A1}-\x{24F}]*$"


class Pair:
    """Both encoders, by the places of their files: a byte-level one (tokenizers, A) and one of pieces (sentencepiece, B)."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        from siftspan.llm.bpe import byte_symbols

        of = {c: i for i, c in enumerate(byte_symbols())}
        size = self.a.get_vocab_size(with_added_tokens=True)
        strings = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in strings]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or self.b.encode("a", out_type=str) != [SPACE + "a"]:
            raise ValueError(f"{b}: pieces must not go on after a space, and a text must get a space before it")
        if [t for t, _ in self.a.pre_tokenizer.pre_tokenize_str(" a b'c  d")] != ["Ġa", "Ġb", "'", "c", "Ġ", "Ġd"]:
            raise ValueError(f"{a}: not a byte-level file that splits before spaces")
        self.lone = self.b.piece_to_id(SPACE)
        self.names = tuple(pa.array(names, pa.large_binary()) for names in (self.a_bytes, self.b_bytes))
        # Each id of A, then of B, with the sign after it: in a group, then where its side of the group is over.
        signed = [f"{i}{sign}" for names, signs in zip(self.names, (",|", ",;"), strict=True) for sign in signs for i in range(len(names))]
        self.signed = pa.array(signed, pa.large_string())

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of units, each of which begins with a space (to B, the one that it adds itself)."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        return a, [x or [self.lone] for x in b]

    def kept(self, units: list[str]) -> list[bool]:
        """Whether the bytes of both sides' tokens are those of the unit."""
        a, b = self.encode(units)
        return [b"".join(map(self.a_bytes.__getitem__, x)) == u.encode() == b"".join(map(self.b_bytes.__getitem__, y)) for u, x, y in zip(units, a, b, strict=True)]


@cache
def load(a: str, b: str) -> Pair:
    """The encoders of a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pair(a, b)


def units_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of texts (a space before each), the number of the unit of each occurrence, and units of each text.

    An empty text has none.
    """
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    parts = split.flatten().dictionary_encode()
    names, code = parts.dictionary, np.asarray(parts.indices).astype(np.int64)
    per = np.asarray(pc.list_value_length(split)).astype(np.int64)
    per[[not t for t in texts]] = 0
    code = code[np.repeat([bool(t) for t in texts], np.asarray(pc.list_value_length(split)))]
    solid = np.asarray(pc.match_substring_regex(names, SOLID), bool)
    first = np.cumsum(per) - per
    begins = np.zeros(len(code), bool)
    if len(code):
        begins[1:] = solid[code[:-1]]
        begins[first[per > 0]] = True
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(code)))
    unit = code[start]
    extra: dict[str, int] = {}
    long = np.flatnonzero(length > 1)
    if len(long):
        inside = code[np.repeat(length > 1, length)]
        rows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[long])), pa.int32()), names.take(pa.array(inside)).cast(pa.string()))
        for i, joined in zip(long.tolist(), pc.binary_join(rows, " ").to_pylist(), strict=True):
            unit[i] = len(names) + extra.setdefault(joined, len(extra))
    seen, unit = np.unique(unit, return_inverse=True)
    known = names.take(pa.array(seen[seen < len(names)])).to_pylist()
    added = list(extra)
    strings = [" " + s for s in [*known, *(added[i - len(names)] for i in seen[seen >= len(names)].tolist())]]
    sums = np.append(0, np.cumsum(begins))
    return strings, unit, sums[first + per] - sums[first]


def sliced(docs: DataFrame, a: str, b: str, id_col: str, text_col: str) -> DataFrame:
    """Of slices of texts: rows with kind 0 (slice, doc_id, codes of the units in order) and 1 up to SHARES, by the unit
    (slice, code, unit, n occurrences).

    A text with a unit whose bytes are not those of its tokens has no codes, and its units are not counted.
    """

    def run(batches):
        pair = load(a, b)
        base = TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(text_slices(batches, SLICE)):
            strings, unit, per = units_of(texts)
            odd = np.flatnonzero(~np.asarray(pc.match_substring_regex(pa.array(strings, pa.string()), KNOWN), bool)).tolist() if strings else []
            doc = np.repeat(np.arange(len(texts)), per)
            if odd:
                bad = np.zeros(len(strings), bool)
                bad[[i for i, ok in zip(odd, pair.kept([strings[i] for i in odd]), strict=True) if not ok]] = True
                lost = np.zeros(len(texts), bool)
                lost[doc[bad[unit]]] = True
                unit, per = unit[~lost[doc]], np.where(lost, 0, per)
            n = np.bincount(unit, minlength=len(strings))
            ends = np.cumsum(per)
            flat = unit.astype("<i4")
            codes = [flat[e - m : e].tobytes() for e, m in zip(ends, per, strict=True)]
            used = np.flatnonzero(n)
            rows, more = len(texts), len(used)
            yield pa.record_batch([
                pa.array(np.repeat([0, 1], [rows, more]), pa.int32()), pa.array(np.full(rows + more, base + k), pa.int64()), pa.array([*ids, *[None] * more], pa.int64()),
                pa.array([*codes, *[None] * more], pa.binary()), pa.array(np.concatenate([np.zeros(rows, np.int64), used]), pa.int32()),
                pa.array([*[None] * rows, *map(strings.__getitem__, used.tolist())], pa.string()), pa.array(np.concatenate([np.zeros(rows, np.int64), n[used]]), pa.int64()),
            ], names=["kind", "slice", "doc_id", "codes", "code", "unit", "n"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(tidy(run), "kind int, slice long, doc_id long, codes binary, code int, unit string, n long")
    return found.withColumn("kind", F.when(F.col("kind") > 0, F.pmod(F.xxhash64("unit"), F.lit(SHARES)).cast("int") + 1).otherwise(0))


def laid_out(strings: pa.LargeStringArray) -> tuple[np.ndarray, memoryview]:
    """Where strings that aren't null begin, and at last end, in the bytes of all of them."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return at, memoryview(data if data is not None else b"")


def encoded(units: DataFrame, a: str, b: str, k: int = 0) -> DataFrame:
    """(uid, n, places, n_a, tokens) of (unit, n, places): the tokens of A, then of B, each as bytes << 32 | id.

    uid is a number that the cut of this table fixes; tables of the same corpus have different `k`, under SHARES, and so
    no uid in common.
    """
    apart = max(SHARES, k + 1)

    def run(batches):
        pair = load(a, b)
        at = TaskContext.get().partitionId() * apart + k << 33
        for batch in batches:
            for first in range(0, batch.num_rows, UNITS):
                part = batch.slice(first, UNITS)
                start, text = laid_out(part.column(0).cast(pa.large_string()))
                whole, sizes, tokens = text[start[0] : start[-1]], [], []
                for lists, names in zip(pair.encode(part.column(0).to_pylist()), pair.names, strict=True):
                    sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
                    ids = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes[-1].sum()))
                    end, said = laid_out(names.take(pa.array(ids)))
                    if said[: end[-1]] != whole:
                        raise ValueError("tokens of a unit of common characters don't give its bytes")
                    tokens.append(np.diff(end) << 32 | ids)
                of = np.concatenate([2 * np.repeat(np.arange(len(sizes[0])), sizes[0]), 2 * np.repeat(np.arange(len(sizes[1])), sizes[1]) + 1])
                flat = np.concatenate(tokens)[np.argsort(of, kind="stable")]
                rows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[0] + sizes[1])), pa.int32()), pa.array(flat))
                uid = np.arange(at, at := at + part.num_rows)
                yield pa.record_batch([pa.array(uid), part.column(1), part.column(2), pa.array(sizes[0].astype(np.int32)), rows], names=["uid", "n", "places", "n_a", "tokens"])

    return units.mapInArrow(tidy(run), "uid long, n long, places array<struct<of: long, code: int>>, n_a int, tokens array<long>")


#: Spark's own switch: lists are collected over rows that a window has sorted, which hashing would sort once more.
HASHED_LISTS = "spark.sql.execution.useObjectHashAggregateExec"


def linked(units: DataFrame) -> DataFrame:
    """(uid, n, links array<struct<end, a, b, last_a, last_b, back>>): of each unit all pairs of tokens that overlap.

    `last_a` and `last_b` say which of the two tokens end there; both do at a cut. `back` numbers the groups from the
    last one: it is the running count of cuts from the end of the unit.
    """
    # One shuffle by unit serves the running sums, the ends and the links. Units are sorted before they are many rows: what
    # the windows sort is nearly in order then.
    tokens = units.repartition("uid").sortWithinPartitions("uid").select("uid", "n", "n_a", F.posexplode("tokens").alias("pos", "token"))
    tokens = tokens.selectExpr("uid", "n", "pos >= n_a AS of_b", "pos", "cast(token & 4294967295 AS int) AS id", "shiftright(token, 32) AS size")
    ends = tokens.selectExpr("uid", "n", "of_b", "id", "sum(size) OVER (PARTITION BY uid, of_b ORDER BY pos) AS end")
    met = ends.groupBy("uid", "end").agg(F.max("n").alias("n"), F.max(F.when(~F.col("of_b"), F.col("id"))).alias("own_a"), F.max(F.when(F.col("of_b"), F.col("id"))).alias("own_b"))
    filled = met.selectExpr(
        "uid", "n", "end", "own_a IS NOT NULL AS last_a", "own_b IS NOT NULL AS last_b",
        "cast(sum(if(own_a IS NOT NULL AND own_b IS NOT NULL, 1, 0)) OVER (PARTITION BY uid ORDER BY end DESC) AS int) AS back",
        "last(own_a, true) OVER (PARTITION BY uid ORDER BY end DESC) AS a", "last(own_b, true) OVER (PARTITION BY uid ORDER BY end DESC) AS b",
    )
    return filled.groupBy("uid").agg(F.max("n").alias("n"), F.collect_list(F.struct("end", "a", "b", "last_a", "last_b", "back")).alias("links"))


def written(links: DataFrame, a: str, b: str) -> DataFrame:
    """(uid, n, n_a, n_b, n_groups, n_links, groups, links) of `linked` rows: the text of a unit's groups, `a1,a2|b1;a3|b2;`,
    and its links as A's id << 32 | B's."""

    def run(batches):
        pair = load(a, b)
        for batch in batches:
            n_links = np.asarray(pc.list_value_length(batch.column(2))).astype(np.int64)
            end, *ids, last_a, last_b, back = (np.asarray(x) if x.type != pa.bool_() else x.to_numpy(zero_copy_only=False) for x in batch.column(2).flatten().flatten())
            unit = np.repeat(np.arange(batch.num_rows), n_links)
            cut, last = last_a & last_b, (last_a, last_b)
            n_a, n_b, n_groups = (np.bincount(unit[x], minlength=batch.num_rows) for x in (*last, cut))
            # Ids that end, each with its sign, by unit, group, side and end.
            sign = [x[f].astype(np.int64) + len(names) * cut[f] for x, f, names in zip(ids, last, pair.names, strict=True)]
            side = np.repeat([0, 1], [len(x) for x in sign])
            end, group, unit = (np.concatenate([x[last_a], x[last_b]]) for x in (end, -back, unit))
            order = np.lexsort((end, side, group, unit))
            starts, said = laid_out(pair.signed.take(pa.array(np.concatenate([sign[0], sign[1] + 2 * len(pair.names[0])])[order])))
            bounds = starts[np.append(0, np.cumsum(n_a + n_b))]
            groups = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(bounds), pa.py_buffer(said)).cast(pa.string())
            found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_links)), pa.int32()), pa.array(ids[0].astype(np.int64) << 32 | ids[1]))
            yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, (n_a, n_b, n_groups, n_links)), groups, found], names=["uid", "n", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return links.mapInArrow(tidy(run), "uid long, n long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>")


def pairs(units: DataFrame) -> DataFrame:
    """(link, a, b, count, best): links that hold an id pair in the whole corpus, and whether no pair of its B id has more."""
    counted = units.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count"))
    counted = counted.select("link", F.shiftright("link", 32).cast("int").alias("a"), F.col("link").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "count")
    most = counted.groupBy(F.col("b").alias("of")).agg(F.max("count").alias("most"))
    return counted.join(most, F.col("b") == F.col("of")).select("link", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def summed(units: DataFrame, links: DataFrame, counted: DataFrame, send: bool) -> DataFrame:
    """(of, code, NUMBERS, groups): of each unit a row for every slice that holds it; with `send`, pairs go to all links."""
    counted = counted.select("link", "count", F.col("best").cast("long").alias("best"))
    each = links.select("uid", F.explode("links").alias("link"))
    sums = each.join(F.broadcast(counted) if send else counted, "link").groupBy("uid").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    return units.select("uid", "places").join(links.drop("n", "links"), "uid").join(sums, "uid").select(F.inline("places"), *NUMBERS, "groups")


def by_place(numbers: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then the next ones and so on: high bytes are mostly zero, and compress as a run."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def from_places(body: memoryview, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)


def packed(rows: DataFrame) -> DataFrame:
    """(of, rows binary) from (of, code, NUMBERS, groups): the rows of a slice that a task has, by column and compressed."""

    def blobs(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).sort_by([("of", "ascending"), ("code", "ascending")]).combine_chunks()
        of, code = np.asarray(table["of"]), np.asarray(table["code"])
        numbers = np.stack([np.asarray(table[c]) for c in NUMBERS])
        at, text = laid_out(pa.concat_arrays(table["groups"].chunks).cast(pa.large_string()))
        sizes = np.diff(at).astype("<i4")
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
        bodies = [
            np.int64(j - i).astype("<i8").tobytes() + by_place(np.diff(code[i:j], prepend=np.int32(0)).astype("<i4")) + by_place(sizes[i:j])
            + by_place(numbers[:, i:j].ravel().astype("<i8")) + bytes(text[at[i] : at[j]])
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=False)
        ]
        squeeze = zstandard.ZstdCompressor()
        return pa.record_batch([pa.array(of[first], pa.int64()), pa.array([squeeze.compress(b) for b in bodies], pa.binary())], names=["of", "rows"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield blobs(held)
                held, n = [], 0
        if n:
            yield blobs(held)

    return rows.mapInArrow(tidy(run), "of long, rows binary")


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The numbers (by code, then by NUMBERS) and the texts of groups of a slice's units by code."""
    codes, numbers, texts = [], [], []
    for blob in blobs:
        body = memoryview(zstandard.ZstdDecompressor().decompress(blob))
        n = int(np.frombuffer(body, "<i8", 1)[0])
        codes.append(np.cumsum(from_places(body, "<i4", n, 8), dtype=np.int64))
        ends = np.append(0, np.cumsum(from_places(body, "<i4", n, 8 + 4 * n), dtype=np.int64))
        numbers.append(from_places(body, "<i8", n * len(NUMBERS), 8 + 8 * n).reshape(len(NUMBERS), n).T)
        data = pa.py_buffer(body[8 + (8 + 8 * len(NUMBERS)) * n :])
        texts.append(pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), data))
    if not codes:
        return np.zeros((0, len(NUMBERS)), np.int64), pa.array([], pa.large_string())
    code = np.concatenate(codes)
    place = np.zeros(int(code.max()) + 1, np.int64)
    place[code] = np.arange(len(code))
    return np.concatenate(numbers)[place], pa.concat_arrays(texts).take(pa.array(place))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def added(texts: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(doc_id, NUMBERS, groups_sha256) of the texts in the k-th share of the slices: `texts(slice, doc_id, codes)`, and `packed` rows."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        values, text = unpacked(right["rows"].to_pylist())
        totals, hashes = np.zeros((left.num_rows, len(NUMBERS)), np.int64), []
        for i, raw in enumerate(left["codes"].to_pylist()):
            at = np.frombuffer(raw, "<i4")
            totals[i] = values[at].sum(axis=0)
            ends, said = laid_out(text.take(pa.array(at)))
            hashes.append(sha256(said[: ends[-1] - 1]).hexdigest() if len(at) else "")
        return pa.table([left["doc_id"], *[pa.array(totals[:, c]) for c in range(len(NUMBERS))], pa.array(hashes, pa.string())], names=["doc_id", *NUMBERS, "groups_sha256"])

    columns = ", ".join(f"{c} long" for c in ("doc_id", *NUMBERS))
    share = lambda of: F.pmod(F.xxhash64(of), F.lit(SUMS)) == k
    return texts.where(share("slice")).groupBy("slice").cogroup(rows.where(share("of")).groupBy("of")).applyInArrow(add, f"{columns}, groups_sha256 string")


def align(spark: SparkSession, docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables of a corpus: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, and `pairs`.

    Texts that are null or empty, or whose bytes the tokens of either side don't give, have no tokens: zeros and an
    empty string. Repeated rows count as often as they are there; null ids stay null; an empty table gives no rows;
    other columns are not read.
    """
    with short_shuffles(spark):
        slices, slices_path = cut(spark, sliced(docs, a, b, id_col, text_col), "align-slices", "kind", "zstd")
        units, links, paths = [], [], []
        for k in range(SHARES):
            here = slices.where(F.col("kind") == k + 1)
            distinct = here.groupBy("unit", F.shiftright("slice", 32 + LOT).alias("lot")).agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col("slice").alias("of"), "code")).alias("places"))
            df, path = cut(spark, encoded(distinct.select("unit", "n", "places"), a, b, k), "align-units", None, "zstd")
            # The strings and places are in the units' table now; the texts are read from what is left of the slices.
            remove(spark, f"{slices_path}/kind={k + 1}")
            with setting(spark, HASHED_LISTS, "false"):
                met, links_path = cut(spark, written(linked(df.drop("places")), a, b), "align-links", None, "zstd")
            units.append(df)
            links.append(met)
            paths.append((path, links_path))
        counted, _ = cut(spark, pairs(together(links)), "align-pairs")
        send = counted.count() <= SEND_PAIRS
        rows = []
        for df, met, gone in zip(units, links, paths, strict=True):
            rows.append(cut(spark, packed(summed(df, met, counted, send)), "align-rows", None, "uncompressed")[0])
            for path in gone:
                remove(spark, path)
        texts = spark.read.schema(slices.schema).parquet(slices_path).where("kind = 0").select("slice", "doc_id", "codes")
        # The last share is computed when the result is.
        done = [cut(spark, added(texts, together(rows), k), "align-docs", None, "zstd")[0] for k in range(SUMS - 1)]
    return together([*done, added(texts, together(rows), SUMS - 1)]), counted

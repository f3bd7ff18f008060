"""SimHash fingerprints and near-duplicates by a grid join over segment popcounts.

A fingerprint is cut into equal segments and mapped to the vector of their bit counts. Two fingerprints that differ in
d bits have vectors at Manhattan distance d at most, so the distance is a lower bound. Vectors lie in a grid of cells
of some counts a side; a fingerprint is copied to the cells of smaller number that it could reach within the radius,
cells are joined in blocks, and every pair that meets is verified by its differing bits. Equal fingerprints are one row
before the join, so groups of copies cost nothing there. More segments make more copies and let fewer pairs meet; which
grid costs least depends on how many fingerprints there are (`grid`), the result does not.

Where a radius is too wide for any grid to leave something out, links also ask for a Jaccard similarity of the shingles:
the cells are then classes of the number of shingles, as similar sets have similar sizes, and what the fingerprints
link are candidates alone. A second fingerprint, of other bits of the same hashes, keeps texts apart that are near in
the first one by chance; among many texts those chances would join all candidates to one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.llm.cells import linked
from siftspan.llm.common import cut, text_slices, tidy

BLOCK = 65536
#: Grids to choose from, as (segments, counts of a cell's side), and what a copy and a compared pair cost, in seconds.
GRIDS = ((4, 2), (8, 2), (16, 2))
COPY, PAIR = 3e-6, 3e-9
#: Rows of a block in joins by the number of shingles, and of shingles themselves.
SIZE_BLOCK, SHINGLE_BLOCK = 16384, 4096
#: Shingles whose bits are counted at once.
PART = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the runs of `words` words of a whole text in parts, repeats included: see `fingerprints`."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split cuts at 0x20 and 0x09 to 0x0D
    if not parts:
        return
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        yield np.array([digest(joined, 42)], "<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(parts) - words + 1
    for at in range(0, n, PART):
        to = min(n, at + PART)
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist(), strict=True)], "<u8")


def fingerprint(text: str, words: int = 4) -> int:
    """The SimHash of a whole text: see `fingerprints`."""
    n, bits = 0, np.zeros(64, np.int64)
    for h in shingles(text, words):
        n += len(h)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, bits long) of every row: the fingerprint as a signed long.

    The text is lower-cased in A-Z alone and cut into words at ASCII white space; h is XXH64 (seed 42) of each run of
    `words` words, repeats included, or of the whole sequence if it is shorter; a bit is 1 if it is set in over half
    of the h. Null, empty or blank texts have fingerprint zero. Null ids stay null; other columns are not read.
    """

    def run(batches):
        for keys, texts in text_slices(batches):
            prints = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(prints)], names=["doc_id", "bits"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "doc_id long, bits long")


def _costs(size: int, width: int, radius: int) -> list[np.ndarray]:
    """By steps -m .. m to another cell of one coordinate: the least change that takes a count there, 0 .. `size` counts
    long; one more than the radius where there is no cell."""
    count = np.arange(size + 1)
    low, most = count // width * width, -(-radius // width)
    out = []
    for s in range(-most, most + 1):
        cost = count - low + (-s - 1) * width + 1 if s < 0 else low + s * width - count if s else 0 * count
        there = count // width + s
        out.append(np.where((there < 0) | (there > size // width), radius + 1, cost))
    return out


def estimate(segments: int, width: int, radius: int) -> tuple[float, float]:
    """Copies of a fingerprint of random bits, and the share of other ones that it meets."""
    size = 64 // segments
    chance = np.array([comb(size, k) for k in range(size + 1)], float) / 2.0**size
    costs = _costs(size, width, radius)
    most = len(costs) // 2
    cells = np.array([chance[k * width : (k + 1) * width].sum() for k in range(size // width + 1)])
    copies, meets = np.zeros(radius + 1), np.zeros(radius + 1)
    for s, cost in enumerate(costs):
        for k in np.flatnonzero(cost <= radius):
            copies[cost[k]] += chance[k]
            meets[cost[k]] += chance[k] * cells[k // width + s - most]
    total = []
    for one in (copies, meets):
        sums = np.eye(1, radius + 1)[0]
        for _ in range(segments):
            sums = np.convolve(sums, one)[: radius + 1]
        total.append(float(sums.sum()))
    return total[0] / 2, total[1]


def grid(n: int, radius: int) -> tuple[int, int]:
    """Segments and width of the cheapest grid for `n` fingerprints."""
    def cost(g: tuple[int, int]) -> float:
        copies, meets = estimate(*g, radius)
        return n * copies * COPY + n * n / 2 * meets * PAIR

    return min(GRIDS, key=cost)


def cells_of(prints: DataFrame, radius: int, segments: int, width: int) -> DataFrame:
    """(id, home, cell) of each print `id`: its own cell, and the cells of smaller number within the radius."""
    size = 64 // segments
    side = size // width + 1
    costs = _costs(size, width, radius)

    def place(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for at in range(0, len(ids), 2048):
                part = ids[at : at + 2048].view(np.uint64)
                row, cell, left = np.arange(len(part)), np.zeros(len(part), np.int64), np.full(len(part), radius)
                own = np.zeros(len(part), np.int64)
                for k in range(segments):
                    count = np.bitwise_count((part >> np.uint64(k * size)) & np.uint64((1 << size) - 1)).astype(np.int64)
                    own += count // width * side**k
                    states = []
                    for s, cost in enumerate(costs):
                        rest = left - cost[count[row]]
                        on = rest >= 0
                        states.append((row[on], cell[on] + (count[row[on]] // width + s - len(costs) // 2) * side**k, rest[on]))
                    row, cell, left = (np.concatenate(c) for c in zip(*states, strict=True))
                keep = cell <= own[row]
                row, cell = row[keep], cell[keep]
                yield pa.record_batch([pa.array(part.view(np.int64)[row]), pa.array(cell == own[row]), pa.array(cell)], names=["id", "home", "cell"])

    return prints.select("id").mapInArrow(tidy(place), "id long, home boolean, cell long")


def _finder(radius: int, name: str = "id", also: tuple[str, int] | None = None):
    """`find` of `cells.linked`: fingerprints `name` that differ in at most `radius` bits, and those of `also` in as many."""

    def find(a: pa.Table, b: pa.Table):
        x, y = (t.column(name).to_numpy().view(np.uint64) for t in (a, b))
        others = [t.column(also[0]).to_numpy().view(np.uint64) for t in (a, b)] if also else None
        step = max(1, (1 << 16) // max(1, len(y)))
        mixed, counts = np.empty((step, len(y)), np.uint64), np.empty((step, len(y)), np.uint8)
        for at in range(0, len(x) if len(y) else 0, step):
            k = min(step, len(x) - at)
            np.bitwise_xor(x[at : at + k, None], y[None, :], out=mixed[:k])
            np.bitwise_count(mixed[:k], out=counts[:k])
            i, j = np.nonzero(counts[:k] <= radius)
            if others and len(i):
                near = np.bitwise_count(others[0][i + at] ^ others[1][j]) <= also[1]
                i, j = i[near], j[near]
            if len(i):
                yield i + at, j

    return find


def links(spark: SparkSession, prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_links) and (node, component) of distinct fingerprints `id` that differ in at most `radius` bits."""
    segments, width = grid(prints.count(), radius)
    return linked(spark, cells_of(prints, radius, segments, width), BLOCK, _finder(radius), "simhash")


def sized_links(spark: SparkSession, prints: DataFrame, radius: int, second: int, jaccard: float) -> DataFrame:
    """(node, component) of the `key` of `prints(key, bits, more, n)`: at most `radius` bits apart in `bits` and `second`
    in `more`, and sets of n shingles each whose sizes allow the similarity. Classes of sizes grow by 1 / jaccard, so a
    partner is in the next one at most. A key that two pairs of fingerprints share only joins their candidates."""
    step = 1 / jaccard * (1 + 1e-9)
    edges = [1.0]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * step)

    def place(batches):
        for batch in batches:
            home = np.searchsorted(edges, batch.column("n").to_numpy(), "right")  # 0: without shingles
            i = np.concatenate([np.arange(len(home)), np.flatnonzero(home > 1)])
            own = np.arange(len(i)) < len(home)
            yield pa.record_batch([*(batch.column(c).take(pa.array(i)) for c in ("key", "bits", "more")), pa.array(own), pa.array(home[i] - ~own)], names=["id", "bits", "more", "home", "cell"])

    rows = prints.select("key", "bits", "more", "n").mapInArrow(tidy(place), "id long, bits long, more long, home boolean, cell long").distinct()
    return linked(spark, rows, SIZE_BLOCK, _finder(radius, "bits", ("more", second)), "simhash")[1]


def alike(spark: SparkSession, texts: DataFrame, radius: int, words: int, jaccard: float) -> DataFrame:
    """(node, component) of the `th` of `texts(th long, text, bits long, cell long)`: links are within a cell.

    Texts link if their fingerprints differ in at most `radius` bits and their sets of shingles have a Jaccard
    similarity of `jaccard` or more; sets without shingles are equal. Pairs that links join already are not verified.
    """

    def sets(batches):
        for batch in batches:
            found = [np.unique(np.concatenate([np.empty(0, "<u8"), *shingles(t.as_py() or "", words)])).view(np.int64) for t in batch.column("text")]
            at = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *found]))
            yield pa.record_batch([batch.column("th"), batch.column("bits"), batch.column("cell"), pa.ListArray.from_arrays(pa.array(at), flat)], names=["id", "bits", "cell", "shingles"])

    def find(a: pa.Table, b: pa.Table):
        if not len(a) or not len(b):
            return
        x, y = (t.column("bits").to_numpy().view(np.uint64) for t in (a, b))
        lists = [t.column("shingles").chunk(0) for t in (a, b)]
        flat = [np.asarray(v.flatten()) for v in lists]
        n, m = (np.asarray(v.value_lengths(), np.int64) for v in lists)
        left, right = (np.split(f, np.cumsum(k)[:-1]) for f, k in zip(flat, (n, m), strict=True))
        ids, label = np.unique(np.concatenate([t.column("id").to_numpy() for t in (a, b)]), return_inverse=True)
        one, two = label[: len(a)], label[len(a) :]
        label = np.arange(len(ids))
        for i in range(len(x) if len(y) else 0):
            near = (np.bitwise_count(y ^ x[i]) <= radius) & (np.minimum(m, n[i]) >= jaccard * np.maximum(m, n[i]))
            for j in np.flatnonzero(near & (label[two] != label[one[i]])).tolist():
                p, q = label[one[i]], label[two[j]]
                if p == q:
                    continue
                both = len(np.intersect1d(left[i], right[j], assume_unique=True))
                if both >= jaccard * (n[i] + m[j] - both):
                    label[label == max(p, q)] = min(p, q)
                    yield np.array([i]), np.array([j])

    rows = texts.mapInArrow(tidy(sets), "id long, bits long, cell long, shingles array<long>").withColumn("home", F.lit(True))
    rows, _ = cut(spark, rows, "shingles")
    return linked(spark, rows, SHINGLE_BLOCK, find, "alike")[1]


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits, component_id) of every row: the smallest id reachable by links of at most `radius` bits.

    Repeated rows and equal texts share a fingerprint and so a component; texts without words all have fingerprint
    zero and are linked like any other. A component of null ids alone has a null component_id. The join sees each
    distinct fingerprint once; components come back by a join on the fingerprint, which AQE splits where one
    fingerprint holds many rows. An empty table gives no rows.
    """
    prints, _ = cut(spark, fingerprints(docs, id_col, text_col, words), "prints")
    least, _ = cut(spark, prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "prints-least")
    _, found = links(spark, least.select(F.col("bits").alias("id")), radius)
    member = least.join(found.select(F.col("node").alias("bits"), "component"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    ids = member.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(member.join(ids, "component").select("bits", "component_id"), "bits").select("doc_id", "bits", "component_id")


def sized_prints(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(th, bits, more, n) of the distinct texts: xxhash64 of the text, its fingerprint, one of the same hashes after a
    multiplication that mixes their bits, and how many distinct shingles it has."""

    def run(batches):
        for keys, texts in text_slices(batches):
            made: list[tuple[int, int, int]] = []
            for t in texts:
                n, parts = 0, []
                bits = np.zeros((2, 64), np.int64)
                for h in shingles(t, words):
                    n += len(h)
                    parts.append(h)
                    for row, x in enumerate((h, mixed(h))):
                        bits[row] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                one, two = (int(np.packbits(b * 2 > n, bitorder="little").view("<u8")[0]) for b in bits)
                made.append((one, two, len(np.unique(np.concatenate([np.empty(0, "<u8"), *parts])))))
            bits, more = (pa.array(np.array([m[k] for m in made], np.uint64).view(np.int64)) for k in (0, 1))
            yield pa.record_batch([pa.array(keys, pa.int64()), bits, more, pa.array([m[2] for m in made], pa.int64())], names=["th", "bits", "more", "n"])

    text = F.col(text_col).cast("string")
    made = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(tidy(run), "th long, bits long, more long, n long")
    return made.groupBy("th").agg(*[F.min(c).alias(c) for c in ("bits", "more", "n")])


def mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits from each hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def keep_one(spark: SparkSession, docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text", jaccard: float = 0.0, second: int = 64) -> DataFrame:
    """The rows of `docs`, one for each component: the row of its smallest id.

    Components are those of links of at most `radius` bits between fingerprints of `words` words, with `jaccard` of
    those links whose shingles are that similar, and whose second fingerprints differ in at most `second` bits. Texts without words are one component. Of the rows of a component, the
    first by id (nulls last), then by a hash of the text stays: a shared id or a null one does not make rows one. Same
    columns, which may have any names; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    prints, _ = cut(spark, sized_prints(docs, text_col, words).withColumn("key", F.xxhash64("bits", "more") if jaccard else F.col("bits")), "prints")
    if jaccard:
        found = sized_links(spark, prints, radius, second, jaccard)
    else:
        found = links(spark, prints.select(F.col("bits").alias("id")).distinct(), radius)[1]
    named = prints.join(found.select(F.col("node").alias("key"), "component"), "key", "left").select("th", "bits", F.coalesce("component", "key").alias("cell"))
    if jaccard:
        several = named.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("cell")
        texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).join(named.join(several, "cell"), "th").dropDuplicates(["th"])
        found = alike(spark, texts.select("th", "text", "bits", "cell"), radius, words, jaccard)
        named = named.join(found.select(F.col("node").alias("th"), "component"), "th", "left").select("th", F.coalesce("component", "th").alias("cell"))
    # One row of each component, and one of the rows that repeat it. Null ids are told apart, so that keys are equal as they are.
    own = [F.col(id_col).cast("long").isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("own"), F.xxhash64(text).alias("th")]
    ids = docs.select(*own).groupBy("th").agg(F.min(F.struct("none", "own")).alias("first"))
    firsts = named.join(ids, "th").groupBy("cell").agg(F.min(F.struct("first.none", "first.own", "th")).alias("first")).select("first.*")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *own)
    kept = keyed.join(firsts, ["none", "own", "th"], "left_semi").dropDuplicates(["none", "own", "th"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])

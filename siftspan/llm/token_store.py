"""Token ids in binary shards: one zstandard frame a document with a shared dictionary, and an offset index.

A shard is one file: the magic, the sha-256 of the dictionary, then the frames end to end, then the index (a row a
document: doc_id, start, n_tokens, offset and length of the frame; start counts from the first id of the shard), then
the number of documents, the number of ids and the magic again. A frame holds the ids as little-endian 16-bit
integers, or 32-bit ones if the vocabulary needs them (the header says which). One document is read with two seeks:
its index row, then its frame; by its id after a binary search in the index. The dictionary lies beside the shards under
its hash and is trained on the serialized ids of a bounded sample of documents. `manifest.json` lists the shards in
order with the ids before each.

Shards have about SHARD_BYTES of text, so their number grows with the input and their size does not. They are written
by the executors to the folder that the cluster shares, under a name of the task attempt and then renamed; a repeated
task, which makes the same file, leaves the first one where it is. The folder is opened by its URI: the local file
system for file:, otherwise pyarrow's file systems (hdfs, s3, gs).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.llm import bpe
from siftspan.llm.common import shared_dir, text_slices, tidy

MAGIC = b"TIDS0001"
INDEX = np.dtype([("doc_id", "<i8"), ("valid", "<i8"), ("start", "<i8"), ("n_tokens", "<i8"), ("offset", "<i8"), ("length", "<i8")])
ROW, TAIL = struct.Struct("<6q"), struct.Struct("<qq8s")
#: Bounds of the sample of which the dictionary is trained, not of what is written: documents, and bytes of whole texts.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 8 << 20
DICT_BYTES = 64 << 10
SHARD_BYTES = 128 << 20  # of text; there are four shards a core at least, so that cores share the work of small inputs
PIECE = 8192  # bytes of serialized ids that are one sample to the trainer


def _files(folder: str):
    """A file system of pyarrow and the folder's path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def put(folder: str, name: str, write) -> None:
    """Makes a file whole or not at all: write(stream) to a name of its own, then a rename.

    Where another attempt has made the file, that one stays: not every file system replaces a file by a rename.
    """
    from pyarrow.fs import FileType

    files, at = _files(folder)
    files.create_dir(at, recursive=True)
    own, there = f"{at}/.{name}.{uuid.uuid4().hex}", lambda: files.get_file_info(f"{at}/{name}").type != FileType.NotFound
    with files.open_output_stream(own) as out:
        write(out)
    try:
        if not there():
            files.move(own, f"{at}/{name}")
            return
    except OSError:
        if not there():
            raise
    if files.get_file_info(own).type != FileType.NotFound:
        files.delete_file(own)


def read(folder: str, name: str) -> bytes:
    files, at = _files(folder)
    with files.open_input_stream(f"{at}/{name}") as f:
        return f.read()


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary of serialized ids; with too little to train on, the samples' own end, or nothing."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class ShardWriter:
    """Writes documents in order to an open stream."""

    def __init__(self, out, dictionary: bytes, wide: bool):
        self.out, self.kind = out, "<u4" if wide else "<u2"
        self.press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=3)
        self.rows = bytearray()  # of INDEX
        self.docs = self.ids = 0
        self.at = out.write(MAGIC + sha256(dictionary).digest() + struct.pack("<q", 4 if wide else 2))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.press.compress(np.ascontiguousarray(ids, self.kind).tobytes())
        self.rows += ROW.pack(doc_id or 0, int(doc_id is not None), self.ids, len(ids), self.at, len(frame))
        self.docs += 1
        self.out.write(frame)
        self.at += len(frame)
        self.ids += len(ids)

    def close(self) -> tuple[int, int]:
        self.out.write(bytes(self.rows))
        self.out.write(TAIL.pack(self.docs, self.ids, MAGIC))
        return self.docs, self.ids


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, folder: str, name: str):
        files, at = _files(folder)
        self.file = files.open_input_file(f"{at}/{name}")
        size = self.file.size()
        head = self.file.read_at(48, 0)
        n, self.ids, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if head[:8] != MAGIC or magic != MAGIC:
            raise ValueError(f"{name} is not a whole shard")
        self.hash, self.kind = head[8:40].hex(), "<u4" if struct.unpack("<q", head[40:])[0] == 4 else "<u2"
        self.docs, self.index_at = n, size - TAIL.size - n * INDEX.itemsize
        dictionary = read(folder, f"{self.hash}.dict")
        if sha256(dictionary).hexdigest() != self.hash:
            raise ValueError("the dictionary is not the one that the shard names")
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return self.docs

    def rows(self, at: int, n: int) -> np.ndarray:
        """Up to `n` rows of the index from the one of number `at` on."""
        return np.frombuffer(self.file.read_at(max(0, min(n, self.docs - at)) * INDEX.itemsize, self.index_at + at * INDEX.itemsize), INDEX)

    def ids_at(self, row: np.void) -> np.ndarray:
        """The ids of the document of an index row."""
        return np.frombuffer(self.open.decompress(self.file.read_at(int(row["length"]), int(row["offset"]))), self.kind)

    def get(self, k: int) -> np.ndarray:
        return self.ids_at(self.rows(k, 1)[0])

    def find(self, doc_id: int | None) -> int:
        """The number of the first document of an id, by binary search (null ids come first); -1 if there is none."""
        key = (doc_id is not None, doc_id or 0)
        low, high = 0, self.docs
        while low < high:
            mid = (low + high) // 2
            row = self.rows(mid, 1)[0]
            low, high = (mid + 1, high) if (bool(row["valid"]), int(row["doc_id"])) < key else (low, mid)
        row = self.rows(low, 1)
        return low if len(row) and (bool(row[0]["valid"]), int(row[0]["doc_id"])) == key else -1

    def close(self) -> None:
        self.file.close()


def write(spark: SparkSession, docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes every row of `docs` in ascending id order; returns the folder.

    Rows of equal id are ordered by a hash of their texts, then by the texts; null ids come first and stay null. A
    null or empty text is `end_id` alone. Each partition of a range partitioning is one shard; an empty table gives a
    manifest without shards. The rows that partitions and files hold grow with the input, not with any one key.
    """
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def ids_of(batches):
        coder = bpe.load(path)
        kind = "<u4" if coder.size > 1 << 16 else "<u2"
        for _, texts in text_slices(batches):
            flat, counts = coder.encode_batch(texts)
            ends = np.cumsum(counts)
            yield pa.record_batch([pa.array([np.append(flat[e - n : e], end_id).astype(kind).tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())], names=["ids"])

    # Whole texts in order of a hash, until either bound is reached. Rows that repeat id and text are one.
    hashed = rows.where(F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = dict(map(tuple, hashed.select("h", F.octet_length("text").alias("n")).orderBy("h", "n").limit(SAMPLE_DOCS).collect()))
    chosen = [h for h, total in zip(sizes, np.cumsum(list(sizes.values())), strict=True) if total <= SAMPLE_BYTES]
    sample = hashed.where(F.col("h") <= chosen[-1]).groupBy("h").agg(F.min("text").alias("text")) if chosen else hashed.where("false")
    pieces = [r["ids"][at : at + PIECE] for r in sample.select("h", "text").mapInArrow(tidy(ids_of), "ids binary").collect() for at in range(0, len(r["ids"]), PIECE)]
    dictionary = train_dictionary(sorted(pieces))
    put(folder, f"{sha256(dictionary).hexdigest()}.dict", lambda out: out.write(dictionary))

    def shards(batches):
        from pyspark import TaskContext

        coder = bpe.load(path)
        slices = text_slices(batches)
        first = next(slices, None)
        if first is None:
            return
        name, counted = f"shard-{TaskContext.get().partitionId():07d}.tids", []

        def fill(out):
            writer = ShardWriter(out, dictionary, coder.size > 1 << 16)
            for keys, texts in (s for group in ([first], slices) for s in group):
                flat, counts = coder.encode_batch(texts)
                ends = np.cumsum(counts)
                for key, e, n in zip(keys, ends, counts, strict=True):
                    writer.add(key, np.append(flat[e - n : e], end_id))
            counted.append(writer.close())

        put(folder, name, fill)
        yield pa.record_batch([pa.array([name]), pa.array([counted[0][0]], pa.int64()), pa.array([counted[0][1]], pa.int64())], names=["name", "docs", "ids"])

    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    ordered = rows.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text"))
    made = sorted(map(tuple, ordered.mapInArrow(tidy(shards), "name string, docs long, ids long").collect()))
    before, listed = 0, []
    for name, n, ids in made:
        listed.append({"name": name, "docs": n, "ids": ids, "before": before})
        before += ids
    put(folder, "manifest.json", lambda out: out.write(json.dumps({"dictionary": sha256(dictionary).hexdigest(), "tokenizer": os.path.basename(path), "shards": listed}).encode()))
    return folder


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of the folder."""
    listed = json.loads(read(folder, "manifest.json"))["shards"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listed:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(folder, name)
                for at in range(0, len(reader), 4096):
                    part = reader.rows(at, 4096)
                    sums = [zlib.crc32(np.ascontiguousarray(reader.ids_at(row), "<u4")) for row in part]
                    yield pa.record_batch([pa.array(part["doc_id"], mask=part["valid"] == 0), pa.array(part["start"] + before), pa.array(part["n_tokens"].copy()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                reader.close()

    shards = spark.createDataFrame([(s["name"], s["before"]) for s in listed], "name string, before long")
    return shards.repartition(len(listed)).mapInArrow(tidy(run), schema)

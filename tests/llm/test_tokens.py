"""BPE, token store and packing against the tokenizers library."""

import json
import os
import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from siftspan.llm import bpe, packing, token_store

ODD = "aaaa  b\n\n\tc's 'S it's   12345 <|endoftext|> é́ Σας ΣΑΣ İ ﬁ 漢字かな 😀👍🏽 \x1c \x1d a\x1fb  x   y' 've 'll --- ... !!?? A_b_c <|startoftext|> ½ ² Ⅷ"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    want, mine = Tokenizer.from_file(P.path(name)), bpe.Bpe(P.path(name))
    draw = random.Random(1)
    texts = ["", "   ", "\n", "a" * 500, "ab" * 300, "abc" * 200, " \n a", "x  ", ODD] + ["".join(draw.choice(ODD + "thein ") for _ in range(draw.randint(0, 60))) for _ in range(800)] + ["".join(draw.choice("thianergo") for _ in range(draw.randint(0, 40))) for _ in range(800)]
    flat, counts = mine.encode_batch(texts)
    ends = np.cumsum(counts)
    for t, e, n in zip(texts, ends, counts, strict=True):
        ids = want.encode(t, add_special_tokens=False).ids
        assert flat[e - n : e].tolist() == ids
        assert mine.decode(ids) == want.decode(ids, skip_special_tokens=False)


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CODES", 10)
    mine = bpe.Bpe(P.path("byte_bpe_50k.json"))
    once = mine.encode("many different words to fill a small cache again and again and more")
    assert mine.encode("many different words to fill a small cache again and again and more") == once


def test_digests(odd, empty):
    path = P.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    rows = {(r["doc_id"], t): r for r, t in zip(bpe.digests(odd, path).collect(), [r["text"] for r in odd.collect()], strict=True)}
    assert len(rows) == 7
    for (_, t), r in rows.items():
        ids = want.encode(t or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == sha256(want.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty, path).count() == 0 and bpe.encode(odd, path).where("size(ids) = 0 and decoded = ''").count() == 3


def test_store_round_trip(spark, odd, empty):
    path = P.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    folder = token_store.write(spark, odd, path)
    rows = token_store.scan(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6]
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    start = 0
    for r in rows:
        ids = np.array(want.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.scan(spark, token_store.write(spark, empty, path)).count() == 0


def test_store_reads_by_id(spark, make, tmp_path, monkeypatch):
    """Shards of few documents, repeated ids over several shards, one long text, and attempts that come twice."""
    monkeypatch.setattr(token_store, "SHARD_BYTES", 900)
    path = P.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["some", "words", "of", "a", "text", "Ünï"]) for _ in range(draw.randint(0, 60))) for _ in range(60)] + ["long " * 20000]
    ids = [draw.choice([None, 5, -3, 10 ** 15, *range(20, 60)]) for _ in texts]
    folder = token_store.write(spark, make(texts, ids), path, folder=f"file://{tmp_path}/store")
    listed = json.loads(token_store.read(folder, "manifest.json"))["shards"]
    assert len(listed) > 4 and sum(s["docs"] for s in listed) == 61
    seen = []
    for s in listed:
        reader = token_store.ShardReader(folder, s["name"])
        keys = [int(r["doc_id"]) if r["valid"] else None for r in reader.rows(0, len(reader))]
        for k, key in enumerate(keys):
            assert keys.index(key) == reader.find(key) and reader.find(777) == -1
            seen.append((key, reader.get(k).tolist()))
        reader.close()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(seen, key=order) == sorted(((i, want.encode(t, add_special_tokens=False).ids + [2]) for i, t in zip(ids, texts, strict=True)), key=order)
    assert [k for k, _ in seen] == sorted(ids, key=lambda i: (i is not None, i or 0))
    token_store.put(folder, "twice", lambda out: out.write(b"first"))
    token_store.put(folder, "twice", lambda out: out.write(b"first"))
    assert token_store.read(folder, "twice") == b"first" and not [f for f in os.listdir(tmp_path / "store") if f.startswith(".twice") and not f.endswith(".crc")]


def check_pieces(rows, texts, size=1024):
    want = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = {i: want.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    at = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["doc_row"], r["start"])):
        key = (r["doc_id"], r["doc_row"])
        ids = enc[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at.get(key, 0) and r["doc_tokens"] == len(enc[r["doc_id"]]) and r["ids_crc32"] == bpe.crc32(np.array(ids))
        at[key] = r["start"] + r["length"]
    assert all(n == len(enc[i]) for (i, _), n in at.items())
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(0 < n <= size for n in ends.values())
    return ends


def test_packing(odd, empty):
    rows = packing.pack(odd.coalesce(1), P.path("byte_bpe_50k.json")).collect()
    ends = check_pieces(rows, {r["doc_id"]: r["text"] for r in odd.collect()})
    assert len({(r["doc_id"], r["doc_row"]) for r in rows}) == 8 and sum(ends.values()) > 0.9 * 1024 * (len(ends) - 1)
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_windows_cost_least():
    draw = random.Random(5)
    for _ in range(200):
        size, n = 12, draw.randint(1, 60)
        ends = np.array(sorted({*draw.sample(range(1, n + 1), draw.randint(1, n)), n}))
        inner = np.array(sorted(set(draw.sample(range(1, n + 1), draw.randint(0, n))) - set(ends.tolist())), int)
        places, penalty = packing.cut_points(ends, inner, size)
        pen = dict(zip(places.tolist(), penalty.tolist(), strict=True))

        def cost(cuts):
            return sum(size - (b - a) for a, b in zip([0, *cuts], cuts[:-1], strict=False)) + sum(pen[c] for c in cuts[:-1])

        best = {0: 0}
        for p in places.tolist():
            options = [best[q] + (0 if p == n else size - (p - q) + pen[p]) for q in best if 0 < p - q <= size]
            if options:
                best[p] = min(options)
        cuts = packing.windows(places, penalty, size)
        assert cuts[-1] == n and all(0 < b - a <= size for a, b in zip([0, *cuts[:-1]], cuts, strict=True)) and cost(cuts) == best[n]


def test_buffers_lose_nothing():
    draw = random.Random(2)
    kinds = np.array([(k % 7 == 0) + 2 * (k % 11 == 5) for k in range(100)], np.int8) % 3
    docs = [(k, k, np.array([draw.randrange(1, 100) for _ in range(draw.choice([1, 5, 300, 3000]))] + [0], np.int32)) for k in range(60)]
    rows = [r for part in packing.pack_stream(iter(docs), kinds, 64, 7, buffer=500) for r in part]
    got = {}
    for doc, start, length, crc, total, *_ in rows:
        assert start == got.get(doc, 0) and crc == bpe.crc32(docs[doc][2][start : start + length]) and total == len(docs[doc][2])
        got[doc] = start + length
    assert all(got[d] == len(ids) for d, _, ids in docs) and rows[0][5] == 7
    ends = {}
    for *_, length, _, _, sequence, offset, _ in [(r[0], r[1], *r[2:]) for r in rows]:
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert sorted(ends) == list(range(7, 7 + len(ends))) and max(ends.values()) <= 64


def test_one_long_document_without_cuts():
    """A stretch that nothing breaks, many buffers long, fills its windows."""
    kinds = np.zeros(100, np.int8)
    docs = [(1, 0, np.full(30_000, 5, np.int32)), (2, 1, np.full(7, 6, np.int32))]
    rows = [r for part in packing.pack_stream(iter(docs), kinds, 64, 0, buffer=500) for r in part]
    assert sum(r[2] for r in rows) == 30_007 and len({r[5] for r in rows}) <= 30_007 // 64 + 2
    assert [r[1] for r in rows if r[0] == 1] == [sum(x[2] for x in rows[:k]) for k in range(len(rows) - 1)]

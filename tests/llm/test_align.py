"""Token alignment against whole texts that are encoded and aligned one by one."""

import random
from bisect import bisect_left, bisect_right
from collections import Counter
from hashlib import sha256

import pytest

from siftspan.llm import align
from siftspan.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def slow(texts):
    """One row a text, from the libraries' ids of the whole text and byte ranges of all tokens."""
    pair = align.load(A, B)
    found = []
    for text in texts:
        if not text:
            found.append(([], [], []))
            continue
        a = pair.a.encode(" " + text, add_special_tokens=False).ids
        b = pair.b.encode(text)
        want = (" " + text).encode()
        if b"".join(pair.a_bytes[i] for i in a) != want or b"".join(pair.b_bytes[i] for i in b) != want:
            found.append(([], [], []))
            continue
        spans = []
        for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, side = 0, []
            for i in ids:
                side.append((at, at + len(names[i]), i))
                at += len(names[i])
            spans.append(side)
        starts = [x for x, _, _ in spans[1]]
        near = [(t, spans[1][max(0, bisect_right(starts, t[0]) - 1) : bisect_left(starts, t[1])]) for t in spans[0]]
        found.append((*spans, [(i, j) for (s, e, i), others in near for x, y, j in others if s < y and x < e]))
    count = Counter(p for *_, links in found for p in links)
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    rows = []
    for a, b, links in found:
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        sides = [[[] for _ in cuts] for _ in range(2)]
        for side, ids in zip(sides, (a, b), strict=True):
            for _, e, i in ids:
                side[bisect_left(cuts, e)].append(str(i))
        parts = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True)]
        rows.append((len(a), len(b), len(cuts), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha256(";".join(parts).encode()).hexdigest() if a else ""))
    return rows, count


def got(df):
    return [tuple(r)[1:] for r in sorted(df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect(), key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("send, slice_bytes, lot", [(1 << 19, 16 << 20, 10), (0, 300, 0)])
def test_brute_force(spark, make, monkeypatch, send, slice_bytes, lot):
    """With pairs sent and shuffled, in one slice and in many, a row a unit and one for every input split."""
    monkeypatch.setattr(align, "SEND_PAIRS", send)
    monkeypatch.setattr(align, "LOT", lot)
    monkeypatch.setattr(align, "SLICE", slice_bytes)
    draw = random.Random(send)
    parts = ["the", "Then", "unhappily", "naïveté", "漢字漢", "😀", "123456", "can't", "...", "a_b", "<|endoftext|>", "</s>", "<s>", "<0x0A>", "▁", "x\x00y", "\x1c", " ", "　", "é", "ſ", "Straße", "http://a.b/c?d=e", "﻿"]
    gaps = [" ", " ", " ", "  ", "   ", "\n", " \n", "\n ", "\n\n", "\t", "", "\r\n", " \t "]
    texts = ["".join(draw.choice(parts if draw.random() < 0.1 else parts[:8]) + draw.choice(gaps) for _ in range(draw.randint(1, 30))) for _ in range(80)]
    texts += [None, "", " ", "  ", "\n", "a", " a", "a ", "▁", "the▁the", "w" * 3000, "the the the", "the the the"]
    want, count = slow(texts)
    rows, pairs = align.align(spark, make(texts).repartition(3), A, B)
    assert got(rows) == want
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == count
    assert sum(not r[0] for r in want) < 30


def test_units_together(spark):
    """Units of a batch have the numbers, groups and links that each has by itself."""
    texts = ["unhappily", "naïveté", "漢字漢", "😀", "can't", "a_b<|endoftext|>", "é", "x" * 40, "http://a.b/c?d=e", "\n"]
    units = spark.createDataFrame([(" " + t, n + 1, [(0, n)]) for n, t in enumerate(texts)], "unit string, n long, places array<struct<of: long, code: int>>").coalesce(1)
    with align.setting(spark, align.HASHED_LISTS, "false"):
        rows = sorted(align.written(align.linked(align.encoded(units, A, B)), A, B).collect(), key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(1, len(texts) + 1))
    for r, text in zip(rows, texts, strict=True):
        (want,), count = slow([text])
        assert r["groups"][-1] == ";"
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], sha256(r["groups"][:-1].encode()).hexdigest()) == (*want[:4], want[6])
        assert Counter((k >> 32, k & 0xFFFFFFFF) for k in r["links"]) == count


def test_shares_are_read_once(spark, make, monkeypatch):
    """A share of the units has files of its own that no other share's pass reads, and texts of groups are written once."""
    made = []

    def cut(spark, df, label, *rest):
        read = {f for f in df.inputFiles() if "align-pairs" not in f}
        out = align_cut(spark, df, label, *rest)
        made.append((label, read, out[0].columns))
        return out

    align_cut = align.cut
    monkeypatch.setattr(align, "cut", cut)
    align.align(spark, make([" ".join(f"word{k}" for k in range(60))]), A, B)
    passes = [read for label, read, _ in made if label == "align-rows"]
    assert len(passes) > 1 and all(passes) and sum(map(len, passes)) == len(set().union(*passes))
    assert {label for label, _, columns in made if "groups" in columns} == {"align-links"}


def test_odd_tables(spark, odd, empty, make):
    rows, pairs = align.align(spark, empty, A, B)
    assert rows.count() == pairs.count() == 0
    texts = [r["text"] for r in odd.collect()]
    rows, _ = align.align(spark, odd, A, B)
    assert sorted(tuple(r)[1:] for r in rows.collect()) == sorted(slow(texts)[0])


def test_long_unbroken_text(spark, make):
    """A word of 60,000 letters is one unit, whose links are as many as its ends, not pairs."""
    draw = random.Random(1)
    text = "".join(draw.choice("etaoinshrdlu") for _ in range(60_000))
    row = align.align(spark, make([text]), A, B)[0].first()
    pair = align.load(A, B)
    assert row["n_a"] == len(pair.a.encode(" " + text).ids) and row["n_b"] == len(pair.b.encode(text)) and row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"]


def test_units_of_slices_go(spark, make):
    """Once the units are a table, the rows of slices that named them are off the disk, and the texts are read all the same."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("align-slices-*/kind=*"))
    texts = ["one two three", "two three", None, ""]
    rows, _ = align.align(spark, make(texts), A, B)
    assert {p.name for p in set(shared.glob("align-slices-*/kind=*")) - before} == {"kind=0"}
    got = {r["doc_id"]: r["groups_sha256"] for r in rows.collect()}
    assert [bool(got[k]) for k in range(4)] == [True, True, False, False]


def test_rows_travel_in_shares(spark, make, monkeypatch):
    """No shuffle of units, of their rows or of slices has all of them, and the shares together are the whole."""
    made = {}

    def cut(spark, df, label, *rest):
        out = align_cut(spark, df, label, *rest)
        made.setdefault(label, []).append(out[0].collect())
        return out

    align_cut = align.cut
    monkeypatch.setattr(align, "cut", cut)
    monkeypatch.setattr(align, "SLICE", 200)
    texts = [" ".join(f"word{(k * j) % 211}" for j in range(20)) for k in range(120)]
    rows, _ = align.align(spark, make(texts).repartition(4), A, B)
    assert got(rows) == slow(texts)[0]
    units = [[r["uid"] for r in part] for part in made["align-units"]]
    assert max(map(len, units)) < 0.7 * sum(map(len, units))
    assert len({u for part in units for u in part}) == sum(map(len, units)) == len({w for t in texts for w in t.split()})
    sizes = [sum(len(r["rows"]) for r in part) for part in made["align-rows"]]
    assert max(sizes) < 0.5 * sum(sizes)
    assert 0 < sum(map(len, made["align-docs"])) < len(texts)

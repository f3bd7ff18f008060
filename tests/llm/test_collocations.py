"""Collocations against counting by hand."""

import random
import re
from collections import Counter

import pytest

from siftspan.llm import collocations


def slow(rows, max_n=3, least=10, top=2000):
    """All phrases of pieces, counted and cut one by one."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = set()
    for lang, count in f.items():
        some = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in some.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            s, c = min((10**6 * a * a // (count[p[:c]] * count[p[c:]]), c) for c in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode("utf-8", "surrogatepass"), count[p[:c]], count[p[c:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def got(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("share, rows_a_batch", [(1024, 10000), (20, 3), (3, 50)])
def test_brute_force(spark, monkeypatch, share, rows_a_batch):
    """With and without words and pairs that are dealt finer, and with stacks that go on over many batches."""
    monkeypatch.setattr(collocations, "SHARE", share)
    draw = random.Random(share)
    words = ["the", "of", "a", "The", "naïve", "x\x01", "x", "ÄB", "%20", "漢", "b"]
    marks = [" ", "  ", "\t", ", ", ".\n", " ", " ", " "]
    langs = ["en", None, "e n", "und", "a\nb", "a", "%"]
    rows = [(draw.choice(langs), "".join(draw.choice(words[: draw.randint(1, 11)]) + draw.choice(marks) for _ in range(draw.randint(0, 120)))) for _ in range(150)]
    rows += [("en", "of the of the the " * 200), ("en", None), (None, ""), ("es", "one")] + rows[:20]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
        want = slow(rows, least=5)
        assert len(want) > 60 and got(collocations.collocations(spark, docs, least=5)) == want
        assert got(collocations.collocations(spark, docs, least=5, top=7)) == slow(rows, least=5, top=7)
        assert got(collocations.collocations(spark, docs, max_n=4, least=8)) == slow(rows, 4, 8)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_exact_products(spark):
    """Counts whose products pass 64 bits, and ties after flooring, which go to the smaller cut."""
    a = 4_000_000_000
    rows = [("en", 0, "", 9 * a, ), ("en", 1, "u", 2 * a), ("en", 1, "v", 3 * a + 1), ("en", 2, "u v", a), ("en", 3, "u v u", 9), ("en", 2, "v u", 2 * a)]
    found = {r["phrase"]: r for r in collocations.score(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).collect()}
    assert found["u v"]["score"] == 10**6 * a * a // (2 * a * (3 * a + 1))
    assert (found["u v u"]["score"], found["u v u"]["l"], found["u v u"]["r"]) == (0, 2 * a, 2 * a)


def test_odd_tables(spark, odd, empty, make):
    assert got(collocations.collocations(spark, empty)) == set()
    rows = [("en", r["text"]) for r in odd.collect()]
    assert got(collocations.collocations(spark, odd, least=2)) == slow(rows, least=2)
    one = "word " * 50_000 + "x" * 300_000
    assert got(collocations.collocations(spark, make([one, one]))) == slow([("en", one)] * 2)

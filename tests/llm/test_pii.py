"""Personal data: base spans against plain expressions, decoding against whole chains, tags on held-out sentences."""

import random
import re
from hashlib import sha256

import hypothesis
import hypothesis.strategies as st
import numpy as np
import pytest

from siftspan.llm import pii

EXPRESSIONS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def slow_base(text):
    out = []
    for k, pattern in enumerate(EXPRESSIONS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and slow_luhn(d), 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.sentences(500, 7))


@hypothesis.settings(max_examples=400, deadline=None)
@hypothesis.given(st.lists(st.sampled_from(["a", "1", "4929348385146306", "@", ".", "+", "-", " ", "(", ")", "b.c", "255", "256", "0", "é", "\n", "٣", "+1 (017) 555-7713", "x@y.zz", "1.2.3.4"]), max_size=30).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_base(text)


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a." * 150_000 + "@", "@a" * 150_000, "1 " * 150_000):
        pii.base_spans(text)


def test_held_out_sentences(field):
    decoder = pii.Decoder(field)
    hits = wanted = found = 0
    for words, tags in pii.sentences(250, 1234):
        text, want, at = " ".join(words), [], 0
        for w, t in zip(words, tags, strict=True):
            if t and t[0] != "+":
                want.append((at, at + len(w), t))
            elif t:
                want[-1] = (want[-1][0], at + len(w), want[-1][2])
            at += len(w) + 1
        got = decoder.runs([text])[0]
        hits, wanted, found = hits + len(set(got) & set(want)), wanted + len(want), found + len(got)
    assert hits >= 0.93 * wanted and hits >= 0.93 * found


def test_cut_chains_are_whole_ones(field):
    """Words that can't be anything are left out of Viterbi; a pass over whole documents gives the same states."""
    decoder = pii.Decoder(field)
    draw = random.Random(3)
    texts = [" ".join(w for words, _ in pii.sentences(draw.randint(0, 12), k) for w in words) for k in range(60)] + ["", "one", "(555) 123-4567", "Δ [at] Δ"]
    got = decoder.runs(texts)
    for text, runs in zip(texts, got, strict=True):
        spots = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\t-\r]+", text)]
        if not spots:
            assert runs == []
            continue
        rows = np.stack([field.emission(pii.features(text[a:b])) for a, b in spots])
        emission = rows[:, 0].copy()
        emission[1:] += rows[:-1, 1]
        emission[:-1] += rows[1:, 2]
        states = pii.best_paths(emission, field.transition, np.array([len(spots)]))
        want, last = [], 0
        for (a, b), s in zip(spots, states.tolist(), strict=True):
            if s:
                if s % 2 == 0 and last and (last - 1) // 2 == (s - 1) // 2:
                    want[-1] = (want[-1][0], b, want[-1][2])
                else:
                    want.append((a, b, pii.KINDS[(s - 1) // 2]))
            last = s
        assert runs == want


def test_viterbi_is_brute_force():
    draw = np.random.default_rng(5)
    for n in (1, 2, 3):
        emission, move = draw.normal(size=(n, pii.STATES)), draw.normal(size=(pii.STATES, pii.STATES))
        best = max((sum(emission[t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip((0, *p), (*p, 0), strict=True)), p) for p in np.ndindex(*[pii.STATES] * n))
        assert pii.best_paths(emission, move, np.array([n])).tolist() == list(best[1])


def test_gradient_is_that_of_the_likelihood():
    """Marginals and pairs against sums over all paths."""
    draw = np.random.default_rng(2)
    emit, move = draw.normal(size=(2, 3, pii.STATES)), draw.normal(size=(pii.STATES, pii.STATES)) / 3
    real = np.array([[True, True, True], [True, True, False]])
    got, pairs = pii._marginals(emit, move, real)
    want, want_pairs = np.zeros_like(emit), np.zeros_like(move)
    for r, n in ((0, 3), (1, 2)):
        paths = list(np.ndindex(*[pii.STATES] * n))
        weight = np.exp([sum(emit[r, t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip((0, *p), (*p, 0), strict=True)) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight, strict=True):
            for t, s in enumerate(p):
                want[r, t, s] += w
            for a, b in zip((0, *p), (*p, 0), strict=True):
                want_pairs[a, b] += w
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_checks():
    assert pii.checked("phone", "(826) 555-4081.") == (0, 14) and pii.checked("phone", "12-34") is None
    assert pii.checked("iban", "GB82 WEST 1234 5698 7654 32") == (0, 27) and pii.checked("iban", "GB83 WEST 1234 5698 7654 32") is None
    assert pii.checked("ip", "10[.]0[.]0[.]256") is None and pii.checked("ip", "10[.]0[.]0[.]25") == (0, 15)
    assert pii.checked("card", "4929.3483.8514.6306") == (0, 19) and pii.checked("card", "4929.3483.8514.6307") is None


def test_queries(spark, odd, empty, make, field):
    texts = ["mail jo.fi@mail4.example.com or ba [at] co [dot] org", "call (826) 555-4081 now", "é 😀 10.2.3.4 and 4929348385146306", "+1 (017) 555-7713", "clean words, 12 of them. In 2020-01-15", None, ""]
    docs = make(texts)
    rows = {r["doc_id"]: r for r in pii.digest(docs, field).collect()}
    for i, text in enumerate(texts):
        base = slow_base(text or "")
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert rows[i]["base_sha256"] == sha256(listed.encode()).hexdigest() and [rows[i][f"n_{k}"] for k in pii.BASE] == [sum(b[1] == k for b in base) for k in range(4)]
        assert set(filter(None, listed.split(","))) <= set(rows[i]["spans"].split(","))
    assert rows[0]["spans"] == "email:5:28,email:32:52" and rows[1]["spans"] == "phone:5:19" and rows[4]["spans"] == rows[5]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, field).collect()}
    assert masked[0] == "mail [EMAIL] or [EMAIL]" and masked[2] == "é 😀 [IP] and [CARD]" and masked[4] == texts[4]
    spans = {r["doc_id"]: r["spans"] for r in pii.scan(docs, field).collect()}
    assert [(s["start"], s["end"], s["kind"], s["base"]) for s in spans[0]] == [(5, 28, "email", True), (32, 52, "email", False)]
    assert pii.digest(empty, field).count() == pii.scan(empty, field).count() == pii.mask(empty, field).count() == 0
    found = sorted((r["doc_id"] or -1, r["spans"]) for r in pii.digest(odd, field).collect())
    assert len(found) == odd.count() and {s for _, s in found} == {""}
    long = "word " * 40_000 + "5" * 100_000 + " (826) 555-4081"
    assert pii.digest(make([long]), field).first()["spans"] == "phone:300001:300015"


def test_tables(spark):
    """A table of others, one without tags, and none: the fit is bounded and says nothing without tags."""
    table = pii.labelled(spark, 40, 3)
    assert table.count() == 40 and pii.train(table).names
    for rows in ([], [(["a", "b"], ["", ""])], [(["a"], ["", ""]), (None, None)]):
        empty = pii.train(spark.createDataFrame(rows, "words array<string>, tags array<string>"))
        assert pii.Decoder(empty).runs(["call (826) 555-4081 now", ""]) == [[], []]

"""Embedding and SimHash near-duplicates, line dedup and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from siftspan.llm import cells, common, embed_dedup, line_dedup, simhash


def classes(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "TASK_EDGES", most)
    draw = random.Random(4)
    pairs = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(40)]
    edges = spark.createDataFrame([*pairs, (None, 3), (5, 5)], "a long, b long")
    want = classes(250, pairs)
    got = {r["node"]: r["component"] for r in common.components(spark, edges).collect()}
    assert all(want[a] == got[a] and want[b] == got[b] for a, b in pairs if a != b)
    assert common.components(spark, edges.where("false")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, cell string, v int, home string")


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    monkeypatch.setattr(embed_dedup, "PER_PIVOT", 25)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 20, 120)] + 0.12 * rng.normal(size=(120, 16))
    group = base[0] + 0.1 * rng.normal(size=(60, 16))
    x = np.vstack([base, near, group, base[:10], 3 * base[5:8]]).astype(np.float32)
    rows = [(k, v.tolist(), 0, "c", 1, "h") for k, v in enumerate(x)]
    odd = [(900, None, 0, "", 0, ""), (901, [0.0] * 16, 0, "", 0, ""), (902, [float("nan")] * 16, 0, "", 0, ""), (903, [None, *[1.0] * 15], 0, "", 0, ""), (904, [], 0, "", 0, ""), (905, [float("inf"), *[1.0] * 15], 0, "", 0, "")]
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark, vectors(spark, rows + odd)).collect()}
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    link = d @ d.T >= 0.9
    np.fill_diagonal(link, False)
    want = classes(len(d), zip(*np.nonzero(link), strict=True))
    for k in range(len(d)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (link[k].sum(), want[k], want[k] == k)
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in range(900, 906))
    assert embed_dedup.near_duplicates(spark, vectors(spark, rows).where("false")).count() == 0
    assert embed_dedup.near_duplicates(spark, vectors(spark, odd)).count() == 6


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text).encode())
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    count = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def test_fingerprints():
    for text in ("", " \n", "One", "A b c", "A B c d", "x y z w v " * 30, "É è \x1c ok ok ok ok"):
        assert simhash.fingerprint(text) == slow_print(text)


@pytest.mark.parametrize("grid", simhash.GRIDS)
def test_simhash_links(spark, monkeypatch, grid):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    monkeypatch.setattr(simhash, "GRIDS", (grid,))
    rng = np.random.default_rng(7)
    n = {4: 300, 8: 60, 16: 12}[grid[0]]  # in fine grids, few prints have many cells
    base = rng.integers(0, 1 << 63, n // 2, dtype=np.int64)
    flips = np.array([np.bitwise_xor.reduce(np.int64(1) << rng.choice(63, rng.integers(1, 6), replace=False)) for _ in range(n)])
    x = np.unique(np.concatenate([base, base[rng.integers(0, max(2, n // 8), n)] ^ flips, [0, -1, 1, 3]]))
    u = x.view(np.uint64)
    link = np.bitwise_count(u[:, None] ^ u[None]) <= 4
    np.fill_diagonal(link, False)
    found, comp = simhash.links(spark, spark.createDataFrame([(int(k),) for k in x], "id long"), 4)
    assert {r["id"]: r["n_links"] for r in found.collect()} == {int(x[k]): n for k, n in enumerate(link.sum(1)) if n}
    got = {r["node"]: r["component"] for r in comp.collect()}
    want = classes(len(x), zip(*np.nonzero(link), strict=True))
    assert all(got[int(x[k])] == int(x[want[k]]) for k in range(len(x)) if link[k].any())


def test_grids():
    """The estimates are those of random bits, and more fingerprints are joined in finer grids."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    for segments in (4, 8, 16):
        size = 64 // segments
        c = np.stack([np.bitwise_count((x >> np.uint64(k * size)) & np.uint64((1 << size) - 1)).astype(int) for k in range(segments)])
        apart = np.abs(c[:, :1500, None] - c[:, None, 1500:]).sum(axis=0)
        assert simhash.estimate(segments, 1, 4)[1] == pytest.approx((apart <= 4).mean(), rel=0.15, abs=2e-5)
    chosen = [simhash.grid(10**k, 4) for k in range(3, 12)]
    assert [g[0] for g in chosen] == sorted(g[0] for g in chosen) and chosen[0][0] == 4 and chosen[-1][0] == 16


def test_simhash_documents(spark, odd, empty):
    rows = simhash.near_duplicates(spark, odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "3", "4", "4", "5", "6", "None"]
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["bits"] == by[2]["bits"] == by[3]["bits"] == 0 and by[3]["component_id"] == 1
    kept = simhash.keep_one(spark, odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "None"]
    assert simhash.near_duplicates(spark, empty).count() == 0


def test_blocks_cover_all_pairs(spark):
    rows = spark.createDataFrame([(k, k % 3 > 0, 5) for k in range(100)], "id long, home boolean, cell long")

    def every(a, b):
        i, j = np.divmod(np.arange(len(a) * len(b)), max(len(b), 1))
        yield i, j

    found, comp = cells.linked(spark, rows, 9, every, "t")
    n = {r["id"]: r["n_links"] for r in found.collect()}
    assert all(n[k] == (99 if k % 3 else 66) for k in range(100))
    assert {r["component"] for r in comp.collect()} == {0}


PASSAGE = "A first sentence with several words in it. Another sentence that follows the first one closely. And a third to be quite sure of it."


def pieces(text):
    ends = [u[0] for u in line_dedup.units_of(text)]
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def test_units():
    draw = random.Random(1)
    for _ in range(300):
        t = "".join(draw.choice(["word ", "As. ", "x! ", "a b c d. ", "\n", "end?", " ", "漢字。"]) for _ in range(draw.randint(0, 40)))
        assert "".join(pieces(t)) == t and "" not in pieces(t)
    assert pieces("One two three four. As. Is so. Five six seven eight.\nZ") == ["One two three four. ", "As. Is so. ", "Five six seven eight.\n", "Z"]


def test_pieces_are_the_same_in_other_sentences():
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) + draw.choice(["", "", "", ","])
    for _ in range(100):
        passage = " ".join(word() for _ in range(60))
        seen = []
        for _ in range(2):
            before, after = (" ".join(word() for _ in range(draw.randint(0, 30))) for _ in range(2))
            text = f"{before} {passage} {after}."
            ends = [u[0] for u in line_dedup.units_of(text)]
            assert all(line_dedup.SHORT <= u[1] < line_dedup.MOST + line_dedup.SHORT for u in line_dedup.units_of(text))
            seen.append({e - len(before) - 1 for e in ends if 0 < e - len(before) - 1 < len(passage) - 40})
        a, b = sorted(seen, key=len)
        late = len(passage) // 2  # they may begin apart, and soon agree
        assert {e for e in a if e > late} == {e for e in b if e > late}


def test_line_dedup_passage_within_sentences(spark, make):
    """A passage of 50 words that begins and ends within other sentences goes, but for some words at its ends."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghijklm") for _ in range(draw.randint(2, 8)))
    own = lambda n: " ".join(word() for _ in range(n))
    passages = [own(50) for _ in range(20)]
    texts = [f"{own(30)}. {own(7)} {p} {own(9)}. {own(20)}." for p in passages for _ in range(3)]
    new = {r["doc_id"]: r for r in line_dedup.dedup(spark, make(texts)).collect()}
    left = [sum(w in set(new[k]["text"].split()) for w in passages[k // 3].split()) for k in range(60)]
    assert all(left[k] == 50 for k in range(0, 60, 3)) and all(left[k] <= 30 for k in range(60) if k % 3) and sum(left) < 20 * (50 + 2 * 18)
    assert all(len(new[k]["text"].split()) >= 66 for k in range(60))


def test_line_dedup(spark, make):
    own = [f"Document {k} has its own words number {k} here." for k in range(6)]
    texts = [f"{own[0]}\n{PASSAGE}\nTail zero.", f"{own[1]} {PASSAGE} Then more own words of one.", f"{own[2]}\nLicensed under some licence text.", f"{own[3]}\nLicensed under some licence text.", f"{own[0]}\n{PASSAGE}\nTail zero.", None, ""]
    docs = make(texts, [10, 11, 12, 13, 14, 15, None])
    got = line_dedup.dedup(spark, docs)
    assert got.columns == [*docs.columns, "dropped_blocks", "dropped_chars"]
    new = {r["doc_id"]: r["text"] for r in got.collect()}
    assert new[10] == texts[0] and new[12] == texts[2] and new[13] == texts[3] and new[15] is None and new[None] == ""
    assert PASSAGE not in new[11] and own[1] in new[11] and "own words of one" in new[11]
    assert new[14].strip() in ("", "Tail zero.")
    assert line_dedup.dedup(spark, docs.where("false")).count() == 0


def test_line_dedup_hot_passage(spark, make):
    texts = [f"Text {k} begins with {k} words of {k * k} its own kind.\n{PASSAGE}\nAnd ends with {k} as said {k + 7} before." for k in range(80)]
    new = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark, make(texts)).collect()}
    assert new[0] == texts[0] and all(PASSAGE not in new[k] and f"Text {k} begins" in new[k] and f"as said {k + 7}" in new[k] for k in range(1, 80))


def test_shuffled_join_is_the_same(spark, make, monkeypatch):
    texts = [f"Own {k} words {k} here {k} now.\n{PASSAGE}" for k in range(10)]
    a = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark, make(texts)).collect()}
    monkeypatch.setattr(line_dedup, "SEND_BYTES", 0)
    assert a == {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark, make(texts)).collect()}


def test_patience():
    draw = random.Random(2)
    for _ in range(100):
        x = [draw.randrange(30) for _ in range(draw.randint(0, 12))]
        best = max(sum(m >> k & 1 for k in range(len(x))) for m in range(1 << len(x)) if all(p < q for p, q in zip(*[[v for k, v in enumerate(x) if m >> k & 1][i:] for i in (0, 1)])))
        got = [x[k] for k in line_dedup.increasing(x)]
        assert len(got) == best and got == sorted(set(got))
    # One moved passage and one that occurs several times are blocks of their own.
    rows = [(0, 9, 1, 50, True), (9, 19, 2, 60, True), (30, 39, 3, 10, True), (50, 59, 4, 20, False), (70, 79, 4, 20, False)]
    assert sorted(line_dedup.aligned(rows)) == [(0, 19), (30, 39), (50, 59), (70, 79)]


def slow_dedup(texts, min_words):
    """Of (id, text): each text without the stretches of units that one text of a smaller id has as well."""
    cut = [[(p, " ".join(p.split()), line_dedup.units_of(t)[k][1]) for k, p in enumerate(pieces(t))] for _, t in texts]

    def sequences(units):
        for size in (1, line_dedup.SHORT):
            yield [k for k, u in enumerate(units) if u[2] >= size]

    def stretches(units, order):
        for i in range(len(order)):
            for j in range(i + 1, len(order) + 1):
                if sum(units[k][2] for k in order[i:j]) >= min_words:
                    yield i, j, tuple(units[k][1] for k in order[i:j])

    def least(units, order, i, j):
        """Whether a stretch would be short without its last unit, or without its first one if it ends a line."""
        size = sum(units[k][2] for k in order[i:j])
        last = order[j - 1]
        return size - units[last][2] < min_words or size - units[order[i]][2] < min_words and (units[last][0].endswith("\n") or last == len(units) - 1)

    out = []
    for (i, _), units in zip(texts, cut, strict=True):
        gone = set()
        for kind, order in enumerate(sequences(units)):
            earlier = {s for (o, _), other in zip(texts, cut, strict=True) if o < i for a, b, s in stretches(other, list(sequences(other))[kind]) if least(other, list(sequences(other))[kind], a, b)}
            gone |= {k for a, b, s in stretches(units, order) if s in earlier and least(units, order, a, b) for k in range(order[a], order[b - 1] + 1)}
        out.append("".join(u[0] for k, u in enumerate(units) if k not in gone))
    return out


def test_line_dedup_is_brute_force(spark, make):
    """Random texts of few units, in crossed order, repeated, with repeated rows and ids and short units between."""
    draw = random.Random(8)
    units = [" ".join(draw.choice("abcdefgh") + str(k) for _ in range(draw.randint(4, 15))) + ("." if k % 2 else "") + draw.choice(["\n", " "] if k % 2 else ["\n"]) for k in range(14)] + ["1.\n", "so it is\n", "\n"]
    for _ in range(3):
        texts = [(draw.randrange(12), "".join(draw.choice(units) for _ in range(draw.randint(1, 14)))) for _ in range(24)]
        texts += draw.sample(texts, 3)
        docs = make([t for _, t in texts], [i for i, _ in texts])
        got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup(spark, docs).collect())
        assert got == sorted(zip([i for i, _ in texts], slow_dedup(texts, 20), strict=True))


def test_no_block_of_several_owners(spark, make):
    """Four sentences of which each stands in another earlier document are no block."""
    four = [f"Sentence {k} of all of them has nine words here.\n" for k in "abcd"]
    texts = [f"Document {k} has its own words number {k} here.\n" + four[k] for k in range(4)] + ["".join(four), "".join(four)]
    new = {r["doc_id"]: r for r in line_dedup.dedup(spark, make(texts)).collect()}
    assert all(new[k]["text"] == texts[k] for k in range(5)) and new[5]["text"] == "" and new[5]["dropped_blocks"] == 1


def test_line_dedup_passage_repeated_in_both(spark, make):
    own = [f"Text {k} begins with {k} words of {k * k} its own kind.\n" for k in range(5)]
    mid = [f"Between them text {k} says {k + 9} other things.\n" for k in range(5)]
    twice = [own[k] + PASSAGE + "\n" + mid[k] + PASSAGE for k in (0, 1)]
    texts = [*twice, own[2] + PASSAGE, own[3] + (PASSAGE + "\n") * 13 + mid[3]]
    new = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark, make(texts)).collect()}
    assert new == {0: texts[0], 1: own[1] + mid[1], 2: own[2], 3: own[3] + mid[3]}


def test_runs_cover_every_repeated_block():
    draw = random.Random(5)
    for _ in range(100):
        size = np.array([draw.randint(4, 25) for u in range(6)])
        a, b = ([draw.randrange(6) for _ in range(draw.randint(0, 25))] for _ in range(2))
        name = np.array([xxhash.xxh64_intdigest(str(u)) for u in range(6)], np.uint64)
        doc = np.repeat([0, 1], [len(a), len(b)])
        first, end, h = line_dedup.runs(doc, size[np.array(a + b, int)], name[np.array(a + b, int)], np.ones(len(doc), bool), 20)
        held = {x for i, x in zip(first, h, strict=True) if i < len(a)}
        got = {p for i, j, x in zip(first, end, h, strict=True) if i >= len(a) and x in held for p in range(i - len(a), j - len(a))}
        stretches = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = {p for i in range(len(b)) for j in range(i + 1, len(b) + 1) if tuple(b[i:j]) in stretches and sum(size[u] for u in b[i:j]) >= 20 for p in range(i, j)}
        assert got == want


def test_line_dedup_moved_blocks(spark, make):
    x = "".join(f"The block called x has a sentence {k} of eleven words here.\n" for k in range(2))
    y = "".join(f"Of the other block, y, this is sentence {k} of twelve words.\n" for k in range(3))
    own = [f"Text {k} begins with {k} words of {k * k} its own kind.\n" for k in range(3)]
    first = own[0] + y + "And here is more that is only in it.\n" + x
    new = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark, make([first, own[1] + x + y, own[2] + y + own[2] + x])).collect()}
    assert new == {0: first, 1: own[1], 2: own[2] * 2}


def test_line_dedup_short_lines_and_unspaced_scripts(spark, make):
    own = [f"Text {k} begins with {k} words of {k * k} its own kind.\n" for k in range(3)]
    verse = "".join(f"item {k}\n\nof {k * 7} b\n" for k in range(9))
    assert max(u[1] for u in line_dedup.units_of(verse)) < line_dedup.SHORT
    chinese = "春天的早晨我们在河边散步。孩子们看见一只白色的鸟飞过水面！然后大家一起回家吃饭。"
    japanese = "これは空白のない日本語の文章の例であり単語の数を数えることができません"
    assert [u[1] for u in line_dedup.units_of("汉字 ab 漢")] == [4] and "".join(pieces(chinese)) == chinese and len(pieces(chinese)) >= 3
    texts = [own[0] + verse, own[1] + verse, own[2] + "item 1\nof 7 b\nas it is", chinese, japanese, chinese, "别的话。" + japanese]
    new = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark, make(texts)).collect()}
    assert new[1].strip() == own[1].strip() and [new[5], new[6]] == ["", "别的话。"]
    assert all(new[k] == texts[k] for k in (0, 2, 3, 4))


@pytest.mark.parametrize("ids", [[1, 1, 2, 3], [1, 2, 2, 3], [1, 1, 2, 2]])
def test_line_dedup_repeated_rows(spark, make, ids):
    own = {k: f"Text {k} begins with {k} words of {k * k} its own kind.\n" for k in (1, 2, 3)}
    got = line_dedup.dedup(spark, make([own[k] + PASSAGE for k in ids], ids)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((k, own[k] + PASSAGE * (k == 1)) for k in ids)


def both_prints(texts):
    """First and second fingerprints of 5-word shingles, bit by bit."""
    out = [], []
    for text in texts:
        h = [int(x) for part in simhash.shingles(text, 5) for x in part]
        other = [int(x) for x in simhash.mixed(np.array(h, np.uint64))]
        for found, hashes in zip(out, (h, other), strict=True):
            found.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes)))
    assert out[0] == [simhash.fingerprint(t, 5) for t in texts]
    return out


def test_second_prints_are_others():
    """Unrelated hashes give unrelated bits: about half differ."""
    h = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    assert 31 < np.bitwise_count(h ^ simhash.mixed(h)).mean() < 33 and len(np.unique(simhash.mixed(h))) == 4000


def test_simhash_stage_by_similarity(spark, make, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(simhash, "SHINGLE_BLOCK", 7)
    monkeypatch.setattr(simhash, "SIZE_BLOCK", 9)
    draw = random.Random(11)
    texts = []
    for k in range(12):
        base = [f"w{draw.randrange(10 ** 6)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(base[: 200 - 3 * k]), " ".join(base + base[: 2 * k])]
        for edits in (1, 2, 3, 4, 6, 9):
            new = list(base)
            for at in draw.sample(range(200), edits):
                new[at] = f"x{draw.randrange(10 ** 6)}"
            texts.append(" ".join(new))
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    bits, more = both_prints(texts)
    n = range(len(texts))
    similar = [(i, j) for i in n for j in n if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links = [(i, j) for i, j in similar if (bits[i] ^ bits[j]).bit_count() <= corpus_pipeline.NEAR_BITS and (more[i] ^ more[j]).bit_count() <= corpus_pipeline.SECOND_BITS]
    assert len(links) >= 0.98 * len(similar) > sum((bits[i] ^ bits[j]).bit_count() <= 4 for i, j in similar)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, make(texts), "").collect()}
    assert kept == set(classes(len(texts), links))


def test_simhash_null_and_repeated_ids(spark, make):
    texts = [f"text {k} has its own words {k * k} and more {k + 7} of them {k * 11} here" for k in range(6)]
    docs = make([texts[0], texts[1], texts[2], texts[0], texts[3], texts[4], texts[4], texts[5]], [1, None, None, 2, 2, 3, 3, 3])
    kept = simhash.keep_one(spark, docs)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", texts[0]), ("None", texts[1]), ("None", texts[2]), ("2", texts[3]), ("3", texts[4]), ("3", texts[5])])


@pytest.mark.parametrize("per", [3, 1000])
def test_vectors_of_many_lengths(spark, monkeypatch, per):
    """Lengths with and without pivots, in one join; double-precision vectors, repeated and null ids, clashing columns."""
    monkeypatch.setattr(embed_dedup, "PER_PIVOT", per)
    rows = []
    for d in range(1, 131):
        v = np.cos(np.arange(1, d + 1) * d)
        rows += [(2 * d, v.tolist(), 0, "c", 1, "h"), (2 * d + 1, (v * (3 + 0.01 * np.arange(d) / d)).tolist(), 0, "c", 1, "h")]
    extra = [([1.0, 0.0, 1e200], 900), ([1.0, 0.0, 1e200], 900), ([2e-200, 0.0, 1e-5], None), ([0.0, 1.0, 0.0], 901), ([0.0, 1.0, 0.02], 901), ([0.0, -1.0, 0.0], 902)]
    rows += [(i, v, 0, "c", 1, "h") for v, i in extra]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, cell string, v int, home string")
    found = embed_dedup.near_duplicates(spark, made).collect()
    got = {r["vec_id"]: r for r in found}
    assert len(found) == 266 and all((got[k]["n_links"], got[k]["component_id"]) == (1, k - k % 2) for k in range(2, 262) if k not in (6, 7))
    assert [(r["n_links"], r["component_id"]) for r in found if r["vec_id"] == 900] == [(2, 900)] * 2 and got[None]["n_links"] == 2 and got[None]["component_id"] == 900
    assert [(r["n_links"], r["component_id"]) for r in found if r["vec_id"] == 901] == [(1, 901)] * 2 and got[902]["n_links"] == 0


def test_line_dedup_writes_one_table(spark, make, monkeypatch):
    """Each file of the shared folder starts a process from the JVM: only the blocks are written, and nothing stays persisted."""
    labels, write = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda spark, df, label: labels.append(label) or write(spark, df, label))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    passage = " ".join(f"w{k}" for k in range(30)) + "\n"
    got = line_dedup.dedup(spark, make([f"one {passage}", f"two {passage}", "three"]))
    assert sorted(r["dropped_blocks"] for r in got.collect()) == [0, 0, 1]
    assert labels == ["lines-blocks"]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before

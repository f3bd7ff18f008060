"""Text functions and chunkers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from siftspan.functions import text as T
from siftspan.operators import chunkers as C


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


def test_tokens_and_windows(spark):
    assert one(spark, "Straße, foo_bar 12-x!", T.tokens) == ["straße", "foo_bar", "12", "x"]
    assert one(spark, " ".join(map(str, range(10))), lambda c: T.word_windows(c, 4)) == ["0 1 2 3", "2 3 4 5", "4 5 6 7", "6 7 8 9"]
    assert one(spark, "One. Two!  Three?", T.sentences) == ["One.", "Two!", "Three?"]


@pytest.mark.parametrize(("a", "b", "want"), [("", "abc", 0.0), ("ab", "ab", 1.0), ("ab", "ac", 0.0), ("abcd", "abce", 1 / 3)])
def test_trigram_jaccard(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(T.trigram_jaccard(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert got == pytest.approx(want)


def test_parsers(spark):
    assert one(spark, 'so {"is_relevant": false, "confidence": 0.7} ok', T.critique).asDict() == {"is_relevant": False, "is_supported": True, "is_useful": True, "confidence": 0.7}
    assert one(spark, '{"is_relevant": true}', T.critique)["confidence"] == 0.0
    assert one(spark, "no json", T.critique).asDict() == {"is_relevant": True, "is_supported": True, "is_useful": True, "confidence": 0.5}
    assert [r.asDict() for r in one(spark, "a | b | c | d\n| x | y\nq|w", T.triples)] == [{"subject": "a", "predicate": "b", "object": "c"}]
    assert one(spark, "- Alpha\n\n -- Beta -\n", T.entity_lines) == ["Alpha", "Beta"]
    assert one(spark, "1. First.\n- second\n\n", T.claim_lines) == ["First.", "second"]
    got = one(spark, "I think so\nQUERY: what next\nmore", lambda c: T.thought_query(c, F.lit("old")))
    assert got["query"] == "what next" and got["thought"] == "I think so"
    assert one(spark, "nothing", lambda c: T.thought_query(c, F.lit("old")))["query"] == "old"
    # A text that begins with its query has no thought before it, so the whole text is one; a query may be empty.
    got = one(spark, "Query: at once", lambda c: T.thought_query(c, F.lit("old")))
    assert got.asDict() == {"thought": "Query: at once", "query": "at once"}
    assert one(spark, "hm\nQUERY:  \n", lambda c: T.thought_query(c, F.lit("old"))).asDict() == {"thought": "hm", "query": ""}
    notes = one(spark, "relevance: Relevant\nKEY_INFO: k: l\nCONNECTION: c\nTYPE: conflicting\n\nRELEVANCE: huh\nTYPE: odd\n\nTYPE: Complementary\nTYPE: odd\n\nNOTE_TYPE: conflicting", T.note_blocks)
    assert [n["relevance"] for n in notes] == ["relevant", *["partially_relevant"] * 3] and notes[0]["key_info"] == "k: l" and notes[0]["connection"] == "c"
    assert [n["note_type"] for n in notes] == ["conflicting", "standard", "complementary", "standard"]


def model_recursive(text, size, overlap, seps):
    def cut(piece, at):
        if len(piece) <= size:
            return [piece]
        for k in range(at, len(seps)):
            if seps[k] in piece:
                parts = piece.split(seps[k])
                parts = [p + seps[k] for p in parts[:-1]] + [parts[-1]]
                return [x for p in parts if p.strip() for x in cut(p, k + 1)]
        out = []
        for s in range(0, len(piece), max(1, size - overlap)):
            out += [piece[s : s + size]] if piece[s : s + size].strip() else []
            if s + size >= len(piece):
                return out
        return out

    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    out, current = [], ""
    for p in cut(text, 0):
        if len(current) + len(p) <= size:
            current += p
        elif current:
            out.append(current)
            current = (current[-overlap:] if overlap else "") + p
        else:
            current = p
    out += [current] if current else []
    return [c.strip() for c in out if c.strip()]


def test_recursive_matches_a_recursion(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["ab", "c", ". ", " ", "\n", "\n\n", "; ", ", "]) for _ in range(draw.randint(0, 120))) for _ in range(60)] + ["", "   ", "x" * 95]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((20, 5), (30, 0), (8, 3)):
        got = {}
        for r in C.recursive(docs, size, overlap).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r["doc_id"], []).append(r["content"])
        for k, t in enumerate(texts):
            assert got.get(k, []) == model_recursive(t, size, overlap, C.SEPARATORS), (k, size)


def test_fixed(spark):
    docs = spark.createDataFrame([(1, "word " * 200), (2, ""), (3, "short"), (4, None)], "doc_id long, text string")
    rows = C.fixed_chars(docs, 50, 0).collect()
    assert max(len(r["content"]) for r in rows) <= 50 and {r["doc_id"] for r in rows} == {1, 3}
    assert [r["content"] for r in C.fixed_tokens(docs.where("doc_id = 1"), 150, 50).orderBy("chunk_index").collect()] == [" ".join(["word"] * 150), " ".join(["word"] * 100)]


def test_last_sentence_without_words(spark):
    docs = spark.createDataFrame([(1, "Alpha beta. Gamma delta. Alpha beta. --. --!")], "doc_id long, text string")
    rows = C.breakpoints(docs).orderBy("pos").collect()
    assert [r["distance"] is None for r in rows] == [False, False, False, False, True]
    known = sorted(r["distance"] for r in rows[:-1])
    assert abs(rows[0]["threshold"] - (known[2] + 0.7 * (known[3] - known[2]))) < 1e-9


def test_semantic(spark):
    docs = spark.createDataFrame([(1, "Cats sleep here. Cats sleep there. Cats sleep now. Rockets burn fuel. Rockets burn hot."), (2, "Only one.")], "doc_id long, text string")
    rows = C.semantic(docs, 70.0, 5, 2000).orderBy("doc_id", "chunk_index").collect()
    assert [r["chunk_id"] for r in rows if r["doc_id"] == 2] == ["2"] and rows[-1]["chunk_index"] is None
    mine = [r for r in rows if r["doc_id"] == 1]
    assert len(mine) >= 2 and " ".join(r["content"] for r in mine) == docs.first()["text"]


def test_windows_of_unbroken_text():
    """A window that reaches the end is the last: none repeats the end of the one before alone."""
    text = "".join(chr(97 + k % 26) for k in range(900))
    assert [len(c) for c in C.merged_chunks(text, 512, 64)] == [512, 64 + 452]
    assert C.merged_chunks(text, 512, 0) == [text[:512], text[512:]]


def test_separator_order():
    """Of marks of exclamation and question, the first is cut at first."""
    text = "Is it? No! Who? Me! Why? So! And"
    assert C.merged_chunks(text, 12, 0) == ["Is it? No! ", "Who? Me! ", "Why? So! And"]
    assert C.merged_chunks("a? bb! c? dd! e? f", 7, 0, ("! ", "? ")) == ["a? bb! ", "c? dd! ", "e? f"]


def kinds(text):
    return [(b[0], b[3], b[4]) for b in C.blocks_of(text)]


def test_blocks():
    assert kinds("## Notes\nsome text\nmore of it\n\n* a\n  goes on\n+ b\nnot b") == [("heading", 0, 0), ("paragraph", 1, 2), ("list", 4, 6), ("paragraph", 7, 7)]
    # A number is an item only in the first column and with white space after its full stop; marks count anywhere.
    assert kinds("3.14 is pi") == [("paragraph", 0, 0)] and kinds("3. is an item") == [("list", 0, 0)] and kinds(" 3. is none") == [("paragraph", 0, 0)] and kinds("   - is one") == [("list", 0, 0)]
    assert kinds("- a\n one space") == [("list", 0, 0), ("paragraph", 1, 1)]
    # A row needs a bar at its begin and another one.
    assert kinds("|half a row") == [("paragraph", 0, 0)] and kinds("|a|b|\n|c|d|\n|e") == [("table", 0, 1), ("paragraph", 2, 2)] and kinds(" |a|b|") == [("paragraph", 0, 0)]
    assert kinds("> quoted\nlazily\n\n > not") == [("quote", 0, 1), ("paragraph", 3, 3)]
    assert kinds("   ```sh\n# no heading\n\n```\nafter\n```\nopen") == [("code", 0, 3), ("paragraph", 4, 4), ("code", 5, 6)]
    assert kinds("####### seven\n#none\n# ") == [("paragraph", 0, 1), ("heading", 2, 2)] and kinds("") == kinds(" \n\t") == []


def test_assembly():
    def chunks(text, size, **more):
        return C.assemble(C.blocks_of(text), size, **more)

    # A block that does not fit closes what is there, a heading alone as well, and the next chunk begins with it.
    long = "w" * 30
    assert chunks(f"# H\n\n{long}\n\n{long}", 40) == [f"# H\n\n{long}", f"# H\n\n{long}"]
    assert chunks(f"# H\n\n{long}", 20) == ["# H", f"# H\n\n{long}"]
    assert chunks(f"# H\n\n{long}", 20, headings=False) == ["# H", long]
    # Code that is too long is whole and closed at once; what follows has no heading.
    code = "```\n" + long + "\n```"
    assert chunks(f"# H\n\na\n\n{code}\n\nb", 20) == ["# H\n\na", f"# H\n\n{code}", "b"]
    assert chunks(f"{code}\n\n{code}", 200) == [f"{code}\n\n{code}"] and chunks(f"{code}\n\n{code}", 50) == [code, code]
    # The blank line counts for paragraphs, not for code.
    assert chunks("aaaa\n\nbbbb", 12) == ["aaaa\n\nbbbb"] and chunks("aaaa\n\nbbbb", 11) == ["aaaa", "bbbb"]


def test_structured(spark):
    text = "# Harbour log\n\nShips came in.\n\n- a barge\n- a tug\n\n```sql\nSELECT tide\nFROM moon\n```\n\n## Cargo\n\n| Good | Tons |\n|---|---|\n| Salt | 40 |\n| Rope | 3 |\n\nNight fell."
    rows = C.structured(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), 60).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {1} and [r["chunk_index"] for r in rows] == list(range(len(rows))) and rows[0]["chunk_id"] == "1_dachunk_0"
    assert sum("SELECT tide\nFROM moon" in r["content"] for r in rows) == 1 and sum("| Salt | 40 |\n| Rope | 3 |" in r["content"] for r in rows) == 1
    assert [b[0] for b in C.blocks_of(text)] == ["heading", "paragraph", "list", "code", "heading", "table", "paragraph"]

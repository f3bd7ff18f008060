"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() removes, as far as ASCII goes (Spark's trim removes spaces alone).
BLANK = " \t\n\r\f\u000b"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, also where `use` refers to it inside of a lambda over many elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def ws_tokens(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")


def sentences(c: Column) -> Column:
    """Sentences that end in . ! or ? before white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def dot_sentences(c: Column) -> Column:
    """Pieces between full stops, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\."), strip), lambda s: s != "")


def word_windows(c: Column, size: int) -> Column:
    """Windows of `size` words, half overlapping; the first that reaches the end is the last."""
    stride = max(1, size // 2)

    def cut(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(stride)), lambda s: (s == 0) | (s - stride + size < F.size(words)))
        return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))

    return let(F.filter(F.split(c, r"\s+"), lambda t: t != ""), cut)


def entity(c: Column) -> Column:
    return strip(F.lower(c))


def trigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; empty strings 0; strings without trigrams 1 if equal, else 0."""

    def of(g: Column) -> Column:
        x, y = g["x"], g["y"]
        whole = let(F.size(F.array_intersect(x, y)), lambda k: k / (F.size(x) + F.size(y) - k))
        return F.when((a == "") | (b == ""), 0.0).when((F.size(x) == 0) | (F.size(y) == 0), (a == b).cast("double")).otherwise(whole)

    return let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), of)


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of the sets of words."""
    x, y = F.array_distinct(ws_tokens(a)), F.array_distinct(ws_tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (both == 0), 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def contains_yes(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("yes"))


def says_done(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("[done]")) | F.contains(F.lower(c), F.lit("[complete]"))


def json_part(c: Column) -> Column:
    """From the first brace to the last one; empty without any."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def triples(c: Column) -> Column:
    """array<struct(subject, predicate, object)> of lines with three or more parts between bars; empty entities go."""
    lines = F.transform(F.split(c, "\n"), lambda line: F.transform(F.split(line, r"\|"), strip))
    full = F.filter(lines, lambda p: (F.size(p) >= 3) & (p[0] != "") & (p[2] != ""))
    return F.transform(full, lambda p: F.struct(p[0].alias("subject"), p[1].alias("predicate"), p[2].alias("object")))


def entity_lines(c: Column) -> Column:
    """Lines without list dashes, blank ones dropped."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: strip(F.btrim(strip(x), F.lit("-")))), lambda x: x != "")


def thought_query(c: Column, fallback: Column) -> Column:
    """struct(thought, query): the first line that starts with QUERY: splits the text; without it the fallback.

    The thought is what stands before that line, or the whole text if nothing does; the query may be empty.
    """
    found = F.regexp_extract(c, r"(?im)^\s*QUERY:(.*)$", 1)
    has = F.regexp_like(c, F.lit(r"(?im)^\s*QUERY:"))
    before = strip(F.regexp_extract(c, r"(?is)^(.*?)(?:^|\n)\s*QUERY:", 1))
    return F.struct(F.when(has & (before != ""), before).otherwise(strip(c)).alias("thought"), F.when(has, strip(found)).otherwise(fallback).alias("query"))


def claim_lines(c: Column) -> Column:
    """Claims of a list: without dashes, numbers and their dots or brackets, blank ones dropped."""
    clean = lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), r"^[- ]+", ""), r"^[0-9.)]+", ""))
    return F.filter(F.transform(F.split(c, "\n"), clean), lambda x: x != "")


#: The kinds of relevance and of notes; what a missing or unknown one is taken for.
RELEVANCE, NOTE_TYPES = ("relevant", "partially_relevant", "irrelevant"), ("standard", "conflicting", "complementary")


def note_blocks(c: Column) -> Column:
    """array<struct(relevance, key_info, connection, note_type)> by position of blocks between blank lines.

    Fields are the last lines RELEVANCE:, KEY_INFO:, CONNECTION: and TYPE: of a block, of the kinds the last known ones;
    missing ones are partially_relevant, empty, empty and standard.
    """

    def one(block: Column) -> Column:
        def of(name: str) -> Column:
            lines = F.regexp_extract_all(block, F.lit(rf"(?im)^\s*{name}:[ \t]*(.*)$"), F.lit(1))
            return F.transform(lines, strip)

        def kind(name: str, known: tuple[str, ...], other: str) -> Column:
            return F.coalesce(F.try_element_at(F.filter(F.transform(of(name), F.lower), lambda x: x.isin(*known)), F.lit(-1)), F.lit(other))

        text = lambda name: F.coalesce(F.try_element_at(of(name), F.lit(-1)), F.lit(""))
        return F.struct(kind("RELEVANCE", RELEVANCE, "partially_relevant").alias("relevance"), text("KEY_INFO").alias("key_info"), text("CONNECTION").alias("connection"), kind("TYPE", NOTE_TYPES, "standard").alias("note_type"))

    return F.transform(F.split(strip(c), r"\n\n"), one)


def critique(c: Column) -> Column:
    """struct(is_relevant, is_supported, is_useful, confidence) from JSON in a text: missing fields take true and 0;
    a text without readable JSON counts as relevant and supported with 0.5."""
    parsed = F.from_json(json_part(c), "is_relevant boolean, is_supported boolean, is_useful boolean, confidence double, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = (json_part(c) != "") & parsed.isNotNull() & parsed["_bad"].isNull()
    pick = lambda name, default, unread: F.when(good, F.coalesce(parsed[name], F.lit(default))).otherwise(F.lit(unread)).alias(name)
    return F.struct(pick("is_relevant", True, True), pick("is_supported", True, True), pick("is_useful", True, True), pick("confidence", 0.0, 0.5))


def cache_key(c: Column) -> Column:
    return F.sha2(c, 256)


def prompt(template: str, **parts: Column) -> Column:
    """A template with {name} places, filled from columns."""
    out = F.lit(template)
    for name, c in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out

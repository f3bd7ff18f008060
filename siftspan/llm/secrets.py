"""Secret scans through a trigram inverted index, in DataFrame functions alone.

Every rule is a regular expression, from which a Boolean query over trigrams is derived (`trigrams.query`): alternatives
of conjunctions, of which each match holds one. The index has postings (trigram, document) for the trigrams that the
queries name, on lower-cased text. Conjunctions intersect postings, alternatives unite them, and the candidates of a
rule are verified by its expression. A rule without a mandatory trigram scans every document.

Places come from the pieces between matches: the lengths of the pieces and matches before one add up to its start.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.llm import trigrams
from siftspan.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` of a match must have `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules in the order in which equal starts are listed, then the added ones, of the public
#: formats of keys and tokens. Classes are spelled out, so that all engines of expressions read them alike.
ASSIGN = Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 0, 20)
HEX = Rule("hex", r"[0-9a-f]{24,}", 0, 24)
BASE = (ASSIGN, ACCESS, HEX)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("pgp", r"-----BEGIN PGP PRIVATE KEY BLOCK-----"),
    Rule("putty", r"PuTTY-User-Key-File-[23]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"https://hooks\.slack\.com/(services|workflows)/[A-Za-z0-9+/]{20,}"),
    Rule("stripe", r"(sk|rk)_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"GOCSPX-[A-Za-z0-9_-]{28}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}"),
    Rule("mailgun", r"key-[0-9a-z]{32}"),
    Rule("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}"),
    Rule("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Rule("shopify", r"shp(at|ca|pa|ss)_[0-9a-f]{32}"),
    Rule("digitalocean", r"do[opr]_v1_[0-9a-f]{64}"),
    Rule("huggingface", r"hf_[A-Za-z0-9]{34,}"),
    Rule("vault", r"hv[bs]\.[A-Za-z0-9_-]{24,}"),
    Rule("docker", r"dckr_pat_[A-Za-z0-9_-]{27}"),
    Rule("postman", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    Rule("grafana", r"glsa_[A-Za-z0-9]{32}_[0-9a-f]{8}"),
    Rule("azure", r"AccountKey=[A-Za-z0-9+/]{80,}={0,2}"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!*-]+@"),
)


#: Trigrams of an alternative that are looked up, the ones of the rarest characters: a query may ask for less than all
#: that a match must hold, and each more costs a pass over the text. Characters by falling frequency, others are rare.
KEEP, FREQUENT = 2, " etaoinshrdlcumwfgypbvkjxqz"


def rarity(gram: str) -> tuple[int, str]:
    return sum(FREQUENT.find(c) if c in FREQUENT else len(FREQUENT) for c in gram), gram


def query(rule: Rule) -> list[list[str]]:
    """The trigrams of each alternative of a rule that are looked up; an empty list if it has to scan fully."""
    asked = trigrams.query(rule.pattern)
    return [] if asked == trigrams.ALL else [list(q) for q in sorted({tuple(sorted(sorted(q, key=rarity)[-KEEP:])) for q in asked})]


def all_grams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for q in query(r) for g in q})


def key(id_col: str, text_col: str) -> Column:
    """What postings call a document: its id, or where that is null a hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))


def postings(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, doc): the inverted index over the trigrams that the queries of the rules name."""
    low = docs.select(key(id_col, text_col).alias("doc"), F.lower(text_col).alias("low"))
    found = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in all_grams(rules)]).cast("array<string>"), lambda g: g.isNotNull())
    return low.select("doc", F.explode(found).alias("trigram"))


#: Bits of a long that number trigrams.
WORD = 62


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc, one boolean a rule with a query): the union of its alternatives, each an intersection of postings.

    Postings of a document meet by grouped ORs of one bit a trigram, WORD trigrams to a long, combined before the
    shuffle: all of a conjunction's bits set is membership in the intersection of its postings.
    """
    grams = all_grams(rules)
    place = F.array_position(F.array(*map(F.lit, grams)).cast("array<string>"), F.col("trigram")).cast("int") - 1
    words = range(-(-len(grams) // WORD))
    bit = F.expr(f"shiftleft(1L, place % {WORD})")
    sets = index.select("doc", place.alias("place")).groupBy("doc").agg(F.count("*").alias("n"), *[F.bit_or(F.when(F.floor(F.col("place") / WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{w}") for w in words])

    def holds(q: list[str]) -> Column:
        hit = F.lit(True)
        for w in words:
            mask = sum(1 << grams.index(g) % WORD for g in q if grams.index(g) // WORD == w)
            if mask:
                hit = hit & (F.col(f"bits{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        return hit

    flags = {}
    for r in rules:
        if query(r):
            hit = F.lit(False)
            for q in query(r):
                hit = hit | holds(q)
            flags[r.kind] = hit
    any_ = F.lit(False)
    for hit in flags.values():
        any_ = any_ | hit
    return sets.where(any_).select("doc", *[hit.alias(f"may_{k}") for k, hit in flags.items()])


def spans(rule: Rule, text: Column) -> Column:
    """array<struct(start, end, kind)> of the matches of a rule in a text, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    size = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else F.transform(found, F.length)
    before = F.transform(F.split(text, rule.pattern), F.length)
    # Running ends: each match starts where the last one ended plus the piece between.
    start_ = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"))
    parts = F.arrays_zip(before.alias("gap"), F.transform(found, F.length).alias("len"), size.alias("size"))

    def step(acc, p):
        start, end = acc["at"] + p["gap"], acc["at"] + p["gap"] + p["len"]
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(F.coalesce(end, start, acc["at"]).alias("at"), F.when(p["size"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start_, step, lambda acc: acc["out"])


def scan(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` with `_spans`: the spans of all rules, by start and then by the order of the rules.

    A null text is empty. Rows that repeat an id are verified each for itself. The columns travel in one struct, so
    only a column called _spans would clash: it is replaced. The join brings candidates to documents by key; keys are
    ids, so no group of copies shares one.
    """
    found, _ = cut(spark, candidates(postings(docs, rules, id_col, text_col), rules), "secrets")
    kept = [c for c in docs.columns if c != "_spans"]
    keyed = docs.select(F.struct(*kept).alias("row"), key(id_col, text_col).alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("whole"))
    joined = keyed.join(found.select("doc", F.struct("*").alias("may")), F.col("own") == F.col("doc"), "left")
    text = F.col("whole")
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    parts = []
    for r in rules:
        may = F.coalesce(F.col("may")[f"may_{r.kind}"], F.lit(False)) if query(r) else F.regexp_like(text, F.lit(r.pattern))
        parts.append(F.when(may, spans(r, text)).otherwise(empty))
    names = F.array(*[F.lit(r.kind) for r in rules])
    ranked = F.array_sort(F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return joined.select(*[F.col("row")[c].alias(c) for c in kept], ranked.alias("_spans"))


def listed(spans_col: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = scan(spark, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("_spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    of = lambda kind: F.filter("_spans", lambda s: s["kind"] == kind)
    count = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every secret replaced by `mark`; texts without secrets, null ones among them, stay as they are.

    Overlapping spans are replaced together. Same columns in the same order.
    """
    found = scan(spark, docs, id_col=id_col, text_col=text_col)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    one = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"))
    new = F.aggregate("_spans", start, one, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.select(*[F.when(F.size("_spans") > 0, new).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans of one text by Python's own expressions; tests compare with it."""
    out = []
    for rule in BASE:
        pattern = "[0-9a-f]+" if rule is HEX else rule.pattern
        out += [(m.start(), k, rule.kind, m.end()) for k, r in enumerate(BASE) if r is rule for m in re.finditer(pattern, text or "", re.ASCII) if len(m[rule.group]) >= rule.least]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]

"""Personal data: base expressions, and a linear-chain conditional random field over word shapes for other spellings.

The field labels the words of a document (runs without white space) with the states of KINDS, each a first word or a
later one, or with none. A word has features of its shape; a state is scored by those of the word and of its two
neighbours, and by the state before. Weights come from a small labelled table: (words, tags) rows that `labelled` makes
by rule, or others. Documents are decoded by Viterbi in numpy batches. A decoded run becomes a span if a check of its
kind (digits of a phone, Luhn, modulo 97, ...) finds it well formed, and if it overlaps no base span.

Nearly all words can't be anything: where no state beats none by more than any neighbours could give it, the best path
has none there, exactly. Such words cut the chain, and Viterbi runs over what lies between, for many stretches at once.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.llm.common import text_slices, tidy

#: The kinds with base expressions, in the order of their names, and those that only the field finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: State 0 is none, 1 + 2 k and 2 + 2 k are the first and later words of kind k.
STATES = 1 + 2 * len(KINDS)
#: Bound of the fit: rows of the labelled table that it takes, in order of a hash.
MAX_TRAIN = 4_000
SLICE = 1 << 20
#: Words that a worker keeps the features of; past it they start anew.
MAX_SHAPES = 100_000
#: Longer than any address or number of these kinds may be.
MAX_RUN = 400

# -- base spans

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # a run without points matches too, so that it is passed over at once
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    double = str.maketrans("0123456789", "0246813579")
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(double)))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base expressions' matches that hold, each kind from left to right, in linear time."""
    out = []
    free = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                free = m.end()
    for m in _DOTTED.finditer(text):
        parts = list(_DIGITS.finditer(text, m.start(), m.end()))
        for k in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                out.append((parts[k].start(), 1, parts[k + 3].end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


# -- words and their features

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_PARTS = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_EDGE = ".,;:!?\"'"


def size_of(n: int) -> str:
    return str(n) if n < 6 else "6" if n < 9 else "9" if n < 14 else "14" if n < 20 else "20"


def features(word: str) -> list[str]:
    """The features of a word's shape: runs of digits by their number, of letters by their case, other signs as they are."""
    seen = word if len(word) <= 64 else word[:48] + word[-16:]
    parts = []
    for p in _PARTS.findall(seen):
        if p[0] in "0123456789":
            parts.append("d" + size_of(len(p)))
        elif p.isalpha():
            parts.append("a" if p.islower() else "A" if p.isupper() else "Aa")
        else:
            parts.append(p)
    low = seen.lower()
    found = ["s=" + "".join(parts), "first=" + parts[0], "last=" + parts[-1], "n=" + size_of(sum(map(low.count, "0123456789"))), "letters" if any(map(str.isalpha, seen)) else "none", "w=" + low.strip(_EDGE)]
    found += [f"has={name}" for name, marks in (("@", ("@",)), ("at", ("[at]", "(at)", "{at}", "<at>")), ("dot", ("[dot]", "(dot)", "{dot}", "<dot>")), ("[.]", ("[.]", "(.)")), ("::", ("::",))) if any(m in low for m in marks)]
    found.append("kind=" + re.sub(r"d[0-9]+", "d", found[0][2:]))
    if low.count(":") > 2:
        found.append("colons")
    return found


#: Words of letters alone, by far the most, have the same features if they are of one form and end in the same mark.
FORMS, MARKS = (r"^\p{Ll}+[.,;:!?]?$", r"^\p{Lu}\p{Ll}+[.,;:!?]?$", r"^\p{Lu}+[.,;:!?]?$"), ("", *".,;:!?")
FIXED = 1 + len(FORMS) * len(MARKS)


@dataclass
class Field:
    """Numbers of features; their weights by place (the word, the one before, the one after) and state; weights of neighbouring states."""

    names: dict[str, int]
    weights: np.ndarray
    transition: np.ndarray

    def emission(self, found: list[str]) -> np.ndarray:
        """3 x STATES: what a word of these features gives itself, the word after it and the word before it."""
        at = [self.names[f] for f in found if f in self.names]
        return self.weights[:, at].sum(axis=1)


def best_paths(emission: np.ndarray, transition: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best states of chains end to end, with none (0) before and after each; ties go to the smaller state."""
    n, states = emission.shape
    order = np.argsort(-sizes, kind="stable")
    start, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    score, back = np.zeros((n, states)), np.zeros((n, states), np.int8)
    score[start] = transition[0] + emission[start]
    alive = len(order)
    for t in range(1, int(length[0]) if len(length) else 0):
        while alive and length[alive - 1] <= t:
            alive -= 1
        at = start[:alive] + t
        step = score[at - 1][:, :, None] + transition
        back[at] = step.argmax(axis=1)
        score[at] = step.max(axis=1) + emission[at]
    out = np.zeros(n, np.int8)
    last = start + length - 1
    out[last] = (score[last] + transition[:, 0]).argmax(axis=1)
    for t in range(int(length[0]) - 1 if len(length) else 0, 0, -1):
        alive = int(np.searchsorted(-length, -t, side="left"))  # chains of more than t words
        at = start[:alive] + t
        out[at - 1] = back[at, out[at]]
    return out


def fit(rows: list[tuple[list[str], list[str]]], rounds: int = 80, ridge: float = 5e-5) -> Field:
    """Gradient ascent (Adam) on the likelihood of the tags of (words, tags) rows: `email` begins, `+email` goes on, `` is none.

    Without rows, or with rows that have no tag, the field finds nothing.
    """
    rows = [r for r in rows if len(r[0])]
    states = {"": 0} | {k: 1 + 2 * i for i, k in enumerate(KINDS)} | {"+" + k: 2 + 2 * i for i, k in enumerate(KINDS)}
    found = [[features(w) for w in words] for words, _ in rows]
    count: dict[str, int] = {}
    for f in (f for doc in found for word in doc for f in set(word)):
        count[f] = count.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, c in count.items() if c >= 3))}
    size = len(names)
    if not any(t for _, tags in rows for t in tags):
        return Field({}, np.zeros((3, 0, STATES)), np.zeros((STATES, STATES)))
    longest = max(len(doc) for doc in found)
    x = np.zeros((len(rows), longest, 3 * size), np.float32)
    y = np.zeros((len(rows), longest), np.int64)
    real = np.zeros((len(rows), longest), bool)
    for i, (doc, (_, tags)) in enumerate(zip(found, rows, strict=True)):
        real[i, : len(doc)] = True
        y[i, : len(doc)] = [states[t] for t in tags]
        for t, word in enumerate(doc):
            at = [names[f] for f in word if f in names]
            x[i, t, at] = 1
            if t + 1 < len(doc):
                x[i, t + 1, [size + a for a in at]] = 1
            if t:
                x[i, t - 1, [2 * size + a for a in at]] = 1
    flat = x[real]
    steps = y[real]
    one = np.eye(STATES)
    held = np.zeros((STATES, STATES))
    for row, r in zip(y, real, strict=True):
        path = np.concatenate([[0], row[r], [0]])
        np.add.at(held, (path[:-1], path[1:]), 1)
    total = real.sum()
    wanted = flat.T @ one[steps].astype(np.float32)
    w, v = np.zeros((3 * size, STATES)), np.zeros((STATES, STATES))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    for k in range(1, rounds + 1):
        emit = np.zeros((len(rows), longest, STATES))
        emit[real] = flat @ w.astype(np.float32)
        expected, pairs = _marginals(emit, v, real)
        grads = [(wanted - flat.T @ expected[real].astype(np.float32)) / total - ridge * w, (held - pairs) / total - ridge * v]
        for j, (value, g) in enumerate(zip((w, v), grads, strict=True)):
            m, s = moments[2 * j], moments[2 * j + 1]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            value += 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return Field(names, w.reshape(3, size, STATES).copy(), v)


def _marginals(emit: np.ndarray, transition: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of states (rows x words x STATES) and expected pairs of neighbours, in scaled probabilities."""
    n, longest, _ = emit.shape
    power, move = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(transition)
    forward, scale = np.zeros_like(emit), np.ones((n, longest))
    for t in range(longest):
        f = power[:, t] * (move[0] if t == 0 else forward[:, t - 1] @ move)
        scale[:, t] = f.sum(axis=1)
        forward[:, t] = f / scale[:, t, None]
    length = real.sum(axis=1)
    backward, pairs = np.zeros_like(emit), np.zeros_like(transition)
    last = np.arange(n), length - 1
    ends = forward[last] @ move[:, 0]
    out = np.zeros_like(emit)
    for t in range(longest - 1, -1, -1):
        here = real[:, t]
        final = t == length - 1
        backward[final, t] = move[:, 0] / ends[final, None]
        inner = here & ~final
        if inner.any():
            nxt = power[inner, t + 1] * backward[inner, t + 1] / scale[inner, t + 1, None]
            backward[inner, t] = nxt @ move.T
            pairs += move * (forward[inner, t].T @ nxt)
        out[here, t] = forward[here, t] * backward[here, t]
    first, end = out[:, 0].sum(axis=0), out[last].sum(axis=0)
    pairs[0] += first
    pairs[:, 0] += end
    return out, pairs


# -- the labelled table

def labelled(spark: SparkSession, rows: int = 900, seed: int = 7) -> DataFrame:
    """(words array<string>, tags array<string>): invented sentences with personal data in spellings that the base
    expressions miss, and with numbers, dates and codes that are none; made by rule from a seed."""
    return spark.createDataFrame(sentences(rows, seed), "words array<string>, tags array<string>")


def sentences(rows: int, seed: int) -> list[tuple[list[str], list[str]]]:
    draw = random.Random(seed)
    parts = "an be co de el fi gra hu in jo ka lo mé na ou pra qui ré so tü un vo wha xi yo zu th ion".split()

    def digits(n):
        return "".join(draw.choice("0123456789") for _ in range(n))

    def word(n=3):
        return "".join(draw.choice(parts) for _ in range(draw.randint(1, n)))

    def latin():
        return re.sub("[^a-z]", "e", word())

    def closing(d):
        return d + next(c for c in "0123456789" if luhn(d + c))

    def iban():
        body, country = digits(draw.choice([14, 16, 18])), draw.choice(["DE", "FR", "ES", "GB", "NL"])
        check = 98 - int(body + "".join(str(ord(c) - 55) for c in country) + "00") % 97
        whole = f"{country}{check:02d}{body}"
        return whole if draw.random() < 0.3 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def email():
        a, b = draw.choice(["[]", "()", "{}"])
        gap = draw.choice(["", " ", " "])
        at, dot = f"{gap}{a}at{b}{gap}", draw.choice([".", f"{gap}{a}dot{b}{gap}"])
        return latin() + draw.choice(["", "." + latin(), digits(2)]) + at + latin() + draw.choice(["", digits(1)]) + dot + draw.choice(["com", "org", "net", "fr"])

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return draw.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b} {c}", f"({a}) {b} {c}", f"0{digits(2)}/{b}-{c}"])

    def ip():
        v = [str(draw.randint(0, 255)) for _ in range(4)]
        return draw.choice(["[.]".join(v), "(.)".join(v), ":".join(f"{draw.randint(1, 65535):x}" for _ in range(8)), "2001:db8::" + f"{draw.randint(1, 65535):x}"])

    def card():
        d, s = closing(digits(15)), draw.choice("./_")
        return s.join(d[i : i + 4] for i in range(0, 16, 4))

    make = {"email": email, "ip": ip, "card": card, "phone": phone, "iban": iban, "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"}
    cues = {"email": "mail write contact", "ip": "host server from", "card": "card visa paid", "phone": "call phone tel fax", "iban": "iban account transfer", "ssn": "ssn number"}
    none = [lambda: digits(draw.randint(1, 20)), lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(2)},{digits(2)}", lambda: f"{digits(3)}-{digits(3)}", lambda: f"({digits(4)})", lambda: f"{digits(2)}/{digits(2)}/20{digits(2)}", lambda: "+" + digits(1), lambda: f'"{draw.getrandbits(160):x}"', lambda: f"{latin()}[{digits(1)}]", lambda: f"{latin()}({latin()})", lambda: f"{latin()}@{latin()}", lambda: word().upper(), lambda: word().title(), lambda: "|", lambda: "=", lambda: f"{word()}{draw.choice('#&%$*!')*3}", lambda: f"{digits(1)}.", lambda: f"{digits(2)}%", lambda: f"http://{latin()}.com/{latin()}", lambda: f"{latin()}::{latin()}", lambda: f"{digits(3)} {digits(3)} {digits(3)}"]
    out = []
    for _ in range(rows):
        words: list[str] = []
        tags: list[str] = []
        for _ in range(draw.randint(1, 4)):
            for _ in range(draw.randint(1, 7)):
                words.append(word() + (draw.choice(".,;:!?") if draw.random() < 0.15 else ""))
            if draw.random() < 0.5:
                words += draw.choice(none)().split(" ")
            tags += [""] * (len(words) - len(tags))
            if draw.random() < 0.5:
                kind = draw.choice(KINDS)
                if draw.random() < 0.5:
                    words.append(draw.choice(cues[kind].split()) + draw.choice(["", ":"]))
                    tags.append("")
                pieces = (make[kind]() + (draw.choice(".,;)") if draw.random() < 0.2 else "")).split(" ")
                words += pieces
                tags += [kind] + ["+" + kind] * (len(pieces) - 1)
        out.append((words, tags))
    return out


def train(table: DataFrame) -> Field:
    """The field of a labelled table (words, tags): MAX_TRAIN rows of it at most, in order of a hash."""
    rows = table.select("words", "tags").where(F.size("words") == F.size("tags")).orderBy(F.xxhash64("words", "tags"), "words", "tags").limit(MAX_TRAIN).collect()
    return fit([(list(r["words"]), [t or "" for t in r["tags"]]) for r in rows])


# -- checks of decoded runs

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:\[at\]|\(at\)|\{at\}|<at>)\s?[A-Za-z0-9-]+(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\}|<dot>)\s?[A-Za-z0-9-]+)+", re.I)
_IP4 = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])", re.I)
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])")
_SPLIT_CARD = re.compile(r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}(?:\1[0-9]{2,7}){1,3}(?![0-9])")
_OTHER_PHONE = re.compile(r"(?<![0-9.])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\s./-]{1,2}[0-9]{2,5}){2,4}(?![0-9])|\([0-9]{2,5}\)\s?[0-9]{5,10}(?![0-9])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?!\w)")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def checked(kind: str, text: str) -> tuple[int, int] | None:
    """Where in a decoded run the well-formed part lies; None without one, or in a run of over MAX_RUN characters."""
    m = None
    if len(text) > MAX_RUN:
        return None
    if kind == "email":
        m = _EMAIL.search(text)
    elif kind == "ip":
        m = _IP4.search(text) or _IP6.search(text)
        if m and ":" not in m[0] and any(int(x) > 255 for x in _DIGITS.findall(m[0])):
            m = None
    elif kind == "card":
        m = _SPLIT_CARD.search(text)
        m = m if m and 14 <= len(digits_of(m[0])) <= 19 and luhn(digits_of(m[0])) else None
    elif kind == "phone":
        m = _OTHER_PHONE.search(text)
        m = m if m and 9 <= len(digits_of(m[0])) <= 15 else None
    elif kind == "iban":
        m = _IBAN.search(text)
        if m:
            flat = re.sub(r"\s", "", m[0])
            turned = "".join(str(int(c, 36)) for c in flat[4:] + flat[:4])
            m = m if 15 <= len(flat) <= 34 and int(turned) % 97 == 1 else None
    elif kind == "ssn":
        m = _SSN.search(text)
    return m.span() if m else None


# -- documents

class Decoder:
    """Decodes slices of texts; keeps what words of a shape give, by shape."""

    def __init__(self, field: Field):
        self.field = field
        # Class 0 is the edge of a document, then come the fixed forms, then all other sets of features.
        shown = [form + mark for form in ("qzq", "Qzq", "QZ") for mark in MARKS]
        self.rows = [np.zeros((3, STATES)), *[field.emission([f for f in features(w) if f[:2] != "w="]) for w in shown]]
        self.words: dict[str, int] = {}
        self.sets: dict[tuple, int] = {}
        known = {f[2:] for f in field.names if f.startswith("w=")}
        self.forms = pa.array(sorted(known), pa.string())
        a = field.transition
        # What neighbours can add to a state against none, whatever they are.
        self.gain = (a - a[:, :1]).max(axis=0) + (a - a[:1]).max(axis=1)
        fixed = np.stack(self.rows)
        cube = fixed[:, 1][:, None, None] + fixed[:, 0][None, :, None] + fixed[:, 2][None, None]
        #: By classes of the word before, the word and the word after: that it is none whatever its neighbours are.
        self.plain = self.sure(cube.reshape(-1, STATES)).reshape(FIXED, FIXED, FIXED)

    def classes(self, names: pa.Array) -> np.ndarray:
        """The class of each distinct word."""
        if len(self.words) > MAX_SHAPES:
            self.words, self.sets, self.rows = {}, {}, self.rows[:FIXED]
        mark = np.asarray(pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(names, -1), pa.array(MARKS[1:])), -1)).astype(np.int64) + 1
        out = np.zeros(len(names), np.int64)
        for k, form in enumerate(FORMS):
            out = np.where((out == 0) & np.asarray(pc.match_substring_regex(names, form)), 1 + k * len(MARKS) + mark, out)
        if len(self.forms):
            out[np.asarray(pc.is_in(pc.utf8_lower(pc.utf8_rtrim(names, _EDGE)), self.forms))] = 0
        rest = np.flatnonzero(out == 0)
        for i, word in zip(rest.tolist(), names.take(pa.array(rest)).to_pylist(), strict=True):
            code = self.words.get(word)
            if code is None:
                found = tuple(f for f in features(word) if f in self.field.names)
                code = self.sets.get(found)
                if code is None:
                    code = self.sets[found] = len(self.rows)
                    self.rows.append(self.field.emission(list(found)))
                self.words[word] = code
            out[i] = code
        return out

    def runs(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the decoded runs of each text, in code points."""
        whole = "\n".join(texts).encode("utf-8", "replace")
        edge = np.diff(np.concatenate([[0], (~_WHITE[np.frombuffer(whole, np.uint8)]).view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(start):
            return out
        bounds = np.empty(2 * len(start) + 1, np.int64)
        bounds[0:-1:2], bounds[1::2], bounds[-1] = start, end, len(whole)
        both = pa.Array.from_buffers(pa.large_utf8(), 2 * len(start), [None, pa.py_buffer(bounds), pa.py_buffer(whole)])
        words = both.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
        cls = self.classes(words.dictionary.cast(pa.string()))[np.asarray(words.indices)]
        sizes = np.array([len(t.encode("utf-8", "replace")) for t in texts], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        doc = np.searchsorted(begin, start, side="right") - 1
        table = np.stack(self.rows)
        edge = np.concatenate([[True], doc[1:] != doc[:-1], [True]])
        before, after = np.append(0, cls[:-1]), np.append(cls[1:], 0)
        before[edge[:-1]] = 0
        after[edge[1:]] = 0
        fixed = (cls < FIXED) & (before < FIXED) & (after < FIXED)
        fixed[fixed] = self.plain[before[fixed], cls[fixed], after[fixed]]
        look = np.flatnonzero(~fixed)
        emission = table[cls[look], 0] + table[before[look], 1] + table[after[look], 2]
        open_ = ~self.sure(emission)
        at, emission = look[open_], emission[open_]
        if not len(at):
            return out
        fresh = np.concatenate([[True], (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])])
        lengths = np.diff(np.append(np.flatnonzero(fresh), len(at)))
        states = best_paths(emission, self.field.transition, lengths)
        kind = (states.astype(int) - 1) // 2
        # A run goes on with later words of its kind; anything else begins anew.
        begins = (states > 0) & (fresh | (states % 2 == 1) | np.append(True, kind[1:] != kind[:-1]) | np.append(True, states[:-1] == 0))
        inside = np.flatnonzero(states > 0)
        group = np.cumsum(begins)[inside]
        for g in np.split(inside, np.flatnonzero(np.diff(group)) + 1) if len(inside) else []:
            d = int(doc[at[g[0]]])
            a, b = int(start[at[g[0]]]), int(end[at[g[-1]]])
            skip = len(whole[begin[d] : a].decode("utf-8", "replace"))
            out[d].append((skip, skip + len(whole[a:b].decode("utf-8", "replace")), KINDS[kind[g[0]]]))
        return out

    def sure(self, emission: np.ndarray) -> np.ndarray:
        """Words whose best state is none, whatever states their neighbours have."""
        return (emission[:, 1:] + self.gain[1:]).max(axis=1) < emission[:, 0] + self.gain[0] - 1e-9


def spans(decoder: Decoder, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """(start, rank of the kind, end, base) of each text, in order."""
    out = []
    for text, runs in zip(texts, decoder.runs(texts), strict=True):
        base = base_spans(text)
        rows = [(s, k, e, True) for s, k, e in base]
        for s, e, kind in runs:
            if kind == "email" and text[s] in "[({<":  # the name before a mark is any word: it belongs to the address
                s = max(text.rfind(c, max(0, s - MAX_RUN), max(0, s - 1)) for c in " \t\n") + 1
            found = checked(kind, text[s:e])
            if found and not any(x < s + found[1] and s + found[0] < y for x, _, y in base):
                rows.append((s + found[0], KINDS.index(kind), s + found[1], False))
        out.append(sorted(rows))
    return out


def listed(rows: list[tuple[int, int, int, bool]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in rows)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind, base>>) of every row, over its whole text, in code points.

    A null or empty text has no spans; repeated rows get equal spans, null ids stay null, an empty table gives no rows,
    other columns are not read. One narrow pass without a shuffle.
    """

    def run(batches):
        decoder = Decoder(field)
        for keys, texts in text_slices(batches, SLICE):
            found = [[{"start": s, "end": e, "kind": KINDS[k], "base": b} for s, k, e, b in rows] for rows in spans(decoder, texts)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "doc_id long, spans array<struct<start:int,end:int,kind:string,base:boolean>>")


def mask(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row with each span replaced by its kind in brackets; overlapping spans as one, by the first."""

    def run(batches):
        decoder = Decoder(field)
        for keys, texts in text_slices(batches, SLICE):
            new = []
            for text, rows in zip(texts, spans(decoder, texts), strict=True):
                parts, at = [], 0
                for s, k, e, _ in rows:
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                new.append("".join([*parts, text[at:]]))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(new, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "doc_id long, text string")


def digest(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): the base spans counted and hashed, all of them listed."""

    def run(batches):
        decoder = Decoder(field)
        for keys, texts in text_slices(batches, SLICE):
            found = spans(decoder, texts)
            base = [[r for r in rows if r[3]] for rows in found]
            counts = [pa.array([sum(r[1] == k for r in rows) for rows in base], pa.int64()) for k in range(len(BASE))]
            hashes = pa.array([sha256(listed(rows).encode()).hexdigest() for rows in base], pa.string())
            yield pa.record_batch([pa.array(keys, pa.int64()), *counts, hashes, pa.array(map(listed, found), pa.string())], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    columns = "".join(f"n_{k} long, " for k in BASE)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), f"doc_id long, {columns}base_sha256 string, spans string")
